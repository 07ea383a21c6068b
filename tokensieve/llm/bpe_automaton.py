"""BPE encoding and decoding with a tokenization automaton (operator 3).

The merges are compiled, in rank order, by merge gadgets. The automaton's arcs are tokens, and the state after a token
says which may not come next. It starts with the single bytes, all arcs in place. The gadget of merge ``u v -> w`` redirects every u-arc to a
copy of its target that lacks the v-arc, and adds a w-arc beside each u-arc that leads where the v-arc led. So the state of w is a copy of v's as it was then, and
a w-arc stands where u's stood. The compiled tables hold just that: ``copied`` and ``until``, the state that each state is a copy of
and when it was taken; ``beside`` and ``made``, the arc that each arc was put beside and when; ``removed``, the arcs that gadgets took from states, and
when; ``dead``, tokens whose arcs stand nowhere. A transition is looked up in them, and kept in a table of its own.

The automaton accepts exactly one token path for each byte string, and every prefix of a path is the path of a prefix. So each
prefix of a pre-split word has one state, its last token: that of which the arc leaves the state of the prefix before it. Encoding
fills in the states from the word's end, each once, and reads the path off; decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensieve.llm.common import bounded_batches

#: The pre-tokenizer's public pattern for byte-level BPE.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that re and the pattern's \s see differently; texts with them are not cut into pieces first.
ODD_SPACE = re.compile("[\x1c-\x1f\x85᠎]")
PIECE = re.compile(r"\s*\S+|\s+$")
#: Entries that a worker keeps; the table starts anew beyond it, so memory stays bounded.
CACHE = 400_000
#: Bytes of a token's end that tell how long a token can be.
TAIL = 5


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by the public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return out


class MergeAutomaton:
    """The automaton of a merge list; tokens are given as bytes."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocab = vocab
        self.labels = {i: b for b, i in vocab.items()}
        self.size = max(vocab.values(), default=-1) + 2
        self.start = self.size - 1  # the state before any token; it lacks no arc
        never = len(merges)
        self.copied, self.until = [-1] * self.size, [never] * self.size
        self.beside, self.made = [-1] * self.size, [never] * self.size
        self.removed: dict[int, int] = {}
        self.dead = bytearray(self.size)
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.table: dict[int, bool] = {}  # state * size + token -> whether the arc stands
        self.tails: dict[bytes, int] = {}  # last TAIL bytes -> length of the longest token that ends so
        for t in vocab:
            if len(t) >= TAIL:
                self.tails[t[-TAIL:]] = max(len(t), self.tails.get(t[-TAIL:], 0))

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """Apply the gadget of the merge u v -> w."""
        if self.beside[w] < 0:  # a token that two merges make has the arcs of the first
            self.dead[w] = self.dead[u] or self.dead[v] or self._lacks(u, v, rank)
            self.beside[w], self.made[w], self.copied[w], self.until[w] = u, rank, v, rank
        self.removed.setdefault(u * self.size + v, rank)

    def _lacks(self, state: int, token: int, now: int) -> bool:
        """Whether a state lacks a token's arc after the gadgets before ``now``."""
        removed, copied, until, size = self.removed, self.copied, self.until, self.size
        arc, stood = token, now - 1
        while arc >= 0:  # the arc stands where the one beside it stood when it was made
            of, taken = state, now
            while of >= 0:  # the state lacks what the state it copies lacked when the copy was taken
                r = removed.get(of * size + arc)
                if r is not None and r < taken and r <= stood:
                    return True
                taken = min(taken, until[of])
                of = copied[of]
            stood = min(stood, self.made[arc])
            arc = self.beside[arc]
        return False

    def arc(self, state: int, token: int) -> bool:
        """Whether a token's arc leaves a state."""
        key = state * self.size + token
        got = self.table.get(key)
        if got is None:
            if len(self.table) > 4 * CACHE:
                self.table.clear()
            got = self.table[key] = not self.dead[token] and (state == self.start or not self._lacks(state, token, 1 << 60))
        return got

    def encode(self, word: bytes) -> list[int]:
        """The token path of a pre-split word."""
        vocab, table, tails, size, n = self.vocab, self.table, self.tails, self.size, len(word)
        state: list[int] = [-1] * n + [-1]
        state[0] = self.start
        todo = [(n, min(tails.get(word[-TAIL:], TAIL - 1), n))] if n else []
        while todo:
            end, length = todo.pop()
            while length:
                w = vocab.get(word[end - length : end])
                if w is not None:
                    before = state[end - length]
                    if before < 0:  # that prefix comes first
                        at = end - length
                        todo.append((end, length))
                        todo.append((at, min(tails.get(word[max(at - TAIL, 0) : at], TAIL - 1), at)))
                        break
                    ok = table.get(before * size + w)
                    if ok is None:
                        ok = self.arc(before, w)
                    if ok:
                        state[end] = w
                        break
                length -= 1
            else:
                raise ValueError("no token path: the vocabulary lacks a byte")
        path, end = [], n
        while end:
            path.append(state[end])
            end -= len(self.labels[state[end]])
        return path[::-1]


class Codec:
    """Encoder and decoder of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(vocab, merges)
        self.labels = {str(i): b for i, b in self.automaton.labels.items()} | {str(i): t.encode() for t, i in self.added.items()}
        self.pre = regex.compile(PRE_SPLIT)
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known: dict[str, str] = {}

    def _piece(self, piece: str) -> str:
        encode = self.automaton.encode
        return ",".join(str(i) for w in self.pre.findall(piece) for i in encode(w.encode("utf-8")))

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        if ODD_SPACE.search(text):
            return [self._piece(text)]
        pieces, known = PIECE.findall(text), self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            out = []
            for p in pieces:
                got = known.get(p)
                if got is None:
                    got = self._piece(p)
                    if len(p) <= 64:
                        known[p] = got
                out.append(got)
            return out

    def encode(self, text: str) -> str:
        """The ids of a text, in decimal, joined by commas."""
        if self.special is None or not any(t in text for t in self.added):
            return ",".join(self._plain(text))
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [str(self.added[part])] if i % 2 else self._plain(part)
        return ",".join(out)

    def decode(self, ids: str) -> str:
        return b"".join(map(self.labels.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids.

    A null text counts as empty: no tokens, the digests of the empty string. Every row yields a row, equal rows
    too; a null doc_id stays null; other columns are ignored. Map-only: nothing is shuffled.
    """
    path = path or default_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            ids = [c.encode(t) for t in texts]
            out = {
                "doc_id": b.column("doc_id"),
                "n_tokens": pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(c.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
            }
            if keep_ids:
                out["ids"] = pa.array([[int(i) for i in x.split(",")] if x else [] for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from (doc_id, ids array<int>); null ids decode to the empty text."""
    path = path or default_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(",".join(map(str, x or []))) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
