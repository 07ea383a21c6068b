"""Token ids as directly addressable codes (operator 2).

An id is cut into chunks of ``width`` bits. Level 0 holds the lowest chunk of every id, level l
the l-th chunk of those ids that need it. A continuation bitmap beside each level says whose id goes on, and
a rank directory, one count for each 512 bits, tells in constant time where on the next level it
goes on. So any token is read by one lookup a level; no block is decoded.

A shard file: the magic, the length of a JSON header, the header, then the documents' ids and offsets
and, for each level, chunks, bitmap and directory, at the places that the header names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.llm.common import bounded_batches, materialize, new_path, partitions
from tokensieve.llm.files import committed, open_fs

MAGIC = b"DACSHRD1"
BLOCK = 512
#: Characters that the library and str.split see differently; a text with one is encoded in one piece.
ODD_SPACE = re.compile("[\x1c-\x1f᠎]")
#: Those, characters that str.lower and the library may fold differently, and what special tokens begin with.
ODD = re.compile("[\x1c-\x1f᠎İΣ]|<\\||[^\x00-\u024f\u0370-\u04ff\u2010-\u2027]")
#: Words that the pre-tokenizer keeps whole.
PLAIN = re.compile("[a-zà-öø-ÿ]+").fullmatch
#: What may follow them as a piece of its own.
STOPS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
STOPPED = re.compile(f"([a-zà-öø-ÿ]+)([{re.escape(STOPS)}]+)").fullmatch
#: Entries that a worker keeps of piece -> ids.
CACHE = 1_200_000


def pack(ids: np.ndarray, width: int = 8) -> list[dict[str, np.ndarray]]:
    """The levels of an array of unsigned ids."""
    levels, rest, dtype = [], ids.astype(np.uint64), np.uint8 if width <= 8 else np.uint16
    while True:
        more = (rest >> np.uint64(width)) > 0
        bits = np.packbits(more, bitorder="little")
        padded = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([[np.uint64(0)], np.cumsum(ones, dtype=np.uint64)]).astype(np.uint64)
        levels.append({"chunks": (rest & np.uint64((1 << width) - 1)).astype(dtype), "bits": padded, "rank": directory})
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(width)


def dump(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, width: int = 8) -> bytes:
    """A shard file of documents that follow one another."""
    arrays = [
        ("doc_id", np.array([0 if d is None else d for d in doc_ids], np.int64)),
        ("no_id", np.array([d is None for d in doc_ids], np.uint8)),
        ("offset", np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int64)),
    ]
    levels = pack(ids, width)
    for i, level in enumerate(levels):
        arrays += [(f"{k}{i}", v) for k, v in level.items()]
    at, places = 0, {}
    for name, a in arrays:
        places[name] = [at, len(a), a.dtype.str]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"width": width, "levels": len(levels), "tokens": len(ids), "at": places}).encode()
    body = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for _, a in arrays)
    return MAGIC + struct.pack("<Q", len(head)) + head + body


class Shard:
    """A shard in memory (or memory-mapped): token(k) and slice(a, b) without decoding anything else."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        size = struct.unpack("<Q", data[8:16])[0]
        head = json.loads(bytes(data[16 : 16 + size]))
        self.width, self.n_levels, self.tokens = head["width"], head["levels"], head["tokens"]
        get = lambda name: np.frombuffer(data, dtype=np.dtype(p[2]), count=p[1], offset=16 + size + p[0]) if (p := head["at"][name])[1] else np.empty(0, p[2])
        self.doc_ids = [None if no else int(d) for d, no in zip(get("doc_id"), get("no_id"), strict=True)]
        self.offset = get("offset")
        self.chunks, self.bits, self.rank = ([get(f"{k}{i}") for i in range(self.n_levels)] for k in ("chunks", "bits", "rank"))

    def _rank(self, level: int, k: int) -> int:
        """Set bits before bit k."""
        block, bits = k // BLOCK, self.bits[level]
        ones = int(self.rank[level][block]) + int(np.bitwise_count(bits[block * BLOCK // 8 : k // 8]).sum())
        return ones + (int(bits[k // 8]) & ((1 << k % 8) - 1)).bit_count() if k % 8 else ones

    def token(self, k: int) -> int:
        """The k-th id of the shard."""
        if not 0 <= k < self.tokens:
            raise IndexError(k)
        value, level = 0, 0
        while True:
            value |= int(self.chunks[level][k]) << (self.width * level)
            if not self.bits[level][k // 8] >> k % 8 & 1:
                return value
            k, level = self._rank(level, k), level + 1

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1, read from where they lie."""
        out = np.zeros(b - a, np.uint32)
        where = slice(None)
        for level in range(self.n_levels):
            if a >= b:
                break
            part = self.chunks[level][a:b].astype(np.uint32) << np.uint32(self.width * level)
            out[where] |= part
            more = np.unpackbits(self.bits[level][a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where = np.arange(b - a)[more] if level == 0 else where[more]
            a, b = self._rank(level, a), self._rank(level, b)
        return out


def odd(text: str) -> bool:
    """Whether ODD finds anything; the scan is spared for texts in Latin-1."""
    if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return True
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return ODD.search(text) is not None


class PieceEncoder:
    """Encodes with the tokenizers library, each distinct piece between white space once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.known: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        one = lambda s: self.lib.encode(s, add_special_tokens=False).ids
        self.folds = one("ABC ÀÉ Thé") == one("abc àé thé")
        # plain words that are folded already need no normalizer and no pattern
        from tokenizers import normalizers, pre_tokenizers

        self.words = Tokenizer.from_file(path)
        self.words.no_truncation()
        self.words.no_padding()
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "thé abcdefghij straße ça zzzyx"
        if not self.folds or self.words.encode(probe, add_special_tokens=False).ids != one(probe):
            self.words = self.lib

    def _learn(self, new: set[str]) -> None:
        """Enter pieces. Words of plain letters share calls of the library; each ends with a token that is marked as a word's end.

        The pre-tokenizer cuts a plain word from the stops that follow it, so both are looked up by themselves.
        """
        known, tailed, plain, rest = self.known, [], set(), []
        for p in new:
            w = p.rstrip(STOPS)
            if w.isascii() and w.isalpha() and w.islower():
                plain.add(w)
                if w != p:
                    tailed.append((p, w, p[len(w) :]))
            elif m := STOPPED(p):
                tailed.append((p, *m.groups()))
                plain.add(m[1])
            elif PLAIN(p):
                plain.add(p)
            else:
                rest.append(p)
        words = [w for w in plain if w not in known]
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            else:
                rest += part
        stops = {x[2] for x in tailed} - self.stops.keys()
        for into, keys in ((known, rest), (self.stops, list(stops))):
            into.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(keys, self.lib.encode_batch_fast(keys, add_special_tokens=False), strict=True))
        for p, word, stop in tailed:
            known[p] = known[word] + self.stops[stop]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE:
            self.known = dict(islice(self.known.items(), CACHE // 4))  # what is met first is what is met often
        if len(self.stops) > CACHE:
            self.stops = {}
        known, get = self.known, self.known.get
        rows, new = [], set()
        for t in texts:
            if odd(t):
                x = [t] if ODD_SPACE.search(t) else t.split()
            else:
                x = (t.lower() if self.folds else t).split()
            v = list(map(get, x))
            gaps = []
            for _ in range(v.count(None)):
                i = v.index(None, gaps[-1][0] + 1 if gaps else 0)
                gaps.append((i, x[i]))
            new.update([p for _, p in gaps])
            rows.append((v, gaps))
        self._learn(new)
        out = []
        for v, gaps in rows:
            for i, p in gaps:
                v[i] = known[p]
            out.append(b"".join(v))
        for p in [p for p in new if len(p) > 64]:
            del known[p]
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2, folder: str | None = None, width: int = 8, shard_tokens: int = 4_000_000) -> DataFrame:
    """Tokenize the documents and write them, in ascending doc_id order, as shard files.

    Returns the manifest: part, number, file, n_docs, n_tokens; ordering by (part, number) gives the order of the
    documents. A null text is empty and yields just end_id; a null doc_id sorts first; equal doc_ids sort by text;
    no rows make no shard. Texts are shuffled once, by ranges of doc_id; a task holds one shard at a time.
    """
    spark = docs.sparkSession
    path, folder = path or default_path(), folder or new_path(spark, "dac")
    bounded_batches(spark, 256)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(path) or _ENCODERS.setdefault(path, PieceEncoder(path))
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = dump(doc_ids, [len(x) // 4 for x in held], np.frombuffer(b"".join(held), "<u4"), width)
            with committed(folder, ".dac") as (out, name):
                out.write(data)
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "file": name, "n_docs": len(held), "n_tokens": size}], schema)

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                doc_ids.append(d)
                held.append(x + end)
                size += len(x) // 4 + 1
                if size >= shard_tokens:
                    yield flush()
                    doc_ids, held, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "part int, number int, file string, n_docs long, n_tokens long"), "dac-manifest")


def read_tokens(manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of each document, read back from the shard files.

    start counts the ids of all documents before it; its window runs over the manifest, a row a shard.
    """
    bounded_batches(manifest.sparkSession)
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, p = open_fs(name)
                with fs.open_input_file(p) as f:
                    shard = Shard(f.read())
                for lo in range(0, len(shard.doc_ids), 256):
                    spans = list(zip(shard.offset[lo : lo + 256].tolist(), shard.offset[lo + 1 : lo + 257].tolist(), strict=False))
                    first = spans[0][0]
                    part = shard.slice(first, spans[-1][1]).astype("<u4", copy=False)
                    ids = [part[s - first : e - first] for s, e in spans]
                    out = {
                        "doc_id": pa.array(shard.doc_ids[lo : lo + 256], pa.int64()),
                        "start": pa.array([base + s for s, _ in spans], pa.int64()),
                        "n_tokens": pa.array([e - s for s, e in spans], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    }
                    if keep_ids:
                        out["ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return placed.select("file", "base").repartition(partitions(manifest.sparkSession)).mapInArrow(run, schema)
