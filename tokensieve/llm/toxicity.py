"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM (operator 5).

Two words are alike as far as they share subsequences of four characters, gaps allowed; a gap costs a factor for each
character skipped, and a subsequence spans at most SPAN characters. So ``i.d-i-o.t`` still
resembles ``idiot``. Words carry a start and an end mark; runs of single letters, with spaces or marks between them, are read as one
word. The kernel is divided by the norms that words of these lengths have.

Labels are given for whole texts, so training is by multiple instances: a text counts by its
most suspicious word. Each round picks that word in every toxic text, maps the words onto the
landmarks (K(w, L) K(L, L)^-1/2), fits a squared-hinge SVM against words of clean texts, and
looks again. A logistic curve on texts that the SVM has not seen turns margins into scores.
The fitted function is a weight for each subsequence of a landmark, so scoring a word costs time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokensieve.llm.common import bounded_batches

SPAN = 7
DECAY = 0.6
OFFSETS = [(a, b, c) for a, b, c in combinations(range(1, SPAN), 3)]
PAD = SPAN - 1
#: The classifier is fitted on at most so many labelled texts of each label, those with the lowest hashes.
MAX_TOXIC, MAX_CLEAN = 1200, 2400
LANDMARKS, ALPHABET, ROUNDS, MAX_NEGATIVE = 128, 56, 3, 12_000
THRESHOLD = 0.3
CACHE = 400_000
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"
SPELLED = re.compile(r"(?:(?<!\S)\w[^\w\s]?(?!\S)\s*){3,}|(?<!\w)(?:\w[^\w\s]+){2,}\w(?!\w)")


def words(text: str) -> list[str]:
    """The distinct raw words of a text, lower-cased, and its spelled-out runs joined up, in order of first sight."""
    low = text.lower()
    out = dict.fromkeys(low.split())
    for run in SPELLED.findall(low):
        out["".join(re.findall(r"\w", run))] = None
    return list(out)


def core(word: str) -> str:
    return word.strip(EDGE)


def coded(cores: list[str], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, lengths): marked words one after another, zeros between; code 0 stands for no known character."""
    joined = "".join(["\x02" + w + "\x03" + "\x00" * PAD for w in cores])
    codes = lut[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter((len(w) + 2 for w in cores), np.int64, len(cores))
    starts = np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]]).astype(np.int64) if len(cores) else np.empty(0, np.int64)
    return codes, starts, lengths


def norms(lengths: np.ndarray) -> np.ndarray:
    total = np.zeros(len(lengths))
    for _, _, c in OFFSETS:
        total += DECAY ** (2 * (c - 3)) * np.maximum(0, lengths - c)
    return np.sqrt(np.maximum(total, 1e-9))


def alphabet(cores: list[str]) -> np.ndarray:
    """char -> code: the ALPHABET - 3 most frequent characters have codes of their own."""
    seen: dict[str, int] = {}
    for w in cores:
        for ch in w:
            seen[ch] = seen.get(ch, 0) + 1
    lut = np.zeros(0x110000, np.uint8)
    lut[2], lut[3] = 1, 2
    for i, ch in enumerate(sorted(seen, key=lambda ch: (-seen[ch], ch))[: ALPHABET - 3]):
        lut[ord(ch)] = i + 3
    return lut


def features(cores: list[str], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence, value) triples of normalized words."""
    codes, starts, lengths = coded(cores, lut)
    x = np.concatenate([codes, np.zeros(SPAN, np.uint8)]).astype(np.int64)
    n = len(codes)
    owner = np.repeat(np.arange(len(cores)), lengths + PAD)
    who, what, value = [], [], []
    for a, b, c in OFFSETS:
        p, q, r, s = x[:n], x[a : n + a], x[b : n + b], x[c : n + c]
        ok = (p > 0) & (q > 0) & (r > 0) & (s > 0)
        who.append(owner[ok])
        what.append((((p * ALPHABET + q) * ALPHABET + r) * ALPHABET + s)[ok])
        value.append(np.full(int(ok.sum()), DECAY ** (c - 3)))
    who, what, value = np.concatenate(who), np.concatenate(what), np.concatenate(value)
    return who, what, value / norms(lengths)[who]


def gram(cores: list[str], keys: np.ndarray, phi: np.ndarray, lut: np.ndarray) -> np.ndarray:
    """K(words, landmarks); phi has a row for each of the landmarks' subsequences, whose sorted codes are keys."""
    out = np.zeros((len(cores), phi.shape[1]))
    for lo in range(0, len(cores), 200):
        who, what, value = features(cores[lo : lo + 200], lut)
        at = np.minimum(np.searchsorted(keys, what), len(keys) - 1)
        ok = keys[at] == what
        np.add.at(out, lo + who[ok], phi[at[ok]] * value[ok, None])
    return out


def fit_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0) -> np.ndarray:
    """Squared-hinge SVM by Newton steps; the last coefficient is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    v = np.zeros(z.shape[1])
    for _ in range(25):
        slack = 1 - y * (z @ v)
        on = slack > 0
        za, wa = z[on], weight[on]
        grad = v - 2 * c * (za.T @ (wa * y[on] * slack[on]))
        step = np.linalg.solve(np.eye(len(v)) + 2 * c * (za.T * wa) @ za, grad)
        v = v - step
        if np.abs(step).max() < 1e-6:
            break
    return v


def fit_logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """P(y) = 1 / (1 + exp(-(a m + b))), with weak priors on both."""
    t = np.zeros(2)
    x = np.stack([m, np.ones(len(m))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad = x.T @ (p - y) + 0.02 * t
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.02 * np.eye(2), grad)
        t = t - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(t[0], 0.0)), float(t[1])


@dataclass
class Model:
    """Weights of subsequences, the alphabet, the margin's bias and the curve's two numbers."""

    keys: np.ndarray
    weights: np.ndarray
    chars: dict[str, int]
    bias: float
    slope: float
    offset: float
    _table: np.ndarray | None = None
    _lut: np.ndarray | None = None

    def margins(self, cores: list[str]) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(ALPHABET**4, np.float32)
            self._table[self.keys] = self.weights
            self._lut = np.zeros(0x110000, np.uint8)
            self._lut[2], self._lut[3] = 1, 2
            for ch, i in self.chars.items():
                self._lut[ord(ch)] = i
        if not cores:
            return np.empty(0)
        codes, starts, lengths = coded(cores, self._lut)
        n = len(codes)
        x = np.concatenate([codes, np.zeros(SPAN, np.uint8)]).astype(np.int32)
        x3, x2, x1 = x * ALPHABET**3, x * ALPHABET**2, x * ALPHABET
        total = np.zeros(n, np.float32)
        for a, b, c in OFFSETS:
            total += np.float32(DECAY ** (c - 3)) * self._table[x3[:n] + x2[a : n + a] + x1[b : n + b] + x[c : n + c]]
        return np.add.reduceat(total.astype(np.float64), starts) / norms(lengths) + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, d):
        self.__dict__ |= d | {"_table": None, "_lut": None}


def fit(texts: list[list[str]], labels: list[int]) -> Model:
    """Fit on the distinct words of each text; the list is emptied on the way. Without toxic or without clean texts every score is the share of toxic labels, without labels 0."""
    y = np.array(labels, float)
    none = Model(np.empty(0, np.int64), np.empty(0), {}, 0.0, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -30.0)
    if not len(y) or y.min() == y.max():
        return none
    number: dict[str, int] = {}
    docs = []
    for i, ws in enumerate(texts):  # the words go as they are numbered
        docs.append(np.array(sorted({number.setdefault(c, len(number)) for c in map(core, ws) if c}), np.int32))
        texts[i] = None
    cores = list(number)
    del number
    hold = np.array([i % 10 >= 7 for i in range(len(y))])
    for v in (0, 1):  # both parts need both labels
        own = np.flatnonzero(y == v)
        hold[own] = np.arange(len(own)) % 10 >= 7
    train = np.flatnonzero(~hold)

    # First suspects: runs of four characters that toxic texts have and clean ones lack.
    lut = np.zeros(0x110000, np.uint8)
    codes, starts, lengths = coded([c if c else " " for c in cores], lut)
    raw = "".join(["\x02" + c + "\x03" + "\x00" * PAD for c in cores])
    u = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = np.zeros(len(u), np.uint64)
    for i in range(4):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([u[i:], np.zeros(i, np.uint64)])
    grams, inverse = np.unique(mixed, return_inverse=True)
    inverse = inverse.astype(np.int32)
    del raw, u, mixed, codes
    pos, neg = np.zeros(len(grams)), np.zeros(len(grams))
    spans = [inverse[s : s + max(n - 3, 1)] for s, n in zip(starts, lengths, strict=True)]
    for i in train:
        if len(docs[i]):
            (pos if y[i] else neg)[np.unique(np.concatenate([spans[w] for w in docs[i]]))] += 1
    n_pos, n_neg = max(1, y[train].sum()), max(1, (1 - y[train]).sum())
    odds = np.log((pos + 0.2) / (n_pos + 0.4)) - np.log((neg + 0.5) / (n_neg + 1.0))
    odds[pos < max(3.0, 0.01 * n_pos)] = -9.0
    suspect = np.array([odds[s].max() for s in spans])
    del spans, inverse, grams, pos, neg, odds
    margin = suspect - 2.5
    able = suspect > 2.5  # only these may stand for a toxic text, in every round

    df_neg = np.zeros(len(cores))
    for i in train[y[train] == 0]:
        df_neg[docs[i]] += 1
    rng = np.random.default_rng(7)
    clean = np.flatnonzero(df_neg > 0)
    model = none
    for _ in range(ROUNDS):
        witnesses = []
        for d in (docs[i][able[docs[i]]] for i in train[y[train] == 1]):
            if len(d):
                witnesses.append(d[[np.argmax(margin[d])]])
        witnesses = np.concatenate(witnesses) if witnesses else np.empty(0, np.int64)
        witnesses = witnesses[df_neg[witnesses] <= 0.002 * n_neg]
        if not len(witnesses) or not len(clean):
            return none
        hard = clean[np.argsort(-margin[clean])[: MAX_NEGATIVE // 2]]
        rest = np.setdiff1d(clean, hard)
        negative = np.concatenate([hard, rng.permutation(rest)[: MAX_NEGATIVE // 2]])
        distinct, counts = np.unique(witnesses, return_counts=True)
        top = distinct[np.argsort(-counts, kind="stable")]
        marks = [cores[w] for w in np.concatenate([top[: LANDMARKS * 5 // 8], hard[: LANDMARKS // 8], rng.permutation(rest)[: LANDMARKS // 4]])]
        lut = alphabet(marks)
        who, what, value = features(marks, lut)
        if not len(what):
            return none
        keys, at = np.unique(what, return_inverse=True)
        phi = np.zeros((len(keys), len(marks)))
        np.add.at(phi, (at, who), value)
        lam, vec = np.linalg.eigh(phi.T @ phi)
        root = (vec / np.sqrt(np.maximum(lam, 1e-6))) @ vec.T
        z = np.vstack([gram([cores[w] for w in distinct], keys, phi, lut), gram([cores[w] for w in negative], keys, phi, lut)]) @ root
        label = np.concatenate([np.ones(len(distinct)), -np.ones(len(negative))])
        weight = np.concatenate([counts / counts.sum(), np.full(len(negative), 1 / len(negative))]) * len(label) / 8
        v = fit_svm(z, label, weight)
        chars = {chr(i): int(lut[i]) for i in np.flatnonzero(lut) if i not in (2, 3)}
        model = Model(keys, phi @ (root @ v[:-1]), chars, float(v[-1]), 1.0, 0.0)
        margin = np.concatenate([model.margins(cores[lo : lo + 20_000]) for lo in range(0, len(cores), 20_000)])
    least = model.bias
    m = np.array([margin[d].max() if len(d) else least for d in docs])
    model.slope, model.offset = fit_logistic(m[hold], y[hold])
    return model


def train(docs: DataFrame, labels: DataFrame, learn=None) -> Model:
    """Fit on a bounded sample of the labelled documents.

    learn is a condition on ``doc_id`` that labelled rows must meet. Null labels are left out; a doc_id that is labelled
    twice counts as toxic if one label says so. At most MAX_TOXIC + MAX_CLEAN rows reach the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = (known.where(learn) if learn is not None else known).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [words(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "words": pa.array(ws, pa.list_(pa.string()))})

    got = rows.mapInArrow(run, "doc_id long, toxic int, words array<string>").toArrow().combine_chunks().sort_by("doc_id")
    texts = [x.as_py() for x in got.column("words")]
    return fit(texts, got.column("toxic").to_pylist())


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text; a null or empty text has the score of a word without any known part.

    All columns are kept; a column that has the new one's name already is replaced. Map-only.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            sets = [words(t or "") for t in b.column("text").to_pylist()]
            new = list({w for s in sets for w in s if w not in known})
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                known.update(zip(part, model.margins([core(w) for w in part]).tolist(), strict=True))
            least = model.bias
            out = [model.score(max(map(known.__getitem__, s), default=least)) for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])
            if len(known) > CACHE:
                known = {}

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id=None):
    """The contract's fold: crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 4 == 2
