"""Near-duplicate embeddings by spherical-cap filters (operator 8).

A filter is a direction on the sphere; a vector passes it when it lies in the cap around it. The directions are a
structured random product code: the rotated space is cut into blocks, each block has a small random code, and
every combination of code words is a direction. So all directions whose caps hold a vector are listed block by
block with bounds, without looking at the others. Vectors are joined on the filters they pass, and every pair
that meets is verified by its cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokensieve.llm.common import bounded_batches, components, join_hot, materialize, partitions, release

THRESHOLD = 0.95
#: Vectors that a filter should hold on average, and how many filters a vector should pass.
PER_FILTER, PASSED = 24, 14
#: Where the caps lie thin, a vector passes this many of the nearest filters all the same.
AT_LEAST = 14
#: Members of one part of a crowded filter; parts are compared pair by pair in tasks of their own.
PART = 256


class Caps:
    """The product code of a dimension: blocks of code words, and the least inner product of a cap."""

    def __init__(self, dim: int, n: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim, self.blocks = dim, 2 if dim >= 2 else 1
        filters = max(64, n / PER_FILTER * PASSED)
        self.words = max(4, math.ceil(filters ** (1 / self.blocks)))
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        self.cuts = [dim * i // self.blocks for i in range(self.blocks + 1)]
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            c = rng.standard_normal((self.words, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(self.blocks))
        x = rng.standard_normal((400, dim))
        x = x / np.linalg.norm(x, axis=1, keepdims=True) @ self.rotation
        self.least = self._bound(x, min(400 * PASSED, 400 * self.words**self.blocks - 1))

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes, strict=False)]

    def _bound(self, x: np.ndarray, keep: int) -> float:
        """The keep-th largest inner product of the vectors with all filters; holds as many numbers at once, however many filters there are."""
        best = np.empty(0)
        for lo in range(len(x)):
            parts = [-np.sort(-p[0]) for p in self._parts(x[lo : lo + 1])]
            least = best.min() if len(best) == keep else -np.inf
            if self.blocks == 1:
                sums = [parts[0][:keep]]
            else:  # of sorted parts, the i-th and j-th (from 1 on) make one of the largest only if i * j <= keep
                p, q = parts
                rows = min(int(np.searchsorted(-p, -(least - q[0]), side="right")), keep)
                sums = [p[i] + q[: keep // (i + 1)] for i in range(rows)]
            best = np.concatenate([best, *sums])
            if len(best) > keep:
                best = np.partition(best, len(best) - keep)[len(best) - keep :]
        return float(best.min())

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all filters it passes, and of the AT_LEAST nearest."""
        parts = self._parts(unit @ self.rotation)
        out = []
        if self.blocks == 1:
            return [np.union1d(np.flatnonzero(p >= self.least), np.argsort(-p, kind="stable")[:AT_LEAST]) for p in parts[0]]
        for p, q in zip(*parts, strict=True):
            order = np.argsort(-q, kind="stable")
            falling = q[order]
            # the code words of the second block that still lift a first one over the bound are a prefix
            count = np.searchsorted(-falling, p - self.least, side="right")
            ids = [i * self.words + order[: count[i]] for i in np.flatnonzero(count)]
            got = np.concatenate(ids) if ids else np.empty(0, np.int64)
            if len(got) < AT_LEAST:
                top = np.argsort(-p, kind="stable")[:AT_LEAST]
                sums = p[top, None] + falling[None, :AT_LEAST]
                best = np.argsort(-sums, axis=None, kind="stable")[:AT_LEAST]
                got = np.union1d(got, top[best // sums.shape[1]] * self.words + order[best % sums.shape[1]])
            out.append(np.sort(got))
        return out


def usable(e: str) -> Column:
    """Whether a vector can be compared: not null, not empty, not zero, all components finite."""
    c = F.col(e)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def meet(pdf: pd.DataFrame, threshold: float, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the verified pairs of a group that meet here first: no filter with a smaller number holds both."""
    e = np.stack(pdf["e"].to_numpy()).astype(float)
    e /= np.abs(e).max(axis=1, keepdims=True)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    cos = e @ e.T
    i, j = np.nonzero(np.triu(cos >= threshold, 1))
    if len(spans) == 2:
        n = spans[0][1]
        cross = (i < n) & (j >= n)
        i, j = i[cross], j[cross]
    if not len(i):
        return i, j, cos[i, j]
    lists, own = pdf["earlier"].to_numpy(), np.unique(np.concatenate(pdf["earlier"].to_numpy()))
    member = np.zeros((len(pdf), len(own)), np.float32)
    for r, x in enumerate(lists):
        member[r, np.searchsorted(own, x)] = 1
    first = (member @ member.T)[i, j] == 0
    return i[first], j[first], cos[i[first], j[first]]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Vectors are linked when their cosine reaches the threshold, in double precision. Null, zero and non-finite vectors,
    and vectors of another length than their partner, are linked with nothing. Equal vectors are one class that is compared once; a class of n copies
    counts as n. A repeated vec_id is one vector if the vectors are equal too; n_links counts rows. Null vec_ids are linked
    with nothing. Candidates meet in filters (recall is measured in the tests), crowded filters are compared part by part, and no pair list leaves a
    task: it returns counts and a spanning set of links.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 2000)
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("e"))
    able = F.col("vec_id").isNotNull() & usable("e")
    rows = every.where(able).withColumn("d", F.transform("e", lambda x: x.cast("double")))
    rows = rows.withColumn("d", F.transform("d", lambda x: x / F.array_max(F.transform("d", lambda y: F.abs(y)))))
    rows = rows.withColumn("nrm", F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x)))
    rows = rows.select("vec_id", "e", F.sha1(F.concat_ws(",", F.transform("d", lambda x: F.round(x / F.col("nrm"), 12).cast("string")))).alias("cls"))
    rows = materialize(rows, "vectors")
    classes = materialize(rows.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e")), "classes")
    lengths = [(r["d"], r["n"]) for r in classes.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect()]
    caps: dict[int, Caps] = {}
    for d, n in lengths:
        caps[d] = Caps(d, n)

    kind = pa.float32() if single else pa.float64()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, copies, es = np.array(b.column("rep").to_pylist(), np.int64), np.array(b.column("copies").to_pylist(), np.int64), b.column("e").to_pylist()
            for d in sorted({len(e) for e in es}):
                at = [i for i, e in enumerate(es) if len(e) == d]
                raw = np.array([es[i] for i in at], float)
                scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
                found = caps[d].decode(scaled / np.linalg.norm(scaled, axis=1, keepdims=True))
                of = np.repeat(np.arange(len(at)), [len(x) for x in found])
                f = np.concatenate(found)
                before = np.concatenate([np.arange(len(x)) for x in found])
                for lo in range(0, len(f), 4000):
                    o, k = of[lo : lo + 4000], before[lo : lo + 4000]
                    earlier = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(k)]).astype(np.int32), np.concatenate([found[i][:j] for i, j in zip(o, k, strict=True)]).astype(np.int64))
                    e = pa.ListArray.from_arrays((np.arange(len(o) + 1) * d).astype(np.int32), pa.array(raw[o].ravel()).cast(kind))
                    rows = np.array(at)[o]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), d, np.int32)), pa.array(f[lo : lo + 4000].astype(np.int64)), pa.array(reps[rows]), pa.array(copies[rows]), e, earlier], names=["dim", "f", "rep", "copies", "e", "earlier"])

    met = materialize(classes.select("rep", "copies", "e").repartition(partitions(spark)).mapInArrow(decode, f"dim int, f long, rep long, copies long, e array<{'float' if single else 'double'}>, earlier array<long>"), "caps")
    crowd = materialize(met.groupBy("dim", "f").agg(F.count("*").alias("m")).where("m > 1"), "crowds")
    parted = join_hot(met, crowd, ["dim", "f"], "m", met.count(), ["rep"]).where("m IS NOT NULL")
    parts = F.ceil(F.col("m") / PART).cast("int")
    mine = F.pmod(F.xxhash64("rep"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("a"), F.greatest(o, F.col("part")).alias("b")))
    parted = parted.withColumn("parts", parts).withColumn("part", mine).withColumn("x", F.explode(pairs)).select("dim", "f", "x.a", "x.b", "part", "rep", "copies", "e", "earlier")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "rep"]).reset_index(drop=True)
        two = pdf["a"].iloc[0] != pdf["b"].iloc[0]
        n = int((pdf["part"] == pdf["a"].iloc[0]).sum())
        i, j, _ = meet(pdf, threshold, [(0, n), (n, len(pdf))] if two else [(0, len(pdf))])
        copies, rep = pdf["copies"].to_numpy(), pdf["rep"].to_numpy()
        links = np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf))
        low = rep.copy()
        root = np.arange(len(pdf))
        for _ in range(len(pdf)):  # smallest representative reachable within the group
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            if (new == low).all():
                break
            low = new
        on = np.unique(np.concatenate([i, j])) if len(i) else root[:0]
        return pd.DataFrame({"rep": rep[on], "links": links[on].astype(np.int64), "low": low[on]})

    found = materialize(parted.groupBy("dim", "f", "a", "b").applyInPandas(compare, "rep long, links long, low long"), "vector-links")
    linked = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = classes.select("cls", "rep", "copies").join(links, "rep", "left").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    whole = materialize(whole.select("cls", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component_id")), "vector-classes")
    out = join_hot(rows.select("vec_id", "cls"), whole, ["cls"], "copies", rows.count(), ["vec_id"])
    out = out.select("vec_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    out = materialize(out, "vectors-linked")
    release(met, found)
    alone = every.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
