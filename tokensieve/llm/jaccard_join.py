"""Exact Jaccard self-join of word shingles in metric space (operator 7).

Jaccard distance is a metric, and two texts are linked when it is at most r. The space is divided into the Voronoi regions of
pivots, documents near a border are copied into the neighbouring region's window, and regions are divided again and compared.

First level: the pivots are all single shingles. A set is at distance 1 - 1/n from each shingle it holds and 1 from all others;
ties go to the first in a global order, so its region is that of its first shingle, and its window, the regions where a partner
within r may live, are those of its first n - ceil(t n) + 1 shingles (t = 1 - r). The order puts frequent shingles
last, so a region is crowded only when nearly everything in its sets is frequent. Equal sets are one class before anything is joined.
In each region the class with the smallest set is measured against the others, which connects most of what is linked.

Further levels: a region that is not connected yet and holds more than BLOCK classes takes PIVOTS of its classes as pivots.
A class within r of a pivot belongs to the cell of the nearest one, the others to the far cell. If x and y are within r and y
is in the cell of p, then d(x, p) <= d(x, y) + d(y, p) <= 2 r: so a class is copied into each later cell whose pivot is within 2 r, and every
pair meets in one cell at least. A cell's own members are connected through its pivot, so who is connected with it already need not be copied.
Cells are divided again, up to LEVELS times and while they have fewer members than the regions they come from.

Bottom: the pairs of a cell that are not connected are compared, in blocks; in crowded cells each class first with its nearest in a block only,
TURNS times, so that of a dense group few pairs are left. The triangle inequality rules out pairs whose distances to the pivot
differ by more than r, and the parities of their sets' bucket counts give a lower bound that rules out nearly all the rest; what
remains is measured exactly. So every pair within r is either linked or connected by links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.llm.common import HOT_SHARES, bounded_batches, components, fresh, join_hot, join_hot_inner, materialize, release, rows_in, tidy
from tokensieve.llm.shingles import shingle_set, signed

WORDS, LINK, OF = 5, 80, 100
#: How many frequent shingles the order knows of, and how often one must occur in a chunk of that many shingles to be counted.
FREQUENT, CHUNK, OFTEN = 1 << 17, 4_000_000, 4
#: Members of a region that are compared in one block, and bits of the tables that tell whose rows are read again.
BLOCK, SLOTS, PROBE = 256, 1 << 26, 31
#: How often a crowded region is divided, by how many pivots at a time, and how often its members are linked with their nearest before all are compared.
LEVELS, PIVOTS, TURNS = 3, 4, 1
#: Rows of regions alike that go to one task, and pairs for which one copy of a set is sent.
ALIKE, SPREAD = 512, 1024
#: Parts of the single shingles, by their hash, whose regions are made one part after the other; their shuffle files take so much less disk.
PASSES = 4


def survey(docs: DataFrame, k: int) -> DataFrame:
    """Per row doc_id, row, n, kid (identifies the set; null when it is empty); and h, c: shingles that recur within a chunk, with their counts."""
    names = ["doc_id", "row", "n", "kid", "h", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            on = c >= OFTEN
            none = pa.nulls(int(on.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(signed(u[on])), pa.array(c[on].astype(np.int64))], names=names)

        for b in batches:
            n, kid = [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, k)
                n.append(len(s))
                kid.append(set_id(s) if len(s) else None)
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n, pa.int64()), pa.array(kid, pa.int64()), none, none], names=names)
        if held:
            yield flush()

    return docs.mapInArrow(run, "doc_id long, row long, n long, kid long, h long, c long")


def frequent_shingles(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), sorted by shingle: the FREQUENT most common of those that a survey found. They only set the order."""
    got = found.where("h IS NOT NULL").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    h, c = got.column("h").to_numpy().astype(np.int64).view(np.uint64), got.column("c").to_numpy()
    at = np.argsort(h)
    return h[at], c[at]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's counts in 4 to 8 buckets per shingle, as packed bits."""
    size = 1 << max(5, (4 * max(len(s), 1) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(a: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set in fewer buckets."""
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def prefix(n: int, link: int, of: int) -> int:
    return n - -(-link * n // of) + 1


def set_id(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def bit_table(keys: DataFrame, key: str) -> np.ndarray:
    """SLOTS bits, whatever the number of keys: two bits of each key (a hash) are set."""
    slot = F.explode(F.array(F.pmod(F.col(key), F.lit(SLOTS)), F.pmod(F.shiftright(F.col(key), PROBE), F.lit(SLOTS))))
    slots = keys.select(slot.alias("s"))
    table = np.zeros(SLOTS // 8, np.uint8)
    # a row for each 32768 slots, SLOTS bits in all: the driver holds no more, however many keys there are
    parts = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).toArrow()
    for number, bits in zip(parts.column("b").to_pylist(), parts.column("m"), strict=True):
        if number < 1:  # bucket 0 holds slot 0 alone
            table[0] |= 1
            continue
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), bitorder="little")) + (number - 1) * 32768 + 1
        at = at[at < SLOTS]
        np.bitwise_or.at(table, at // 8, (1 << (at % 8)).astype(np.uint8))
    return table


def listed(table: np.ndarray, keys: pa.Array) -> pa.Array:
    """Positions of the keys whose bits are set; few others share theirs."""
    k = keys.to_numpy(zero_copy_only=False)
    on = np.ones(len(k), bool)
    for slots in (k % SLOTS, (k >> PROBE) % SLOTS):
        on &= (table[slots // 8] >> (slots % 8).astype(np.uint8) & 1).astype(bool)
    return pa.array(np.flatnonzero(on))


def describe(docs: DataFrame, reps: np.ndarray, hot: tuple[np.ndarray, np.ndarray], crowd: int, k: int, link: int, of: int) -> DataFrame:
    """kid, n, first (the window's shingles), hot (how many of its last are in over ``crowd`` texts) and sketch of the rows of a bit table."""
    keys, counts = hot
    names = ["kid", "n", "first", "hot", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kid, first, many, sk = [], [], [np.empty(0, np.int64)], [], []
            for t in b.column("text").take(listed(reps, b.column("row"))).to_pylist():
                s = shingle_set(t, k)
                if not len(s):
                    continue
                n.append(len(s))
                kid.append(set_id(s))
                sk.append(sketch(s).tobytes())
                often = np.zeros(len(s), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    often = np.where(keys[at] == s, counts[at], 0)
                order = np.argsort(often, kind="stable")[: prefix(len(s), link, of)]
                first.append(signed(s[order]))
                many.append(int((often[order] > crowd).sum()))
            lists = pa.ListArray.from_arrays(np.cumsum([len(x) for x in first]).astype(np.int32), np.concatenate(first))
            yield pa.RecordBatch.from_arrays([pa.array(kid, pa.int64()), pa.array(n, pa.int64()), lists, pa.array(many, pa.int32()), pa.array(sk, pa.binary())], names=names)

    return docs.mapInArrow(run, "kid long, n long, first array<long>, hot int, sketch binary")


def first_regions(sets: DataFrame) -> list[DataFrame]:
    """h, kid, n, pivot, pivot_n, in tables to be united: the regions around single shingles that hold several classes; pivot is the class with the smallest set.

    Those of hot shingles, FREQUENT at most, are summed up within each task first; no task sees all of one. The others are taken in PASSES parts.
    """
    size = F.size("first")
    region = Window.partitionBy("h")
    columns = ["h", "kid", "n", F.col("p.kid").alias("pivot"), F.col("p.n").alias("pivot_n")]
    out = []
    for i in range(PASSES):
        own = F.filter(F.slice("first", F.lit(1), size - F.col("hot")), lambda h: F.pmod(h, F.lit(PASSES)) == F.lit(i))  # noqa: B023
        cold = sets.select("kid", "n", F.explode(own).alias("h"))
        cold = cold.withColumn("p", F.min(F.struct("n", "kid")).over(region)).withColumn("top", F.max("kid").over(region)).withColumn("low", F.min("kid").over(region)).where("top <> low")
        out.append(materialize(cold.select(*columns).distinct(), "regions"))
        tidy(sets.sparkSession)
    crowds = sets.where("hot > 0").select("kid", "n", F.explode(F.slice("first", size - F.col("hot") + 1, F.col("hot"))).alias("h")).distinct()
    crowds = materialize(crowds, "regions-hot")
    tops = crowds.groupBy("h").agg(F.min(F.struct("n", "kid")).alias("p"), F.max("kid").alias("top"), F.min("kid").alias("low")).where("top <> low")
    out.append(materialize(crowds.join(F.broadcast(tops), "h").select(*columns), "regions"))
    release(crowds)
    return out


def one_each(rows: DataFrame, need: DataFrame, name: str) -> DataFrame:
    """The rows of the needed kids, written, one for each: several bits of a table may let a class by twice."""
    out = materialize(rows.join(need.select("kid"), "kid", "left_semi"), name)
    if rows_in(out) == rows_in(need):
        return out
    return materialize(out.dropDuplicates(["kid"]), name)


def only(table: DataFrame, need: DataFrame, name: str) -> DataFrame:
    """The rows of a table whose kid is needed, written; a bit table skips most others before anything is shuffled."""
    bits = bit_table(need, "kid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(listed(bits, b.column("kid")))

    return one_each(table.mapInArrow(run, table.schema), need, name)


def ends(pairs: DataFrame) -> DataFrame:
    """kid, ma, mb: the classes of pairs, and in how many pairs each is a and b."""
    both = pairs.select(F.explode(F.array(*[F.struct(F.col(c).alias("kid"), F.lit(int(c == "a")).alias("x"), F.lit(int(c == "b")).alias("y")) for c in ("a", "b")])).alias("e")).select("e.*")
    return materialize(both.groupBy("kid").agg(F.sum("x").alias("ma"), F.sum("y").alias("mb")), "ends", 2 * rows_in(pairs))


def attach(pairs: DataFrame, n: int, crowded: DataFrame | None, table: DataFrame, key: str, other: str, columns: dict[str, str]) -> DataFrame:
    """The n pairs with columns of table (one row per kid) for the class in ``key``; a class in over SPREAD pairs has its row sent in copies. crowded are the ends of those, or None.

    The table's rows are large, so they are shuffled whatever their number is: what a run needs grows in proportion.
    """
    named = [F.col(c).alias(x) for c, x in columns.items()]
    if crowded is None:
        return pairs.join(table.select(F.col("kid").alias(key), *named).hint("merge"), key)
    mine = crowded.select(F.col("kid").alias(key), F.col(f"m{key}").alias("m")).where(F.col("m") > SPREAD).withColumn("copies", F.ceil(F.col("m") / SPREAD).cast("int"))
    salted = join_hot(pairs, mine, [key], "m", n, [other]).withColumn("copy", F.coalesce(F.pmod(F.xxhash64(other), F.col("copies")).cast("int"), F.lit(0))).drop("m", "copies")
    rows = table.withColumnRenamed("kid", key).join(mine, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    return salted.join(rows.select(key, "copy", *named).hint("merge"), [key, "copy"]).drop("copy")


def crowded_ends(found: DataFrame, n: int) -> DataFrame | None:
    """The ends that are in over SPREAD of n pairs on a side; None if there are none."""
    if n <= SPREAD:
        return None
    out = materialize(found.where((F.col("ma") > SPREAD) | (F.col("mb") > SPREAD)), "crowded", rows_in(found))
    return out if rows_in(out) else None


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """a, b, common, na, nb of written pairs (a, b) of set ids: the exact sizes of the intersection and of both sets.

    The texts of the sets in question are read again: a bit table of bounded size skips most others, and a join drops the rest.
    """
    found = ends(pairs)
    need = materialize(found.join(classes.select("kid", "at_row"), "kid"), "needed", rows_in(found))
    bits = bit_table(need, "at_row")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column("text").take(listed(bits, b.column("row"))).to_pylist()]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["kid", "s"])

    sets = one_each(docs.mapInArrow(read, "kid long, s binary"), need, "sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                rows.append((int((both[1:] == both[:-1]).sum()), len(x), len(y)))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(c, pa.int64()) for c in cols)], names=["a", "b", "common", "na", "nb"])

    m = rows_in(pairs)
    crowded = crowded_ends(need, m)
    joined = attach(attach(pairs, m, crowded, sets, "a", "b", {"s": "sa"}), m, crowded, sets, "b", "a", {"s": "sb"})
    out = materialize(joined.select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long, common long, na long, nb long"), "measured", m)
    release(need, found, sets, pairs)
    tidy(docs.sparkSession)
    return out


def bound(pairs: DataFrame, sets: DataFrame, link: int, of: int) -> DataFrame:
    """The pairs (a, b) that sizes and bucket counts do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            on = [possible(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), int(m), int(n), link, of) for x, y, m, n in zip(b.column("ka").to_pylist(), b.column("kb").to_pylist(), na, nb, strict=True)]
            at = pa.array(np.flatnonzero(on))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], names=["a", "b"])

    pairs = materialize(pairs, "met")
    need, m = ends(pairs), rows_in(pairs)
    own = only(sets.select("kid", "n", "sketch"), need, "met-sketches")
    crowded = crowded_ends(need, m)
    joined = attach(attach(pairs, m, crowded, own, "a", "b", {"n": "na", "sketch": "ka"}), m, crowded, own, "b", "a", {"n": "nb", "sketch": "kb"})
    out = materialize(joined.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long"), "possible", m)
    release(pairs, own, need)
    tidy(sets.sparkSession)
    return out


def possible(x: np.ndarray, y: np.ndarray, m: int, n: int, link: int, of: int) -> bool:
    """Whether sets of m and n shingles may be linked: a bucket whose parities differ holds a shingle that only one set has."""
    if of * min(m, n) < link * max(m, n):
        return False
    size = min(len(x), len(y))
    gap = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
    return gap * (of + link) <= (of - link) * (m + n)


def blocks(rows: DataFrame) -> DataFrame:
    """h, k0, x, y, part, kid, n, component, d: each row once for each block that its members are compared in.

    A region of BLOCK members is one block. A larger one is cut into parts, those of its largest component apart from the
    others; two parts make a block unless both are of that component, whose members are connected already.
    """
    per = materialize(rows.groupBy("h", "component").agg(F.count("*").alias("c"), F.min("k0").alias("k0")), "region-components", rows_in(rows))
    sizes = per.groupBy("h").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("m"))
    sizes = materialize(sizes.select("h", "m", F.col("top.c").alias("mc"), F.col("top.component").alias("main")), "region-sizes", rows_in(per))
    rows = join_hot_inner(rows, sizes, ["h"], "m", rows_in(rows))
    one = F.col("m") <= BLOCK
    pa_, pb = F.ceil(F.col("mc") / BLOCK).cast("int"), F.ceil((F.col("m") - F.col("mc")) / BLOCK).cast("int")
    inner = F.col("component") == F.col("main")
    rows = rows.withColumn("pa", F.when(one, 0).otherwise(pa_)).withColumn("pb", F.when(one, 1).otherwise(pb))
    hashed = F.xxhash64("kid")
    rows = rows.withColumn("part", F.when(one, 0).when(inner, F.pmod(hashed, F.col("pa"))).otherwise(F.col("pa") + F.pmod(hashed, F.greatest("pb", F.lit(1)))).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("pb") - 1), lambda j: F.col("pa") + j)
    every = F.sequence(F.lit(0), F.col("pa") + F.col("pb") - 1)
    against = F.when(one, F.array(F.lit(0))).when(inner, others).otherwise(every)
    two = F.transform(against, lambda o: F.struct(F.least(o, F.col("part")).cast("int").alias("x"), F.greatest(o, F.col("part")).cast("int").alias("y")))
    return rows.withColumn("p", F.explode(two)).select("h", "k0", "p.x", "p.y", "part", "kid", "n", "component", "d")


def with_partners(rows: DataFrame, link: int, of: int) -> DataFrame:
    """Of the regions of BLOCK members at most, the members that could be linked with one of another component by their sizes and distances to the pivot."""
    reach = 1 - link / of
    one = ["kid", "n", "component", "d"]
    met = rows.where(F.col("m") <= BLOCK).groupBy("h").agg(F.min("k0").alias("k0"), F.collect_list(F.struct(*one)).alias("ms"))

    def may(x: Column, y: Column) -> Column:
        apart = F.coalesce(F.abs(x["d"] - y["d"]) > reach + 1e-9, F.lit(False))
        return (x["component"] != y["component"]) & (F.lit(of) * F.least(x["n"], y["n"]) >= F.lit(link) * F.greatest(x["n"], y["n"])) & ~apart

    kept = F.filter("ms", lambda x: F.exists("ms", lambda y: may(x, y)))
    small = met.select("h", "k0", F.explode(kept).alias("x")).select("h", "k0", *[f"x.{c}" for c in one])
    return small.unionByName(rows.where(F.col("m") > BLOCK).select("h", "k0", *one))


def small_sketches(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """kid, sketch: the sketches of the classes in rows, folded to half their size."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            small = [fold(np.frombuffer(x, np.uint8), max(4, len(x) // 2)).tobytes() for x in b.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("kid"), pa.array(small, pa.binary())], names=["kid", "sketch"])

    need = materialize(rows.select("kid").distinct(), "last-needed", rows_in(rows))
    return materialize(only(sets.select("kid", "sketch"), need, "last-sketches").mapInArrow(shrink, "kid long, sketch binary"), "last-small")


def leftover_pairs(rows: DataFrame, own: DataFrame, link: int, of: int, best: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of different components that meet in a region and that neither window nor bucket counts rule out.

    rows: h, k0, kid, n, component, d (distance to the region's pivot, or null); see blocks. own has their small sketches. With ``best`` each member of a
    block tells of one pair only, that with the least bound.
    """

    rows = materialize(rows.select("h", "k0", "kid", "n", "component", "d"), "regions-last")
    # regions that begin with the same class hold much the same pairs; they go to one task, up to ALIKE rows, which tells each pair once
    cut = materialize(blocks(rows), "region-blocks")
    alike = materialize(cut.groupBy("k0", "x", "y").agg(F.count("*").alias("m")).where(F.col("m") > ALIKE), "regions-alike", rows_in(cut))
    cut = join_hot(cut, alike, ["k0", "x", "y"], "m", rows_in(cut), ["kid"])
    cut = cut.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("h"), F.ceil(F.col("m") / ALIKE)), F.lit(0))).drop("m").join(own.hint("merge"), "kid")
    cut = cut.repartition("k0", "x", "y", "salt").sortWithinPartitions("h", "x", "y", "part", "n", "kid")
    reach = 1 - link / of

    def block(g: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        kid, n, comp, part = (np.array(g[c], np.int64) for c in ("kid", "n", "component", "part"))
        d = np.array([np.nan if v is None else v for v in g["d"]])
        i, j = np.triu_indices(len(kid), 1)
        ok = comp[i] != comp[j]
        if g["x"][0] != g["y"][0]:
            ok &= part[i] != part[j]
        ok &= of * np.minimum(n[i], n[j]) >= link * np.maximum(n[i], n[j])
        ok &= ~(np.abs(d[i] - d[j]) > reach + 1e-9)
        i, j = i[ok], j[ok]
        if len(i):
            raw = [np.frombuffer(s, np.uint8) for s in g["sketch"]]
            size = np.array([len(s) for s in raw])
            gap = np.zeros(len(i), np.int64)
            for w in np.unique(np.minimum(size[i], size[j])).tolist():
                sk = np.stack([fold(s, w) if len(s) >= w else np.zeros(w, np.uint8) for s in raw])
                own = np.flatnonzero(np.minimum(size[i], size[j]) == w)
                for lo in range(0, len(own), 4096):
                    o = own[lo : lo + 4096]
                    gap[o] = np.bitwise_count(sk[i[o]] ^ sk[j[o]]).sum(axis=1, dtype=np.int64)
            on = gap * (of + link) <= (of - link) * (n[i] + n[j])
            i, j, gap = i[on], j[on], gap[on]
            if best:
                order = np.argsort(gap / (n[i] + n[j]), kind="stable")
                i, j = i[order], j[order]
                on = np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
                i, j = i[on], j[on]
        return np.minimum(kid[i], kid[j]), np.maximum(kid[i], kid[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h", "x", "y", "part", "kid", "n", "component", "d", "sketch")
        held: dict[str, list] = {c: [] for c in names}
        at = None
        told: set[tuple[int, int]] = set()

        def tell() -> pa.RecordBatch | None:
            if len(held["kid"]) < 2:
                return None
            a, b = block(held)
            new = set(zip(a.tolist(), b.tolist(), strict=True)) - told
            if len(told) > 500_000:
                told.clear()
            told.update(new)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.int64()), pa.array([y for _, y in new], pa.int64())], names=["a", "b"]) if new else None

        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in names}
            for r in range(b.num_rows):
                key = (cols["h"][r], cols["x"][r], cols["y"][r])
                if key != at:
                    if (out := tell()) is not None:
                        yield out
                    held, at = {c: [] for c in names}, key
                for c in names:
                    held[c].append(cols[c][r])
        if (out := tell()) is not None:
            yield out

    return cut.drop("k0", "salt").mapInArrow(run, "a long, b long").distinct()


def linked(measured: DataFrame, link: int, of: int) -> DataFrame:
    return measured.where(F.col("common") * of >= (F.col("na") + F.col("nb") - F.col("common")) * link).select("a", "b")


def joined_up(label: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after further links (a, b): only components that they connect are gone through again."""
    own = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    x = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    edges = x.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")).where("a <> b")
    merged = components(edges.select(*pair_of("a", "b")).distinct())
    if not rows_in(merged):
        return label
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = label.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    new = merged.select("node", "component").join(label.select("node"), "node", "left_anti")
    out = materialize(old.unionByName(new), "labels", rows_in(label) + rows_in(merged))
    release(merged)
    return out


def distances(measured: DataFrame) -> DataFrame:
    return measured.select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("away"))


def pair_of(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def regions_left(met: DataFrame, label: DataFrame) -> DataFrame:
    """The memberships, with component, m (members) and k0 (the region's smallest class), of regions that hold several components; regions of equal members count once.

    Components only grow, so a region that is connected now is never looked at again.
    """
    named = met.join(label.select(F.col("node").alias("kid"), "component"), "kid", "left").withColumn("component", F.coalesce("component", "kid"))
    named = materialize(named, "regions-named")
    split = named.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.expr("bit_xor(xxhash64(kid))").alias("sig"), F.min("kid").alias("k0"))
    split = materialize(split.where("lo <> hi").groupBy("m", "sig", "k0").agg(F.min("h").alias("h")).select("h", "k0", "m"), "regions-split", rows_in(named))
    out = materialize(join_hot_inner(named, split, ["h"], "m", rows_in(named)), "regions-open", rows_in(named))
    release(named, split)
    tidy(met.sparkSession)
    return out


def with_pivots(rows: DataFrame, level: int) -> DataFrame:
    """h, kid, n, component, j, p, pn: each member beside each of its region's PIVOTS pivots, numbered from 1 on."""
    best = [F.min(F.struct(F.xxhash64("kid", F.lit(level * PIVOTS + i)).alias("o"), "kid", "n")).alias(f"p{i}") for i in range(PIVOTS)]
    chosen = F.array_distinct(F.array(*[F.struct(F.col(f"p{i}.kid").alias("kid"), F.col(f"p{i}.n").alias("n")) for i in range(PIVOTS)]))
    pivots = materialize(rows.groupBy("h").agg(F.count("*").alias("c"), *best).select("h", "c", chosen.alias("ps")), "pivots", rows_in(rows))
    rows = join_hot_inner(rows.drop("m", "k0", "d"), pivots, ["h"], "c", rows_in(rows))
    rows = rows.select("h", "kid", "n", "component", F.posexplode("ps").alias("at", "x"))
    return rows.select("h", "kid", "n", "component", (F.col("at") + 1).alias("j"), F.col("x.kid").alias("p"), F.col("x.n").alias("pn"))


def cells(beside: DataFrame, measured: DataFrame, label: DataFrame, level: int, reach: float) -> DataFrame:
    """h, kid, n, d of the cells of with_pivots: a member's own cell, and the later ones whose pivots are within twice the reach but in another component (0 is the far cell)."""
    pairs = beside.select("h", "kid", "n", "j", "p", *pair_of("kid", "p")).join(distances(measured), ["a", "b"], "left")
    d = F.when(F.col("kid") == F.col("p"), F.lit(0.0)).when(F.col("away") <= 2 * reach + 1e-9, F.col("away"))
    for c in ("kid", "p"):
        pairs = pairs.join(label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c")), c, "left").withColumn(f"{c}_c", F.coalesce(f"{c}_c", c))
    near = pairs.withColumn("d", d).groupBy("h", "kid", "n").agg(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "j", (F.col("kid_c") != F.col("p_c")).alias("foreign")))).alias("ds"))
    nearest = F.array_min("ds")
    near = near.withColumn("own", F.when(F.coalesce(nearest["d"] <= reach + 1e-9, F.lit(False)), nearest["j"]).otherwise(0))
    there = F.transform(F.filter("ds", lambda x: (x["j"] == F.col("own")) | ((x["j"] > F.col("own")) & x["foreign"])), lambda x: F.struct(x["d"].alias("d"), x["j"].alias("j")))
    far = F.array(F.struct(F.lit(None).cast("double").alias("d"), F.lit(0).alias("j")))
    near = near.select("h", "kid", "n", F.explode(F.when(F.col("own") == 0, F.concat(there, far)).otherwise(there)).alias("x"))
    return near.select(F.xxhash64("h", F.lit(level), F.col("x.j")).alias("h"), "kid", "n", F.col("x.d").alias("d"))


def jaccard_components(docs: DataFrame, words: int = WORDS, link: int = LINK, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every row of (doc_id, text).

    Texts are linked when of * |intersection| >= link * |union| of their shingle sets. A null text, or one without words, has the empty set and is linked
    with nothing; its component is its own doc_id. class_id is the smallest doc_id with the same set, component_id the smallest
    that links reach. A repeated doc_id is a document each time; a null doc_id takes part and is never the
    smallest. Other columns are ignored. Sets are told apart by 64-bit hashes, as are shingles.
    """
    return named_rows(docs, words, link, of).select("doc_id", "n_shingles", "class_id", "component_id")


def row_key() -> Column:
    """Identifies a row by doc_id and text."""
    d, t = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.xxhash64(d, t, d.isNull(), t.isNull())


def named_rows(docs: DataFrame, words: int, link: int, of: int) -> DataFrame:
    """The columns of jaccard_components, row (see row_key) and component, which is null for the empty set and else tells components apart whatever their doc_ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    found = materialize(survey(docs, words), "shingle-rows")
    hot = frequent_shingles(found)
    all_rows = materialize(found.where("n IS NOT NULL").select("doc_id", "row", "n", "kid"), "shingle-docs")
    release(found)
    least = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "row")
    classes = all_rows.where("kid IS NOT NULL").groupBy("kid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min(least).alias("l"), F.max("n").alias("n"))
    classes = materialize(classes.select("kid", "rep", "copies", F.col("l.row").alias("at_row"), "n"), "shingle-classes")
    total = rows_in(all_rows)
    sets = materialize(describe(docs, bit_table(classes, "at_row"), hot, max(total // HOT_SHARES, OFTEN), words, link, of), "class-sets")
    reach = 1 - link / of
    regions = first_regions(sets)
    met = reduce(DataFrame.unionByName, regions)
    tidy(spark)

    star = met.where((F.col("kid") != F.col("pivot")) & (F.col("pivot_n") * of >= F.col("n") * link)).select(*pair_of("kid", "pivot")).distinct()
    measured = verify(docs, classes, bound(star, sets, link, of), words)
    label = components(linked(measured, link, of))
    left = regions_left(met.select("h", "kid", "n", "pivot"), label)
    release(*regions)
    tidy(spark)
    away = left.select("h", "k0", "m", "kid", "n", "component", "pivot", *pair_of("kid", "pivot")).join(distances(measured), ["a", "b"], "left")
    d = F.when(F.col("kid") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("away"))
    whole = materialize(away.select("h", "k0", "m", "kid", "n", "component", d.alias("d")), "regions-first")
    release(left)
    bottom = [whole.where(F.col("m") <= BLOCK)]
    rest = materialize(whole.where(F.col("m") > BLOCK), "regions-crowded", rows_in(whole))

    def meet(pairs: DataFrame, least: int) -> None:
        """Measure the pairs that have not been, if their sets may be as near as that; what is linked by now gets its labels."""
        nonlocal measured, label
        got = verify(docs, classes, bound(pairs.join(measured.select("a", "b"), ["a", "b"], "left_anti"), sets, least, of), words)
        measured = materialize(measured.unionByName(got), "measured", rows_in(measured) + rows_in(got))
        label = joined_up(label, linked(got, link, of))

    wide = max(of - 2 * (of - link), 0)
    for level in range(LEVELS):
        if not rows_in(rest):
            break
        beside = materialize(with_pivots(rest, level), "beside-pivots", PIVOTS * rows_in(rest))
        near = F.lit(of) * F.least("n", "pn") >= F.lit(wide) * F.greatest("n", "pn")
        meet(beside.where((F.col("kid") != F.col("p")) & near).select(*pair_of("kid", "p")).distinct(), wide)
        inner = materialize(cells(beside, measured, label, level, reach), "cells", 2 * rows_in(beside))
        left = regions_left(inner, label)
        release(beside, inner)
        if rows_in(left) >= rows_in(rest):  # the pivots do not tell these classes apart
            break
        bottom.append(left.where(F.col("m") <= BLOCK))
        rest = materialize(left.where(F.col("m") > BLOCK), "regions-crowded", rows_in(left))
    crowd = small_sketches(sets, rest) if rows_in(rest) else None
    for _ in range(TURNS):
        rest = regions_left(rest.drop("m", "k0", "component"), label)
        if not rows_in(rest):
            break
        meet(leftover_pairs(rest, crowd, link, of, best=True), link)
    tidy(spark)

    last = rest.select("h", "k0", "m", "kid", "n", "d")
    for part in bottom:
        last = last.unionByName(part.select("h", "k0", "m", "kid", "n", "d"))
    last = last.join(label.select(F.col("node").alias("kid"), "component"), "kid", "left").withColumn("component", F.coalesce("component", "kid"))
    last = materialize(with_partners(last, link, of), "regions-partnered")
    small = small_sketches(sets, last)
    meet(leftover_pairs(last, small, link, of), link)
    final = label
    release(sets, whole)
    tidy(spark)

    comp = classes.join(final.select(F.col("node").alias("kid"), "component"), "kid", "left").withColumn("component", F.coalesce("component", "kid"))
    comp = materialize(comp.select("kid", "rep", "copies", "component"), "class-components", rows_in(classes))
    lowest = materialize(comp.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("m")), "component-ids", rows_in(comp))
    comp = materialize(join_hot_inner(comp, lowest, ["component"], "m", rows_in(comp)).select("kid", F.col("rep").alias("class_id"), "copies", "component_id", "component"), "class-ids")
    out = join_hot(all_rows.select("doc_id", "row", F.col("n").alias("n_shingles"), "kid").withColumn("_r", F.monotonically_increasing_id()), comp, ["kid"], "copies", total, ["_r"])
    none = F.col("kid").isNull()
    return out.select("doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row", "component")


def keep_one(docs: DataFrame, words: int = WORDS, link: int = LINK, of: int = OF) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, nulls last; of those that share it the first by text, once.

    Rows without words stay. All columns are kept, whatever their names; an empty table stays empty.
    """
    named = materialize(named_rows(docs, words, link, of).select("doc_id", "row", "component"), "named-rows")
    some = named.where("component IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    lowest = some.groupBy("component").agg(F.min(order).alias("l")).select("component", F.col("l.doc_id").alias("low"))
    best = materialize(some.distinct().join(lowest, "component").where("doc_id <=> low").select("row", "component"), "best-rows")
    (key,) = fresh(docs, "row_key")
    rows = docs.withColumn(key, row_key())
    tied = materialize(best.join(best.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi"), "best-tied")
    texts = rows.select(F.col(key).alias("row"), "text").join(tied, "row")
    first = texts.groupBy("component").agg(F.min(F.struct("text", "row")).alias("l")).select("component", F.col("l.row").alias("row"))
    keep = materialize(best.join(tied.select("component").distinct(), "component", "left_anti").select("row").unionByName(first.select("row")), "kept-rows")
    gone = materialize(some.select(F.col("row").alias(key)).distinct().join(keep.withColumnRenamed("row", key), key, "left_anti"), "gone-rows")
    again = materialize(some.groupBy("row").count().where("count > 1").select(F.col("row").alias(key)).join(gone, key, "left_anti"), "kept-again")
    kept = rows.join(gone, key, "left_anti")
    if rows_in(again):
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)
