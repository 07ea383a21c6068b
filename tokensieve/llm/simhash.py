"""SimHash document fingerprints in DataFrame functions only (operator 4).

Terms are pairs of neighbouring words, weighted by their length. Each of 128 hash bits of a term votes by its weight. The
votes for bits k and k + 32 of a hash share one 64-bit sum, so 64 sums make a fingerprint, exact for texts of
up to half a billion words.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.llm.common import join_hot_inner, materialize, rows_in

BITS = 128
SPACE = r"[\x20\x09-\x0D]+"
#: Bits in which fingerprints of near documents may differ, and members of one part of a crowded block key.
RADIUS, PART = 3, 128
#: Rows that a neighbour window holds on average, and the most windows that are told apart.
ROWS_A_RANGE, MAX_RANGES = 64, 8192


def fingerprints(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key columns, hi, lo: the two halves of the fingerprint of each row's text; rows with equal keys are taken together.

    A null text is taken as empty; all texts without words share one fingerprint. Votes are summed within each task
    before they are shuffled.
    """
    w = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE)
    rows = texts.select(*key, w.alias("_w"))
    rows = rows.select(*key, F.explode(F.arrays_zip(F.col("_w").alias("a"), F.slice(F.col("_w"), F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))).alias("b"))).alias("_t"))
    a, b = F.col("_t.a"), F.col("_t.b")
    weight = (F.lit(1) + F.least(F.lit(6), F.floor((F.length(a) + F.coalesce(F.length(b), F.lit(0))) / 4))).cast("long")
    rows = rows.select(*key, F.xxhash64(a, b).alias("_h0"), F.xxhash64(b, F.lit(17), a).alias("_h1"), weight.alias("_wt"))
    pair = F.lit((1 << 32) | 1)
    votes = [F.sum(F.shiftrightunsigned(f"_h{i}", k).bitwiseAND(pair) * F.col("_wt")).alias(f"_v{i}_{k}") for i in (0, 1) for k in range(32)]
    sums = rows.groupBy(*key).agg(F.sum("_wt").alias("_all"), *votes)

    def half(i: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            low, high = F.col(f"_v{i}_{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"_v{i}_{k}", 32)
            for count, at in ((low, k), (high, k + 32)):
                out = out.bitwiseOR(F.shiftleft((2 * count > F.col("_all")).cast("long"), at))
        return out

    return sums.select(*key, half(0).alias("hi"), half(1).alias("lo"))


def shown(hi: str, lo: str) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """1 for equal fingerprints, about 0.5 for unrelated texts."""
    return 1 - distance(hi, lo, hi2, lo2) / F.lit(float(BITS))


def ranges(docs: DataFrame) -> tuple[Column, Column, int]:
    """(range number, whether the row ends its range, number of ranges) by doc_id.

    The bounds, at most MAX_RANGES of them, are doc_ids of the table, so every range ends with a known row.
    """
    n = docs.count()
    k = max(1, min(MAX_RANGES, n // ROWS_A_RANGE))
    got = docs.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)] + [1.0], 8 * k + 100).alias("b"), F.max("doc_id").alias("m")).first()
    bounds = sorted(set(got.b or []) | ({got.m} if got.m is not None else set()))
    if not bounds:
        return F.lit(0), F.lit(True), 1
    listed = F.expr(f"array({','.join(f'{b}L' if b > -(1 << 63) else '-9223372036854775807L - 1L' for b in bounds)})")  # a literal, so it is folded once
    steps = len(bounds).bit_length()

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(listed, mid) < F.col("doc_id"), F.lit(False)) & (acc["lo"] < acc["hi"])
        return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(below | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)["lo"]
    number = F.least(found, F.lit(len(bounds) - 1))
    return number, F.coalesce(F.get(listed, found) == F.col("doc_id"), F.lit(False)), len(bounds)


def with_neighbour(docs: DataFrame) -> DataFrame:
    """_range, _row, _ghost, doc_id, text, next_text, where next_text is the text of the next row in descending doc_id order; after the last comes the first.

    Null texts become empty; null doc_ids come last; equal doc_ids are ordered by their text. The row that ends a range is
    copied, as a ghost, to the front of the following one, so no window spans more than a range. Texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    number, ends, k = ranges(rows)
    rows = rows.withColumn("_n", number).withColumn("_ends", ends)
    here, after = F.struct(F.col("_n").alias("r"), F.lit(0).alias("g")), F.struct(F.pmod(F.col("_n") + 1, F.lit(k)).alias("r"), F.lit(1).alias("g"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_ends"), F.array(here, after)).otherwise(F.array(here))))
    rows = rows.select(F.col("_at.r").alias("_range"), F.col("_at.g").alias("_ghost"), "doc_id", "text")
    w = Window.partitionBy("_range").orderBy(F.desc("_ghost"), F.asc_nulls_first("doc_id"), "text")
    return rows.withColumn("_row", F.row_number().over(w)).withColumn("next_text", F.lag("text").over(w))


def agreeing(radius: int, blocks: int | None, agree: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """(cuts, tables): where the bits are cut into blocks, and the choices of ``agree`` blocks, in order.

    Of radius + agree blocks or more, ``agree`` are equal at least in fingerprints within the radius.
    """
    blocks = blocks or radius + agree
    if blocks < radius + agree:
        raise ValueError("too few blocks for this radius")
    return [BITS * i // blocks for i in range(blocks + 1)], list(combinations(range(blocks), agree))


def block_bits(hi: Column, lo: Column, a: int, b: int) -> Column:
    """The bits from a up to b of a fingerprint, hashed together where they lie in both halves."""
    parts = []
    for half, base in ((lo, 0), (hi, 64)):
        x, y = max(a, base), min(b, base + 64)
        if x < y:
            parts.append(F.shiftrightunsigned(half, x - base).bitwiseAND(F.lit((1 << (y - x)) - 1 if y - x < 64 else -1)))
    return parts[0] if len(parts) == 1 else F.xxhash64(*parts)


def differs(hi: Column, lo: Column, a: int, b: int) -> Column:
    """Whether two fingerprints, of which the halves' differences are given, differ between bits a and b."""
    out = F.lit(False)
    for half, base in ((lo, 0), (hi, 64)):
        x, y = max(a, base), min(b, base + 64)
        if x < y:
            mask = (((1 << (y - x)) - 1) << (x - base)) & ((1 << 64) - 1)
            out = out | (half.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) != 0)
    return out


def tables(prints: DataFrame, radius: int, blocks: int | None, agree: int) -> tuple[DataFrame, DataFrame, list[int], list[tuple[int, ...]]]:
    """(classes, cells, cuts, choices): fingerprints with their copies, and the block tables' crowded keys cut into parts.

    cells has t, k, part, parts and members (hi, lo, copies), PART of them or so; keys that one fingerprint has alone are left out.
    """
    cuts, choices = agreeing(radius, blocks, agree)
    classes = materialize(prints.where("hi IS NOT NULL AND lo IS NOT NULL").groupBy("hi", "lo").agg(F.count("*").alias("copies")), "simhash-classes")
    key = lambda chosen: F.xxhash64(*[block_bits(F.col("hi"), F.col("lo"), cuts[i], cuts[i + 1]) for i in chosen])
    every = F.array(*[F.struct(F.lit(t).alias("t"), key(chosen).alias("k")) for t, chosen in enumerate(choices)])
    keyed = classes.select("hi", "lo", "copies", F.explode(every).alias("x")).select("x.t", "x.k", "hi", "lo", "copies")
    keyed = materialize(keyed, "simhash-tables")
    crowd = materialize(keyed.groupBy("t", "k").agg(F.count("*").alias("m")).where("m > 1"), "simhash-crowds")
    met = join_hot_inner(keyed, crowd, ["t", "k"], "m", rows_in(keyed)).withColumn("parts", F.ceil(F.col("m") / PART).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int"))
    cells = met.groupBy("t", "k", "part", "parts").agg(F.collect_list(F.struct("hi", "lo", "copies")).alias("members"))
    return classes, materialize(cells, "simhash-cells"), cuts, choices


def beside(cells: DataFrame) -> DataFrame:
    """Each part of a block key beside each part of it: t, members, others."""
    left = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("t", "k", "members", "other")
    return left.join(cells.select("t", "k", F.col("part").alias("other"), F.col("members").alias("others")), ["t", "k", "other"]).select("t", "members", "others")


def meets_here(t: Column, hi: Column, lo: Column, cuts: list[int], choices: list[tuple[int, ...]]) -> Column:
    """Whether table t is the first in which a pair meets, whose halves differ by hi and lo: its blocks are the pair's first equal ones."""
    gone = {i: differs(hi, lo, cuts[i], cuts[i + 1]) for i in range(len(cuts) - 1)}
    out = F.lit(False)
    for n, chosen in enumerate(choices):
        here = t == n
        for i in range(max(chosen)):
            if i not in chosen:
                here = here & gone[i]
        for i in chosen:
            here = here & ~gone[i]
        out = out | here
    return out


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, agree: int = 2) -> DataFrame:
    """hi, lo, copies, n_near: of each fingerprint of (hi, lo) how many rows have it and how many others lie within the Hamming radius.

    Rows with null fingerprints take no part. Permuted block tables find all of them (see agreeing). Equal fingerprints are one class with its
    copies. A crowded key is cut into parts, two of which are compared at a time, and only counts leave a
    comparison; a pair is counted in the first table that holds it. Built-in expressions only.
    """
    classes, cells, cuts, choices = tables(prints, radius, blocks, agree)

    def near(m: Column) -> Column:
        def add(n: Column, x: Column) -> Column:
            hi, lo = m["hi"].bitwiseXOR(x["hi"]), m["lo"].bitwiseXOR(x["lo"])
            d = F.bit_count(hi) + F.bit_count(lo)
            return n + F.when((d <= radius) & (d > 0) & meets_here(F.col("t"), hi, lo, cuts, choices), x["copies"]).otherwise(F.lit(0))

        return F.aggregate("others", F.lit(0).cast("long"), add)

    found = beside(cells).select(F.explode(F.transform("members", lambda m: F.struct(m["hi"].alias("hi"), m["lo"].alias("lo"), near(m).alias("n")))).alias("x")).select("x.*")
    found = found.where("n > 0").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    return classes.join(found, ["hi", "lo"], "left").select("hi", "lo", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_near"))


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, agree: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all pairs of different fingerprints within the Hamming radius, and the documents of each fingerprint.

    prints has doc_id, hi, lo. pairs has hi, lo, hi2, lo2, distance, the smaller first; members is prints without nulls. Pairs are found as in near_counts.
    """
    _, cells, cuts, choices = tables(prints, radius, blocks, agree)

    def partners(m: Column) -> Column:
        def fits(x: Column) -> Column:
            hi, lo = m["hi"].bitwiseXOR(x["hi"]), m["lo"].bitwiseXOR(x["lo"])
            less = (m["hi"] < x["hi"]) | ((m["hi"] == x["hi"]) & (m["lo"] < x["lo"]))
            return less & (F.bit_count(hi) + F.bit_count(lo) <= radius) & meets_here(F.col("t"), hi, lo, cuts, choices)

        return F.transform(F.filter("others", fits), lambda x: F.struct(m["hi"].alias("hi"), m["lo"].alias("lo"), x["hi"].alias("hi2"), x["lo"].alias("lo2")))

    pairs = beside(cells).select(F.explode(F.flatten(F.transform("members", partners))).alias("x")).select("x.*")
    d = distance(F.col("hi"), F.col("lo"), F.col("hi2"), F.col("lo2"))
    return pairs.withColumn("distance", d), prints.where("hi IS NOT NULL AND lo IS NOT NULL")
