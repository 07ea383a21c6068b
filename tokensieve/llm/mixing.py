"""Mixing sources to target weights by entropy balancing (operator 9).

Each source has a token target. The rates of its documents maximize entropy under that constraint
and the bound of two copies; the solution is an exponential tilt of the odds by size, rate = 2 / (1 +
exp(-l x / m)) for a document of x words and the source's mean m. The dual is convex in l, and Newton
steps, bracketed by bisection, solve all sources at once; each step is one aggregation over the
distinct (source, size) pairs. The rates become whole copies by error feedback from large to small sizes, so a
source misses its target by about half of a small document; within a size, those with the smallest hashes get the odd copy: the
hash up to which they do is found among sizes and hashes alone, so that texts are not shuffled to rank them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.llm.common import fresh, join_hot, join_hot_inner, materialize, release, rows_in, tidy, words_of

#: Weights of the sources in code-point order, repeating; what all targets add up to; the most a source or document is repeated.
WEIGHTS = [5, 2, 1]
SHARE, CAP = 1.5, 2.0
#: Documents of a (source, size) pair that are ranked in one window, on average; larger groups are sliced by hash.
SLICE = 1 << 15
#: The columns that mix adds.
ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(groups: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """skey, source_size, n_docs, target from (skey, size, n) by water-filling; a source of no words has target 0.

    The sources are ranked in one window; there are as many rows as sources.
    """
    by_source = groups.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("skey") == "n", "skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = materialize(by_source.withColumn("w", weight), "sources")
    total, all_w = table.agg(F.sum("source_size"), F.sum("w")).first()
    goal, level, capped = share * (total or 0), 0.0, -1
    level = goal / all_w if all_w else 0.0
    while True:
        over = F.col("w") * F.lit(level) >= F.lit(cap) * F.col("source_size")
        n, held, free = table.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.lit(cap) * F.col("source_size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (goal - held) / free
    return table.withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.lit(level) * F.col("w")).cast("double")).drop("w")


def solve(groups: DataFrame, goals: DataFrame, cap: float, steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """goals with the multiplier ``tilt`` of each source; null where all is taken cap times or nothing is there to take."""
    mean = F.col("source_size") / F.col("n_docs")
    state = goals.withColumn("mean", mean).withColumn("tilt", F.when((F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12)), F.lit(0.0)))
    state = materialize(state.withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6)).withColumn("gap", F.lit(0.0)), "tilt")
    for _ in range(steps):
        x = groups.join(state.where("tilt IS NOT NULL").select("skey", "tilt", "mean"), "skey")
        rate = F.lit(cap) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("mean")))))
        x = x.withColumn("r", rate)
        slope = F.col("r") * (1 - F.col("r") / cap) * F.col("size") / F.col("mean")
        sums = x.groupBy("skey").agg(F.sum(F.col("n") * F.col("r") * F.col("size")).alias("f"), F.sum(F.col("n") * slope * F.col("size")).alias("g"))
        low, high = F.col("f") < F.col("target"), F.col("f") > F.col("target")
        new = state.join(sums, "skey", "left")
        new = new.withColumn("lo", F.when(low, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(high, F.col("tilt")).otherwise(F.col("hi")))
        newton = F.col("tilt") + (F.col("target") - F.col("f")) / F.col("g")
        middle = F.when(F.col("hi") > 9e5, 2 * F.greatest(F.col("tilt"), F.lit(0.5))).when(F.col("lo") < -9e5, 2 * F.least(F.col("tilt"), F.lit(-0.5))).otherwise((F.col("lo") + F.col("hi")) / 2)
        step = F.when((F.col("g") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("tilt")) < 8), newton).otherwise(middle)
        gap = F.coalesce(F.abs(F.col("f") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0))
        new = new.withColumn("gap", gap).withColumn("tilt", F.when(F.col("tilt").isNull(), F.col("tilt")).when(F.col("gap") < tolerance, F.col("tilt")).otherwise(step))
        old, state = state, materialize(new.select(*state.columns), "tilt")
        release(old)
        if (state.agg(F.max("gap")).first()[0] or 0.0) < tolerance:
            break
    return state


def copies_of(groups: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """skey, size, n, copies: whole copies of all documents of a (source, size) pair together."""

    def feed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        x, n, rate = pdf["size"].to_numpy(float), pdf["n"].to_numpy(), pdf["rate"].to_numpy(float)
        out, owed = np.zeros(len(pdf), np.int64), 0.0
        for i in range(len(pdf)):
            if x[i] > 0:
                owed += n[i] * rate[i] * x[i]
                out[i] = min(int(cap) * int(n[i]), max(0, int(np.floor(owed / x[i] + 0.5))))
                owed -= out[i] * x[i]
            else:
                out[i] = n[i]
        return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "n": n, "copies": out})

    rate = F.when(F.col("tilt").isNull(), F.lit(cap)).otherwise(F.lit(cap) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("mean"))))))
    rated = groups.join(state.select("skey", "tilt", "mean"), "skey").select("skey", "size", "n", rate.alias("rate"))
    return rated.groupBy("skey").applyInPandas(feed, "skey string, size long, n long, copies long")


def odd_copies(sized: DataFrame, groups: DataFrame) -> DataFrame:
    """skey, size, bits, s, t, tied, take: of a (source, size) pair the documents with the ``extra`` smallest hashes.

    groups has skey, size, n, extra. Documents of slices below s, and those of slice s with a hash up to t, are the smallest; of the ``tied``
    ones with the hash t itself ``take`` are among them. A pair of many documents is cut into slices by the first ``bits`` of the
    hashes, and only the slice that the border falls into is ranked.
    """
    width = F.ceil(F.log2(F.greatest(F.col("n") / SLICE, F.lit(1.0)))).cast("int")
    need = materialize(groups.where("extra > 0").select("skey", "size", "n", "extra", F.least(width, F.lit(30)).alias("bits")), "mix-need")
    rows = materialize(join_hot_inner(sized, need, ["skey", "size"], "n", rows_in(sized)).withColumn("s", sliced("h", "bits")), "mix-sliced")
    per = rows.groupBy("skey", "size", "s").agg(F.count("*").alias("m"), F.max("extra").alias("extra"))
    before = Window.partitionBy("skey", "size").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    border = materialize(per.where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("m"))).select("skey", "size", "s", (F.col("extra") - F.col("before")).alias("want")), "mix-border")
    whole = ["skey", "size", "s"]
    counted = rows.join(border, whole).groupBy(*whole, "bits", "want", "h").agg(F.count("*").alias("tied"))
    to = F.sum("tied").over(Window.partitionBy(*whole).orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("to", to).where((F.col("to") >= F.col("want")) & (F.col("to") - F.col("tied") < F.col("want")))
    out = materialize(counted.select("skey", "size", "bits", "s", F.col("h").alias("t"), "tied", (F.col("want") - F.col("to") + F.col("tied")).alias("take")), "mix-odd")
    release(need, rows, border)
    return out


def sliced(h: str, bits: str) -> Column:
    """The first ``bits`` bits of a hash as a number, 0 for no bits; hashes of a slice are ordered as signed numbers are."""
    top = F.shiftrightunsigned(F.col(h), 34)  # the first 30 bits
    return F.floor(top / F.pow(F.lit(2.0), F.lit(30) - F.col(bits))).cast("long")


def mix(docs: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, size: str | None = None, added: list[str] = ADDED) -> DataFrame:
    """The rows of docs with mix_size, mix_source_size, mix_target and mix_copies, or what ``added`` calls them.

    Size is the number of words of ``text``, or the column that size names; it is 0 for null or empty texts, which keep one copy and take no words. A null source is a
    source of its own, the last. Repeated rows are documents of their own. Columns of docs named like the added ones are replaced; all others stay, whatever their names.
    Equal inputs give equal results. Sizes are read first; texts are read again at the end and joined with a table of the (source, size) pairs.
    """
    tidy(docs.sparkSession)
    docs = docs.drop(*added)
    skey, own, h = fresh(docs, "skey", "words", "h")
    hashed = F.xxhash64("doc_id", *(["text"] if "text" in docs.columns else []))
    rows = docs.withColumn(own, words_of(F.col("text")) if size is None else F.col(size).cast("long")).withColumn(skey, source_key(F.col("source"))).withColumn(h, hashed)
    sized = materialize(rows.select(F.col(skey).alias("skey"), F.col(own).alias("size"), F.col(h).alias("h")), "mix-sizes")
    groups = materialize(sized.groupBy("skey", "size").agg(F.count("*").alias("n")), "mix-groups")
    goals = targets(groups, weights, share, cap)
    state = solve(groups, goals, cap)
    copies = copies_of(groups, state, cap).withColumn("base", F.floor(F.col("copies") / F.col("n"))).withColumn("extra", F.col("copies") % F.col("n"))
    copies = materialize(copies, "mix-copies")
    odd = odd_copies(sized, copies)
    plan = copies.join(odd, ["skey", "size"], "left").join(state.select("skey", "source_size", "target"), "skey")
    names = ["n", "base", "bits", "s", "t", "tied", "take", "source_size", "target"]
    total = rows_in(sized)
    out_names = fresh(rows, *names)
    plan = materialize(plan.select(F.col("skey").alias(skey), F.col("size").alias(own), *[F.col(c).alias(o) for c, o in zip(names, out_names, strict=True)]), "mix-plan")
    release(sized, groups)
    n, base, bits, s, t, tied, take, source_size, target = out_names
    out = join_hot(rows, plan, [skey, own], n, total, [h])
    mine = sliced(h, bits)
    out = out.withColumn(s, F.coalesce((mine < F.col(s)) | ((mine == F.col(s)) & (F.col(h) <= F.col(t))), F.lit(False)))
    split = plan.where(F.col(take) < F.col(tied))
    if split.limit(1).count():  # rows that nothing tells apart: some of them get the odd copy
        same = F.coalesce((F.col(h) == F.col(t)) & (F.col(take) < F.col(tied)), F.lit(False))
        rank = F.row_number().over(Window.partitionBy(skey, own, h).orderBy(h))
        out = out.where(~same).unionByName(out.where(same).withColumn(s, rank <= F.col(take)))
    values = [F.col(own), F.col(source_size), F.col(target), (F.col(base) + F.col(s).cast("long"))]
    return out.select(*docs.columns, *[v.alias(a) for v, a in zip(values, added, strict=True)])
