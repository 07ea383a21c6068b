"""Corpus management: copies, checksums, groups, sets, expiry, search and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.functions.text import clean_body, loose_lines, quarters

#: Slices that an order is cut into for numbering.
SLICES = 256


def first_copies(messages: DataFrame, content: str, order: str) -> DataFrame:
    """order, first, n: for each message the first with the same content, and how many there are; null contents are alike.

    Only a digest is shuffled; the group's first comes from an aggregate, so copies do not meet in one window.
    """
    rows = messages.select(order, F.coalesce(F.md5(F.col(content).cast("binary")), F.lit("null")).alias("digest"))
    group = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return rows.join(group, "digest").select(order, "digest", "first", "n")


def checksum_keys(messages: DataFrame, key: str, text: str, loose: bool = False) -> DataFrame:
    """key, sub: the three keys that two adjacent parts of the fuzzy checksum make. A null text has none."""
    lines = loose_lines(F.col(text)) if loose else F.split(clean_body(F.col(text)), "\n")
    # the lines are a column of their own, so they are made once for all quarters
    c = messages.where(F.col(text).isNotNull()).select(key, lines.alias("l")).select(key, quarters(F.col("l")).alias("c"))
    subs = F.array(*[F.concat(F.lit(f"{i}:"), F.col("c")[i], F.lit("."), F.col("c")[i + 1]) for i in range(3)])
    return c.select(key, F.explode(subs).alias("sub"))


def fuzzy_matches(messages: DataFrame, key: str, text: str) -> DataFrame:
    """key, first: the first earlier message that shares two adjacent parts of the checksum.

    The first of each key comes from an aggregate; the join that follows has as many rows as keys, and a hot key is split by the adaptive join.
    """
    keys = checksum_keys(messages, key, text)
    first = keys.groupBy("sub").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return keys.join(first, "sub").where(F.col("first") < F.col(key)).groupBy(key).agg(F.min("first").alias("first"))


def by_md5(key: str, seed: int = 0) -> tuple[Column, Column]:
    """(number, digest): an order that looks random and is the same everywhere; the number is the first 15 digits of the digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), digest


def ranked(rows: DataFrame, by: list[str], order: Column, ties: list[Column], name: str, slices: int = SLICES) -> DataFrame:
    """rows with their number within a group in order of a numeric column, then of ties; no task sorts a whole group.

    The order is cut into slices at quantiles; rows are numbered within slices and the sizes of the slices before are added. The
    broadcast tables have ``slices`` bounds, and the window over slices sees as many rows a group.
    """
    rows = rows.withColumn("_o", order)
    cuts = rows.agg(F.percentile_approx("_o", [i / slices for i in range(1, slices)], 10 * slices).alias("_cuts"))
    rows = rows.crossJoin(F.broadcast(cuts)).withColumn("_slice", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<long>")), lambda c: c < F.col("_o")))).drop("_cuts")
    sizes = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slice").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_slice") == F.col("_s")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    rows = rows.join(sizes, same).withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_o", *ties)))
    return rows.drop("_o", "_slice", "_s", "_before", *[f"_by{i}" for i in range(len(by))])


def newest(rows: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """The ``keep`` rows that come last."""
    return rows.orderBy(*order).limit(keep)


def group_by_day(messages: DataFrame, ts: str) -> DataFrame:
    """messages with grp, whole days since the earliest message. The earliest time is one broadcast row."""
    first = messages.agg(F.min(ts).alias("_first"))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    return messages.crossJoin(F.broadcast(first)).withColumn("grp", F.floor(seconds / 86_400_000_000).cast("long")).drop("_first")


def deal_sets(messages: DataFrame, order: str, group: str, sets: int, per_set: int, groups: int) -> DataFrame:
    """order, set_no: round robin over the messages that are kept; 0 is the reservoir.

    Of each of the first ``groups`` groups the first sets * per_set messages are kept; the turn moves on kept messages only. What is kept
    is bounded by groups * sets * per_set rows, which one window numbers.
    """
    inside = F.row_number().over(Window.partitionBy(group).orderBy(order))
    early = messages.select(group).distinct().orderBy(group).limit(groups).withColumn("_g", F.lit(1))
    rows = messages.select(order, group).withColumn("_k", inside).join(F.broadcast(early), group, "left")
    kept = F.col("_g").isNotNull() & (F.col("_k") <= sets * per_set)
    turn = (F.row_number().over(Window.orderBy(group, order)) - 1) % sets + 1
    dealt = rows.where(kept).select(order, group, turn.cast("int").alias("set_no"))
    return dealt.unionByName(rows.where(~kept).select(order, group, F.lit(0).alias("set_no"))).select(order, "set_no")


def expire(messages: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """The messages that are not older than ``days``; what was learned from the others stays learned."""
    return messages.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change: what came and what went."""
    came = after.select(key).join(before.select(key), key, "left_anti").select(key, F.lit("added").alias("change"))
    went = before.select(key).join(after.select(key), key, "left_anti").select(key, F.lit("removed").alias("change"))
    return came.unionByName(went)


def identical(everything: DataFrame, spam: DataFrame, content: str) -> DataFrame:
    """everything with is_spam: whether a spam message has the same bytes."""
    k = [F.length(content).alias("_n"), F.sha2(F.col(content).cast("binary"), 256).alias("_d")]
    bad = spam.select(*k).distinct().withColumn("is_spam", F.lit(True))
    return everything.select("*", *k).join(bad, ["_n", "_d"], "left").withColumn("is_spam", F.coalesce("is_spam", F.lit(False))).drop("_n", "_d")


def search(corpora: dict[str, DataFrame], text: str, needle: str, limit: int) -> DataFrame:
    """The first messages (corpus, msg_id) of several corpora that contain a string, by corpus and id."""
    out = None
    for name, df in corpora.items():
        hit = df.where(F.contains(F.lower(F.col(text)), F.lit(needle.lower()))).select(F.lit(name).alias("corpus"), "msg_id")
        out = hit if out is None else out.unionByName(hit)
    return out.orderBy("corpus", "msg_id").limit(limit)


def days_around(messages: DataFrame, ts: str) -> DataFrame:
    """day, n, prior, next: how many messages a day has and the neighbouring days that have any."""
    d = messages.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")
    return d.select("day", "n", F.lag("day").over(w).alias("prior"), F.lead("day").over(w).alias("next"))


def success_curve(daily: DataFrame, order: str, right: str, total: str) -> DataFrame:
    """Running counts of right and all messages, and their ratio."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r, t = F.sum(right).over(w), F.sum(total).over(w)
    return daily.select(order, r.alias("right_so_far"), t.alias("total_so_far"), F.round(r / t, 6).alias("ratio"))


def span_average(daily: DataFrame, order: str, right: str, total: str, span: int) -> DataFrame:
    """The share of right messages over the last ``span`` steps, as differences of running counts."""
    w = Window.orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    c = daily.select(order, F.sum(right).over(run).alias("r"), F.sum(total).over(run).alias("t"))
    dr, dt = (F.col(x) - F.coalesce(F.lag(x, span).over(w), F.lit(0)) for x in ("r", "t"))
    return c.select(order, F.round(dr / dt, 6).alias("rate"))


def sample_keep(messages: DataFrame, by: str, key: str, keep: int, seed: int) -> DataFrame:
    """``keep`` messages of each directory by seeded digest; not bit-compatible with any generator of random numbers."""
    number, digest = by_md5(key, seed)
    return ranked(messages, [by], number, [digest], "_r").where(F.col("_r") <= keep).drop("_r")


def split_percent(messages: DataFrame, key: str, percent: float, seed: int) -> DataFrame:
    """messages with part 1 for about ``percent`` of them, else 2."""
    u = (by_md5(key, seed)[0] % 1_000_000) / 10_000.0
    return messages.withColumn("part", F.when(u < percent, 1).otherwise(2))


def split_n(messages: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return messages.withColumn("part", (by_md5(key, seed)[0] % n).cast("int"))


def equal_parts(messages: DataFrame, key: str, n: int) -> DataFrame:
    """messages with part 1 to n, of sizes that differ by one at most, the first ones larger."""
    number, digest = by_md5(key)
    total = messages.agg(F.count("*").alias("_n"))
    rows = ranked(messages, [], number, [digest], "_r").crossJoin(F.broadcast(total))
    size, more = F.floor(F.col("_n") / n), F.col("_n") % n
    large = more * (size + 1)
    part = F.when(F.col("_r") <= large, F.ceil(F.col("_r") / (size + 1))).otherwise(more + F.ceil((F.col("_r") - large) / F.greatest(size, F.lit(1))))
    return rows.withColumn("part", part.cast("int")).drop("_r", "_n")


def rebalance(messages: DataFrame, key: str, set_col: str, size: int) -> DataFrame:
    """key, set_no: every set brought to ``size`` messages; the surplus goes to the reservoir (0), which refills the others. Sets are few, and broadcast."""
    number, digest = by_md5(key)
    rows = ranked(messages.select(key, set_col), [set_col], number, [digest], "_r")
    stay = rows.where((F.col(set_col) != 0) & (F.col("_r") <= size))
    spare = ranked(rows.where((F.col(set_col) == 0) | (F.col("_r") > size)).select(key), [], number, [digest], "_n")
    need = messages.where(F.col(set_col) != 0).groupBy(set_col).count().select(F.col(set_col).alias("to"), F.greatest(F.lit(size) - F.col("count"), F.lit(0)).alias("need"))
    last = F.sum("need").over(Window.orderBy("to"))
    need = need.select("to", (last - F.col("need")).alias("a"), last.alias("b"))
    moved = spare.join(F.broadcast(need), (F.col("_n") > F.col("a")) & (F.col("_n") <= F.col("b")), "left").select(key, F.coalesce("to", F.lit(0)).alias("set_no"))
    return stay.select(key, F.col(set_col).alias("set_no")).unionByName(moved)


def interleave(messages: DataFrame, key: str) -> DataFrame:
    """messages with pos: ham and spam in an order that keeps their shares even throughout. key is a number.

    A message of rank r among n of its class stands at (r - 0.5) / n; its position follows from how many of the other class stand before, which
    is arithmetic, so nothing is sorted as a whole.
    """
    n = messages.groupBy().agg(F.sum(F.col("is_spam").cast("long")).alias("_ns"), F.sum((~F.col("is_spam")).cast("long")).alias("_nh"))
    rows = ranked(messages, ["is_spam"], F.col(key), [], "_r").crossJoin(F.broadcast(n))
    own, other = F.when(F.col("is_spam"), F.col("_ns")).otherwise(F.col("_nh")), F.when(F.col("is_spam"), F.col("_nh")).otherwise(F.col("_ns"))
    # the other class has s before it where (s - 0.5) / other < (r - 0.5) / own; ham comes first where they stand alike
    at = (2 * F.col("_r") - 1) * other + own
    before = F.when(F.col("is_spam"), F.floor(at / (2 * own))).otherwise(F.ceil(at / (2 * own)) - 1)
    return rows.withColumn("pos", (F.col("_r") + F.least(other, F.greatest(before, F.lit(0)))).cast("long")).drop("_r", "_ns", "_nh")
