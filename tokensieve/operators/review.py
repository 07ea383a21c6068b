"""Around the score: message state, review lists, evidence, headers of the engine's own, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.operators.policy import category
from tokensieve.options import DEFAULT, EngineOptions

#: The headers that the engine writes; all begin alike.
OWN_HEADER = "X-Sieve-"
#: Clues within so much of 0 or 1 are shown in the evidence header; wrapped lines stay below WIDTH characters.
EVIDENCE_CUTOFF, WIDTH = 0.5, 78
#: Age in days beyond which a day graph shows nothing, days a column, and lines of its scale.
EXPIRE, GROUPING = 120, 2


def evidence_list(found: DataFrame, scored: DataFrame) -> DataFrame:
    """msg_id, clues: (token, prob) by prob, after *H* and *S*, the two sides of the score (ham_side, spam_side)."""
    own = found.groupBy("msg_id").agg(F.sort_array(F.collect_list(F.struct("prob", "token"))).alias("found"))
    side = lambda n, c: F.struct(F.lit(n).alias("token"), F.col(c).cast("double").alias("prob"))
    clues = F.transform(F.coalesce("found", F.array().cast("array<struct<prob:double,token:string>>")), lambda c: F.struct(c["token"].alias("token"), c["prob"].alias("prob")))
    return scored.join(own, "msg_id", "left").select("msg_id", F.concat(F.array(side("*H*", "ham_side"), side("*S*", "spam_side")), clues).alias("clues"))


def shown_clues(clues: Column, cutoff: float = EVIDENCE_CUTOFF) -> Column:
    """'token': 0.99 for the sides and each clue that is strong enough."""
    quote = lambda t: F.when(F.contains(t, F.lit("'")) & ~F.contains(t, F.lit('"')), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))
    strong = F.filter(clues, lambda c: c["token"].isin("*H*", "*S*") | (c["prob"] <= cutoff) | (c["prob"] >= 1 - cutoff))
    return F.transform(strong, lambda c: F.concat(quote(c["token"]), F.lit(": "), F.format_string("%.2f", F.bround(F.round(c["prob"], 6) * 100, 0) / 100)))


def wrapped(name: str, parts: Column, width: int = WIDTH) -> Column:
    """Parts joined by '; ', folded where a header line would reach the width."""
    start = F.struct(F.lit("").alias("out"), F.lit(len(name) + 2).alias("at"), F.lit(0).alias("n"))

    def add(a: Column, p: Column) -> Column:
        fits = a["at"] + 2 + F.length(p) < width
        first = a["n"] == 0
        # the width counts the parts of a line, without what stands between them
        at = F.when(first | fits, a["at"]).otherwise(F.lit(8)) + F.length(p)
        return F.struct(F.concat(a["out"], F.when(first, "").when(fits, "; ").otherwise(";\n\t"), p).alias("out"), at.cast("int").alias("at"), (a["n"] + 1).alias("n"))

    return F.aggregate(parts, start, add, lambda a: a["out"])


def unique_ids(messages: DataFrame, key: str, ts: str) -> DataFrame:
    """messages with msg_name: the second of arrival, and a number from the second message of that second on."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    n = F.row_number().over(Window.partitionBy(at).orderBy(key))
    second = at.cast("string")
    return messages.withColumn("msg_name", F.when(n > 1, F.concat(second, F.lit("-"), (n - 1).cast("string"))).otherwise(second))


def own_headers(headers: Column) -> Column:
    """The engine's own headers, to be restored later."""
    return F.filter(headers, lambda h: h["name"].startswith(OWN_HEADER))


def foreign_headers(headers: Column) -> Column:
    return F.filter(headers, lambda h: ~h["name"].startswith(OWN_HEADER))


def unnotate(text: Column, mark: Column) -> Column:
    """The text without its mark, taken off once."""
    begin = F.concat(mark, F.lit(","))
    return F.when(F.startswith(text, begin), F.substring(text, F.length(begin) + 1, F.length(text))).otherwise(text)


def message_state(messages: DataFrame, info: DataFrame) -> DataFrame:
    """messages with what is known of them: c (ham, spam or unsure as h, s, u) and t (trained as spam; null if untrained)."""
    return messages.join(info.select("msg_id", "c", "t"), "msg_id", "left")


def review_sections(scored: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` messages of each category by the given order."""
    w = Window.partitionBy("category").orderBy(*order)
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def review_action(label: Column, score: Column, spam_level: float = 100.0, ham_level: float = -1.0, defaults: tuple[str, str, str] = ("discard", "discard", "defer")) -> Column:
    """What a review page proposes: discard beyond a level, else the label's default (spam, ham, unsure)."""
    spam, ham, unsure = defaults
    return (
        F.when((label == "spam") & (score > spam_level), "discard").when(label == "spam", spam)
        .when((label == "ham") & (score < ham_level), "discard").when(label == "ham", ham).otherwise(unsure)
    )


def session_counters(events: DataFrame, o: EngineOptions = DEFAULT) -> DataFrame:
    """The seven counters of a log of events: kind (classify, train), score, as_ham, old_score, old_class.

    A training counts as a false positive if it takes a message back that scored above the spam cutoff or was called spam; likewise false negatives.
    """
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    seen, trained, ham = F.col("kind") == "classify", F.col("kind") == "train", F.col("as_ham")
    label = category(F.col("score"), "tester", o)
    was_spam = F.coalesce(F.col("old_score") > o.spam_cutoff, F.lit(False)) | F.coalesce(F.col("old_class") == "spam", F.lit(False))
    was_ham = F.coalesce(F.col("old_score") < o.ham_cutoff, F.lit(False)) | F.coalesce(F.col("old_class") == "ham", F.lit(False))
    return events.agg(
        n(seen & (label == "ham")).alias("num_ham"), n(seen & (label == "spam")).alias("num_spam"), n(seen & (label == "unsure")).alias("num_unsure"),
        n(trained & ham).alias("num_trained_ham"), n(trained & ham & was_spam).alias("num_trained_ham_fp"),
        n(trained & ~ham).alias("num_trained_spam"), n(trained & ~ham & was_ham).alias("num_trained_spam_fn"),
    )


def folder_counts(scored: DataFrame, folder: str) -> DataFrame:
    """Per folder how many messages are ham, spam and unsure."""
    n = lambda c: F.sum((F.col("category") == c).cast("long"))
    return scored.groupBy(folder).agg(n("ham").alias("ham"), n("spam").alias("spam"), n("unsure").alias("unsure"))


def bulk_report(scored: DataFrame, text: Column, reverse: bool = False) -> DataFrame:
    """msg_id, line: number, score and S, . or U of each message; clues (text) where the report lists them.

    A report lists spam and unsure messages, or ham and unsure ones if reversed; both cutoffs are inclusive.
    """
    label = category(F.col("score"), "bulk")
    mark = F.when(label == "spam", "S").when(label == "ham", ".").otherwise("U")
    line = F.concat(F.lpad(F.col("msg_id").cast("string"), 6, " "), F.lit(" "), F.format_string("%.2f", F.bround(F.col("score") * 100, 0) / 100), F.lit(" "), mark, F.lit(" "), text)
    return scored.where(label != ("spam" if reverse else "ham")).select("msg_id", line.alias("line"))


def mailbox_counts(parsed: DataFrame) -> DataFrame:
    """good, bad: messages with a To or Cc header, and those without."""
    addressed = F.exists("headers", lambda h: F.lower(h["name"]).isin("to", "cc"))
    return parsed.agg(F.sum(addressed.cast("long")).alias("good"), F.sum((~addressed).cast("long")).alias("bad"))


def merge_histograms(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket counts n of two histograms added up."""
    return a.select(*keys, "n").unionByName(b.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n"))


def plotted(buckets: DataFrame, bucket: str, n: str, nbuckets: int) -> DataFrame:
    """x, y for a plot: the bucket's place in per cent and its count."""
    return buckets.select((100.0 * F.col(bucket) / nbuckets).alias("x"), F.col(n).alias("y"))


def day_graph(days: DataFrame, values: list[int], expire: int = EXPIRE, grouping: int = GROUPING) -> DataFrame:
    """value, line: a graph of (age, category, n) with a column for each ``grouping`` days, the oldest first.

    A column shows s, h or u if that many messages a day were spam, ham or unsure; of several the least frequent, in capitals. Ages are days;
    those of ``expire`` and more are left out, so a graph has a bounded number of columns.
    """
    slots = expire // grouping
    n = lambda c: F.floor(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)) / grouping)
    spark = days.sparkSession
    per = days.where((F.col("age") >= 0) & (F.col("age") < expire)).groupBy(F.floor(F.col("age") / grouping).alias("slot")).agg(n("spam").alias("s"), n("ham").alias("h"), n("unsure").alias("u"))
    grid = spark.range(slots).select(F.col("id").alias("slot")).crossJoin(spark.createDataFrame([(v,) for v in values], "value int"))
    x = grid.join(F.broadcast(per), "slot", "left").fillna(0, ["s", "h", "u"])
    v = F.col("value")
    shown = F.array_compact(F.array(*[F.when(F.col(c) >= v, F.struct(F.col(c).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("c"))) for i, c in enumerate("shu")]))
    least = F.array_min(shown)["c"]
    x = x.withColumn("char", F.when(F.size(shown) == 0, " ").when(F.size(shown) == 1, least).otherwise(F.upper(least)))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("slot")).alias("o"), "char"))), lambda r: r["char"]), "")
    return x.groupBy("value").agg(line.alias("body")).select("value", F.concat(F.lpad(F.col("value").cast("string"), 5, " "), F.lit("|"), "body").alias("line"))


def live_lookups(cache: DataFrame, now: Column) -> DataFrame:
    """key, answer of the lookups that have not run out; of several for a key the one that lasts longest. ttl is in seconds; null answers are negative ones."""
    from_ = F.unix_seconds(F.col("asked"))
    rows = cache.withColumn("until", from_ + lifetime(F.col("ttl"), F.col("answer"))).where(F.col("until") > F.unix_seconds(now))
    return rows.groupBy("key").agg(F.max(F.struct("until", "answer")).alias("m")).select("key", "m.answer", "m.until")


def lifetime(ttl: Column, answer: Column, least: int = 86_400, most: int = 7 * 86_400, negative: int = 300) -> Column:
    """Seconds that a lookup is kept: its own, from a day to a week, and five minutes for negative ones."""
    return F.when(answer.isNull(), F.lit(negative)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), ttl)))


def pruned(cache: DataFrame, used: str, most: int = 5000, keep: int = 2500) -> DataFrame:
    """The cache, or of one with over ``most`` rows the ``keep`` rows that were used last."""
    rank = cache.orderBy(F.desc(used), "key").limit(keep).select("key").withColumn("kept", F.lit(True))
    full = cache.agg((F.count("*") > most).alias("full"))
    return cache.join(rank, "key", "left").crossJoin(F.broadcast(full)).where("NOT full OR kept").drop("kept", "full")
