"""Learning, unlearning, merging and querying token counts.

Messages are (msg_id, is_spam, tokens array<string>); a model is a pair of DataFrames: wordinfo (token,
spamcount, hamcount) and meta, one row (nspam, nham).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokensieve.options import DEFAULT, EngineOptions


@dataclass
class Model:
    wordinfo: DataFrame
    meta: DataFrame


def _count(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def exploded(messages: DataFrame, *keep: str) -> DataFrame:
    """Each distinct token of each message."""
    return messages.select(*keep, F.explode(F.array_distinct("tokens")).alias("token"))


def learn(messages: DataFrame) -> Model:
    """Counts of messages by label; a token counts once a message, a message without tokens counts in the totals."""
    spam = F.col("is_spam")
    info = exploded(messages, "is_spam").groupBy("token").agg(_count(spam).alias("spamcount"), _count(~spam).alias("hamcount"))
    return Model(info, messages.agg(_count(spam).alias("nspam"), _count(~spam).alias("nham")))


def combine(a: Model, b: Model, sign: int = 1) -> Model:
    """a plus (or minus) b. Counts stop at 0 and rows without counts go; message totals below 0 are an error."""
    signed = lambda m, s: m.wordinfo.select("token", (s * F.col("spamcount")).alias("spamcount"), (s * F.col("hamcount")).alias("hamcount"))
    info = signed(a, 1).unionByName(signed(b, sign)).groupBy("token").agg(*[F.greatest(F.sum(c), F.lit(0)).alias(c) for c in ("spamcount", "hamcount")])
    meta = a.meta.unionByName(b.meta.select(*[(sign * F.col(c)).alias(c) for c in ("nspam", "nham")])).agg(F.sum("nspam").alias("nspam"), F.sum("nham").alias("nham"))
    fail = F.raise_error(F.lit("more messages unlearned than learned")).cast("long")
    meta = meta.select(*[F.when(F.col(c) < 0, fail).otherwise(F.col(c)).alias(c) for c in ("nspam", "nham")])
    return Model(info.where("spamcount > 0 OR hamcount > 0"), meta)


def retrain(model: Model, before: DataFrame, after: DataFrame) -> Model:
    """Move messages between classes: before and after are (msg_id, is_spam, tokens); only changed labels matter, null is untrained."""
    moved = before.select("msg_id", F.col("is_spam").alias("was"), "tokens").join(after.select("msg_id", F.col("is_spam").alias("now")), "msg_id").where("NOT (was <=> now)")
    out = combine(model, learn(moved.where("was IS NOT NULL").select("msg_id", F.col("was").alias("is_spam"), "tokens")), -1)
    return combine(out, learn(moved.where("now IS NOT NULL").select("msg_id", F.col("now").alias("is_spam"), "tokens")))


def probability(spam: Column, ham: Column, nspam: Column, nham: Column, o: EngineOptions = DEFAULT) -> Column:
    """The adjusted spam probability of a token; null for a token that was never seen."""
    h, s = ham / F.greatest(nham, F.lit(1)).cast("double"), spam / F.greatest(nspam, F.lit(1)).cast("double")
    n = ham + spam
    return (F.lit(o.unknown_word_strength * o.unknown_word_prob) + n * F.try_divide(s, h + s)) / (F.lit(o.unknown_word_strength) + n)


def token_probability(model: Model, o: EngineOptions = DEFAULT) -> DataFrame:
    """token, spamcount, hamcount, prob. The one row of totals is broadcast."""
    return model.wordinfo.crossJoin(F.broadcast(model.meta)).select(
        "token", "spamcount", "hamcount", probability(F.col("spamcount"), F.col("hamcount"), F.col("nspam"), F.col("nham"), o).alias("prob")
    )


def query_words(probs: DataFrame, pattern: str, how: str = "exact", limit: int | None = None) -> DataFrame:
    """Tokens that equal, match as a wildcard or start like a regular expression, by token; n_all counts all that match."""
    from pyspark.sql import Window

    c = F.col("token")
    if how == "exact":
        out = probs.where(c == pattern)
    elif how == "wildcard":
        import re

        body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
        out = probs.where(c.rlike(f"(?s)^{body}$"))
    else:
        out = probs.where(c.rlike(f"^(?:{pattern})"))
    if limit is None:
        return out
    total = out.agg(F.count("*").alias("n_all"))
    return out.orderBy("token").limit(limit).crossJoin(F.broadcast(total))


def pure_words(model: Model, spam: bool, limit: int) -> DataFrame:
    """The most frequent tokens without a prefix that one class alone has."""
    own, other = ("spamcount", "hamcount") if spam else ("hamcount", "spamcount")
    rows = model.wordinfo.where((F.col(other) == 0) & ~F.contains("token", F.lit(":")))
    return rows.orderBy(F.desc(own), "token").limit(limit)


def inverted_index(messages: DataFrame, block: int = 4096) -> DataFrame:
    """token, is_spam, block, the number of messages and their ids in order. A row has the ids of one block, so a token that all messages hold makes many rows of bounded size."""
    rows = exploded(messages, "msg_id", "is_spam").withColumn("block", F.floor(F.col("msg_id") / block))
    return rows.groupBy("token", "is_spam", "block").agg(F.count("*").alias("n_msgs"), F.sort_array(F.collect_list("msg_id")).alias("msg_ids"))
