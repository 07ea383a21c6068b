"""Scoring: tokens meet probabilities, the strongest clues of each message are combined."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.functions.combine import chi2q
from tokensieve.operators.model import exploded
from tokensieve.options import DEFAULT, EngineOptions


def clues(tokens: DataFrame, probs: DataFrame, o: EngineOptions = DEFAULT, by: list[str] | None = None) -> DataFrame:
    """The strongest clues of each message: by, token, prob, dist, rank.

    tokens has ``by`` (msg_id) and distinct tokens; probs has token, prob and whatever of ``by`` it shares with tokens. Unknown tokens have the neutral
    probability, which is far from none. Ties fall to the larger probability, then the larger token.
    """
    by = by or ["msg_id"]
    on = ["token", *[c for c in by if c in probs.columns]]
    dist = F.abs(F.col("prob") - 0.5)
    if abs(o.unknown_word_prob - 0.5) < o.minimum_prob_strength:  # unknown tokens are no clues: only strong ones take part in the join
        rows = tokens.join(probs.select(*on, "prob", dist.alias("dist")).where(F.col("dist") >= o.minimum_prob_strength), on)
    else:
        rows = tokens.join(probs.select(*on, "prob"), on, "left").withColumn("prob", F.coalesce("prob", F.lit(o.unknown_word_prob)))
        rows = rows.withColumn("dist", dist).where(F.col("dist") >= o.minimum_prob_strength)
    w = Window.partitionBy(*by).orderBy(F.desc("dist"), F.desc("prob"), F.desc("token"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= o.max_discriminators)


def combined(s: Column, h: Column, n: Column) -> Column:
    """(S - H + 1) / 2 of log sums; 0.5 without clues."""
    spam, ham = 1.0 - chi2q(-s, n), 1.0 - chi2q(-h, n)
    return F.when(n > 0, (spam - ham + 1.0) / 2.0).otherwise(0.5)


def score(messages: DataFrame, found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """messages with n_clues, spam_side, ham_side and score; those without clues score 0.5."""
    by = by or ["msg_id"]
    sums = found.groupBy(*by).agg(F.sum(F.log(1.0 - F.col("prob"))).alias("_s"), F.sum(F.log("prob")).alias("_h"), F.count("*").alias("_n"))
    rows = messages.join(sums, by, "left")
    n, s, h = F.coalesce("_n", F.lit(0)), F.coalesce("_s", F.lit(0.0)), F.coalesce("_h", F.lit(0.0))
    side = lambda x: F.when(n > 0, 1.0 - chi2q(-x, n)).otherwise(0.0)
    return rows.select(*messages.columns, n.alias("n_clues"), side(s).alias("spam_side"), side(h).alias("ham_side"), combined(s, h, n).alias("score"))


def score_messages(messages: DataFrame, probs: DataFrame, o: EngineOptions = DEFAULT) -> DataFrame:
    """msg_id, n_clues, spam_side, ham_side, score of (msg_id, tokens)."""
    return score(messages.select("msg_id"), clues(exploded(messages, "msg_id"), probs, o))


def evidence(found: DataFrame) -> DataFrame:
    """Per message its clues as an array of (prob, token), weakest spam sign first."""
    return found.groupBy("msg_id").agg(F.sort_array(F.collect_list(F.struct("prob", "token"))).alias("clues"))


def tile_bigrams(messages: DataFrame, probs: DataFrame, o: EngineOptions = DEFAULT) -> DataFrame:
    """msg_id and its strongest non-overlapping unigrams and bigrams (token, prob), strongest first.

    Clues are taken greedily by strength; a clue that uses a token position already used is left out; then the strongest are kept.
    """
    posed = messages.select("msg_id", F.posexplode("tokens").alias("i", "t"))
    before = F.lag("t").over(Window.partitionBy("msg_id").orderBy("i"))
    posed = posed.withColumn("p", before)
    two = F.struct(F.concat(F.lit("bi:"), "p", F.lit(" "), "t").alias("token"), (F.col("i") - 1).alias("a"), F.col("i").alias("b"))
    one = F.struct(F.col("t").alias("token"), F.col("i").alias("a"), F.col("i").alias("b"))
    every = posed.select("msg_id", F.explode(F.when(F.col("p").isNull(), F.array(one)).otherwise(F.array(one, two))).alias("x")).select("msg_id", "x.*")
    first = every.groupBy("msg_id", "token").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    rows = first.join(probs.select("token", "prob"), "token", "left").withColumn("prob", F.coalesce("prob", F.lit(o.unknown_word_prob))).withColumn("dist", F.abs(F.col("prob") - 0.5))
    rows = rows.where(F.col("dist") >= o.minimum_prob_strength).select("msg_id", "token", "prob", "dist", "a", "b")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[int] = set()
        out = []
        for r in pdf.sort_values(["dist", "prob", "token"], ascending=False).itertuples(index=False):
            if r.a not in seen and r.b not in seen:
                seen.update((r.a, r.b))
                out.append((r.msg_id, len(out) + 1, r.token, r.prob))
                if len(out) == o.max_discriminators:
                    break
        return pd.DataFrame(out, columns=["msg_id", "rank", "token", "prob"])

    kind = messages.schema["msg_id"].dataType.simpleString()
    return rows.groupBy("msg_id").applyInPandas(take, f"msg_id {kind}, rank int, token string, prob double")


def best_model(scores: DataFrame, cutoff: float) -> DataFrame:
    """msg_id and the first model, by ``ordinal``, whose score reaches the cutoff, else ``unsure``. scores: msg_id, ordinal, model, score."""
    hit = F.when(F.col("score") >= cutoff, F.struct("ordinal", "model"))
    return scores.groupBy("msg_id").agg(F.min(hit).alias("m")).select("msg_id", F.coalesce("m.model", F.lit("unsure")).alias("model"))
