"""Structured Streaming: score arriving messages against a model snapshot, and learn from labelled events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensieve.functions.text import body_tokens
from tokensieve.operators.model import Model, combine, learn, token_probability
from tokensieve.operators.policy import category
from tokensieve.operators.score import score_messages
from tokensieve.options import DEFAULT, EngineOptions
from tokensieve.sources.store import ModelStore


def score_batch(rows: DataFrame, probs: DataFrame, o: EngineOptions = DEFAULT) -> DataFrame:
    """msg_id, score, category of (msg_id, text)."""
    scored = score_messages(rows.select("msg_id", body_tokens(F.col("text")).alias("tokens")), probs, o)
    return scored.select("msg_id", "score", category(F.col("score"), "filter", o).alias("category"))


def score_stream(stream: DataFrame, store: ModelStore, sink: Callable[[DataFrame, int], None], checkpoint: str, skip: Callable[[], DataFrame] | None = None):
    """Score each micro-batch with the store's newest model; ``skip`` names messages (msg_id) that have been classified already."""

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch if skip is None else batch.join(skip(), "msg_id", "left_anti")
        sink(score_batch(rows, token_probability(store.load())), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def learn_stream(stream: DataFrame, store: ModelStore, checkpoint: str):
    """Fold labelled events (msg_id, text, is_spam, sign) into the store; sign -1 unlearns.

    A micro-batch is one version, which names the batch. One that is run again after a failure or a restart is told by its number in the
    store and left out, as long as the store is written by one stream.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        held = store.epoch()
        if held is not None and epoch <= held:
            return
        rows = batch.select("msg_id", "is_spam", "sign", body_tokens(F.col("text")).alias("tokens"))
        model = combine(store.load(), learn(rows.where("sign > 0")))
        store.save(combine(model, learn(rows.where("sign < 0")), -1), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def by_address(messages: DataFrame, recipient: str, ham_address: str, spam_address: str) -> DataFrame:
    """Labelled events of the messages (msg_id, text) sent to the training addresses; others are no events."""
    to = F.lower(F.col(recipient))
    rows = messages.where(to.isin(ham_address.lower(), spam_address.lower()))
    return rows.select("msg_id", "text", (to == spam_address.lower()).alias("is_spam"), F.lit(1).alias("sign"))


def daily_volumes(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Windowed counts per day and category of (ts, category), final once ``delay`` has passed."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "category").agg(F.count("*").alias("n"))


def empty_model(spark) -> Model:
    return Model(spark.createDataFrame([], "token string, spamcount long, hamcount long"), spark.createDataFrame([(0, 0)], "nspam long, nham long"))
