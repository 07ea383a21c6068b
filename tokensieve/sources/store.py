"""Model stores: versioned Parquet with a pointer, and the CSV exchange format."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.operators.model import Model, combine


class Versions:
    """A folder of versions. A version is whole before a pointer names it; pointers are numbered files that are never replaced, the newest counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/pointer")
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("v")) if fs.exists(p) else []

    def _point(self, name: str, epoch: int = -1) -> None:
        """Make a version the newest."""
        last = self._pointers()
        number = int(last[-1][1:13]) + 1 if last else 1
        fs, pointer = self._fs(f"{self.path}/pointer/v{number:012d}_{epoch}_{name}")
        fs.create(pointer, False).close()  # the name says it all, so the pointer is whole at once

    def newest(self) -> str | None:
        """The folder of the newest version."""
        last = self._pointers()
        return f"{self.path}/{last[-1].split('_')[2]}" if last else None


class ModelStore(Versions):
    """Versions of a model."""

    def save(self, model: Model, epoch: int | None = None) -> str:
        """Write a new version and point to it; epoch is the stream's batch that it holds, for which see epoch()."""
        name = uuid.uuid4().hex
        model.wordinfo.write.parquet(f"{self.path}/{name}/wordinfo")
        model.meta.write.parquet(f"{self.path}/{name}/meta")
        held = self.epoch() if epoch is None else epoch
        self._point(name, -1 if held is None else held)
        return name

    def epoch(self) -> int | None:
        """The last batch of a stream that the newest version holds."""
        last = self._pointers()
        held = int(last[-1].split("_")[1]) if last else -1
        return None if held < 0 else held

    def load(self) -> Model:
        folder = self.newest()
        if folder is None:
            raise FileNotFoundError(f"no model in {self.path}")
        read = self.spark.read.parquet
        return Model(read(f"{folder}/wordinfo"), read(f"{folder}/meta"))


class MessageInfoStore(Versions):
    """Versions of the table of what is known of messages: msg_id, c (h, s, u), t (trained as spam; null if untrained), date_modified."""

    SCHEMA = "msg_id string, c string, t boolean, date_modified timestamp"

    def load(self) -> DataFrame:
        folder = self.newest()
        return self.spark.createDataFrame([], self.SCHEMA) if folder is None else self.spark.read.schema(self.SCHEMA).parquet(folder)

    def _save(self, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}")
        self._point(name)

    def store(self, rows: DataFrame) -> None:
        """Put the rows in place of those with the same id; they are stamped with the time."""
        self._save(upsert(self.load(), rows.select("msg_id", "c", "t", F.current_timestamp().alias("date_modified")), "msg_id"))

    def remove(self, ids: DataFrame) -> None:
        """Forget messages."""
        self._save(self.load().join(ids.select("msg_id"), "msg_id", "left_anti"))


class CsvStore:
    """A model as one CSV export, by the same interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, model: Model, epoch: int | None = None) -> str:
        export_csv(model, self.path)
        return self.path

    def load(self) -> Model:
        return import_csv(self.spark, self.path)


STORES = {"parquet": ModelStore, "csv": CsvStore}


def open_store(spark: SparkSession, uri: str):
    """The store that a URI names: parquet:path or csv:path; a path alone is Parquet."""
    kind, _, path = uri.partition(":")
    return STORES[kind](spark, path) if kind in STORES else ModelStore(spark, uri)


def convert_store(source, target) -> None:
    """Copy totals and all words from a store to another."""
    target.save(source.load())


def probability_table(model: Model, path: str) -> DataFrame:
    """Write the token, prob table that scoring alone needs, and read it back."""
    from tokensieve.operators.model import token_probability

    token_probability(model).select("token", "prob").write.mode("overwrite").parquet(path)
    return model.wordinfo.sparkSession.read.parquet(path)


def write_corpus(messages: DataFrame, path: str) -> None:
    """(msg_id, raw) as a corpus of gzip-compressed rows."""
    messages.select("msg_id", "raw").write.mode("overwrite").option("compression", "gzip").parquet(path)


def read_corpus(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The messages of a corpus whose ids match a file-name pattern (* and ?)."""
    import re

    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return spark.read.parquet(path).where(F.col("msg_id").rlike(f"(?s)^{body}$"))


def export_csv(model: Model, path: str) -> None:
    """One row of totals (ham, spam), then token, ham, spam; the totals' row has no token."""
    rows = model.meta.select(F.lit(None).cast("string").alias("token"), F.col("nham").alias("ham"), F.col("nspam").alias("spam"))
    rows.unionByName(model.wordinfo.select("token", F.col("hamcount").alias("ham"), F.col("spamcount").alias("spam"))).write.mode("overwrite").option("nullValue", "\u0000").csv(path)


def import_csv(spark: SparkSession, path: str, into: Model | None = None) -> Model:
    """The model in a CSV file; merged with another it adds up."""
    rows = spark.read.schema("token string, ham long, spam long").option("nullValue", "\u0000").csv(path)
    meta = rows.where("token IS NULL").select(F.col("spam").alias("nspam"), F.col("ham").alias("nham"))
    got = Model(rows.where("token IS NOT NULL").select("token", F.col("spam").alias("spamcount"), F.col("ham").alias("hamcount")), meta)
    return got if into is None else combine(into, got)


def upsert(info: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """info with the rows of updates in place of those with the same key."""
    return info.join(updates.select(key), key, "left_anti").unionByName(updates)
