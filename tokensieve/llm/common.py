"""Helpers that the training-data operators share.

Everything that has to outlive a lost executor is written as Parquet below the folder
named by ``spark.checkpoint.dir``; nothing is kept in a machine-local folder on a cluster.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot when it holds more than 1/HOT_SHARES of all rows, so at most HOT_SHARES keys can be hot.
HOT_SHARES = 512
#: Rows of a small table that a task writes, and tasks that write it at least.
TASK_ROWS, FEWEST = 20_000, 8

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is configured."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix=f"{app}-", dir="/tmp/checkpoints")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def hadoop(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path, through Hadoop so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the session has ended already; the folder is the cluster's to clean
            return


def materialize(df: DataFrame, name: str, at_most: int | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back. They are counted on the way; see rows_in.

    Where a bound on their number is known, no more tasks write them than TASK_ROWS rows each need, FEWEST at least.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if at_most is not None:
        df = df.coalesce(max(FEWEST, -(-at_most // TASK_ROWS)))
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    out._llm_rows = seen.get["n"]
    return out


def rows_in(df: DataFrame) -> int:
    """How many rows a materialized frame has."""
    return df._llm_rows


def release(*dfs: DataFrame) -> None:
    """Delete the files of materialized frames that no later result reads."""
    for df in dfs:
        if path := getattr(df, "_llm_path", None):
            remove(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Shuffle files go once the driver's references to them are collected, by default every half hour; ask for it now.

    All that is read later has been written to the shared folder, so nothing needs them.
    """
    gc.collect()
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small whatever the length of the texts in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors where PYTHONPATH does not bring it along."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    if f"shipped {app}" in _OWN or any(os.path.abspath(p) == root for p in os.environ.get("PYTHONPATH", "").split(":") if p):
        return
    _OWN[f"shipped {app}"] = root
    out = os.path.join(tempfile.mkdtemp(), "tokensieve.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tokensieve")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(out)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has such columns already, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_hot(left: DataFrame, right: DataFrame, key: list[str], n: str, total: int, spread: list[str]) -> DataFrame:
    """left LEFT JOIN right on key, where right has one row per key and n says how many left rows share it.

    The hot keys, at most HOT_SHARES, are broadcast; their left rows take part in the second,
    shuffled join under a salted key that matches nothing, so no partition receives a hot group.
    """
    payload = [c for c in right.columns if c not in key]
    salt, *held = fresh(left, "salt", *[f"hot_{c}" for c in payload])
    is_hot = F.col(n) * HOT_SHARES > F.lit(max(total, HOT_SHARES))
    hot = right.where(is_hot).select(*key, *[F.col(c).alias(h) for c, h in zip(payload, held, strict=True)])
    cold = right.where(~is_hot).withColumn(salt, F.lit(0))
    out = left.join(F.broadcast(hot), key, "left")
    salted = F.when(F.col(held[payload.index(n)]).isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(9973)).cast("int") + 1).otherwise(0)
    out = out.withColumn(salt, salted).join(cold, [*key, salt], "left")
    for c, h in zip(payload, held, strict=True):
        out = out.withColumn(c, F.coalesce(F.col(h), F.col(c))).drop(h)
    return out.drop(salt)


def join_hot_inner(left: DataFrame, right: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """left JOIN right on key, as join_hot: rows of hot keys meet a broadcast, the others alone are shuffled. left is read twice, so it should be a written table."""
    is_hot = F.col(n) * HOT_SHARES > F.lit(max(total, HOT_SHARES))
    hot, cold = F.broadcast(right.where(is_hot)), right.where(~is_hot)
    return left.join(hot, key).unionByName(left.join(F.broadcast(right.where(is_hot).select(*key)), key, "left_anti").join(cold, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b): component is the smallest node reachable.

    Labels fall to the smallest label among the neighbours and then jump along the label
    itself, so the rounds grow with the logarithm of a component's width. Every round is one write to the
    shared folder. The joins are between written tables, which lets skewed keys be split.
    """
    both = materialize(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b"), "edges")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    label = materialize(label, "labels", rows_in(both))
    while rows_in(label):
        near = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        low = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "c").alias("low"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("next"))
        new = low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("component"), "was")
        changed = Observation()
        new = materialize(new.observe(changed, F.count(F.when(F.col("component") != F.col("was"), 1)).alias("n")), "labels", rows_in(label))
        release(label)
        label = new
        if not changed.get["n"]:
            break
    release(both)
    out = label.select("node", "component")
    out._llm_path, out._llm_rows = label._llm_path, label._llm_rows
    return out
