"""Size-tiered compaction of immutable shards under a versioned manifest (operator 10).

A store is a folder: ``data/`` has shards, Parquet files that never change, and ``manifest/`` one JSON file a version. An append
writes its rows as small shards and commits a new version. Compaction puts the live shards into tiers by size; RUN or more of a tier are
merged into files of the target size, and the next version names those in place of the old. A version is committed by whoever creates its
claim, which fails if it exists, and then moves a whole manifest into place; the others start over from the new version. A claim is a
lease: its holder gives up after half of it, and when it has run out without a manifest its writer was lost, and the next one takes the claim away. Readers
see the shards of one version, whole. Shards that no version names any longer are deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm.common import fresh, hadoop, new_path

TARGET, BASE, RUN = 64 << 20, 4, 4
#: Seconds that a writer may hold a version it has claimed (clocks must agree within half of it), and how often a writer that lost starts over.
LEASE, TRIES = 60.0, 200


class Conflict(Exception):
    """Another writer has committed this version."""


class Store:
    """Shards and manifests below a folder of any store that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, run: int = RUN, lease: float = LEASE):
        self.spark, self.path, self.target, self.run, self.lease = spark, path.rstrip("/"), target, run, lease
        self._first_schema: str | None = None

    def version(self) -> int:
        """The newest version; 0 for an empty store."""
        fs, p = hadoop(self.spark, f"{self.path}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, shards: [{file, bytes, tier}]} of a version, the newest unless named."""
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = hadoop(self.spark, f"{self.path}/manifest/v{v:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def commit(self, shards: list[dict], schema: str | None, on: int) -> int:
        """Make shards the version after ``on``; raises Conflict if that exists."""
        fs, final = hadoop(self.spark, f"{self.path}/manifest/v{on + 1:010d}.json")
        if self.version() != on:
            raise Conflict(f"version {on} is no longer the newest")
        _, tmp = hadoop(self.spark, f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps({"version": on + 1, "schema": schema, "shards": shards}).encode("utf-8")))
        out.close()
        try:
            began = self._claim(on + 1)
            if time.time() - began > self.lease / 2 or self.version() != on or not fs.rename(tmp, final):
                raise Conflict(f"version {on + 1} could not be put in place")
        except Conflict:
            fs.delete(tmp, False)
            raise
        return on + 1

    def _claim(self, version: int) -> float:
        """The time at which this writer claimed the version; raises Conflict if another one holds it."""
        fs, claim = hadoop(self.spark, f"{self.path}/manifest/_claim-{version:010d}")
        began = time.time()
        try:
            fs.create(claim, False).close()  # creation is atomic: one writer gets the number
            return began
        except Exception as e:
            try:
                age = time.time() - fs.getFileStatus(claim).getModificationTime() / 1000
            except Exception:  # another writer has just taken it away
                age = 0.0
            if age > self.lease:  # its writer was lost; only one of those who see that can move the claim
                _, gone = hadoop(self.spark, f"{self.path}/manifest/_lost-{version:010d}-{uuid.uuid4().hex}")
                try:
                    fs.rename(claim, gone)
                except Exception:  # moved by another writer
                    pass
            raise Conflict(f"version {version} is taken") from e

    def _insist(self, change) -> int | None:
        """Commit what ``change`` makes of the newest manifest, again while other writers come first; None if it makes nothing."""
        for turn in range(TRIES):
            m = self.manifest()
            shards = change(m)
            if shards is None:
                return None
            try:
                return self.commit(shards, m["schema"] or self._first_schema, m["version"])
            except Conflict:
                time.sleep(min(1.0, self.lease / 20) * min(1.0, 0.05 * (turn + 1)))
        raise Conflict(f"gave up after {TRIES} tries")

    def tier(self, size: int) -> int:
        """0 for the smallest shards; each tier's are up to BASE times as large; files near the target are done."""
        done = math.ceil(math.log(max(self.target, 2) / (1 << 16), BASE)) + 1
        return done if size >= self.target * 3 // 4 else min(done - 1, max(0, math.ceil(math.log(max(size, 1) / (1 << 16), BASE))))

    def _write(self, df: DataFrame, name: str) -> list[dict]:
        """Write df's partitions as shards and list them."""
        folder = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        fs, p = hadoop(self.spark, folder)
        found = [(f.getPath().toString(), f.getLen()) for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")]
        return [{"file": f, "bytes": n, "tier": self.tier(n)} for f, n in sorted(found)]

    def append(self, df: DataFrame) -> int:
        """Add the rows as small shards, one for each partition, in one version. An arrival without rows adds an empty shard at most."""
        new = self._write(df, "arrival")
        self._first_schema = df.schema.json()
        return self._insist(lambda m: m["shards"] + new)

    def plan(self, m: dict) -> list[list[dict]]:
        """Runs to merge: the shards of a tier, smallest tier first, if there are RUN of them."""
        tiers: dict[int, list[dict]] = {}
        for s in m["shards"]:
            if s["bytes"] < self.target * 3 // 4:
                tiers.setdefault(s["tier"], []).append(s)
        return [sorted(t, key=lambda s: (s["bytes"], s["file"])) for k, t in sorted(tiers.items()) if len(t) >= self.run]

    def compact(self) -> int:
        """Merge until no tier holds RUN shards; returns the version then. Each merge reads its shards once and is one commit."""
        while True:
            m = self.manifest()
            runs = self.plan(m)
            if not runs:
                return m["version"]
            merged = runs[0]
            total = sum(s["bytes"] for s in merged)
            df = self.spark.read.schema(self._schema(m)).parquet(*[s["file"] for s in merged])
            files = max(1, round(total / self.target))
            new = self._write(df.coalesce(files) if files <= df.rdd.getNumPartitions() else df.repartition(files), "merged")
            gone = {s["file"] for s in merged}
            # if another compaction took some of them, the merge is in vain and a new plan is made
            self._insist(lambda m, gone=gone, new=new: [s for s in m["shards"] if s["file"] not in gone] + new if gone <= {s["file"] for s in m["shards"]} else None)

    def _schema(self, m: dict):
        from pyspark.sql import types as T

        return T.StructType.fromJson(json.loads(m["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``_shard`` naming the file of each; if the table has such a column, that of the file gets underscores added."""
        m = self.manifest(version)
        files = [s["file"] for s in m["shards"]]
        if not files:
            raise ValueError("the store is empty")
        rows = self.spark.read.schema(self._schema(m)).parquet(*files)
        return rows.withColumn(fresh(rows, "_shard")[0], F.input_file_name())

    def vacuum(self, keep: int = 1) -> int:
        """Delete the shards that none of the last ``keep`` versions names; returns how many."""
        last = self.version()
        live = {s["file"] for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)["shards"]}
        fs, p = hadoop(self.spark, f"{self.path}/data")
        gone = 0
        if fs.exists(p):
            for folder in fs.listStatus(p):
                for f in fs.listStatus(folder.getPath()):
                    if f.getPath().getName().startswith("part-") and f.getPath().toString() not in live:
                        gone += bool(fs.delete(f.getPath(), False))
        return gone


def shard_documents(docs: DataFrame, path: str | None = None, arrivals: int = 4, target: int = TARGET) -> Store:
    """Bring a table in as ``arrivals`` batches, each dealt by doc_id, and compact after all; equal rows stay apart, nulls are kept."""
    spark = docs.sparkSession
    store = Store(spark, path or new_path(spark, "store"), target)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(part == i))
    store.compact()
    return store
