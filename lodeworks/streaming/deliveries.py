"""Exactly one row of each identifier out of a stream that delivers at least once.

A stream's micro-batches are merged into a keyed state of the best row seen so far. State is a log of runs: a micro-batch
writes one run, of the keys that it touches, and never rewrites what earlier ones wrote. As states of a key merge by maximum,
a look-up takes the greatest of all runs, and runs of one size are merged into one when there are so many. A run that lies
wholly behind the watermark moves from the hot runs to the archive, in which arrivals of keys that are not hot are looked
up, so that expiry never lets a copy through. A micro-batch writes its output and its run first and one small commit file
last; readers believe the commit files only, and a batch that is run again writes the same places.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeworks.sources.shared import Files, fresh

#: What a micro-batch reads of files at most.
BATCH_BYTES = 64 << 30


@dataclass
class DeliveryStore:
    """Runs, output and commits below ``root``, a folder that all executors share.

    ``key`` and ``rank`` are expressions over the stream's rows; ``row_id`` names a unique int64 column, ``event_time`` a
    timestamp. Of one key the row with the greatest rank stays (null is smallest), among equals the smallest row id.
    Rows with null key are never surplus and never kept in state. A null event time goes with its run.

    Scale: a micro-batch's work is its own rows, the keys of the hot runs, which the watermark bounds, and of the archive the
    keys in the ``buckets`` that it asks for. A key is written again as often as its run is merged, which is the logarithm of
    the number of micro-batches to the base ``fan_in``.
    """

    spark: SparkSession
    root: str
    key: Column
    rank: Column
    row_id: str
    event_time: str
    expiry_days: int = 30
    #: runs of one level that are merged into one of the next
    fan_in: int = 4
    #: parts of a run by key, of which look-ups read those they need
    buckets: int = 8

    def __post_init__(self) -> None:
        self.files = Files(self.spark, self.root)

    def committed(self) -> list[int]:
        return sorted(int(x.split(".")[0]) for x in self.files.names(f"{self.root}/commits") if x.endswith(".json"))

    def commit_of(self, n: int) -> dict:
        return json.loads(self.files.read(f"{self.root}/commits/{n}.json"))

    def _last(self, before: int) -> dict:
        if before > 0 and self.files.exists(f"{self.root}/commits/{before - 1}.json"):
            return self.commit_of(before - 1)
        done = [n for n in self.committed() if n < before]
        return self.commit_of(done[-1]) if done else {"hot": [], "archive": [], "latest": None, "dropped": []}

    def _place(self, run: str) -> str:
        return f"{self.root}/runs/run={run}"

    def _read(self, spark: SparkSession, like: DataFrame, runs: list[dict], touched: list[int] | None = None) -> DataFrame:
        """(k, b, best, seen) of some runs, of the touched buckets only."""
        schema = f"k string, best {like.schema['best'].dataType.simpleString()}, seen timestamp_ntz, run string, b int"
        df = spark.read.schema(schema).option("basePath", f"{self.root}/runs").parquet(*[self._place(r["id"]) for r in runs])
        return (df if touched is None else df.where(F.col("b").isin(touched))).select("k", "b", "best", "seen")

    def _write(self, df: DataFrame, run: str) -> None:
        df.hint("rebalance", "b").write.mode("overwrite").partitionBy("b").parquet(self._place(run))

    @staticmethod
    def _folded(df: DataFrame) -> DataFrame:
        return df.groupBy("k", "b").agg(F.max("best").alias("best"), F.max("seen").alias("seen"))

    def _prior(self, rows: DataFrame, last: dict, n: int) -> tuple[DataFrame | None, int]:
        """What earlier batches know of the keys of this one, and how many of those keys only the archive knew."""
        if not last["hot"] and not last["archive"]:
            return None, 0
        spark = rows.sparkSession
        touched = sorted(r.b for r in rows.select("b").distinct().collect())  # buckets, so few
        keys = rows.select("k", "b").distinct()
        kinds = []
        if last["hot"]:
            hot = self._folded(self._read(spark, rows, last["hot"], touched).join(keys, ["k", "b"], "left_semi"))
            kinds.append(hot.withColumn("late", F.lit(0)))
            keys = keys.join(hot.select("k", "b"), ["k", "b"], "left_anti")
        if last["archive"]:
            kinds.append(self._folded(self._read(spark, rows, last["archive"], touched).join(keys, ["k", "b"], "left_semi")).withColumn("late", F.lit(1)))
        found = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
        seen, place = Observation(), f"{self.root}/prior/{n}"
        found.observe(seen, F.coalesce(F.sum("late"), F.lit(0)).alias("late")).write.mode("overwrite").parquet(place)
        return spark.read.schema(found.schema).parquet(place).drop("late"), int(seen.get["late"])

    def merge(self, batch: DataFrame, n: int) -> None:
        """One micro-batch: output and run of batch ``n``, then its commit."""
        spark, last = batch.sparkSession, self._last(n)
        bucket = F.pmod(F.xxhash64("k"), F.lit(self.buckets)).cast("int")
        rows = batch.select(self.key.alias("k"), F.struct(self.rank.alias("rank"), (-F.col(f"`{self.row_id}`")).alias("neg")).alias("best"), F.col(f"`{self.event_time}`").cast("timestamp_ntz").alias("seen")).where("k is not null").select("k", bucket.alias("b"), "best", "seen")
        prior, late = self._prior(rows, last, n)
        candidates = rows if prior is None else rows.unionByName(prior)
        seen, run = Observation(), {"id": f"b{n}", "level": 0}
        self._write(self._folded(candidates).observe(seen, F.max("seen").cast("string").alias("latest"), F.count("*").alias("keys")), run["id"])
        run["latest"] = seen.get["latest"]
        row = (-F.col("best.neg")).alias(self.row_id)
        surplus = candidates.select(row).join(self._read(spark, rows, [run]).select(row), self.row_id, "left_anti")
        surplus.write.mode("overwrite").parquet(f"{self.root}/out/{n}")

        latest = max(filter(None, [run["latest"], last["latest"]]), default=None)
        mark = (datetime.fromisoformat(latest) - timedelta(days=self.expiry_days)) if latest else None
        hot, gone = [*last["hot"], run], []
        # in order of age only, so that what a hot run says of a key is never older than what the archive says
        while mark and hot and (not hot[0]["latest"] or datetime.fromisoformat(hot[0]["latest"]) < mark):
            gone.append(hot.pop(0))
        archive = [*last["archive"], *gone]
        hot, old = self._compacted(rows, hot, f"h{n}")
        archive, older = self._compacted(rows, archive, f"a{n}")
        commit = {"hot": hot, "archive": archive, "latest": latest, "keys": int(seen.get["keys"]), "late": late, "dropped": old + older}
        self.files.write_once(f"{self.root}/commits/{n}.json", json.dumps(commit))
        for r in last["dropped"]:  # no batch can be run again that still needs them
            self.files.delete(self._place(r))
        self.files.delete(f"{self.root}/prior/{n}")

    def _compacted(self, like: DataFrame, runs: list[dict], name: str) -> tuple[list[dict], list[str]]:
        """The runs with so many of one level merged into one of the next, as often as it goes; and the ids of those merged."""
        dropped: list[str] = []
        while full := [lv for lv in {r["level"] for r in runs} if sum(r["level"] == lv for r in runs) >= self.fan_in]:
            old = [r for r in runs if r["level"] == min(full)]  # neighbours in age, as levels fall with it
            new = {"id": f"{name}-{min(full) + 1}", "level": min(full) + 1, "latest": max(filter(None, (r["latest"] for r in old)), default=None)}
            self._write(self._folded(self._read(like.sparkSession, like, old)), new["id"])
            at = runs.index(old[0])
            runs = [*runs[:at], new, *(r for r in runs[at:] if r not in old)]
            dropped += [r["id"] for r in old]
        return runs, dropped

    def run(self, stream: DataFrame) -> None:
        """All that the source has now, as micro-batches; safe to run again after any failure."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.root}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()

    def trace(self) -> DataFrame:
        """(batch, keys, late) of the committed batches: keys that it touched, and those of them that only the archive knew."""
        rows = [(n, c["keys"], c["late"]) for n in self.committed() for c in [self.commit_of(n)]]
        return self.spark.createDataFrame(rows, "batch int, keys bigint, late bigint")

    def surplus(self) -> DataFrame:
        """(row_id) of all surplus rows of the committed batches."""
        parts = [f"{self.root}/out/{n}" for n in self.committed()]
        return self.spark.read.schema(f"`{self.row_id}` bigint").parquet(*parts) if parts else self.spark.createDataFrame([], f"`{self.row_id}` bigint")


def _store(spark: SparkSession, key: str, rank: str, row_id: str, event_time: str, expiry_days: int) -> DeliveryStore:
    k = F.upper(F.trim(F.col(f"`{key}`")))
    return DeliveryStore(spark, fresh(spark, "deliveries"), F.when(k != "", k), F.col(f"`{rank}`"), row_id, event_time, expiry_days)


def surplus_deliveries(spark: SparkSession, path: str, key: str, rank: str, row_id: str, event_time: str, expiry_days: int = 30, files_per_batch: int | None = None, bytes_per_batch: int = BATCH_BYTES) -> DataFrame:
    """(row_id) of each surplus row of a Parquet folder or file that is read as a stream.

    Keys are equal without outer blanks and letter case; rows with a null or blank key are never surplus. Of one key the
    row with the greatest ``rank`` stays (null smallest), among equals the one with the smallest ``row_id``. An empty table
    has no surplus rows. Other columns are not read.

    Scale: all steps are JVM aggregates and joins. The merge by key combines on the map side, so a key that holds a third
    of the rows leaves one state a task; the output is an anti join on the unique row id, which cannot be skewed.
    ``bytes_per_batch`` (or ``files_per_batch``) bounds a micro-batch; see the store for the work of one.
    """
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader.option("maxBytesPerTrigger", bytes_per_batch)
    if Files(spark, path).is_file(path):  # a stream's source is a folder
        folder, _, name = path.rstrip("/").rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(path)
    store = _store(spark, key, rank, row_id, event_time, expiry_days)
    store.run(stream)
    return store.surplus()


def landed_in_order(df: DataFrame, landing: Column, key: str, rank: str, row_id: str, event_time: str, expiry_days: int = 30) -> DeliveryStore:
    """The store after the rows of a table have landed one part after another, by the int ``landing``, each as a micro-batch.

    The columns needed are written to the shared folder by landing; each part is moved to the stream's source and the stream is
    started anew from its checkpoint, as it is when deliveries come days apart. Semantics are those of ``surplus_deliveries``.
    """
    spark = df.sparkSession
    store = _store(spark, key, rank, row_id, event_time, expiry_days)
    needed = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([key, rank, row_id, event_time])], landing.alias("_landing"))
    needed.hint("rebalance", "_landing").write.partitionBy("_landing").parquet(f"{store.root}/staged")
    parts = sorted((x for x in store.files.names(f"{store.root}/staged") if "=" in x), key=lambda x: int(x.split("=")[1]))
    for i, part in enumerate(parts):
        store.files.move(f"{store.root}/staged/{part}", f"{store.root}/in/{i}")
        store.run(spark.readStream.schema(needed.drop("_landing").schema).option("recursiveFileLookup", True).parquet(f"{store.root}/in"))
    return store


def kept_deliveries(spark: SparkSession, path: str, key: str, rank: str, row_id: str, event_time: str, **how) -> DataFrame:
    """The rows that stay: one of each key, and all rows without a key. Every column is kept."""
    return spark.read.parquet(path).join(surplus_deliveries(spark, path, key, rank, row_id, event_time, **how), row_id, "left_anti")
