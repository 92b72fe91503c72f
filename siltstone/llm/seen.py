"""Problem 1: has this key been seen before? A log-structured store of sorted runs of key hashes.

A run is an immutable set of files in the shared folder, bucketed and sorted by the key's hash; the blocks of a file (row groups and
pages) carry their least and greatest hash as fences. A batch of new keys is brought into the same buckets and merge-joined with
the runs where they lie: no run is ever shuffled, not even when runs are merged. A hit counts only if the full key agrees. Keys not
met before become a new run of level 0; when a level has ``fanout`` runs they are merged into one of the next level.

Hashes are spread evenly, so a large batch meets every block and the join reads all hashes. A batch of at most ``point_keys`` keys
instead names its hashes: buckets without one of them are not opened, and within a file fences leave out the blocks without.

A manifest in the store's folder lists the runs, so that a store is opened again by another session and goes on from there. What is
written by a batch that broke off is in no manifest and never read. Nothing is kept in memory beyond the list of runs.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.hexes import hex_id
from siltstone.session import buckets_for, load_state, remove, save_state, scratch

BATCHES = 4
FANOUT = 3
HASH_BITS = 64
POINT_KEYS = 1_000
KNOWN = -1
ROW_GROUP = 8 << 20  # bytes of a block


@dataclass(frozen=True)
class Run:
    table: str
    path: str
    level: int


class KeyStore:
    """Keys with the arrival number of their first occurrence.

    ``hash_bits`` below 64 shortens the hashes (to study wrong answers of hashes alone); ``buckets`` is fixed for the life of a store
    and should suit the number of keys it is to hold; ``measure`` counts the wrong answers of each batch for ``report``. One writer
    at a time: a second one fails when it writes its manifest."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = FANOUT, hash_bits: int = HASH_BITS, measure: bool = True, point_keys: int = POINT_KEYS):
        self.spark, self.fanout, self.hash_bits, self.measure, self.point_keys = spark, fanout, hash_bits, measure, point_keys
        self.path = path or scratch(spark, "seen")
        self.buckets = buckets or buckets_for(spark, 0)
        self.runs: list[Run] = []
        self.metrics: list[dict] = []
        self.answered: list[str] = []
        self.number = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> KeyStore:
        """The store that a session, this or another, has left in ``path``."""
        number, state = load_state(spark, path)
        store = cls(spark, path, state["buckets"], state["fanout"], state["hash_bits"], **options)
        store.number, store.metrics, store.answered = number, state["metrics"], state["answered"]
        for r in state["runs"]:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {r['table']} (kh BIGINT, key STRING, first BIGINT) USING parquet CLUSTERED BY (kh) SORTED BY (kh) INTO {store.buckets} BUCKETS LOCATION '{r['path']}'")
            store.runs.append(Run(**r))
        return store

    def close(self) -> None:
        """Take the runs out of the session's catalogue; the files stay."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r.table}")

    def _save(self) -> None:
        self.number += 1
        save_state(self.spark, self.path, self.number, {"buckets": self.buckets, "fanout": self.fanout, "hash_bits": self.hash_bits, "runs": [asdict(r) for r in self.runs], "metrics": self.metrics, "answered": self.answered})

    def _hash(self, key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.hash_bits) if self.hash_bits < 64 else F.xxhash64(key)

    def _write(self, keys: DataFrame, level: int) -> Run:
        """A run of (kh, key, first), of rows that lie in the store's buckets."""
        name = f"seen_{uuid.uuid4().hex}"
        path = f"{self.path}/{level}-{name}"
        keys.select("kh", "key", "first").write.bucketBy(self.buckets, "kh").sortBy("kh").option("path", path).option("compression", "zstd").option("parquet.block.size", ROW_GROUP).saveAsTable(name)
        return Run(name, path, level)

    def _drop(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")
        remove(self.spark, run.path)

    def _keys(self, runs: list[Run]) -> DataFrame | None:
        """The keys of some runs. All have the same buckets, so that their union has them too and is joined and merged in place."""
        out = None
        for r in runs:
            t = self.spark.table(r.table)
            out = t if out is None else out.unionByName(t)
        return out

    def _compact(self) -> None:
        level = 0
        while any(r.level >= level for r in self.runs):
            old = [r for r in self.runs if r.level == level]
            if len(old) >= self.fanout:
                # a key stands in one run only; grouping has every bucket read by one task
                merged = self._write(self._keys(old).groupBy("kh", "key").agg(F.min("first").alias("first")), level + 1)
                self.runs = [r for r in self.runs if r.level != level] + [merged]
                self._save()
                for r in old:
                    self._drop(r)
            level += 1

    def lookup(self, hashes: list[int]) -> DataFrame | None:
        """The keys of the store with one of a few hashes, read from the blocks whose fences let them in; None of an empty store."""
        keys = self._keys(self.runs)
        return None if keys is None else keys.filter(F.col("kh").isin(hashes))

    def probe(self, keys: DataFrame, n_keys: int) -> DataFrame:
        """``keys`` (kh, key, first), distinct by key, with hash_hit (a run has the hash) and key_hit (it has the key)."""
        c = F.col
        if n_keys <= self.point_keys:
            old = self.lookup([r.kh for r in keys.select("kh").distinct().collect()])
        else:
            old = self._keys(self.runs)
        if old is None:
            return keys.withColumn("hash_hit", F.lit(False)).withColumn("key_hit", F.lit(False))
        met = keys.join(old.select(c("kh").alias("_kh"), c("key").alias("_key")), c("kh") == c("_kh"), "left")
        return met.groupBy("kh", "key").agg(F.min("first").alias("first"), F.max(c("_kh").isNotNull()).alias("hash_hit"), F.max(F.coalesce(c("_key") == c("key"), F.lit(False))).alias("key_hit"))

    def add(self, rows: DataFrame, answer: bool = True) -> DataFrame | None:
        """Take a batch (key, arrival) and say which of its rows came with a key seen before: their arrival numbers, written and
        listed in the manifest. Later batches must arrive later; null keys are left out and never seen. Without ``answer`` the keys
        are taken and nothing is said.

        Seen are all rows but the first ones of the new keys, so that only arrival numbers are joined and a hot key costs nothing."""
        firsts = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("arrival").alias("first")).withColumn("kh", self._hash(F.col("key")))
        batch = self._write(firsts.repartition(self.buckets, "kh"), 0)
        n_keys = self.spark.table(batch.table).count()  # from the files' footers
        if n_keys and (self.runs or self.measure):
            new = self._new_keys(batch, n_keys)
            self._drop(batch)
        else:
            new = batch
            self.metrics.append(dict.fromkeys(("key_hits", "hash_hits", "false_hits", "met", "wrong"), 0) | {"n_keys": n_keys})
        self.runs.append(new)
        path = None
        if answer:
            path = f"{self.path}/seen-{len(self.metrics) - 1}"
            first = self.spark.table(new.table).select(F.col("first").alias("arrival"))
            rows.filter(F.col("key").isNotNull()).select("arrival").join(first, "arrival", "left_anti").distinct().write.mode("overwrite").option("compression", "zstd").parquet(path)
            self.answered.append(path)
        self._save()
        self._compact()
        return self.spark.read.schema("arrival long").parquet(path) if path else None

    def _new_keys(self, batch: Run, n_keys: int) -> Run:
        """The keys of a batch that the store has not met, as a run; what was counted on the way is added to the metrics."""
        probed = self.probe(self.spark.table(batch.table), n_keys)
        counts = [F.count("*").alias("n_keys"), F.count_if("key_hit").alias("key_hits")]
        if self.measure:
            # a hash alone would also take a key for an earlier one of its own batch
            earlier = F.row_number().over(Window.partitionBy("kh").orderBy("first", "key")) > 1
            probed = probed.withColumn("hash_hit", F.col("hash_hit") | earlier)
            met = self._keys(self.runs)
            if met is None:
                probed = probed.withColumn("met", F.lit(False))
            else:  # by the keys themselves, without hashes and fences
                probed = probed.join(met.select("key", F.lit(True).alias("met")).distinct(), "key", "left").withColumn("met", F.coalesce("met", F.lit(False)))
            counts += [F.count_if("hash_hit").alias("hash_hits"), F.count_if(F.col("hash_hit") & ~F.col("met")).alias("false_hits"), F.count_if("met").alias("met"), F.count_if(F.col("met") != F.col("key_hit")).alias("wrong")]
            probed = probed.repartition(self.buckets, "kh")
        told = Observation()
        new = self._write(probed.observe(told, *counts).filter(~F.col("key_hit")), 0)
        self.metrics.append({k: v or 0 for k, v in told.get.items()})
        return new

    def answers(self) -> DataFrame:
        """The arrival numbers of all rows so far that came with a key seen before."""
        return self.spark.read.schema("arrival long").parquet(*self.answered)


def _arrivals(file_metadata: DataFrame) -> DataFrame:
    return file_metadata.select(hex_id("hash_code").alias("key"), F.col("row_id").alias("arrival"))


def ingest(file_metadata: DataFrame, hash_index: DataFrame, batches: int = BATCHES, **options) -> KeyStore:
    """A store that has taken hash_index, then the rows of file_metadata in ``batches`` equal parts by row_id."""
    spark = file_metadata.sparkSession
    options.setdefault("buckets", buckets_for(spark, file_metadata.count() + hash_index.count()))
    store = KeyStore(spark, **options)
    store.add(hash_index.select(hex_id("hash_code").alias("key"), F.lit(KNOWN).cast("long").alias("arrival")), answer=False)
    rows = _arrivals(file_metadata)
    cuts = rows.agg(F.percentile_approx("arrival", [i / batches for i in range(1, batches)] or [1.0], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    for a, b in zip([None, *cuts], [*cuts, None]):
        part = rows
        if a is not None:
            part = part.filter(F.col("arrival") > a)
        if b is not None:
            part = part.filter(F.col("arrival") <= b)
        store.add(part)
    return store


def seen_rows(store: KeyStore) -> DataFrame:
    """row_id of each row whose key was known or came in an earlier row. Null and blank keys are no keys; of rows with one row_id the
    answer is that of the id."""
    return store.answers().select(F.col("arrival").alias("row_id"))


def report(store: KeyStore) -> DataFrame:
    """For each batch of a store that measures: distinct keys, hits of their hashes (in earlier batches or by an earlier key of the
    batch), hits of the full keys, the rate of wrong answers that hashes alone would have given among the keys not met before, and
    the rate of wrong verified answers among all, against a join of the full keys. Of the records of a key not met before only the
    first can get a wrong answer from a hash, so the first rate is also that among the records not seen before."""
    rows = [(i, m["n_keys"], m["hash_hits"], m["key_hits"], m["false_hits"], m["false_hits"] / max(1, m["n_keys"] - m["met"]), m["wrong"] / max(1, m["n_keys"])) for i, m in enumerate(store.metrics)]
    return store.spark.createDataFrame(rows, "batch int, n_keys long, hash_hits long, key_hits long, false_hits long, hash_wrong_rate double, wrong_rate double")


def totals(store: KeyStore) -> DataFrame:
    """The number of different keys that a store has taken, as its batches add up, and of wrong verified answers: one row."""
    c = F.col
    return report(store).agg(F.sum(c("n_keys") - c("key_hits")).alias("n_distinct_keys"), F.round(F.sum(c("n_keys") * c("wrong_rate"))).cast("long").alias("n_wrong"))
