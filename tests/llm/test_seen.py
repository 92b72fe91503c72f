"""The store of keys against brute force."""

import random
import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from siltstone.llm import seen


def brute(data, known):
    have, out = {k.strip().lower() for k in known if k and k.strip()}, set()
    for i, k in sorted(data, key=lambda r: r[0]):
        k = (k or "").strip().lower()
        if k:
            if k in have:
                out.add(i)
            have.add(k)
    return out


@pytest.mark.parametrize("batches, fanout, bits", [(1, 3, 64), (5, 2, 64), (4, 3, 6)])
def test_like_brute_force(spark, batches, fanout, bits):
    r = random.Random(batches)
    data = [(i, r.choice([None, " ", "hot", "HOT "]) if r.random() < 0.4 else f"k{r.randrange(120)}") for i in range(600)]
    known = ["K1", " k2", None, "", "k1", "other"]
    fm = spark.createDataFrame(data, "row_id long, hash_code string").withColumn("key", F.lit("clash"))
    ix = spark.createDataFrame([(k,) for k in known], "hash_code string")
    store = seen.ingest(fm, ix, batches, fanout=fanout, hash_bits=bits)
    assert {r[0] for r in rows(seen.seen_rows(store))} == brute(data, known)
    report = seen.report(store).collect()
    assert len(report) == batches + 1 and all(r.wrong_rate == 0 for r in report)
    # short hashes meet where keys do not, and only the full key tells
    assert (sum(r.false_hits for r in report) > 0) == (bits == 6)
    assert len(store.runs) <= 2 * fanout


@pytest.mark.parametrize("batches, bits", [(1, 6), (3, 7)])
def test_wrong_answers_of_hashes_like_brute_force(spark, batches, bits):
    fm = spark.createDataFrame([(i, f"k{i // 2}") for i in range(240)], "row_id long, hash_code string")
    store = seen.ingest(fm, fm.select("hash_code").limit(0), batches, fanout=2, hash_bits=bits)
    kh = {r.key: r.kh for r in spark.createDataFrame([(f"k{i}",) for i in range(120)], "key string").withColumn("kh", store._hash(F.col("key"))).collect()}
    have, wrong = set(), 0
    for i in range(120):
        wrong += kh[f"k{i}"] in have
        have.add(kh[f"k{i}"])
    report = seen.report(store).collect()
    assert sum(r.false_hits for r in report) == wrong > 0 and all(r.wrong_rate == 0 for r in report)
    if batches == 1:
        assert report[1].hash_wrong_rate == wrong / 120


def test_wrong_verified_answers_are_measured(spark, monkeypatch):
    probe = seen.KeyStore.probe
    monkeypatch.setattr(seen.KeyStore, "probe", lambda self, keys, n: probe(self, keys, n).withColumn("key_hit", F.col("hash_hit")))
    fm = spark.createDataFrame([(i, f"k{i}") for i in range(120)], "row_id long, hash_code string")
    assert any(r.wrong_rate > 0 for r in seen.report(seen.ingest(fm, fm.select("hash_code").limit(9), 2, hash_bits=6)).collect())


def test_totals(spark, monkeypatch):
    fm = spark.createDataFrame([(i, f"k{i % 70}") for i in range(120)], "row_id long, hash_code string")
    ix = spark.createDataFrame([("K1 ",), ("other",), (None,)], "hash_code string")
    assert rows(seen.totals(seen.ingest(fm, ix, 3))) == [(71, 0)]
    # answers by short hashes alone are wrong, and that shows
    probe = seen.KeyStore.probe
    monkeypatch.setattr(seen.KeyStore, "probe", lambda self, keys, n: probe(self, keys, n).withColumn("key_hit", F.col("hash_hit")))
    got = seen.totals(seen.ingest(fm, ix, 3, hash_bits=5)).first()
    assert got.n_wrong > 0 and got.n_distinct_keys < 71


def test_no_rows(spark):
    fm = spark.createDataFrame([], "row_id long, hash_code string")
    store = seen.ingest(fm, fm.select("hash_code"))
    assert seen.seen_rows(store).count() == 0


def numbers(spark, a, b):
    return spark.range(a, b).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("arrival"))


def plan_of(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_neither_runs_nor_batches_in_place_are_shuffled(spark):
    store = seen.KeyStore(spark, fanout=9)
    for i in range(3):
        store.add(numbers(spark, i * 50, i * 50 + 100))
    plan = plan_of(store.probe(spark.table(store.runs[0].table), 10**9))
    assert plan.count("Bucketed: true") == 4 and "SortMergeJoin" in plan and "Exchange" not in plan
    merged = store._keys(store.runs).groupBy("kh", "key").agg(F.min("first").alias("first"))
    assert "Exchange" not in plan_of(merged)
    assert all(len(spark.table(r.table).inputFiles()) <= store.buckets for r in store.runs)
    store.close()


@pytest.mark.parametrize("point_keys", [0, 1000])
def test_another_session_goes_on(spark, point_keys):
    store = seen.KeyStore(spark, fanout=2, buckets=5, point_keys=point_keys)
    assert store.add(numbers(spark, 0, 100)).count() == 0
    assert store.add(numbers(spark, 80, 150).withColumn("arrival", F.col("arrival") + 1000)).count() == 20
    store.close()
    other = seen.KeyStore.open(spark.newSession(), store.path, point_keys=point_keys)
    assert (other.buckets, other.fanout, other.hash_bits) == (5, 2, 64)
    late = spark.createDataFrame([("k149", 3000), ("k150", 3001), ("k150", 3002), (None, 3003)], "key string, arrival long")
    assert rows(other.add(late)) == [(3000,), (3002,)]
    assert other.answers().count() == 22 and [m["n_keys"] for m in other.metrics] == [100, 70, 2]
    other.close()
    again = seen.KeyStore.open(spark, store.path)
    assert again._keys(again.runs).count() == 151
    again.close()


def test_a_small_batch_opens_few_files(spark):
    store = seen.KeyStore(spark, buckets=16, fanout=9)
    store.add(numbers(spark, 0, 5000))
    store.add(numbers(spark, 5000, 9000))
    few = numbers(spark, 7, 9).select(F.xxhash64("key").alias("kh"), "key", F.col("arrival").alias("first"))
    opened = lambda df: [int(n) for n in re.findall(r"SelectedBucketsCount: (\d+) out of 16", plan_of(df))]
    assert len(opened(store.probe(few, 2))) == 2 and max(opened(store.probe(few, 2))) <= 2
    assert all(n == 16 for n in opened(store.probe(few, 10**9)))
    assert rows(store.lookup([r.kh for r in few.collect()]), "key") == [("k7",), ("k8",)]
    # and gives the answers of a join with everything
    assert store.add(numbers(spark, 8990, 9010).withColumn("arrival", F.col("arrival") + 10**6)).count() == 10
    store.close()


def test_a_second_writer_fails(spark):
    store = seen.KeyStore(spark)
    store.add(numbers(spark, 0, 5))
    other = seen.KeyStore.open(spark, store.path)
    store.add(numbers(spark, 5, 9))
    with pytest.raises(OSError):
        other.add(numbers(spark, 5, 9))
    store.close()


def test_nothing_stays_in_the_catalogue(spark):
    before = {t.name for t in spark.catalog.listTables()}
    store = seen.ingest(*(spark.createDataFrame([(1, "a")], "row_id long, hash_code string"),) * 2)
    store.close()
    assert {t.name for t in spark.catalog.listTables()} == before
