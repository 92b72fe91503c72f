"""Attribute versions, skew-safe per-key results, and orphan references."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from siltstone.operators import orphans, skew, versions

SNAP = "k string, a string, t long, c string"


def brute_versions(data):
    held = {}
    for k, a, t, c in data:
        if t is not None:
            best = held.setdefault(k, {}).get(t)
            new = (c is not None, c or "", a is not None, a or "", a)
            if best is None or new[:4] > best[:4]:
                held[k][t] = new
    out = set()
    for k, times in held.items():
        line = []
        for t in sorted(times):
            a = times[t][4]
            if not line or line[-1][0] != a:
                line.append((a, t))
        for i, (a, t) in enumerate(line):
            if a is not None:
                out.add((k, a, t, line[i + 1][1] if i + 1 < len(line) else -1))
    return out


@pytest.mark.parametrize("heavy", [versions.HEAVY_ROWS, 120, 0])
@pytest.mark.parametrize("span", [20, 1 << 22, 1 << 27])
def test_versions_like_brute_force(spark, span, heavy):
    r = random.Random(span)
    data = [(r.choice("xyz"), r.choice(["a", "b", "c", None]), r.randrange(span), r.choice(["1", "2", None])) for _ in range(400)]
    data += data[:40] + [(None, "a", 3, "1"), (None, None, 9, "1"), ("n", "a", None, "1")]
    got = versions.attribute_versions(spark.createDataFrame(data, SNAP).withColumn("_t", F.lit(0)), ["k"], "a", "t", "c", heavy=heavy)
    assert set(rows(got, "k", "a", "valid_from", "valid_to")) == brute_versions(data) and got.count() == len(brute_versions(data))


@pytest.mark.parametrize("heavy", [versions.HEAVY_ROWS, 120, 0])
def test_versions_of_restated_rows(spark, heavy):
    r = random.Random(heavy)
    data = [(r.choice(["x", "y", "z", None]), r.choice(["a", "b", None]), r.choice([None, *range(50)]), r.choice(["1", "2", "3", None])) for _ in range(500)]
    least = {}
    for k, a, t, c in data:
        if t is not None:
            least[k, a, c] = min(t, least.get((k, a, c), t))
    got = versions.attribute_versions(spark.createDataFrame(data, SNAP), ["k"], "a", "t", "c", restated=True, heavy=heavy)
    assert set(rows(got, "k", "a", "valid_from", "valid_to")) == brute_versions([(k, a, t, c) for (k, a, c), t in least.items()])


def test_versions_shuffle_their_rows_once(spark):
    plan = versions.attribute_versions(spark.createDataFrame([("x", "a", 1, "c")], SNAP), ["k"], "a", "t", "c", restated=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_versions_of_nothing(spark):
    assert versions.attribute_versions(spark.createDataFrame([], SNAP), ["k"], "a", "t", "c").count() == 0


def test_versions_at(spark):
    v = spark.createDataFrame([("a", 1, 5), ("b", 5, -1)], "a string, valid_from long, valid_to long")
    assert rows(versions.versions_at(v, 5), "a") == [("b",)] and rows(versions.versions_at(v, 4), "a") == [("a",)]


KEYS = "field_name string, key_value string, at long, row long"


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_per_key_like_brute_force(spark, partitions):
    r = random.Random(5)
    data = [("f", "hot" if r.random() < 0.5 else str(r.randrange(30)), r.randrange(10_000) if r.random() < 0.9 else None) for _ in range(3000)]
    data += [("g", "hot", 7)] * 500 + [("f", None, 1), (None, "x", 1), ("f", "y", None), ("g", "z", None), ("g", "z", None)]
    by = {}
    for f, k, t in data:
        if f and k:
            by.setdefault((f, k), []).append(t)
    want = set()
    for k, v in by.items():
        t = sorted(x for x in v if x is not None)
        want.add((*k, len(v), t[0] if t else None, t[-1] if t else None, max((b - a for a, b in zip(t, t[1:])), default=0)))
    df = spark.createDataFrame([(*d, i if i % 3 else None) for i, d in enumerate(data)], KEYS).withColumn("n_rows", F.lit("clash"))
    assert set(rows(skew.per_key(df, partitions))) == want


@pytest.mark.parametrize("at", ["id", "7L", "CAST(NULL AS LONG)"])
def test_a_heavy_key_is_split(spark, at):
    heavy = spark.range(150_000).select(F.lit("f").alias("field_name"), F.lit("k").alias("key_value"), F.expr(at).alias("at"), F.col("id").alias("row"))
    rest = spark.range(50_000).select(F.lit("f"), F.concat(F.lit("r"), F.col("id")), F.col("id"), F.col("id"))
    df = skew.spread_by_key(heavy.union(rest), 8)
    sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 200_000 / 8
    one = skew.per_key(heavy.union(rest), 8).filter("key_value = 'k'").first()
    assert one.n_rows == 150_000 and one.first_at == heavy.agg(F.min("at")).first()[0]


def test_heavy_keys_of_blank_and_odd_rows(spark):
    fm = spark.createDataFrame([("o", " ", "AB ", 5, 1), ("o", None, "ab", None, 2), (None, "r", "", 1, None)], "repo_owner string, repository string, hash_code string, commit_time long, row_id long")
    keys = skew.per_key(skew.revision_keys(fm))
    assert rows(skew.heavy_keys(keys), "field_name", "key_value", "n_rows", "first_at") == [("hash_code", "ab", 2, 5), ("repo_owner", "o", 2, 5), ("repository", "r", 1, 1)]
    assert skew.heavy_keys(skew.per_key(skew.revision_keys(fm.limit(0)))).count() == 0


def tables(spark):
    fm = spark.createDataFrame(
        [(1, "C1 ", "h1", 0), (2, "c1", None, 40 * 86400), (3, "c2", "H2", 0), (4, "gone", " ", 0), (5, None, "back", None)],
        "row_id long, commit_id string, hash_code string, commit_time long",
    )
    when = "loaded_at timestamp, deleted_at timestamp"
    stamp = __import__("datetime").datetime(2020, 1, 1)
    cm = spark.createDataFrame([("c1", stamp, None), ("c1", stamp, None), ("GONE", stamp, stamp), (None, stamp, None)], f"commit_id string, {when}")
    ct = spark.createDataFrame([("h1", stamp, stamp), ("back", stamp, stamp), ("BACK", stamp, None)], f"hash_code string, {when}")
    return fm, cm, ct


@pytest.mark.parametrize("heavy", [orphans.HEAVY_REFS, 1, 0])
def test_orphans(spark, heavy):
    fm, cm, ct = tables(spark)
    state = orphans.reference_state(fm, cm, ct)
    refs = orphans.references(fm)
    assert rows(orphans.orphan_rows(refs, state, heavy), "target_table", "row_id") == [
        ("commit_messages", 3), ("commit_messages", 4), ("commit_messages", 5), ("contents", 1), ("contents", 3),
    ]
    report = {(r.target_table, r.month): (r.n_references, r.n_orphans, r.n_orphan_keys) for r in orphans.orphan_report(refs, state).collect()}
    assert report["contents", "1970-01"] == (2, 2, 2) and report["contents", None] == (1, 0, 0) and report["commit_messages", "1970-02"] == (1, 0, 0)


def test_rows_of_heavy_references_are_not_shuffled(spark):
    fm = spark.range(1000).select(F.col("id").alias("row_id"), F.lit("gone").alias("commit_id"), F.when(F.col("id") % 2 == 0, F.lit("live")).alias("hash_code"), F.lit(0).cast("long").alias("commit_time"))
    ct = spark.createDataFrame([("live", None)], "hash_code string, deleted_at timestamp")
    state = orphans.reference_state(fm, ct.select(F.lit("x").alias("commit_id"), "deleted_at"), ct)
    found = orphans.orphan_rows(orphans.references(fm), state, 100)
    assert found.count() == 1000 and found.select("target_table").distinct().count() == 1
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_state_follows_deltas(spark):
    fm, cm, ct = tables(spark)
    state = orphans.reference_state(fm, cm, ct)
    late = orphans.existence_deltas(spark.createDataFrame([("c2", None, None)], "commit_id string, loaded_at timestamp, deleted_at timestamp"), "commit_messages", "commit_id")
    healed = orphans.apply_deltas(state, late)
    assert "c2" not in {r.key for r in orphans.orphan_keys(healed).collect()}
    withdrawn = orphans.apply_deltas(healed, late.withColumn("rows", -F.col("rows")))
    assert rows(withdrawn) == rows(state)
    dropped = orphans.apply_deltas(state, orphans.reference_deltas(orphans.references(fm), -1))
    assert orphans.orphan_keys(dropped).count() == 0


def test_orphans_of_nothing(spark):
    fm, cm, ct = (t.limit(0) for t in tables(spark))
    assert orphans.orphan_keys(orphans.reference_state(fm, cm, ct)).count() == 0


@pytest.mark.parametrize("by_time", [True, False])
def test_scans_over_blocks_like_plain_windows(spark, by_time):
    from pyspark.sql import Window

    from siltstone.operators import scan

    r = random.Random(1)
    data = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.randrange(1 << 24), r.choice([None, 1, 2, 3])) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, i long, t long, v long")
    cut = df.withColumn("_block", scan.time_block("t")) if by_time else scan.range_block(df, ["k"], ["t", "i"])
    w = Window.partitionBy("k").orderBy("t", "i")
    want = df.select("k", "i", F.lag("v").over(w), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(w))
    a = scan.previous(cut, ["k"], ["t", "i"], "v", "p")
    b = scan.running(cut.withColumn("v", F.coalesce("v", F.lit(0))), ["k"], ["t", "i"], {"s": "v"})
    c = scan.ranked(cut, ["k"], ["t", "i"], "n")
    assert rows(a, "i", "p") == sorted(((x[1], x[2]) for x in want.collect()), key=repr)
    assert {x[0]: x[1] for x in rows(b, "i", "s")} == {x[1]: x[3] or 0 for x in want.collect()}
    assert rows(c, "i", "n") == sorted(((x[1], x[4]) for x in want.collect()), key=repr)


@pytest.mark.parametrize("heavy", [10**6, 500, 0])
def test_scans_of_heavy_and_other_keys_like_plain_windows(spark, heavy):
    from pyspark.sql import Window

    from siltstone.operators import scan

    r = random.Random(3)
    data = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i, r.randrange(1 << 24), r.choice([1, 2, 3])) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, i long, COMMIT_TIME long, v long")
    order = ("COMMIT_TIME", "i")
    w = Window.partitionBy("k").orderBy(*order)
    want = df.select("i", F.lag("v").over(w), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(w))
    a = scan.previous_of_each(df, ["k"], order, "v", "p", heavy)
    b = scan.running_of_each(df, ["k"], order, {"s": "v"}, heavy)
    c = scan.ranked_of_each(df, ["k"], order, "n", heavy)
    got = a.select("i", "p").join(b.select("i", "s"), "i").join(c.select("i", "n"), "i")
    assert rows(got, "i", "p", "s", "n") == rows(want)
