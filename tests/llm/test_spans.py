"""Shared spans against brute force."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from siltstone.llm import spans

CONTENTS = "hash_code string, contents string, loaded_at timestamp, deleted_at timestamp"


def brute(texts: dict, span: int):
    who = {}
    for h, t in texts.items():
        for i in range(len(t) - span + 1):
            who.setdefault(t[i : i + span], set()).add(h)
    out = set()
    for h, t in texts.items():
        hit = [False] * len(t)
        for i in range(len(t) - span + 1):
            if len(who[t[i : i + span]]) > 1:
                hit[i : i + span] = [True] * span
        i = 0
        while i < len(t):
            j = i
            while j < len(t) and hit[j] == hit[i]:
                j += 1
            if hit[i]:
                out.add((h, i, j))
            i = j
    return out


def corpus(seed: int, letters: str, n: int = 60):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    parts = [word(r.randrange(5, 60)) for _ in range(12)]
    texts = {"e": "", "w": "ab" * 40, "x": "ab" * 33, "y": "c" * 90, "z": "c" * 70}
    for i in range(n):
        t = "".join(r.choice(parts) if r.random() < 0.7 else word(r.randrange(9)) for _ in range(r.randrange(1, 9)))
        texts[f"h{i}"] = parts[0] * 2 + t if i % 3 == 0 else t  # a third of the records share a head
    return texts


def table(spark, texts):
    return spark.createDataFrame([(h.upper() + " ", t, None, None) for h, t in texts.items()], CONTENTS)


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "aé🐛"])
@pytest.mark.parametrize("options", [{}, {"group": 2}, {"hot": 3, "group": 2}, {"batches": 1}])
def test_like_brute_force(spark, letters, options):
    texts = corpus(len(letters), letters)
    got = spans.shared_spans(table(spark, texts), span=20, gram=6, **options)
    assert set(rows(got)) == brute(texts, 20)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    texts = corpus(3, "abc", 20) | {"long": "".join(random.Random(1).choice("abc") for _ in range(3000))}
    texts["tail"] = texts["long"][1001:2900]
    r = list(range(len(texts)))
    monkeypatch.setattr(spans, "BLOCK", 100)
    run = spans._postings(20, 6)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(r), pa.array(list(texts.values()))], names=["rec", "text"])
    starts = {i: set() for i in r}
    for b in run(iter([batch])):
        for rec, place in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
            starts[rec].update(range(place >> 32, (place >> 32) + (place >> 16 & 0xFFFF)))
    for i, t in enumerate(texts.values()):
        assert starts[i] == set(range(len(t) - 19))  # every window has its anchor


def test_empty_null_repeated_and_withdrawn(spark):
    t = "x" * 30
    ct = spark.createDataFrame([("a", t, None, None), ("A ", t, None, None), ("b", None, None, None), (None, t, None, None), ("n", "", None, None)], CONTENTS)
    gone = spark.createDataFrame([("c", t, None, __import__("datetime").datetime(2020, 1, 1))], CONTENTS)
    ct = ct.unionByName(gone).withColumn("text", F.lit("clash")).withColumn("rec", F.lit(0))
    assert spans.shared_spans(ct, span=20, gram=6).count() == 0  # one content alone
    assert spans.shared_spans(ct.limit(0), span=20, gram=6).count() == 0
    two = ct.select("hash_code", "contents", "loaded_at", "deleted_at").unionByName(spark.createDataFrame([("d", "y" + t, None, None)], CONTENTS))
    assert rows(spans.shared_spans(two, span=20, gram=6)) == [("a", 0, 30), ("d", 1, 31)]
    amounts = {r.hash_code: (r.n_chars, r.n_shared) for r in spans.shared_amounts(two, span=20, gram=6).collect()}
    assert amounts == {"a": (30, 30), "d": (31, 30), "b": (0, 0), "n": (0, 0)}


def morse(n: int, a: str, b: str) -> str:
    """Two such texts with a and b exchanged have one polynomial hash modulo 2**64, whatever its odd base."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_different_texts_with_one_hash_are_told_apart(spark):
    import numpy as np

    one, two = morse(2048, "p", "q"), morse(2048, "q", "p")
    whole = [spans._Hashes(spans._codes(t)).of(np.array([0]), np.array([len(t)]))[0] for t in (one, two)]
    assert whole[0] == whole[1]  # the hash alone would take them for equal
    edges = spans._edges(np.array([1, 2]), np.array([0, 0]), np.array([False, False]), [one, two], 2048)
    assert [len(x) for x in edges] == [0, 0, 0]
    # the same where a third has one of them, at other places
    texts = ["x" + one, two + "y", "zz" + one[:2040] + "w", two]
    got = {tuple(map(int, r)) for r in zip(*spans._edges(np.arange(4), np.zeros(4, int), np.zeros(4, bool), texts, 2048))}
    assert got == {(1, 0, 2048), (3, 0, 2048)}
    short = {"a": one[:1024] + "c", "b": two[:1024] + "d", "c": "e" + one[:1024]}
    for options in ({}, {"hot": 0}, {"group": 1}):
        assert set(rows(spans.shared_spans(table(spark, short), span=1024, gram=32, **options))) == brute(short, 1024) == {("a", 0, 1024), ("c", 1, 1025)}


def test_windows_that_differ_are_found_whatever_the_pieces(monkeypatch):
    import numpy as np

    r = random.Random(2)
    codes = np.array([r.randrange(3) for _ in range(500)], np.uint64)
    at = np.array(sorted(r.sample(range(480), 200)))
    other = np.array([max(0, a - r.choice([0, 3, 3, 3, 7])) for a in at])
    want = [i for i in range(200) if (codes[at[i] : at[i] + 4] != codes[other[i] : other[i] + 4]).any()]
    for size in (1, 50, 1 << 22):
        monkeypatch.setattr(spans, "COMPARED", size)
        assert spans._differing(codes, at, other, 4).tolist() == want


@pytest.mark.parametrize("point", [0, 10**6])
def test_batches_add_up_and_another_session_goes_on(spark, monkeypatch, point):
    monkeypatch.setattr(spans, "POINT_HASHES", point)
    texts = corpus(5, "abcd", 50)
    records = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(texts.items())], "rec long, hash_code string, text string")
    index = spans.SpanIndex(spark, span=20, gram=6, fanout=2, buckets=3)
    parts, seen = [], 0
    for lo, hi in ((0, 20), (20, 35), (35, 45), (45, 99)):
        index.add(records.filter(F.col("rec").between(lo, hi - 1)))
        index.close()
        index = spans.SpanIndex.open(spark.newSession(), index.path)
        have = records.filter(F.col("rec") < hi)
        found = index.spark.createDataFrame(have.collect(), have.schema)
        parts += [tuple(r) for r in spans.shared_stretches(index, found, last=True).collect()]
        names = list(texts)
        so_far = spark.createDataFrame(parts or [(0, 0, 0)], "rec long, span_start long, span_end long").filter("span_end > 0")
        got = {(names[i], a, b) for i, a, b in rows(spans.joined_stretches(so_far))}
        assert got == brute(dict(list(texts.items())[:hi]), 20) and len(got) >= seen
        seen = len(got)
    assert (index.span, index.gram, index.fanout, index.buckets) == (20, 6, 2, 3) and len(index.runs) <= 3
    # the postings of three batches lie in ranges of hashes
    merged = next(p for p in index.parts if p.level)
    at = spark.read.parquet(merged.path).groupBy(F.input_file_name().alias("f")).agg(F.min("fp").alias("a"), F.max("fp").alias("b")).orderBy("a").collect()
    assert len(index.parts) == 3 and all(x.b <= y.a for x, y in zip(at, at[1:]))
    hashes = [r.fp for r in index.postings().select("fp").distinct().limit(3).collect()]
    assert "PushedFilters: [In(fp" in index.postings(hashes)._jdf.queryExecution().executedPlan().toString()
    assert rows(index.postings(hashes), "rec", "place") == rows(index.postings().filter(F.col("fp").isin(hashes)), "rec", "place")
    index.close()


def test_records_with_one_number_are_numbered_again(spark, monkeypatch):
    monkeypatch.setattr(spans, "NUMBER_BITS", 11)
    texts = corpus(6, "abc", 90)
    numbers = [r[0] for r in table(spark, texts).select(spans._number(F.lower(F.trim("hash_code")), F.lit(0))).collect()]
    assert len(set(numbers)) < len(numbers)
    assert set(rows(spans.shared_spans(table(spark, texts), span=20, gram=6))) == brute(texts, 20)


def test_hot_anchors_are_a_fixed_number_of_postings_and_split_by_salt(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_ROWS", 0)
    texts = corpus(8, "abcd", 60)
    assert set(rows(spans.shared_spans(table(spark, texts), span=20, gram=6, hot=3))) == brute(texts, 20)


def test_nothing_stays_in_the_catalogue(spark):
    before = {t.name for t in spark.catalog.listTables()}
    spans.shared_spans(table(spark, corpus(1, "ab", 5)), span=20, gram=6)
    assert {t.name for t in spark.catalog.listTables()} == before
