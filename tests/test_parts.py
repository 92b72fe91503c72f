"""Expressions, readers, checkpoints and sketches."""

import os

import pytest
from helpers import FM, rows
from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.functions.hexes import hex_id
from siltstone.operators import checkpoint as C
from siltstone.sources import lake


@pytest.mark.parametrize(
    "path, folder, name",
    [("a", "", "a"), ("a/b", "a", "b"), ("a/b/c.js", "a/b", "c.js"), ("a//b/", "a", "b"), ("/a", "/", "a"), ("/", "", None), ("", "", ""), ("a/b/", "a", "b"),
     ("//x//y//", "/x", "y"), ("./a", ".", "a"), ("a/../b", "a/..", "b")],
)
def test_paths(spark, path, folder, name):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.parent_folder(F.col("p")), paths.file_name(F.col("p"))).first() == (folder, name)


def test_null_path(spark):
    df = spark.createDataFrame([(None,)], "p string")
    assert df.select(paths.parent_folder(F.col("p")), paths.file_name(F.col("p")), hex_id("p")).first() == (None, None, None)


def test_hex(spark):
    df = spark.createDataFrame([(" AbC ",), ("  ",)], "h string")
    assert [r[0] for r in df.select(hex_id("h")).collect()] == ["abc", None]


def test_lake(spark, tmp_path):
    for crawl, t in (("one", 5), ("two", 3)):
        spark.createDataFrame([("o", "r", "p", "h", t, "c")], FM).write.parquet(f"{tmp_path}/data/{crawl}/FILE_METADATA")
        spark.createDataFrame([("c", "x" * t, "m")], "COMMIT_ID string, AUTHOR string, LONG_MESSAGE string").write.parquet(f"{tmp_path}/data/{crawl}/COMMIT_MESSAGES")
        spark.createDataFrame([("h",)], "HASH_CODE string").write.parquet(f"{tmp_path}/data/{crawl}/INDEX")
    assert rows(lake.read_lake(spark, str(tmp_path), "FILE_METADATA")) == [("o", "r", "p", "h", 3, "c")]
    assert rows(lake.read_lake(spark, str(tmp_path), "COMMIT_MESSAGES")) == [("c", "xxx", "m")]
    assert rows(lake.read_lake(spark, str(tmp_path), "INDEX")) == [("h",)]


def test_texts_and_properties(spark, tmp_path):
    lake.write_text(spark.createDataFrame([(1, "a"), (2, None)], "i int, s string"), f"{tmp_path}/t")
    assert rows(lake.read_text(spark, f"{tmp_path}/t")) == [("1,a",), ("2",)]
    (tmp_path / "p").write_text("# c\na = 1\nb:2\n")
    assert lake.read_properties(str(tmp_path / "p")) == {"a": "1", "b": "2"}
    assert any(r.path.endswith("/p") for r in lake.list_files(spark, str(tmp_path)).collect())
    lake.delete_recursively(str(tmp_path / "t"))
    lake.delete_recursively(str(tmp_path / "t"))
    assert not os.path.exists(tmp_path / "t")


def test_sticky_checkpoint(spark):
    one, two = spark.range(3), spark.range(5)
    assert C.sticky_checkpoint(one, "a").count() == 3 and C.sticky_checkpoint(two, "a").count() == 5
    assert C.sticky_checkpoint(one, "b", versioned=False).count() == 3
    assert C.sticky_checkpoint(two, "b", versioned=False).count() == 3  # the name alone counts


def test_sticky_checkpoint_broken_off(spark):
    from siltstone.session import shared_dir

    path = shared_dir(spark).removeprefix("file://") + "/_sticky/c"
    os.makedirs(path)
    open(f"{path}/part-0", "w").close()
    assert C.sticky_checkpoint(spark.range(2), "c", versioned=False).count() == 2


MADE = []  # which frames were made; a name of the module is not enclosed


def test_sticky_checkpoint_knows_logic_and_parameters(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    source = spark.read.parquet(f"{tmp_path}/in")
    MADE.clear()

    def stuck(least, **more):
        def one():
            MADE.append(least)
            return source.filter(F.col("id") > least)

        return C.sticky_checkpoint(one, "logic", source=source, **more).count()

    assert stuck(3) == 6 and stuck(3) == 6 and MADE == [3]
    assert stuck(5) == 4  # what a function encloses is part of what it does
    assert C.sticky_checkpoint(lambda: source.filter("id > 7"), "logic", source=source).count() == 2
    assert C.sticky_checkpoint(lambda: source.filter("id < 7"), "logic", source=source).count() == 7  # and so is its code
    stuck(3, parameters={"a": 1})
    stuck(3, parameters={"a": 2})
    assert MADE == [3, 5, 3, 3]
    spark.range(20, 22).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.read.parquet(f"{tmp_path}/in")
    assert stuck(3) == 8  # and the files
    with pytest.raises(ValueError):
        C.sticky_checkpoint(lambda: source, "logic")


def test_examples_follow_the_ranks(spark, small, monkeypatch):
    from siltstone.operators import imports
    from siltstone.plans import registry

    many = registry._examples(spark, small).agg(F.max("ROW_NUM")).first()[0]
    monkeypatch.setattr(imports, "RANKS", 0)
    assert registry._examples(spark, small).agg(F.max("ROW_NUM")).first()[0] is None and many >= 1


def test_sticky_checkpoint_asks_for_no_single_file(spark, tmp_path, monkeypatch):
    spark.range(100).repartition(30).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(type(df), "inputFiles", lambda self: 1 / 0)
    assert C.version_of(df) == C.version_of(df) != C.version_of(df.filter("id > 1"))
    assert C._files(df)[0][1] >= 30


def test_bloom_words(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("s")).unionByName(spark.createDataFrame([(None,)], "s string"))
    shape = C.bloom_shape(1000, 0.01)
    low, high = (C.bloom_words(df.filter(f"s IS NULL OR int(s) BETWEEN {a} AND {a + 499}"), "s", *shape) for a in (0, 500))
    words = C.unite_words(low.unionByName(high))
    assert words.count() == words.select("word").distinct().count() <= shape[0] // 64 + 1
    passed = {int(r[0]) for r in C.might_contain(df, "s", words, *shape).collect()}
    assert set(range(1000)) <= passed and len(passed) < 1000 + 40
    assert C.might_contain(df, "s", words.limit(0), *shape).count() == 0


def test_rename_and_sketches(spark):
    df = spark.createDataFrame([(str(i % 100), i) for i in range(1000)], "s string, i long")
    assert C.rename(df, {"s": "t", "none": "x"}).columns == ["t", "i"]
    assert abs(C.approx_sizes(df, ["s"]).first()[0] - 100) < 30
    (bloom,) = C.make_bloom_filters(df, ["s"])
    assert all(bloom.mightContainString(str(i)) for i in range(100)) and not all(bloom.mightContainString(f"x{i}") for i in range(100))
    assert C.semi_filter(df, df.filter("i < 2"), ["s", "i"]).count() == 2
