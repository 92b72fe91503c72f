"""The encoder against the public library, and packing."""

import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import bpe, packing


@lru_cache(1)
def own():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Tokenizer(f.read())


@lru_cache(1)
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def public_ids(text):
    return public().encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab '\t\n\r\x0b\x0c\x1c\x85 'tsllre12.,é", max_size=60))
def test_like_the_public_library(text):
    assert own().encode(text) == public_ids(text)
    assert own().decode(own().encode(text)) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 3000, "\n" * 500 + " ", "ab" * 700, "  x", "don't DON'T we'll", "𠮷🐛👩‍💻", "x﻿y", "1" * 999, "\0\x01"])
def test_hard_texts(text):
    assert own().encode(text) == public_ids(text)


def test_stale_pairs_are_skipped():
    # b"ab" merges first and takes the b away from "bc", which waits in the queue by then
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"ab": 4, b"bc": 5, b"cd": 6}
    assert bpe.merge(b"abcd", ranks) == [4, 6] and bpe.merge(b"bcab", ranks) == [5, 4] and bpe.merge(b"aaa", ranks) == [0, 0, 0]


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 10)
    with open(bpe.VOCABULARY, "rb") as f:
        t = bpe.Tokenizer(f.read())
    text = " ".join(f"qz{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    assert t.encode(text) == public_ids(text) and len(t.pieces) <= 10


def docs(spark):
    long = "word " * 40_000
    return spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "x"), (5, long)], "doc_id long, text string").withColumn("ids", F.lit(0))


def test_operator(spark):
    df = docs(spark)
    got = bpe.encode(df, "doc_id", "text").collect()
    want = [(r.doc_id, public_ids(r.text) if r.text else []) for r in df.collect()]
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in got))) == sorted(map(repr, want))
    back = bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id", "ids").collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in df.collect())
    counts = bpe.count_tokens(df, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counts) == sorted((str(i), len(x)) for i, x in want)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def brute_pack(sizes, capacity):
    """The rule, by trying every open container and summing squares anew each time."""
    gaps, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        best = None
        for c in [*range(len(gaps)), len(gaps)]:
            g = gaps[c] if c < len(gaps) else capacity
            if g >= sizes[i] and g > 0:
                after = [*gaps]
                if c < len(gaps):
                    after[c] = g - sizes[i]
                else:
                    after.append(g - sizes[i])
                total = sum(after.count(x) ** 2 for x in set(after) if 0 < x < capacity)
                key = (total, c == len(gaps), g)
                if best is None or key < best[0]:
                    best = (key, c)
        c = best[1]
        if c == len(gaps):
            gaps.append(capacity)
        gaps[c] -= sizes[i]
        out[i] = c
    return gaps, out


@pytest.mark.parametrize("seed", range(8))
def test_packing_follows_the_rule(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 50])
    sizes = [r.randrange(1, capacity + 1) for _ in range(60)]
    got = packing.pack(np.array(sizes), capacity)
    fill = np.bincount(got, weights=sizes)
    assert fill.max() <= capacity
    assert sorted(capacity - fill) == sorted(brute_pack(sizes, capacity)[0])


def test_containers(spark):
    r = random.Random(0)
    rows = [(i, r.choice([0, 1, 5, 300, 2047, 2048, 2049, 4096, 9000]) if i < 300 else r.randrange(1, 2500)) for i in range(3000)]
    rows += [(7, 10), (7, 10), (None, 3), (8, None)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("piece", F.lit("clash"))
    packed = packing.containers(sizes, len(rows), group=800).toPandas()
    assert packed.n_tokens.sum() == sum(n or 0 for _, n in rows)
    assert packed.groupby("container_id").n_tokens.sum().max() <= 2048
    whole = {i: n for i, n in rows[:3000] if i != 7 and n}
    for i, g in packed.groupby("doc_id"):
        if i in whole and i != 7:
            assert len(g) == -(-whole[i] // 2048) == g.n_pieces.iloc[0]
            assert sorted(g.token_start) == [2048 * k for k in range(len(g))]
    fill = packing.fill(packing.containers(sizes, len(rows), group=800)).first()
    assert fill.fullest <= 2048 and fill.used > 0.97
    none = packing.containers(sizes.limit(0), 0)
    assert none.count() == 0 and packing.fill(none).first().n_containers == 0


def test_equal_sizes_fill_exactly(spark):
    sizes = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1024).cast("long").alias("n_tokens"))
    assert packing.fill(packing.containers(sizes, 4000)).first().used == 1.0


def test_violations_are_counted(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 4), (3, 25), (4, 0), (5, 3)], "doc_id long, n_tokens long")
    good = packing.containers(sizes, 5, 10)
    assert packing.violations(good, sizes, 10).first().asDict() == {"n_documents": 4, "n_split": 0, "n_incomplete": 0, "n_overfull": 0}
    rows_ = [
        (1, 0, 1, 0, 5, "a"), (2, 0, 1, 0, 4, "a"), (5, 0, 2, 0, 2, "a"), (5, 1, 2, 2, 1, "b"),  # 11 in a; 5 split in vain
        (3, 0, 3, 0, 10, "c"), (3, 1, 3, 10, 10, "d"),  # the last piece of 3 is missing
    ]
    bad = spark.createDataFrame(rows_, packing.PACKED)
    assert packing.violations(bad, sizes, 10).first().asDict() == {"n_documents": 4, "n_split": 1, "n_incomplete": 1, "n_overfull": 1}
    assert packing.violations(bad.filter("doc_id <> 1"), sizes, 10).first().n_incomplete == 2  # one left out
    assert packing.violations(good.limit(0), sizes.limit(0), 10).first().asDict() == {"n_documents": 0, "n_split": 0, "n_incomplete": 0, "n_overfull": 0}
