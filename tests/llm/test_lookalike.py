"""Forms of texts and pairs of look-alikes."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from siltstone.llm import lookalike as L


def form(text):
    return L.consistent(text)[0]


SAME = [
    ("ｖａｒ　ｘ＝１", "var x=1"), ("é", "é"), ("a​b", "ab"), ("﻿x", "x"), ("a­b⁠c", "abc"), ("a b c", "a b c"),
    ("сору", "copy"), ("pаth", "path"), ("ΑΤ", "AT"), ("nοde", "node"), ("е́té", "été"), ("e​́", "é"),
    ("гaд", "гад"), ("ｶﾞ", "ガ"), ("a‐b", "a-b"), ("ộ", "ộ"), ("x️", "x"), ("1‍2", "12"),
]
APART = [
    ("2", "²"), ("2", "②"), ("a", "á"), ("O", "Ό"), ("l", "I"), ("0", "O"), ("1", "l"), ("a  b", "a b"), ("a\tb", "a b"), ("a\nb", "a b"), ("г", "r"),
    ("\U0001f3f3️‍\U0001f308", "\U0001f3f3\U0001f308"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("می‌خ", "میخ"), ("", " "), ("丁", "丅"), ("c", "ć"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert form(a) == form(b) and form(form(a)) == form(a)


@pytest.mark.parametrize("a, b", APART)
def test_apart(a, b):
    assert form(a) != form(b)


def test_tokens_are_spelled_in_one_script():
    assert L.resolve("pаth") == ("path", "mixed")
    assert L.resolve("сору") == ("copy", "whole")
    assert L.resolve("гaд") == ("гад", "mixed")  # only Cyrillic has all of it
    assert L.resolve("гад") == ("гад", "single")
    assert L.consistent("pаth сору гад")[1:] == (1, 1)


@pytest.mark.parametrize("word", ["Γειά", "Φίλε", "Παιδί", "Θάλασσα", "ψωμί", "Φω", "Γδ", "Δέλτα"])
def test_greek_words_stay_greek(word):
    import unicodedata

    assert form(word) == unicodedata.normalize("NFC", word) and L.consistent(word)[1:] == (0, 0)
    # and the Cyrillic letter that looks like one of theirs comes back to Greek
    swapped = word.translate(str.maketrans("ΓΠΦΘΨψ", "ГПФѲѰѱ"))
    assert form(swapped) == form(word) and (swapped == word or L.consistent(swapped)[1] == 1)


def test_letters_alike_without_a_latin_one():
    assert form("Πример") == "Пример" and form("Г") == form("Γ") and form("ΓΦ") == form("ГФ") != form("rФ")
    assert L.consistent("Γειά Пример ΠΦ")[1:] == (0, 1)


def test_mathematical_and_joined_letters():
    assert form("𝐚𝗕 ﬁle") == "aB file" and form("𝟙") == "𝟙" != "1"


def test_tables_are_sound():
    assert len(set(map(len, L.ALIKE.values()))) == 1
    for letters, latin in L.LOOKS.values():
        assert len(letters) == len(latin) == len(letters.encode("utf-32-le")) // 4 and len(set(letters)) == len(letters) and latin.isascii()


def docs(spark):
    return spark.createDataFrame(
        [(1, "copy x"), (2, "сору x"), (3, "copy x"), (4, "copy x"), (5, "other"), (6, None), (7, ""), (8, "​"), (9, "²"), (10, "2"), (4, "copy x"), (11, "２" * 60_000), (12, "2" * 60_000)],
        "doc_id long, text string",
    ).withColumn("form", F.lit("clash"))


def test_pairs_like_brute_force(spark):
    data = [(r.doc_id, r.text) for r in docs(spark).collect() if r.text is not None]
    want = {(a, b) for a, s in data for b, t in data if a < b and s != t and form(s) == form(t)}
    got = rows(L.lookalike_pairs(docs(spark)))
    assert set(got) == want and (1, 3) not in want and len(want) == 7
    assert L.lookalike_pairs(docs(spark).limit(0)).count() == 0


def test_forms(spark):
    got = {r.doc_id: r.form for r in L.consistent_texts(docs(spark)).collect()}
    assert got[2] == got[4] == "copy x" and got[6] is None and got[8] == ""
    assert L.consistent_texts(docs(spark)).count() == 13


def test_classes(spark):
    got = {r.doc_id: r for r in L.lookalike_classes(docs(spark)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12] and L.lookalike_classes(docs(spark)).count() == len(got)
    links = {i: sum(i in p for p in rows(L.lookalike_pairs(docs(spark)))) for i in got}
    assert {i: r.n_links for i, r in got.items()} == links
    assert (got[1].n_documents, got[1].n_texts) == (4, 3) and got[1].class_id == got[2].class_id != got[5].class_id
    assert L.lookalike_classes(docs(spark).limit(0)).count() == 0


def test_a_large_class_gives_a_row_for_each_document(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("copy")).otherwise(F.lit("сору")).alias("text"))
    got = L.lookalike_classes(df)
    assert got.count() == 600 and rows(got.select("n_links").distinct()) == [(300,)]
