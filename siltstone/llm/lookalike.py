"""Problem 10: one consistent form for texts that look the same.

Zero-width characters go, spaces become plain, full-width forms usual, and accents composed. Letters that look like letters of
another script are settled token by token: each letter stands for the scripts in which its look exists, the sets are
intersected over the token, and the token is spelled in the script that remains. Tokens of several scripts (mixed) and tokens of
one script that could be another's (whole-script confusables) are counted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.skew import sent_if_small
from siltstone.session import materialise

# Letters of other scripts that look like a Latin letter, and the Latin letters in the same order.
LOOKS = {
    "CYRILLIC": ("аԁеһіјӏорԛѕсѵԝхуүАВСЕԌНІЈКМОРԚЅТѴԜХУҮ", "adehijlopqscvwxyyABCEGHIJKMOPQSTVWXYY"),
    "GREEK": ("ονρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovpcjABEZHIKMNOPTYXCJ"),
    "ARMENIAN": ("օհսոցզՕՍՏ", "ohungqOUS"),
    "CHEROKEE": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "LISU": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    "COPTIC": ("ⲟⲥⲣⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬ", "ocpBHIKMNOPCTX"),
    "OTHER": ("ɡɑⅼⅽⅾⅿⅰⅴⅹⅬⅭⅮⅯⅠⅤⅩ", "galcdmivxLCDMIVX"),
}
# Letters of two scripts that look alike although no Latin letter does.
ALIKE = {"CYRILLIC": "ГПФѲѰѱ", "GREEK": "ΓΠΦΘΨψ"}
# Hyphens that look like the ASCII one.
HYPHENS = str.maketrans("‐‑", "--")

_IGNORED = "\u00ad\u034f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202c\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0100-\U000e01ef"
_INVISIBLE = re.compile(f"[{_IGNORED}]+")
_SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
# Full-width and half-width forms, letters of mathematical alphabets (not their digits), and joined letters.
_WIDE = re.compile("[\uff01-\uffee\U0001d400-\U0001d6a5\ufb00-\ufb06]+")
_TOKEN = re.compile("[^\\W\\d_](?:[^\\W_]|[\u0300-\u036f])*")
# Scripts in which a joiner changes the shape of letters.
_SHAPED = re.compile("[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u18af\ufb50-\ufdff\ufe70-\ufefc]")

_PROTOTYPE = {a: b for letters, latin in LOOKS.values() for a, b in zip(letters, latin)}
_MEMBERS: dict[str, dict[str, str]] = {}
for _script, (_letters, _latin) in LOOKS.items():
    for _a, _b in zip(_letters, _latin):
        _MEMBERS.setdefault(_b, {"LATIN": _b}).setdefault(_script, _a)
for _same in zip(*ALIKE.values()):
    _MEMBERS[_same[0]] = dict(zip(ALIKE, _same))
    _PROTOTYPE |= dict.fromkeys(_same, _same[0])


@lru_cache(100_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").partition(" ")[0]


def _scripts(c: str) -> frozenset[str]:
    """The scripts in which the look of a letter exists."""
    p = _PROTOTYPE.get(c, c)
    return frozenset(_MEMBERS[p]) if p in _MEMBERS else frozenset((_script(c),))


@lru_cache(200_000)
def resolve(token: str) -> tuple[str, str]:
    """The token in its consistent spelling, and 'single', 'whole' (one script, but all its letters exist in another) or
    'mixed'. The spelling depends on looks alone: the script is Latin if all letters exist there, else the first by name of
    those that have all; a token that no script has as a whole takes the Latin letter wherever there is one, else that of the
    first script by name."""
    letters = [c for c in token if not unicodedata.category(c).startswith(("M", "N"))]
    if not letters:
        return token, "single"
    common = frozenset.intersection(*map(_scripts, letters)) - {"OTHER"}
    own = {_script(c) for c in letters}
    target = "LATIN" if "LATIN" in common or not common else min(common)
    out = []
    for c in token:
        look = _MEMBERS.get(_PROTOTYPE.get(c, c))
        out.append(look.get(target) or look.get("LATIN") or look[min(look)] if look else c)
    return "".join(out), "mixed" if len(own) > 1 else "whole" if len(common) > 1 and own != {"LATIN"} else "single"


def _visible(c: str) -> bool:
    return unicodedata.category(c) == "So" or "\U0001f3fb" <= c <= "\U0001f3ff"


def _drop_invisible(m: re.Match) -> str:
    """Nothing, unless a joiner or a variant mark belongs to a pictograph or to letters it shapes."""
    run, text, a = m.group(), m.string, m.start()
    before = text[a - 1] if a else ""
    if before and (_visible(before) or before in "\u20e3#*0123456789" and "\ufe0f\u20e3" in text[a : a + 2]):
        after = text[m.end() : m.end() + 1]
        keep = "".join(c for c in run if c == "\ufe0f" or c == "\u200d" and after and _visible(after))
        return keep
    if ("\u200c" in run or "\u200d" in run) and before and _SHAPED.match(before):
        return "".join(c for c in run if c in "\u200c\u200d")
    return ""


def consistent(text: str) -> tuple[str, int, int]:
    """The consistent form of a text, and how many mixed and whole-script confusable tokens it has."""
    if text.isascii():
        return text, 0, 0
    text = _INVISIBLE.sub(_drop_invisible, text)
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), _SPACES.sub(" ", text))
    if text.isascii():
        return text, 0, 0
    text = unicodedata.normalize("NFD", text)
    kinds = {"mixed": 0, "whole": 0, "single": 0}

    def settle(m: re.Match) -> str:
        token = m.group()
        if token.isascii():
            return token
        spelled, kind = resolve(token)
        kinds[kind] += 1
        return spelled

    text = _TOKEN.sub(settle, text).translate(HYPHENS)
    return unicodedata.normalize("NFC", text), kinds["mixed"], kinds["whole"]


_FORMS = "doc_id long, form string, n_mixed int, n_whole int"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [consistent(t) for t in b.column(1).to_pylist()]
        forms, mixed, whole = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), pa.array(mixed, pa.int32()), pa.array(whole, pa.int32())], names=["doc_id", "form", "n_mixed", "n_whole"])


def consistent_texts(documents: DataFrame) -> DataFrame:
    """doc_id, form, n_mixed, n_whole for every row; the form of a null text is null. ASCII texts are their own form and never
    leave the JVM. Other columns are ignored."""
    rows = documents.select("doc_id", "text")
    foreign = F.col("text").rlike(r"[^\x00-\x7F]")
    usual = rows.filter(~foreign | F.col("text").isNull()).select("doc_id", F.col("text").alias("form"), F.lit(0).alias("n_mixed"), F.lit(0).alias("n_whole"))
    return usual.unionByName(rows.filter(foreign).mapInArrow(_forms, _FORMS))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for b in batches:
        texts = b.column(1).to_pylist()
        form = [sha256(consistent(t)[0].encode()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sha256(t.encode()).digest() for t in texts], pa.binary()), pa.array(form, pa.binary())], names=["doc_id", "text_id", "form_id"])


def _identified(documents: DataFrame) -> DataFrame:
    """doc_id, text_id, form_id (SHA-256 digests) of the documents with a text, distinct, written once."""
    rows = documents.filter(F.col("text").isNotNull()).select("doc_id", "text")
    foreign = F.col("text").rlike(r"[^\x00-\x7F]")
    digest = F.unhex(F.sha2("text", 256))
    docs = rows.filter(~foreign).select("doc_id", digest.alias("text_id"), digest.alias("form_id")).unionByName(
        rows.filter(foreign).mapInArrow(_digests, "doc_id long, text_id binary, form_id binary")
    )
    return materialise(docs.distinct(), "lookalike")


def _shared(docs: DataFrame) -> DataFrame:
    """form_id, text_id, n (documents) of the texts whose form another text has too, one row per text. Copies of a text are combined
    before the shuffle."""
    classes = docs.groupBy("form_id", "text_id").agg(F.count("*").alias("n"))
    several = classes.groupBy("form_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("form_id")
    return materialise(classes.join(several, "form_id", "left_semi"), "lookalike-texts")


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b of documents with different texts and one consistent form.

    Texts and forms meet as SHA-256 digests. Copies of a text are one class; classes are paired within a form and only then
    expanded, so that a text copied any number of times costs nothing unless a look-alike of it exists. Null texts pair with
    nothing; an empty text pairs with texts of nothing but invisible characters. Repeated rows (one doc_id) pair as one. The result
    has a row for every pair; ``lookalike_classes`` tells the same in a row for every document."""
    c = F.col
    docs = _identified(documents)
    shared = _shared(docs)
    pairs = (
        shared.alias("a")
        .join(shared.alias("b"), "form_id")
        .filter(c("a.text_id") < c("b.text_id"))
        .select(c("a.text_id").alias("_a"), c("b.text_id").alias("_b"))
    )
    # documents without a look-alike are left where they lie
    few = docs.join(sent_if_small(shared.select("text_id")), "text_id", "left_semi")
    left, right = (few.select(c("text_id").alias(t), c("doc_id").alias(d)) for t, d in (("_a", "_da"), ("_b", "_db")))
    return (
        pairs.join(left, "_a").join(right, "_b").filter(c("_da") != c("_db"))
        .select(F.least("_da", "_db").alias("doc_id_a"), F.greatest("_da", "_db").alias("doc_id_b"))
    )


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """A row for each document with a text: doc_id, class_id (of its form, as a hexadecimal digest), n_documents of the class, n_texts
    of the class, and n_links, the documents that look the same with other characters (0 for most). Whatever the size of a class,
    a document gives one row; a repeated row gives one too. Null texts are in no class.

    Counts are combined before the shuffle, and only classes of several texts are joined back to their documents."""
    c = F.col
    docs = _identified(documents)
    texts = docs.groupBy("form_id", "text_id").agg(F.count("*").alias("n"))
    forms = texts.groupBy("form_id").agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_texts"))
    counted = materialise(texts.join(forms, "form_id").filter("n_documents > 1"), "lookalike-counts")
    told = docs.join(sent_if_small(counted), ["form_id", "text_id"], "left")
    one = lambda x: F.coalesce(x, F.lit(1)).alias(x)
    return told.select("doc_id", F.lower(F.hex("form_id")).alias("class_id"), one("n_documents"), one("n_texts"), F.coalesce(c("n_documents") - c("n"), F.lit(0)).alias("n_links"))
