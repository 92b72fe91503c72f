"""Problem 4: source files that do not parse in the language their path names.

Each distinct content is parsed once per language by a parser of this package: recursive descent for statements, precedence
climbing for expressions, and panic-mode recovery, so that all errors of a text are known and the first is its cause.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import parse_js, parse_json, parse_py
from siltstone.llm.live import REVISION, live_contents, revisions
from siltstone.operators.skew import salted_semi_join

LANGUAGES = {"js": "javascript", "mjs": "javascript", "json": "json", "py": "python"}
PARSERS = {"javascript": parse_js.errors, "json": parse_json.errors, "python": parse_py.errors}
#: Python calls in one another, which take no space on the machine's stack: texts nested a few hundred thousand levels deep are
#: parsed. What is deeper is no text an engine of the language would take, and is reported as such.
DEPTH = 5_000_000
SENT_ERRORS = 50_000  # a text may have as many errors as tokens: rows are handed on when they hold so many
PARSED = "hash_code string, language string, n_errors int, first_position long, first_cause string, errors array<struct<position:long,cause:string>>"


def language(extension: Column) -> Column:
    """The language of an extension, or null."""
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(extension == e, name).otherwise(out)
    return out


def _batch(rows: list[tuple[str, str, list[tuple[int, str]]]]) -> pa.RecordBatch:
    hashes, names, found = zip(*rows)
    every = [e for errors in found for e in errors]
    structs = pa.StructArray.from_arrays([pa.array([p for p, _ in every], pa.int64()), pa.array([c for _, c in every], pa.string())], names=["position", "cause"])
    offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(hashes, pa.string()),
            pa.array(names, pa.string()),
            pa.array([len(e) for e in found], pa.int32()),
            pa.array([e[0][0] if e else None for e in found], pa.int64()),
            pa.array([e[0][1] if e else None for e in found], pa.string()),
            pa.ListArray.from_arrays(offsets, structs),
        ],
        names=["hash_code", "language", "n_errors", "first_position", "first_cause", "errors"],
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
    for b in batches:
        rows, n = [], 0
        for h, name, text in zip(*(c.to_pylist() for c in b.columns)):
            rows.append((h, name, PARSERS[name](text)))
            n += len(rows[-1][2])
            if n >= SENT_ERRORS:
                yield _batch(rows)
                rows, n = [], 0
        if rows:
            yield _batch(rows)


def judged(file_metadata: DataFrame) -> DataFrame:
    """Distinct revisions with a hash and a language."""
    return revisions(file_metadata, tuple(LANGUAGES)).withColumn("language", language(F.col("extension"))).drop("extension")


def parse_contents(file_metadata: DataFrame, contents: DataFrame) -> DataFrame:
    """For each live content and language that a path names for it: the number of errors, the first one's
    position (code points from 0) and cause, and all errors. A content without errors has the number 0.

    An empty text, and a null one, is valid JavaScript and Python but not JSON; a byte-order mark may lead. JavaScript is run as
    a script. Other columns of the tables are ignored; empty tables give nothing."""
    wanted = judged(file_metadata).select("hash_code", "language").distinct()
    texts = live_contents(contents).join(wanted, "hash_code").select("hash_code", "language", "text")
    return texts.mapInArrow(_parse, PARSED)


def invalid_revisions(file_metadata: DataFrame, contents: DataFrame) -> DataFrame:
    """The revisions whose live content their language's parser rejects."""
    bad = parse_contents(file_metadata, contents).filter("n_errors > 0").select("hash_code", "language")
    # a content may be that of a large part of all revisions
    return salted_semi_join(judged(file_metadata), bad, ["hash_code", "language"], ["repo_owner", "repository", "git_path"]).select(*REVISION)


def rates(file_metadata: DataFrame, contents: DataFrame) -> DataFrame:
    """Per repository and language: distinct revisions with a live content, how many are invalid, the share, and the commonest
    first cause (of equally common ones the first by name; null if all are valid)."""
    parsed = parse_contents(file_metadata, contents).select("hash_code", "language", "first_cause", (F.col("n_errors") > 0).alias("bad"))
    # counted per cause first, so that a repository of any size gives few rows
    by_cause = judged(file_metadata).join(parsed, ["hash_code", "language"]).groupBy("repo_owner", "repository", "language", "first_cause").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"))
    return by_cause.groupBy("repo_owner", "repository", "language").agg(
        F.sum("n").alias("n_revisions"),
        F.sum("b").alias("n_invalid"),
        (F.sum("b") / F.sum("n")).alias("invalid_rate"),
        F.min(F.when(F.col("b") > 0, F.struct(-F.col("b"), F.col("first_cause").alias("c")))).getField("c").alias("commonest_cause"),
    )
