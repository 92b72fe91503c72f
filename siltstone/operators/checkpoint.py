"""Named checkpoints that outlive the session, and approximate membership filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import shared_dir


def _complete(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _files(df: DataFrame) -> list[tuple]:
    """Number, bytes and a hash of names, lengths and times of the files that a frame reads. They are listed by a job, directory by
    directory, not asked for one by one."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    roots = set()
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
            paths = leaves.apply(i).relation().location().rootPaths()
            roots.update(paths.apply(j).toString() for j in range(paths.size()))
    out = []
    for root in sorted(roots):
        found = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
        one = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0))).first()
        out.append((root, *one))
    return out


def _meaning(f: Callable | object) -> str:
    """What a function does: its code, that of the functions in it, its defaults and what it has enclosed. A frame it has enclosed
    counts by its plan, other objects by their text."""
    code = getattr(f, "__code__", None)
    if code is None:
        return str(f.semanticHash()) if isinstance(f, DataFrame) else repr(f)

    def body(c) -> list:
        return [c.co_code.hex(), c.co_names, [body(x) if hasattr(x, "co_code") else repr(x) for x in c.co_consts]]

    enclosed = [_meaning(cell.cell_contents) for cell in f.__closure__ or ()]
    return repr([body(code), f.__defaults__, f.__kwdefaults__, enclosed])


@lru_cache(1)
def code_version() -> str:
    """Hash of this package's own modules. Any change of them makes new keys."""
    root = Path(__file__).resolve().parents[1]
    h = hashlib.sha256()
    for f in sorted(p for d in (".", "functions", "operators", "sources") for p in (root / d).glob("*.py")):
        h.update(f.name.encode() + f.read_bytes())
    return h.hexdigest()


def version_of(df: DataFrame | Callable[[], DataFrame], source: DataFrame | None = None, parameters: dict | None = None) -> str:
    """Hash of what a frame depends on: schema, canonical plan and input files of the frame (or of ``source``, with what the function
    that makes the frame of it does), the parameters, and the code of this package."""
    read = df if source is None else source
    parts = [read.schema.json(), str(read.semanticHash()), repr(_files(read)), repr(sorted((parameters or {}).items())), code_version()]
    if callable(df):
        parts.append(_meaning(df))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:20]


def sticky_checkpoint(df: DataFrame | Callable[[], DataFrame], name: str, versioned: bool = True, source: DataFrame | None = None, parameters: dict | None = None) -> DataFrame:
    """Write the frame once to ``_sticky/<name>`` in the shared folder and read it from there ever after.

    A directory without ``_SUCCESS`` is a write that broke off and is written anew. ``versioned`` adds ``version_of`` to the name, so
    that changed inputs, logic or parameters are not answered by an old result; without it the name alone counts. ``source`` is the
    frame whose plan and files count where the frame itself reads tables of its own making; the frame is then given as a function,
    called only if it is to be written. What a function reads besides what it encloses belongs into ``parameters``."""
    if source is None and callable(df):
        raise ValueError("a function needs a source")
    spark = (df if source is None else source).sparkSession
    path = f"{shared_dir(spark)}/_sticky/{name}" + (f"-{version_of(df, source, parameters)}" if versioned else "")
    if not _complete(spark, path):
        (df() if callable(df) else df).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename many columns at once; names not in the frame are ignored."""
    return df.withColumnsRenamed(names)


def approx_sizes(df: DataFrame, columns: list[str], rsd: float = 0.1) -> DataFrame:
    """Approximate numbers of distinct values, one row."""
    return df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns])


def semi_filter(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose value in each column occurs in the same column of ``keys``, column by column and not as a tuple: what a
    Bloom filter per column lets through at a false-positive rate of 0."""
    for c in columns:
        df = df.join(keys.select(c).distinct(), c, "left_semi")
    return df


def make_bloom_filters(df: DataFrame, columns: list[str], fpr: float = 0.001, rsd: float = 0.1) -> list:
    """One JVM Bloom filter per column over its distinct values as text, built per partition and merged in a tree.

    Its size follows the approximate number of values; beyond SIZE_LIMIT_MB it raises instead of filling the driver."""
    sizes = approx_sizes(df, columns, rsd).first()
    out = []
    for c in columns:
        n = max(1, int(sizes[c] * (1 + rsd)))
        stat = df.select(F.col(c).cast("string").alias(c)).filter(F.col(c).isNotNull()).distinct()._jdf.stat()
        bits_mb = -n * math.log(fpr) / (math.log(2) ** 2) / 8e6
        if bits_mb > SIZE_LIMIT_MB:
            raise ValueError(f"a filter of {bits_mb:.0f} MB for {c} is too large for the driver; use semi_filter")
        out.append(stat.bloomFilter(c, n, fpr))
    return out


SIZE_LIMIT_MB = 64


def _bits(c: Column, n_bits: int, n_hashes: int) -> Column:
    """The places of a value's bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_hashes - 1)), lambda i: F.pmod(F.xxhash64(c, i), F.lit(n_bits)))


def bloom_shape(values: int, fpr: float = 0.001) -> tuple[int, int]:
    """Bits and hashes of a filter of so many values and that rate of false positives."""
    n_bits = max(64, math.ceil(-values * math.log(fpr) / math.log(2) ** 2))
    return n_bits, max(1, round(n_bits / max(1, values) * math.log(2)))


def bloom_words(df: DataFrame, column: str, n_bits: int, n_hashes: int) -> DataFrame:
    """word, bits: a Bloom filter over a column's values as rows of 64 bits, built without the driver and of any size. Words are
    combined before the shuffle; nulls are in no filter. Filters of the same shape are united by ``unite_words``."""
    at = df.filter(F.col(column).isNotNull()).select(F.explode(_bits(F.col(column).cast("string"), n_bits, n_hashes)).alias("_at"))
    return unite_words(at.select(F.shiftright("_at", 6).alias("word"), F.expr("shiftleft(1L, CAST(_at & 63 AS INT))").alias("bits")))


def unite_words(words: DataFrame) -> DataFrame:
    """One filter of the rows of several."""
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def might_contain(df: DataFrame, column: str, words: DataFrame, n_bits: int, n_hashes: int) -> DataFrame:
    """The distinct values of a column (as text) that a filter lets through: all it was built over, and few others."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    at = values.select("value", F.explode(F.array_distinct(_bits(F.col("value"), n_bits, n_hashes))).alias("_at"))
    met = at.withColumn("word", F.shiftright("_at", 6)).join(words, "word", "left")
    passed = F.bool_and(F.expr("coalesce(shiftright(bits, CAST(_at & 63 AS INT)) & 1L, 0L) = 1L"))
    return met.groupBy("value").agg(passed.alias("_in")).filter("_in").select("value")
