"""Problem 2: long exact spans shared between records, by a log-structured index of window hashes.

Every window of ``span`` characters names one anchor: the least of the hashes of its substrings of ``gram`` characters, the
rightmost of equal ones. Equal windows name equal anchors, so a window can only recur where its anchor recurs, and about one
position in eighty is an anchor. A posting is an anchor with the range of window starts that name it.

The index keeps, for each anchor hash, the least and greatest record and the number of postings, in sorted immutable runs. A new
batch becomes a run, is merge-joined with the runs before it (all lie in the same buckets by hash, so only the batch moves), and says
which hashes occur in several records; runs of a level are merged where they lie when there are ``fanout`` of them. A manifest lists
what belongs to the index, which another session can open and go on with.

Postings of such hashes are settled in two steps. Postings whose whole surroundings (all windows that name the anchor) also occur
in another record are shared as a whole: surroundings are compared by 128 bits of their text's SHA-256 digest, for which no two
different texts that agree can be found. Those left lie at the edge of what is shared: their texts are read again, and window by
window compared with the others of the same anchor. There a 64-bit hash only proposes; characters decide. Groups of more than
``group`` texts, and anchors of more than ``hot`` postings, take a way on which every window is a row of its own, named by such a
digest and combined before the shuffle; the result is the same.

``shared_stretches`` settles all hashes that are shared, or only those that the last batch has brought or met again. What the
batches give one after the other adds up to the whole: a batch joins its hashes with the postings, which are narrow, and reads
the texts of no others. Postings of several batches are merged into files that are ranges of hashes, sorted, so that the few hashes
of a small batch are found by the fences of files and blocks, and no hot hash lies in one file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.hexes import hex_id
from siltstone.llm.live import live_contents
from siltstone.operators.skew import BROADCAST_ROWS, sent_if_small
from siltstone.session import buckets_for, load_state, materialise, remove, save_state, scratch, shuffle_partitions

SPAN, GRAM = 200, 32
BATCHES, FANOUT = 3, 3
GROUP, HOT_POSTINGS, SALTS = 20_000, 50_000, 16
TEXTS = 100_000  # records of a bucket
ROW_GROUP = 8 << 20  # bytes of a block of postings
NUMBER_BITS = 64
COMPARED = 1 << 22  # characters compared at once
BLOCK = 1 << 20  # characters that are hashed at once
PLACES = 1 << 24  # characters of a block, at most
POINT_HASHES = 1_000  # of a batch whose postings are looked up by fences
CHUNK = 8_000  # texts that are verified at once, besides the rest of a group

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    up, down = np.full(n + 1, base, _U), np.full(n + 1, pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes:
    """Hashes of any stretch of a text in constant time."""

    def __init__(self, codes: np.ndarray, base: int = _BASE):
        n = len(codes)
        up, self.down = _powers(base, 1 << max(20, int(n).bit_length()))
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_mix(codes + _U(base & 0xFFFF)) * up[:n], dtype=_U, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]


def _digest(text: str) -> bytes:
    return sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)


def _rightmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each position, where the least of the next ``width`` values, by their upper 40 bits, stands, the rightmost of equal ones.
    The lower bits hold the place, from the right, so that the least of both is taken at once."""
    if len(values) > PLACES:
        raise ValueError(f"at most {PLACES} values at once")
    mask = _U(PLACES - 1)
    least, size = (values & ~mask) | (mask - np.arange(len(values), dtype=_U)), 1
    while size * 2 <= width:
        least = np.minimum(least[size:], least[:-size])
        size *= 2
    if width > size:
        least = np.minimum(least[width - size :], least[: size - width])
    return (mask - (least & mask)).astype(np.int64)


def _windows(lengths: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(text number, start, place in the joined texts) of every window of texts of some lengths."""
    offsets = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - span + 1, 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, start, offsets[text] + start


def anchors(texts: list[str], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, hash, surroundings, first window start, windows, lead) of the postings of some texts. lead is the anchor's
    place behind the first start; surroundings are digests of all the windows' text and the lead."""
    joined = "".join(texts)
    codes = _codes(joined)
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    empty = np.zeros(0, np.int64)
    if len(codes) < span:
        return empty, empty, empty, empty, empty, empty
    i = np.arange(len(codes) - gram + 1)
    values = _mix(_Hashes(codes).of(i, i + gram))
    at = _rightmost_least(values, span - gram + 1)
    # windows that lie within one text
    text, _, starts = _windows(lengths, span)
    if not len(starts):
        return empty, empty, empty, empty, empty, empty
    new = np.ones(len(starts), bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, b, t = starts[first], starts[last], text[first]
    lead = at[a] - a
    around = [_digest(f"{z} {joined[x:y]}") for x, y, z in zip(a.tolist(), (b + span).tolist(), lead.tolist())]
    return t, values[at[a]].view(np.int64), around, a - offsets[t], b - a + 1, lead


_POSTING = "rec long, fp long, around binary, place long"


def _postings(span: int, gram: int):
    """place packs the first window start, the number of windows and the lead (the last two below 65536)."""

    def pieces(recs: list[int], texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str]]]:
        """Texts in blocks. A text longer than a block is cut so that every window lies in a piece."""
        r, o, t, n = [], [], [], 0
        for rec, text in zip(recs, texts):
            for a in range(0, max(1, len(text) - span + 1), BLOCK):
                piece = text[a : a + BLOCK + span - 1]
                if len(piece) < span:
                    continue
                r.append(rec)
                o.append(a)
                t.append(piece)
                n += len(piece)
                if n >= BLOCK:
                    yield r, o, t
                    r, o, t, n = [], [], [], 0
        if t:
            yield r, o, t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for recs, offsets, texts in pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t, fp, around, start, count, lead = anchors(texts, span, gram)
                place = ((start + np.array(offsets, np.int64)[t]) << 32) | (count << 16) | lead
                cols = [pa.array(np.array(recs, np.int64)[t]), pa.array(fp), pa.array(around, pa.binary()), pa.array(place)]
                yield pa.RecordBatch.from_arrays(cols, names=["rec", "fp", "around", "place"])

    return run


@dataclass(frozen=True)
class Run:
    table: str
    path: str
    level: int


@dataclass(frozen=True)
class Part:
    path: str
    level: int


class SpanIndex:
    """Postings of all records taken so far, and the runs of anchor hashes. ``buckets`` is fixed for the life of an index and should
    suit the number of records it is to hold. One writer at a time: a second one fails when it writes its manifest."""

    def __init__(self, spark: SparkSession, path: str | None = None, span: int = SPAN, gram: int = GRAM, fanout: int = FANOUT, buckets: int | None = None):
        if not 0 < gram <= span or span - gram >= 1 << 16:
            raise ValueError("gram must be from 1 to span, and span - gram below 65536")
        self.spark, self.span, self.gram, self.fanout = spark, span, gram, fanout
        self.path = path or scratch(spark, "spans")
        self.buckets = buckets or buckets_for(spark, 0)
        self.runs: list[Run] = []
        self.parts: list[Part] = []
        self.shared: list[str] = []
        self.number = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SpanIndex:
        """The index that a session, this or another, has left in ``path``."""
        number, state = load_state(spark, path)
        index = cls(spark, path, state["span"], state["gram"], state["fanout"], state["buckets"])
        index.number, index.parts, index.shared = number, [Part(**p) for p in state["parts"]], state["shared"]
        for r in state["runs"]:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {r['table']} (fp BIGINT, least BIGINT, greatest BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {index.buckets} BUCKETS LOCATION '{r['path']}'")
            index.runs.append(Run(**r))
        return index

    def close(self) -> None:
        """Take the runs out of the session's catalogue; the files stay."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r.table}")

    def _save(self) -> None:
        self.number += 1
        save_state(self.spark, self.path, self.number, {"span": self.span, "gram": self.gram, "fanout": self.fanout, "buckets": self.buckets, "runs": [asdict(r) for r in self.runs], "parts": [asdict(p) for p in self.parts], "shared": self.shared})

    def _write(self, entries: DataFrame, level: int) -> Run:
        """A run (fp, least, greatest, n), one row per hash, of rows that lie in the index's buckets."""
        name = f"spans_{uuid.uuid4().hex}"
        path = f"{self.path}/run-{level}-{name}"
        entries.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).option("compression", "zstd").saveAsTable(name)
        return Run(name, path, level)

    def _merged(self, tables: list[str]) -> DataFrame:
        rows = self.spark.table(tables[0])
        for t in tables[1:]:
            rows = rows.unionByName(self.spark.table(t))
        return rows.groupBy("fp").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n").alias("n"))

    def add(self, texts: DataFrame) -> None:
        """Take a batch (rec, text) of records that are not in the index yet."""
        self._merge_parts()
        part = f"{self.path}/postings-{uuid.uuid4().hex}"
        texts.select("rec", "text").filter(F.length("text") >= self.span).mapInArrow(_postings(self.span, self.gram), _POSTING).write.option("compression", "zstd").parquet(part)
        self.parts.append(Part(part, 0))
        rows = self.spark.read.schema(_POSTING).parquet(part)
        # the postings of a hash are combined before the shuffle
        with shuffle_partitions(self.spark, self.buckets):
            run = self._write(rows.groupBy("fp").agg(F.min("rec").alias("least"), F.max("rec").alias("greatest"), F.count("*").alias("n")), 0)
        every = self.spark.table(run.table).withColumn("_new", F.lit(True))
        for old in self.runs:
            every = every.unionByName(self.spark.table(old.table).withColumn("_new", F.lit(False)))
        hits = every.groupBy("fp").agg(F.min("least").alias("_l"), F.max("greatest").alias("_g"), F.max("_new").alias("_new")).filter("_new AND _l < _g").select("fp")
        found = f"{self.path}/shared-{len(self.shared)}-{uuid.uuid4().hex}"
        hits.write.parquet(found)
        self.shared.append(found)
        self.runs.append(run)
        self._save()
        self._compact()

    def _compact(self) -> None:
        level = 0
        while any(r.level >= level for r in self.runs):
            old = [r for r in self.runs if r.level == level]
            if len(old) >= self.fanout:
                merged = self._write(self._merged([r.table for r in old]), level + 1)
                self.runs = [r for r in self.runs if r.level != level] + [merged]
                self._save()
                for r in old:
                    self.spark.sql(f"DROP TABLE IF EXISTS {r.table}")
                    remove(self.spark, r.path)
            level += 1

    def _merge_parts(self) -> None:
        """Bring the postings of ``fanout`` parts of a level into one of the next, by ranges of hash and record."""
        level = 0
        while any(p.level >= level for p in self.parts):
            old = [p for p in self.parts if p.level == level]
            if len(old) >= self.fanout:
                path = f"{self.path}/postings-{uuid.uuid4().hex}"
                rows = self.spark.read.schema(_POSTING).parquet(*[p.path for p in old])
                rows.repartitionByRange("fp", "rec").sortWithinPartitions("fp", "rec").write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
                self.parts = [p for p in self.parts if p.level != level] + [Part(path, level + 1)]
                self._save()
                for p in old:
                    remove(self.spark, p.path)
            level += 1

    def postings(self, hashes: list[int] | None = None) -> DataFrame:
        """All postings, or those of a few hashes, read from the blocks whose fences let them in."""
        rows = self.spark.read.schema(_POSTING).parquet(*[p.path for p in self.parts])
        return rows if hashes is None else rows.filter(F.col("fp").isin(hashes))

    def shared_hashes(self, last: bool = False) -> DataFrame:
        """fp of the anchors that stand in several records, as the merge joins found them; with ``last`` those that the last batch
        has."""
        return self.spark.read.schema("fp long").parquet(*(self.shared[-1:] if last else self.shared)).distinct()

    def hot_hashes(self, least: int) -> DataFrame:
        """fp of the anchors with at least ``least`` postings."""
        tables = [r.table for r in self.runs]
        rows = self.spark.table(tables[0]).select("fp", "n") if len(tables) == 1 else self._merged(tables).select("fp", "n")
        return rows.filter(F.col("n") >= least).select("fp")


def _differing(codes: np.ndarray, at: np.ndarray, other: np.ndarray, span: int) -> np.ndarray:
    """Numbers of the windows (at ``at``) whose characters are not those at ``other``. Windows that follow each other at one distance
    from their others are compared as one stretch."""
    i = np.flatnonzero(at != other)
    if not len(i):
        return i
    a, d = at[i], at[i] - other[i]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(a) != 1) | (np.diff(d) != 0)
    first = np.flatnonzero(new)
    lengths = a[np.append(first[1:], len(i)) - 1] - a[first] + span
    bad = []
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COMPARED, "right")))
        n = lengths[lo:hi]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[first[lo:hi]], n)
        wrong = np.flatnonzero(codes[place] != codes[place - np.repeat(d[first[lo:hi]], n)])
        if len(wrong):
            # all windows of the stretch that reach over a wrong character
            of = np.searchsorted(np.cumsum(n), wrong, "right") + lo
            for k, p in zip(of.tolist(), place[wrong].tolist()):
                w = np.arange(first[k], first[k + 1] if k + 1 < len(first) else len(i))
                bad.append(i[w[(a[w] <= p) & (a[w] + span > p)]])
        lo = hi
    return np.unique(np.concatenate(bad)) if bad else np.zeros(0, np.int64)


def _groups(texts: list[str], span: int) -> tuple[np.ndarray, ...]:
    """(text number, start, group) of every window, and an order that brings groups together; windows are in one group if and only if
    they have the same characters."""
    text, start, at = _windows(np.array([len(t) for t in texts], np.int64), span)
    if not len(text):
        return text, start, text, text
    joined = "".join(texts)
    codes = _codes(joined)
    h = _Hashes(codes).of(at, at + span)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    bad = _differing(codes, at, at[order[np.flatnonzero(new)]][group], span)
    if len(bad):  # different windows met under one hash: theirs are grouped by their characters
        names: dict[tuple[int, str], int] = {}
        n = int(new.sum())
        for i in np.flatnonzero(np.isin(group, group[bad])).tolist():
            group[i] = n + names.setdefault((int(group[i]), joined[at[i] : at[i] + span]), len(names))
        order = np.argsort(group, kind="stable")
    return text, start, group, order


def _edges(recs: np.ndarray, starts: np.ndarray, several: np.ndarray, texts: list[str], span: int) -> list[np.ndarray]:
    """(rec, start, end) of the stretches of shared windows of the texts that are not in ``several`` records as a whole."""
    text, start, group, order = _groups(texts, span)
    if not len(text):
        return [np.zeros(0, np.int64)] * 3
    g = group[order]
    new = np.ones(len(order), bool)
    new[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(new)
    who = recs[text[order]]
    many = (np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)) | np.logical_or.reduceat(several[text[order]], first)
    shared = np.empty(len(order), bool)
    shared[order] = np.repeat(many, np.diff(np.append(first, len(order))))
    hit = np.flatnonzero(shared & ~several[text])
    if not len(hit):
        return [np.zeros(0, np.int64)] * 3
    begin = np.ones(len(hit), bool)
    begin[1:] = (np.diff(hit) > 1) | (text[hit[1:]] != text[hit[:-1]])
    a = hit[begin]
    b = hit[np.append(np.flatnonzero(begin)[1:], len(hit)) - 1]
    return [recs[text[a]], starts[text[a]] + start[a], starts[text[a]] + start[b] + span]


_STRETCH = "rec long, span_start long, span_end long"


def _verify(span: int):
    """Batches (fp, rec, start, several, text) sorted by fp, to stretches. Groups are kept whole; several are done at once, as
    windows of different anchors never are equal."""

    def done(rows: list[list]) -> pa.RecordBatch:
        fp, rec, start, several, text = rows
        out = _edges(np.array(rec, np.int64), np.array(start, np.int64), np.array(several, bool), text, span)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["rec", "span_start", "span_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], []]
        for b in batches:
            for mine, c in zip(rows, b.columns):
                mine += c.to_pylist()
            if len(rows[0]) >= CHUNK:
                cut = len(rows[0]) - 1
                while cut > 0 and rows[0][cut - 1] == rows[0][-1]:
                    cut -= 1
                if cut > 0:
                    yield done([c[:cut] for c in rows])
                    rows = [c[cut:] for c in rows]
        if rows[0]:
            yield done(rows)

    return run


def _explode(span: int):
    """Batches (rec, start, several, text) to a row for every window: rec, at, window (a digest), several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rec, start, several, texts = (c.to_pylist() for c in b.slice(lo, 500).columns)
                text, at, _ = _windows(np.array([len(t) for t in texts], np.int64), span)
                names = [_digest(texts[t][i : i + span]) for t, i in zip(text.tolist(), at.tolist())]
                cols = [pa.array(np.array(rec, np.int64)[text]), pa.array(np.array(start, np.int64)[text] + at), pa.array(names, pa.binary()), pa.array(np.array(several, bool)[text])]
                yield pa.RecordBatch.from_arrays(cols, names=["rec", "at", "window", "several"])

    return run


def _unpacked(rows: DataFrame, span: int) -> DataFrame:
    p = F.col("place")
    return rows.withColumn("start", F.shiftright(p, 32)).withColumn("chars", F.shiftright(p, 16).bitwiseAND(F.lit(0xFFFF)) + span - 1)


def _split_hot(postings: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of other anchors and of hot ones. The list of hot anchors, written beforehand, grows with the data: where it is
    too long to be sent to all executors, it is joined once per salt, so that no anchor's postings meet in one task."""
    if hot.count() <= BROADCAST_ROWS:
        return postings.join(F.broadcast(hot), "fp", "left_anti"), postings.join(F.broadcast(hot), "fp", "left_semi")
    salted = postings.withColumn("_salt", F.pmod(F.xxhash64("rec", "place"), F.lit(SALTS)).cast("int"))
    each = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return salted.join(each, ["fp", "_salt"], "left_anti").drop("_salt"), salted.join(each, ["fp", "_salt"], "left_semi").drop("_salt")


def shared_stretches(index: SpanIndex, texts: DataFrame, group: int = GROUP, hot: int = HOT_POSTINGS, last: bool = False) -> DataFrame:
    """rec, span_start, span_end: the maximal stretches of each record in ``texts`` (rec, text, all that the index has) whose
    positions lie in windows that another record has too.

    With ``last`` only anchors of the last batch are settled: the stretches, in new records and in earlier ones, that it has brought
    or met again. Stretches of batches are put together by ``joined_stretches``."""
    c = F.col
    span, spark = index.span, index.spark
    wanted = index.shared_hashes(last)
    hot_list = index.hot_hashes(hot)  # one anchor in ``hot`` postings at most
    hot_list = materialise(hot_list.join(wanted, "fp", "left_semi") if last else hot_list, "hot")
    any_hot = not hot_list.isEmpty()
    few = [r.fp for r in wanted.limit(POINT_HASHES + 1).collect()] if last else []
    postings = index.postings(few if last and len(few) <= POINT_HASHES else None)
    cold, heavy = _split_hot(postings, hot_list) if any_hot else (postings, None)
    by_around, by_fp = Window.partitionBy("fp", "around"), Window.partitionBy("fp")
    # everything below lies partitioned by fp; a group has less than the hot number of rows
    settled = (
        cold.join(wanted, "fp", "left_semi")
        .withColumn("several", F.min("rec").over(by_around) != F.max("rec").over(by_around))
        .withColumn("_nth", F.row_number().over(by_around.orderBy("rec", "place")))
        .withColumn("_lone", F.max(~c("several")).over(by_fp))
    )
    settled = materialise(_unpacked(settled, span).filter("several OR _lone").select("rec", "fp", "start", "chars", "several", (c("_lone") & (~c("several") | (c("_nth") == 1))).alias("open")), "settled")
    whole = settled.filter("several").select("rec", c("start").alias("span_start"), (c("start") + c("chars")).alias("span_end"))

    # the texts of what is open, one for surroundings that several records have
    opened = settled.filter("open").select("rec", "fp", "start", "chars", "several")
    sizes = opened.groupBy("fp").agg(F.count("*").alias("_size")).filter(c("_size") > group)
    large = materialise(sizes.select("fp"), "large")
    any_large = not large.isEmpty()
    text = lambda rows: rows.join(texts.select("rec", "text"), "rec").select(*[x for x in rows.columns if x != "chars"], F.substring("text", c("start") + 1, c("chars")).alias("text"))
    small = opened.join(large, "fp", "left_anti") if any_large else opened
    checked = text(small).select("fp", "rec", "start", "several", "text").repartition("fp").sortWithinPartitions("fp").mapInArrow(_verify(span), _STRETCH)
    out = whole.unionByName(checked)

    if any_hot or any_large:
        rest = opened.join(large, "fp", "left_semi").select("rec", "start", "chars", "several")
        if any_hot:
            rest = rest.unionByName(_unpacked(heavy, span).select("rec", "start", "chars", F.lit(False).alias("several")))
        windows = text(rest).select("rec", "start", "several", "text").mapInArrow(_explode(span), "rec long, at long, window binary, several boolean")
        windows = materialise(windows, "windows")
        # combined before the shuffle, so that a window of any number of records is one row per task
        both = windows.groupBy("window").agg(F.min("rec").alias("a"), F.max("rec").alias("b"), F.max("several").alias("s")).filter("a <> b OR s")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        hits = windows.filter(~c("several")).withColumn("_salt", F.pmod(F.xxhash64("rec"), F.lit(SALTS)).cast("int")).join(both.select("window", salts.alias("_salt")), ["window", "_salt"], "left_semi")
        out = out.unionByName(hits.select("rec", c("at").alias("span_start"), (c("at") + span).alias("span_end")))

    return joined_stretches(out)


def joined_stretches(found: DataFrame) -> DataFrame:
    """rec, span_start, span_end: stretches of each record that touch or overlap put together."""
    ordered = Window.partitionBy("rec").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("_new", F.when(F.col("span_start") <= reach, 0).otherwise(1))
    islands = apart.withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("rec", "_island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("_island")


def _number(code: Column, tries: Column) -> Column:
    """A number of a record, by its hash code and how often others had the same number before."""
    n = F.when(tries == 0, F.xxhash64(code)).otherwise(F.xxhash64(code, tries))
    return F.shiftrightunsigned(n, 64 - NUMBER_BITS) if NUMBER_BITS < 64 else n


def _records(spark: SparkSession, contents: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """rec, hash_code, text of the live contents, written once, bucketed by rec, and the table's name. Rows of a content are combined
    before the one shuffle of the texts, which also brings them to their buckets. Should two hash codes ever have one number, both
    are numbered again and the table is written anew."""
    code = hex_id("hash_code")
    rows = contents.filter(F.col("deleted_at").isNull() & code.isNotNull()).select(code.alias("hash_code"), F.coalesce("contents", F.lit("")).alias("text"))
    moved, tries = None, 0
    while True:
        name, path = f"records_{uuid.uuid4().hex}", scratch(spark, "records")
        known = rows.withColumn("_tries", F.lit(0)) if moved is None else rows.join(sent_if_small(moved), "hash_code", "left").withColumn("_tries", F.coalesce("_tries", F.lit(0)))
        numbered = known.withColumn("rec", _number(F.col("hash_code"), F.col("_tries")))
        one = numbered.groupBy("rec").agg(F.min("hash_code").alias("hash_code"), F.max("hash_code").alias("other"), F.max("text").alias("text"))
        with shuffle_partitions(spark, buckets):
            one.write.bucketBy(buckets, "rec").option("path", path).option("compression", "zstd").saveAsTable(name)
        clashed = spark.table(name).filter("hash_code <> other").select("rec")
        if clashed.isEmpty():
            return spark.table(name).drop("other"), name
        tries += 1
        again = numbered.join(clashed, "rec", "left_semi").select("hash_code").distinct().withColumn("_tries", F.lit(tries))
        earlier = again if moved is None else moved.join(again, "hash_code", "left_anti").unionByName(again)
        moved = materialise(earlier, "renumbered")
        spark.sql(f"DROP TABLE {name}")
        remove(spark, path)


def shared_spans(contents: DataFrame, batches: int = BATCHES, span: int = SPAN, gram: int = GRAM, **options) -> DataFrame:
    """hash_code, span_start, span_end: the maximal stretches of each live content in runs of at least ``span`` characters that
    stand verbatim in a content with another hash. Positions are code points from 0, the end is exclusive.

    Repeats within one content alone do not count. Contents shorter than ``span``, empty and null ones have none; repeated rows
    of a content count once. Other columns are ignored. The result is written before it is returned."""
    spark = contents.sparkSession
    index = SpanIndex(spark, span=span, gram=gram, buckets=buckets_for(spark, contents.count(), TEXTS))
    records, name = _records(spark, contents, index.buckets)
    for i in range(batches):
        index.add(records.filter(F.pmod(F.shiftrightunsigned("rec", 20), F.lit(batches)) == i))
    found = shared_stretches(index, records, **options)
    result = materialise(found.join(records.select("rec", "hash_code"), "rec").select("hash_code", "span_start", "span_end"), "shared-spans")
    index.close()
    spark.sql(f"DROP TABLE {name}")
    return result


def shared_amounts(contents: DataFrame, **options) -> DataFrame:
    """For each live content its length, the number of shared characters and their share (0 for an empty text)."""
    spans = shared_spans(contents, **options).groupBy("hash_code").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n"))
    n = F.coalesce("n", F.lit(0))
    all_ = live_contents(contents).select("hash_code", F.length("text").cast("long").alias("n_chars"))
    return all_.join(spans, "hash_code", "left").select("hash_code", "n_chars", n.alias("n_shared"), F.when(F.col("n_chars") > 0, n / F.col("n_chars")).otherwise(0.0).alias("share"))
