"""Problem 9: filling containers of a fixed capacity, by the sum-of-squares rule.

An item goes where the sum over all residual gaps of the squared number of open containers with that gap becomes least. The
rule keeps one counter per gap, whatever the number of items. Items are spread at random over groups of about ``GROUP`` items,
each packed on its own, so that the work spreads over tasks; a group leaves a bounded number of containers open, whose share
falls with the size of the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bpe import VOCABULARY, count_tokens

CAPACITY = 2048
GROUP = 8_000
PACKED = "doc_id long, piece int, n_pieces int, token_start long, n_tokens long, container_id string"


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, none larger than the capacity. Items are placed from the largest to the smallest, equal
    ones in their order; of equally good places the one with the smallest gap is taken, an open container before a new one,
    and the container opened last."""
    out = np.empty(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap; gap 0 is full and does not count
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        # change of the sum of squares: one container leaves gap g, one comes to gap g - s
        change = 2 - 2 * count[s:capacity] + 2 * count[: capacity - s]
        if s < capacity:
            change[0] = 1 - 2 * count[s]
        change[count[s:capacity] == 0] = np.iinfo(np.int64).max
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if len(change) and change[g := int(change.argmin())] <= fresh:
            gap = g + s
            c = members[gap].pop()
            count[gap] -= 1
        else:
            gap, c = capacity, used
            used += 1
        out[i] = c
        if gap > s:
            count[gap - s] += 1
            members[gap - s].append(c)
    return out


def _pack_group(capacity: int):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "piece", "n_tokens"], kind="stable", ignore_index=True)
        items["container_id"] = [f"{key[0]}-{c}" for c in pack(items["n_tokens"].to_numpy(), capacity)]
        return items.drop(columns="_group")

    return run


def containers(sizes: DataFrame, n_rows: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``sizes`` (doc_id, n_tokens) packed: doc_id, piece, n_pieces, token_start, n_tokens, container_id.

    A document larger than the capacity is split into full pieces and a rest (a piece of token_start to token_start + n_tokens
    of its ids); no other is split. A full piece is alone in its container. Documents without tokens or with a null size are
    left out; a repeated or null doc_id is packed as often as it occurs. ``n_rows``, about the number of rows, sets the number
    of groups. No rows give no containers."""
    c = F.col
    n = F.ceil(c("n_tokens") / F.lit(capacity)).cast("int")
    pieces = (
        sizes.filter(c("n_tokens") > 0)
        .select("doc_id", "n_tokens", n.alias("n_pieces"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
        .select("doc_id", "piece", "n_pieces", (c("piece").cast("long") * capacity).alias("token_start"), F.least(F.lit(capacity), c("n_tokens") - c("piece") * capacity).cast("long").alias("n_tokens"))
    )
    groups = max(1, math.ceil(n_rows / group))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(groups)).cast("int")
    return pieces.withColumn("_group", spread).groupBy("_group").applyInPandas(_pack_group(capacity), PACKED)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, the share of used space, and the share that the fewest possible containers would use: one row."""
    one = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"))
    full = F.col("n_containers") * capacity
    return one.select("*", F.when(full > 0, F.col("n_tokens") / full).alias("used"), F.when(full > 0, F.col("n_tokens") / (F.ceil(F.col("n_tokens") / capacity) * capacity)).alias("best_used"))


def document_containers(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """All documents with a non-empty text, sized in tokens, in containers. The rows are counted first, which reads only the
    files' footers."""
    return containers(count_tokens(documents, "doc_id", "text", path), documents.count(), capacity)


def violations(packed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that holds a packing of ``sizes`` (doc_id, n_tokens, ids distinct) to its rules: packed documents, containers of more than
    ``capacity``, documents split although they fit, and documents whose pieces are not all of their tokens once."""
    c = F.col
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(c("n") > capacity).alias("n_overfull"))
    of = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"), F.max(c("token_start") + c("n_tokens")).alias("end"), F.max("n_pieces").alias("n_pieces"))
    both = sizes.filter(c("n_tokens") > 0).join(of, "doc_id", "full")
    whole = (c("packed") == c("n_tokens")) & (c("end") == c("n_tokens")) & (c("pieces") == c("n_pieces"))
    docs = both.agg(F.count("packed").alias("n_documents"), F.count_if((c("n_tokens") <= capacity) & (c("pieces") > 1)).alias("n_split"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("n_incomplete"))
    # each of the two has one row
    return docs.withColumn("_k", F.lit(0)).join(full.withColumn("_k", F.lit(0)), "_k").drop("_k")
