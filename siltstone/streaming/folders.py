"""Folder fingerprints on streams: the state of each folder after each commit, as deltas arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["REPO_OWNER", "REPOSITORY", "FOLDER"]
OUT = "REPO_OWNER string, REPOSITORY string, FOLDER string, COMMIT_TIME long, sum_hash_crc long, sum_name_crc long, n_files long"
STATE = "sum_hash_crc long, sum_name_crc long, n_files long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("COMMIT_TIME", kind="stable")
    base = state.get if state.exists else (0, 0, 0)
    out = rows[["COMMIT_TIME"]].copy()
    for name, delta, start in zip(("sum_hash_crc", "sum_name_crc", "n_files"), ("_dh", "_dn", "_df"), base):
        out[name] = rows[delta].cumsum() + start
    state.update(tuple(int(out[c].iloc[-1]) for c in ("sum_hash_crc", "sum_name_crc", "n_files")))
    for name, value in zip(KEYS, key):
        out[name] = value
    yield out[[*KEYS, "COMMIT_TIME", "sum_hash_crc", "sum_name_crc", "n_files"]]


def running_states(deltas: DataFrame) -> DataFrame:
    """A stream of ``fingerprint.folder_deltas`` rows to the state of each folder after each. The state store keeps three numbers
    per folder. Deltas of one folder must arrive in the order of COMMIT_TIME from batch to batch; within a batch any order will do."""
    return deltas.groupBy(*KEYS).applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
