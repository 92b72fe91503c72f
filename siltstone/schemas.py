"""Declared schemas and uniqueness keys of the lake's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Split:
    """One table of the lake: its schema, and the columns on which its rows are unique."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.schema.names)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_s, _l = T.StringType(), T.LongType()

SPLITS = {
    s.name: s
    for s in (
        Split(
            "FILE_METADATA",
            _schema(REPO_OWNER=_s, REPOSITORY=_s, GIT_PATH=_s, HASH_CODE=_s, COMMIT_TIME=_l, COMMIT_ID=_s),
            ("REPO_OWNER", "REPOSITORY", "GIT_PATH", "HASH_CODE", "COMMIT_ID"),
        ),
        Split("COMMIT_MESSAGES", _schema(COMMIT_ID=_s, AUTHOR=_s, LONG_MESSAGE=_s), ("COMMIT_ID",)),
        Split("INDEX", _schema(HASH_CODE=_s), ("HASH_CODE",)),
        Split("CONTENTS", _schema(HASH_CODE=_s, CONTENTS=_s), ("HASH_CODE",)),
    )
}
