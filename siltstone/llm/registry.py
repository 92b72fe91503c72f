"""Named queries of this subpackage over a directory of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, handwritten, lookalike, packing, seen, spans, syntax
from siltstone.session import materialise
from siltstone.sources.lake import table

Query = Callable[[SparkSession, str], DataFrame]


def _store(s: SparkSession, d: str, measure: bool) -> seen.KeyStore:
    store = seen.ingest(table(s, d, "file_metadata"), table(s, d, "hash_index"), measure=measure)
    store.close()
    return store


def _marks(s: SparkSession, d: str) -> DataFrame:
    return handwritten.marks(table(s, d, "file_metadata"), table(s, d, "contents"))


def _violations(s: SparkSession, d: str) -> DataFrame:
    documents = table(s, d, "documents")
    sizes = materialise(bpe.count_tokens(documents, "doc_id", "text"), "sizes")
    return packing.violations(materialise(packing.containers(sizes, documents.count()), "packed"), sizes)


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: seen.seen_rows(_store(s, d, False)),
    "p1_report": lambda s, d: seen.report(_store(s, d, True)),
    "p1_totals": lambda s, d: seen.totals(_store(s, d, True)),
    "p2_found": lambda s, d: spans.shared_spans(table(s, d, "contents")),
    "p2_amounts": lambda s, d: spans.shared_amounts(table(s, d, "contents")),
    "p4_found": lambda s, d: syntax.invalid_revisions(table(s, d, "file_metadata"), table(s, d, "contents")),
    "p4_rates": lambda s, d: syntax.rates(table(s, d, "file_metadata"), table(s, d, "contents")),
    "p4_errors": lambda s, d: syntax.parse_contents(table(s, d, "file_metadata"), table(s, d, "contents")),
    "p5_found": lambda s, d: handwritten.not_handwritten(_marks(s, d)),
    "p5_marks": _marks,
    "p8_ids": lambda s, d: bpe.encode(table(s, d, "documents"), "doc_id", "text"),
    "p8_round_trip": lambda s, d: bpe.decode(bpe.encode(table(s, d, "documents"), "doc_id", "text"), "doc_id", "ids"),
    "p9_containers": lambda s, d: packing.document_containers(table(s, d, "documents")),
    "p9_fill": lambda s, d: packing.fill(packing.document_containers(table(s, d, "documents"))),
    "p9_violations": _violations,
    "p10_found": lambda s, d: lookalike.lookalike_pairs(table(s, d, "documents")),
    "p10_classes": lambda s, d: lookalike.lookalike_classes(table(s, d, "documents")),
    "p10_forms": lambda s, d: lookalike.consistent_texts(table(s, d, "documents")),
}
