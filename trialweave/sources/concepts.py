"""The concept table that linking reads: vocabularies of all sources in one schema, built once per fingerprint."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import VersionedTable
from ..plans.stages import digest
from .vocabularies import dictionary_concepts, omop_concepts


def dictionary_spec(spec: str) -> tuple[str, str, str]:
    """(vocabulary, domain, path) of VOCABULARY:DOMAIN:PATH."""
    parts = spec.split(":", 2)
    if len(parts) != 3:
        raise ValueError(f"a dictionary is VOCABULARY:DOMAIN:PATH, not {spec!r}")
    return parts[0], parts[1], parts[2]


def union_concepts(parts: Iterable[DataFrame]) -> DataFrame:
    """Concepts of all sources, by column name; equal ids of different sources stay apart."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_concepts(concepts: DataFrame, path: str, append: bool = False, note: str = "") -> DataFrame:
    """Writes a version of the concept table, alone or after the rows of the current one; the table as written."""
    table = VersionedTable(concepts.sparkSession, path)
    now = table.read() if append else None
    table.write(concepts if now is None else union_concepts([now, concepts]), note=note)
    return table.read()


def build_concepts(spark: SparkSession, path: str, concept: str | None = None, synonym: str | None = None, dictionaries: Iterable[str] = (), vocabularies: list | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, embedder: str = "", force: bool = False) -> DataFrame:
    """The concept table at ``path``, built unless it is there, not empty and of the same sources and embedder.

    ``concept`` and ``synonym`` are OMOP tables, whose content isn't part of the fingerprint: they always build. ``dictionaries`` are
    VOCABULARY:DOMAIN:PATH. ``embed`` adds an ``embedding`` of ``fts_text``; ``embedder`` is its identity. A table without a
    fingerprint is trusted.
    """
    specs = [dictionary_spec(d) for d in dictionaries]
    if not concept and not specs:
        raise ValueError("there are neither OMOP tables nor dictionaries")
    mark = digest(sorted(map(list, specs)), sorted(vocabularies or []), embedder, embed is None)
    table = VersionedTable(spark, path)
    now = table.read()
    if not force and not concept and now is not None and table.note() in (None, "", mark) and now.limit(1).count():
        return now
    parts = [omop_concepts(spark, concept, synonym, vocabularies)] if concept else []
    parts += [dictionary_concepts(spark, place, vocabulary, domain) for vocabulary, domain, place in specs]
    rows = union_concepts(parts)
    return write_concepts(embed(rows) if embed else rows, path, note=mark)
