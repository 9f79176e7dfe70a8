"""Points of records and sources as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake import schema
from quirelake.functions.text import has_number, has_text


def _points(*pairs: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for test, n in pairs:
        total = total + F.when(test, n).otherwise(0)
    return total


def _filled(names: set[str], wanted: dict[str, int]) -> list[tuple[Column, int]]:
    tests = []
    for name, n in wanted.items():
        if name in names:
            c = F.col(name)
            # a canonical list of authors counts even when empty
            tests.append((c.isNotNull() & (F.size(c) >= (0 if name == "canonical_authors" else 1)) if "uthors" in name else has_number(c) if "ear" in name else has_text(c), n))
    return tests


# Points for fields that are filled.
FIELDS = {"title": 10, "authors": 10, "year": 5, "venue": 5, "abstract": 10}
CANONICAL = {"canonical_title": 5, "canonical_authors": 5, "canonical_year": 3, "canonical_venue": 3, "canonical_abstract": 5}


def relevance(names: list[str]) -> Column:
    """Completeness of a record with open access, PDF and citations; `names` are the columns it has."""
    have = set(names)
    parts = _filled(have, FIELDS | CANONICAL)
    if "pdf_url" in have:
        parts.append((has_text(F.col("pdf_url")), 15))
        parts.append((has_text(F.col("pdf_url")) & F.contains(F.coalesce("pdf_source", F.lit("")), F.lit("publisher")), 5))
    parts.append((F.coalesce(F.col("oa_status") == "published", F.lit(False)), 10))
    parts.append((F.coalesce(F.col("oa_status") == "preprint", F.lit(False)), 5))
    if "is_redistributable" in have:
        parts.append((F.coalesce(F.col("is_redistributable"), F.lit(False)), 3))
    return _points(*parts) + F.when(has_number(F.col("citation_count")), F.least(F.col("citation_count") / 10, F.lit(10.0))).otherwise(0.0)


def record_score(names: list[str]) -> Column:
    """Points by which the best record of a work is chosen."""
    have = set(names)
    parts = _filled(have, FIELDS | CANONICAL)
    if "pdf_url" in have:
        parts.append((has_text(F.col("pdf_url")), 15))
        parts.append((has_text(F.col("pdf_url")) & F.contains(F.coalesce("pdf_source", F.lit("")), F.lit("publisher")), 5))
    if "is_redistributable" in have:
        parts.append((F.coalesce(F.col("is_redistributable"), F.lit(False)), 3))
    if "licence" in have:
        parts.append((has_text(F.col("licence")), 5))
    if "reference_count" in have:
        parts.append((has_number(F.col("reference_count")), 2))
    parts.append((has_number(F.col("citation_count")), 3))
    return _points(*parts) + schema.literal_map(schema.BONUS, 0)(F.col("source"))


def source_score(latency: Column, success: Column, quality: Column) -> Column:
    """Standing of a source among those that can answer."""
    return 0.4 * success + 0.3 * quality + 0.3 * (1 - F.least(latency / 3000, F.lit(1.0)))


def retry_delay(base: Column, attempt: Column, most: int = 10_000) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most)))


def improvement(before: Column, after: Column) -> Column:
    """Change against `before` in percent, null if that is 0."""
    return F.try_divide(after - before, before) * 100
