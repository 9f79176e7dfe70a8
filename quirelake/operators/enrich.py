"""Filling records from other records of the same DOI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import DOI_HOST, doi_bare, has_number, has_text


def _key(c: Column, host: str) -> Column:
    return F.lower(F.trim(doi_bare(F.trim(c), host)))


def first_by_doi(side: DataFrame, host: str = DOI_HOST) -> DataFrame:
    """The first record of each DOI of a side table."""
    keyed = side.withColumn("key", _key(F.col("doi"), host)).where(has_text(F.col("key")))
    return keyed.groupBy("key").agg(F.min_by(F.struct(*side.columns), "ord").alias("s"))


def fill_from_crossref(records: DataFrame, side: DataFrame, host: str = DOI_HOST) -> DataFrame:
    """Fields that a record lacks filled from the side table's record of its DOI; citations and publisher are taken over where known."""
    joined = records.withColumn("key", _key(F.col("doi"), host)).join(first_by_doi(side, host), "key", "left")
    fill = lambda f, filled: F.when(filled(F.col(f)), F.col(f)).otherwise(F.coalesce(F.col(f"s.{f}"), F.col(f)))
    title = F.when(has_text(F.col("title")) & (F.col("title") != "Untitled"), F.col("title")).otherwise(F.when(has_text(F.col("s.title")), F.col("s.title")).otherwise(F.col("title")))
    changes = {
        "title": title,
        "authors": F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce(F.col("s.authors"), F.col("authors"))),
        "year": fill("year", has_number), "venue": fill("venue", has_text), "abstract": fill("abstract", has_text), "best_pdf_url": fill("best_pdf_url", has_text),
        "citation_count": F.when(has_number(F.col("s.citation_count")), F.col("s.citation_count")).otherwise(F.col("citation_count")),
        "publisher": F.when(has_text(F.col("s.publisher")), F.col("s.publisher")).otherwise(F.col("publisher")),
    }
    return joined.select(*(changes[c].alias(c) if c in changes else F.col(c) for c in records.columns))


def fill_from_open_access(records: DataFrame, side: DataFrame, host: str = DOI_HOST) -> DataFrame:
    """Status, PDF and landing page from the open-access record of the DOI."""
    joined = records.withColumn("key", _key(F.col("doi"), host)).join(first_by_doi(side, host), "key", "left")
    fill = lambda f: F.when(has_text(F.col(f)), F.col(f)).otherwise(F.coalesce(F.col(f"s.{f}"), F.col(f)))
    changes = {"oa_status": F.when(F.col("s.oa_status").isin("published", "preprint"), F.lit("published")).otherwise(F.col("oa_status")), "best_pdf_url": fill("best_pdf_url"), "landing_page": fill("landing_page")}
    return joined.select(*(changes[c].alias(c) if c in changes else F.col(c) for c in records.columns))


def looked_up(records: DataFrame, side: DataFrame, most: int = 20, host: str = DOI_HOST) -> DataFrame:
    """The side table's records of the first `most` DOIs: what a bounded look-up fetches."""
    asked = records.where(has_text(F.col("doi"))).orderBy("ord").limit(most).select(_key(F.col("doi"), host).alias("key")).distinct()
    return side.withColumn("key", _key(F.col("doi"), host)).join(asked, "key", "left_semi").drop("key")


def paper(records: DataFrame, wanted: str, host: str = DOI_HOST) -> DataFrame:
    """The first record with the id; without one, and if it holds a DOI, the first with that DOI."""
    by_id = records.where(F.col("id") == wanted)
    if "10." not in wanted:
        return by_id.orderBy("ord").limit(1)
    key = doi_bare(F.lit(wanted.strip().lower()), host)
    either = records.where((F.col("id") == wanted) | (_key(F.col("doi"), host) == key))
    return either.orderBy((F.col("id") != wanted).asc(), "ord").limit(1)


def unseen(page: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows of a further page whose id wasn't shown."""
    return page.join(shown.select("id").distinct(), "id", "left_anti")
