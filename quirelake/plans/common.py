"""What the registered queries share: the records of a directory, and the same records in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake import schema
from quirelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: The resolver's host in the test tables' DOIs.
HOST = r"doi\.example\.org"

#: The records as a common table expression.
R = """WITH r AS (SELECT rec_no AS ord, id, doi, title, authors, pub_year AS year, venue, abstract, source, source_id, oa_status, best_pdf_url, landing_page, topics, lang AS language, citation_count, created_at, updated_at, publisher FROM oa_records)
"""
EDGE = r"'^[\s\x{FEFF}\p{Z}]+|[\s\x{FEFF}\p{Z}]+$'"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, {EDGE}, '', 'g')"


def sql_doi(x: str) -> str:
    return f"regexp_replace({sql_trim(f'lower({x})')}, '^https?://doi\\.example\\.org/', '')"


def sql_bare(x: str) -> str:
    """DOI as enrichment compares it."""
    return rf"lower(trim(regexp_replace(trim({x}), '^(doi:|https?://.*?doi\.example\.org/)', '')))"


def sql_text(x: str) -> str:
    return f"coalesce({x} <> '', false)"


def records(spark: SparkSession, directory: str) -> DataFrame:
    return schema.from_harvest(table(spark, directory, "oa_records"))


def joined(c: str):
    """A list column as one text, so that both engines show it alike."""
    return F.coalesce(F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|"), F.lit("")).alias(c)


def sql_joined(x: str, name: str | None = None) -> str:
    return f"coalesce(array_to_string({x}, '|'), '') AS {name or x}"


def calls(spark: SparkSession, directory: str) -> DataFrame:
    """Events as calls to six sources."""
    names = F.array(*(F.lit(s) for s in ("openalex", "crossref", "europepmc", "ncbi", "arxiv", "core")))
    e = table(spark, directory, "events")
    return e.select(
        F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.element_at(names, (F.col("user_id") % 6 + 1).cast("int")).alias("source"), F.col("event_type").alias("service"),
        F.col("value").alias("latency"), (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("int").alias("results"), F.col("user_id"),
    )


CALLS = """WITH calls AS (SELECT event_id AS call_id, ts, (['openalex','crossref','europepmc','ncbi','arxiv','core'])[(user_id % 6 + 1)::INT] AS source, event_type AS service, value AS latency, event_type <> 'error' AS ok, (props::JSON->>'$.k')::INT AS results, user_id FROM events)
"""


def points(spark: SparkSession, directory: str) -> DataFrame:
    """Events as the points of five services, with running counts of requests."""
    from quirelake.operators.telemetry import numbered

    c = numbered(calls(spark, directory), "service", "requests", "call_id")
    return c.select(F.col("call_id").alias("point_id"), "ts", "service", F.col("requests").cast("bigint").alias("requests"), "latency", F.when(F.col("ok"), 0.0).otherwise(1.0).alias("error_rate"))


POINTS = CALLS.rstrip() + """, points AS (SELECT call_id AS point_id, ts, service, row_number() OVER (PARTITION BY service ORDER BY ts, call_id)::BIGINT AS requests, latency, CASE WHEN ok THEN 0.0 ELSE 1.0 END AS error_rate FROM calls)
"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded to six places."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})
