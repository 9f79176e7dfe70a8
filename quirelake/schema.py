"""The record schema, and the fixed tables that operators look up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
_A = T.ArrayType(_S)

RECORD = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("id", _S), ("doi", _S), ("title", _S), ("authors", _A), ("year", _I), ("venue", _S), ("abstract", _S), ("source", _S), ("source_id", _S), ("oa_status", _S),
            ("best_pdf_url", _S), ("landing_page", _S), ("topics", _A), ("language", _S), ("citation_count", _L), ("created_at", _S), ("updated_at", _S), ("publisher", _S),
        )
    ]
)

# Sources by the trust that merging puts in them, first is best; sources not listed rank 100.
TRUSTED = ("crossref", "openalex", "unpaywall", "europepmc", "core", "openaire", "plos", "mdpi", "elife", "frontiers", "arxiv", "biorxiv", "medrxiv", "zenodo", "osf", "hal", "scielo", "redalyc", "doaj", "ncbi", "opencitations")
PRIORITY = {name: rank for rank, name in enumerate(TRUSTED, 1)}
DEFAULT_PRIORITY = 100
# Points that a source adds to a record's score; others add none.
BONUS = {
    "crossref": 10, "openalex": 8, "unpaywall": 7, "europepmc": 6, "core": 5, "openaire": 5, "plos": 4, "mdpi": 4, "elife": 4, "frontiers": 4, "arxiv": 3, "biorxiv": 3, "medrxiv": 3, "zenodo": 3, "osf": 3, "hal": 3, "scielo": 2, "redalyc": 2, "doaj": 2, "ncbi": 1,
}
# Publication types and the sources that carry them.
PUBLICATION_TYPES = {"peer-reviewed": ("europepmc", "ncbi"), "preprint": ("arxiv",)}
OPEN_STATUSES = ("published", "preprint")

# Latency in ms, reliability, and coverage of the fields of research, of each routed source.
DOMAINS = ("biomedical", "computerScience", "physics", "chemistry", "mathematics", "general")
SOURCES = {
    "openalex": (800.0, 0.95, (0.80, 0.90, 0.85, 0.80, 0.75, 0.90)),
    "crossref": (1200.0, 0.98, (0.90, 0.85, 0.80, 0.85, 0.80, 0.90)),
    "europepmc": (600.0, 0.92, (0.95, 0.30, 0.20, 0.40, 0.10, 0.40)),
    "ncbi": (1500.0, 0.90, (0.98, 0.20, 0.10, 0.30, 0.05, 0.30)),
    "arxiv": (400.0, 0.88, (0.10, 0.80, 0.90, 0.20, 0.85, 0.30)),
    "core": (1000.0, 0.85, (0.60, 0.70, 0.50, 0.60, 0.60, 0.70)),
}
# Sources of each routing strategy: primary, secondary, fallback, and the most to use.
STRATEGIES = {
    "doi": (("crossref", "openalex"), ("europepmc", "core"), ("ncbi", "arxiv"), 3),
    "biomedical": (("europepmc", "ncbi", "openalex"), ("crossref", "core"), ("arxiv",), 4),
    "computerScience": (("openalex", "arxiv", "crossref"), ("core",), ("europepmc", "ncbi"), 3),
    "physics": (("arxiv", "openalex", "crossref"), ("core",), ("europepmc", "ncbi"), 3),
    "general": (("openalex", "crossref"), ("core", "europepmc"), ("ncbi", "arxiv"), 4),
    "fast": (("openalex", "europepmc"), ("arxiv",), ("crossref", "core"), 2),
}
# Share of all records by year that the estimate of a total assumes; other years have none.
YEAR_SHARES = {2025: 0.15, 2024: 0.25, 2023: 0.20, 2022: 0.15, 2021: 0.10, 2020: 0.08, 2019: 0.04, 2018: 0.02, 2017: 0.01}

# Display names.
SOURCE_LABELS = {"openalex": "OpenAlex", "crossref": "Crossref", "europepmc": "Europe PMC", "ncbi": "NCBI", "arxiv": "arXiv", "core": "CORE", "doaj": "DOAJ", "datacite": "DataCite"}
STATUS_LABELS = {"preprint": "Preprint", "accepted": "Author Accepted", "published": "Published", "other": "Other"}
PUBLISHER_LABELS = {"Nature Publishing Group": "Nature", "Oxford University Press": "Oxford UP", "Cambridge University Press": "Cambridge UP"}
FACET_SOURCE_LABELS = {"arxiv": "arXiv", "core": "CORE", "europepmc": "Europe PMC", "ncbi": "NCBI/PMC"}
# Lifetimes in seconds at the three cache levels, by what is cached.
LIFETIMES = {"search_results": (300, 3600, 86400), "paper_details": (600, 7200, 604800), "api_responses": (60, 1800, 7200), "facets": (900, 3600, 21600), "metadata": (1800, 14400, 86400)}
SEARCH_TTL = LIFETIMES["search_results"]


def from_harvest(rows: DataFrame) -> DataFrame:
    """Harvested rows under the record's names, with `ord`, the order in which they came in."""
    names = {"pub_year": "year", "lang": "language"}
    kept = [f.name for f in RECORD.fields]
    columns = [F.col("rec_no").alias("ord")]
    for name in kept:
        old = next((o for o, n in names.items() if n == name), name)
        columns.append(F.col(old).alias(name))
    return rows.select(*columns)


def literal_map(values: dict, default) -> "callable":
    """A function from a column to the value that `values` has for it."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return lambda c: F.coalesce(F.try_element_at(table, c), F.lit(default))
