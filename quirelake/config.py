"""Settings: of connection pools, of the choice of sources, of a search's address; the sources known, and the records to begin with."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from quirelake import schema
from quirelake.operators.search import Filters, Search


@dataclass(frozen=True)
class Pool:
    """Settings of a pool of connections; times in milliseconds."""

    max_connections: int = 20
    keep_alive: int = 30_000
    max_sockets: int = 50
    timeout: int = 10_000
    retry_attempts: int = 3
    retry_delay: int = 1_000
    http2: bool = True

    def high_volume(self) -> Pool:
        return replace(self, max_connections=max(self.max_connections, 30), max_sockets=max(self.max_sockets, 100), keep_alive=max(self.keep_alive, 60_000))

    def low_latency(self) -> Pool:
        return replace(self, timeout=min(self.timeout, 5_000), retry_attempts=min(self.retry_attempts, 2), retry_delay=min(self.retry_delay, 500))

    def batch(self) -> Pool:
        return replace(self, max_connections=max(self.max_connections, 50), max_sockets=max(self.max_sockets, 200), keep_alive=max(self.keep_alive, 120_000), timeout=max(self.timeout, 30_000))

    def problems(self) -> list[str]:
        """What is wrong with the settings; 0 stands for unset and is never wrong."""
        # The complaints.
        rules = (
            (self.max_connections and self.max_connections < 1, "maxConnections must be at least 1"),
            (self.max_sockets and self.max_sockets < self.max_connections, "maxSockets must be greater than or equal to maxConnections"),
            (self.keep_alive and self.keep_alive < 1000, "keepAliveTimeout must be at least 1000ms"),
            (self.timeout and self.timeout < 1000, "timeout must be at least 1000ms"),
            (self.retry_attempts and not 0 <= self.retry_attempts <= 10, "retryAttempts must be between 0 and 10"),
            (self.retry_delay and self.retry_delay < 100, "retryDelay must be at least 100ms"),
        )
        return [text for wrong, text in rules if wrong]


def pool_of(service: str, settings: dict[str, str] | None = None) -> Pool:
    """The pool of a service: defaults, overridden by the JSON under `<SERVICE>_POOL_CONFIG` if there is valid one."""
    known = os.environ if settings is None else settings
    try:
        given = json.loads(known.get(f"{service.upper()}_POOL_CONFIG", "{}"))
    except ValueError:
        given = {}
    names = {f.name for f in fields(Pool)}
    return replace(Pool(), **{k: v for k, v in given.items() if k in names})


@dataclass(frozen=True)
class Choosing:
    """Settings of the choice of sources."""

    enabled: bool = True
    adaptive_learning: bool = True
    performance_monitoring: bool = True
    max_sources: int = 4
    timeout_ms: int = 8_000
    confidence_threshold: float = 0.6
    fallback_strategy: str = "balanced"

    def updated(self, **changes) -> Choosing:
        return replace(self, **changes)

    def exported(self, spark: SparkSession, reports: DataFrame) -> dict:
        """Settings as a dict, and trends and advice of the reports as tables."""
        from pyspark.sql import functions as F

        from quirelake.operators import telemetry

        return {"config": asdict(self), "performance": telemetry.overall_trends(reports), "recommendations": telemetry.advice(reports, F.current_timestamp())}


def _number(text: str | None) -> int | None:
    """The number at the start of a text."""
    digits = ""
    for c in (text or "").strip():
        if not c.isdigit() and not (c in "+-" and not digits):
            break
        digits += c
    return int(digits) if digits.strip("+-") else None


def search_of(params: dict[str, str]) -> Search | None:
    """The search that an address asks for: lists are split at commas, numbers read as far as they go; None without a query."""
    if not params.get("q"):
        return None
    listed = lambda name: tuple(params[name].split(",")) if params.get(name) else ()
    f = Filters(source=listed("sources"), year_from=_number(params.get("yearFrom")), year_to=_number(params.get("yearTo")), years=listed("year"), oa_status=listed("oaStatus"), venue=listed("venue"), publisher=listed("publisher"), topics=listed("topics"), publication_type=listed("publicationType"))
    return Search(params["q"], f, _number(params.get("page")) or 1, 20, params.get("sort") or "relevance")


# The aggregating sources, the variables that hold their addresses, and the addresses taken without.
AGGREGATORS = {
    "core": ("CORE_BASE", "https://api.core.ac.uk/v3"), "openaire": ("OPENAIRE_BASE", "https://api.openaire.eu/search"), "europepmc": ("EUROPE_PMC_BASE", "https://www.ebi.ac.uk/europepmc/webservices/rest"), "ncbi": ("NCBI_EUTILS_BASE", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"),
    "opencitations": ("OPENCITATIONS_BASE", "https://opencitations.net/index/coci/api/v1"), "datacite": ("DATACITE_BASE", "https://api.datacite.org/dois"),
}


def aggregator_table(spark: SparkSession, settings: dict[str, str] | None = None) -> DataFrame:
    """(source, enabled, base_url) of the aggregating sources; core needs a key."""
    known = os.environ if settings is None else settings
    rows = [(name, name != "core" or bool(known.get("CORE_API_KEY")), known.get(variable) or base) for name, (variable, base) in AGGREGATORS.items()]
    return spark.createDataFrame(rows, "source string, enabled boolean, base_url string")


# The records that a new index begins with.
SEEDS = (
    {"id": "arxiv:2301.00001", "title": "Large Language Models for Scientific Discovery", "authors": ["John Doe", "Jane Smith"], "year": 2023, "venue": "arXiv", "abstract": "This paper explores the use of large language models for scientific discovery and research applications.", "source": "arxiv", "source_id": "2301.00001", "oa_status": "preprint", "best_pdf_url": "https://arxiv.org/pdf/2301.00001.pdf", "landing_page": "https://arxiv.org/abs/2301.00001", "topics": ["machine learning", "natural language processing", "scientific discovery"], "language": "en", "created_at": "2023-01-01T00:00:00Z"},
    {"id": "core:12345", "title": "Open Access Publishing Trends in Computer Science", "authors": ["Alice Johnson", "Bob Wilson"], "year": 2023, "venue": "Journal of Open Science", "abstract": "An analysis of open access publishing trends in computer science journals over the past decade.", "source": "core", "source_id": "12345", "oa_status": "published", "best_pdf_url": "https://example.com/paper12345.pdf", "landing_page": "https://example.com/paper/12345", "topics": ["open access", "publishing", "computer science"], "language": "en", "created_at": "2023-06-15T00:00:00Z"},
    {"id": "europepmc:67890", "title": "Machine Learning Applications in Biomedical Research", "authors": ["Carol Davis", "David Brown"], "year": 2023, "venue": "Nature Machine Intelligence", "abstract": "A comprehensive review of machine learning applications in biomedical research and clinical practice.", "source": "europepmc", "source_id": "67890", "oa_status": "published", "best_pdf_url": "https://example.com/biomedical-ml.pdf", "landing_page": "https://example.com/paper/67890", "topics": ["machine learning", "biomedical research", "clinical applications"], "language": "en", "created_at": "2023-09-20T00:00:00Z"},
)


def seeds(spark: SparkSession) -> DataFrame:
    """The seed records, under the record's schema."""
    return spark.createDataFrame([tuple(s.get(f.name) for f in schema.RECORD.fields) for s in SEEDS], schema.RECORD)
