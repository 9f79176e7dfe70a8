"""Connectors: named readers of raw payloads, and scanning several of them at once."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quirelake import schema
from quirelake.operators.search import Filters
from quirelake.sources import parsers


@dataclass(frozen=True)
class Connector:
    """Where a source's payload files lie, and whether it is asked."""

    name: str
    path: str
    format: str = "text"
    enabled: bool = True

    def scan(self, spark: SparkSession) -> DataFrame:
        raw = spark.read.option("wholetext", self.format == "xml").text(self.path).select(F.col("value").alias("raw"))
        return parsers.parse(raw, self.name)


def scan_all(spark: SparkSession, connectors: list[Connector]) -> tuple[DataFrame, DataFrame]:
    """(records of all enabled connectors, status of each): a source that can't be read gives no rows and its error.

    Each source is read once before it joins the others, so that what fails
    only while it is read stops no other source; status has the rows found and
    the milliseconds that took.
    """
    found = spark.createDataFrame([], schema.RECORD)
    status = []
    for c in connectors:
        if not c.enabled:
            status.append((c.name, False, "disabled", None, None))
            continue
        began = time.perf_counter()
        rows, error = None, None
        try:
            records = c.scan(spark)
            rows = records.count()
            found = found.unionByName(records)
        except Exception as problem:  # noqa: BLE001 - one source must not stop the others
            error = str(problem).splitlines()[0]
        status.append((c.name, error is None, error, rows, (time.perf_counter() - began) * 1000))
    return found, spark.createDataFrame(status, "source string, ok boolean, error string, rows bigint, latency_ms double")


class PayloadSource(DataSource):
    """`spark.read.format("quirelake").option("root", folder).load()`: payload files below root/<source>/, one partition a file, `.jsonl` read line by line; filters on source prune the partitions.

    The session needs `spark.sql.python.filterPushdown.enabled`.
    """

    @classmethod
    def name(cls) -> str:
        return "quirelake"

    def schema(self) -> str:
        return "source string, raw string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return PayloadReader(self.options["root"])


class PayloadReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.only = root, None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, In) and f.attribute == ("source",):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            else:
                yield f

    def partitions(self):
        from pathlib import Path

        folders = [p for p in sorted(Path(self.root).iterdir()) if p.is_dir() and (self.only is None or p.name in self.only)]
        return [InputPartition((folder.name, str(path))) for folder in folders for path in sorted(folder.iterdir())]

    def read(self, partition):
        source, path = partition.value
        with open(path, encoding="utf-8") as file:
            if path.endswith(".jsonl"):
                yield from ((source, line.rstrip("\n")) for line in file if line.strip())
            else:
                yield (source, file.read())


# What an upstream search takes for some sources.
UPSTREAM_SOURCES = {"arxiv": "type:preprint", "plos": "primary_location.source.publisher:PLOS", "mdpi": "primary_location.source.publisher:MDPI"}


def upstream_filter(f: Filters, live: bool = False) -> str | None:
    """The part of a search's filters that the upstream search is sent; live always asks for open works and never for sources."""
    parts = ["is_oa:true"] if live else []
    parts += [f"publication_year:{sign}{year}" for sign, year in ((">=", f.year_from), ("<=", f.year_to)) if year]
    known = [] if live else [UPSTREAM_SOURCES[s] for s in f.source if s in UPSTREAM_SOURCES]
    if known:
        parts.append(f"({' OR '.join(known)})")
    return ",".join(parts) or None


# How many records a page of results takes from each upstream search at most.
SOURCE_CAPS = {"openalex": 50, "crossref": 20}
OTHER_CAP = 100


def capped_by_source(records: DataFrame, sources: list[str], caps: dict[str, int] = SOURCE_CAPS, other: int = OTHER_CAP) -> DataFrame:
    """The first records of each source, by `ord`: a top-k for each, not an order of all."""
    found = [records.where(F.col("source") == s).orderBy("ord").limit(caps.get(s, other)) for s in sources]
    return reduce(DataFrame.unionByName, found, records.limit(0))
