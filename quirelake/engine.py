"""The front door: search, single papers, indexes and exports over a table of records."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake import schema
from quirelake.functions import pdf as pdf_functions
from quirelake.functions.citations import Options, export
from quirelake.functions.querylang import compile_query
from quirelake.functions.text import DOI_HOST, looks_like_doi
from quirelake.operators import enrich, merge, search
from quirelake.operators.cache import upserted


@dataclass(frozen=True)
class Response:
    """Hits of one page, facets of all hits, and their number."""

    hits: DataFrame
    facets: DataFrame
    total: int
    page: int
    page_size: int
    kept: DataFrame

    def close(self) -> None:
        """Give the memory of the merged relation back once page and facets are used."""
        self.kept.unpersist()


class Engine:
    """Searches over records; `profile` chooses among the documented and two historical behaviours."""

    def __init__(self, records: DataFrame, profile: str = "documented", doi_host: str = DOI_HOST):
        if profile not in search.PROFILES:
            raise ValueError(f"profile is one of {search.PROFILES}")
        self.records, self.profile, self.host = records, profile, doi_host

    def hits(self, asked: search.Search) -> DataFrame:
        """All records that the search finds, merged by DOI and filtered."""
        found = self.records
        q = asked.query.strip()
        if q:
            found = found.where(enrich._key(F.col("doi"), self.host) == q.lower()) if looks_like_doi(q) else found.where(compile_query(q))
        return search.apply_filters(merge.merge_groups(found, self.host), asked.filters, self.profile)

    def search(self, asked: search.Search) -> Response:
        """One merged relation serves page, facets and total."""
        kept = self.hits(asked).persist()
        return Response(search.page_of(kept, asked, self.profile), search.facets(kept), kept.count(), asked.page, asked.page_size, kept)

    def paper(self, wanted: str) -> DataFrame:
        """The record with an id or DOI, with the best address of its PDF."""
        return enrich.paper(self.records, wanted, self.host).withColumn("resolved_pdf", pdf_functions.best())

    def export(self, asked: search.Search, path: str, style: str = "bibtex", options: Options = Options()) -> None:
        export(self.hits(replace(asked, page=1)), path, style, options)


#: Sort keys of an index; counts of citations aren't indexed, so these sorts leave the newest first.
INDEX_SORTS = {
    "date": lambda: [F.desc_nulls_last("year")], "date_asc": lambda: [F.asc_nulls_last("year")], "citations": list, "citations_asc": list,
    "author": lambda: [F.asc_nulls_last(F.array_join("authors", " "))], "author_desc": lambda: [F.desc_nulls_last(F.array_join("authors", " "))],
    "venue": lambda: [F.asc_nulls_last("venue")], "venue_desc": lambda: [F.desc_nulls_last("venue")], "title": lambda: [F.asc_nulls_last("title")], "title_desc": lambda: [F.desc_nulls_last("title")],
}


# What an index searches, counts and sorts by.
SEARCHED, COUNTED, SORTED = ("title", "authors", "abstract"), ("source", "oa_status", "year", "venue", "topics"), ("year", "created_at")


def index_schema() -> T.StructType:
    """The record's fields, each with what an index does with it as metadata; id, title, authors, source and its id are required."""
    required = ("id", "title", "authors", "source", "source_id", "created_at")
    return T.StructType([T.StructField(f.name, f.dataType, f.name not in required, {"searched": f.name in SEARCHED, "counted": f.name in COUNTED, "sorted": f.name in SORTED}) for f in schema.RECORD.fields])


@dataclass
class Index:
    """A searchable table: exact words over title, authors and abstract; lists of values filter, OR within a field, AND across fields."""

    records: DataFrame
    facet_fields: tuple[str, ...] = field(default=("source", "year", "oa_status", "venue", "topics", "publisher"))

    def upsert(self, new: DataFrame) -> Index:
        return Index(upserted(self.records, new), self.facet_fields)

    def filtered(self, words: str, values: dict[str, list]) -> DataFrame:
        found = self.records.where(search.matches_words(words))
        for name, wanted in values.items():
            if name == "year_from":
                found = found.where(search.year_between(F.col("year"), int(wanted), None))
            elif name == "year_to":
                found = found.where(search.year_between(F.col("year"), None, int(wanted)))
            elif name == "topics":
                found = found.where(search.any_topic(F.col("topics"), tuple(wanted)))
            else:
                found = found.where(search.one_of(F.col(name).cast("string"), tuple(map(str, wanted))))
        return found

    def search(self, words: str = "", values: dict[str, list] | None = None, page: int = 1, page_size: int = 20, sort: str = "created_at") -> DataFrame:
        """One page with `place`, by one of `INDEX_SORTS`; equals come by creation, newest first."""
        from pyspark.sql import Window

        found = self.filtered(words, values or {})
        keys = [*INDEX_SORTS.get(sort, list)(), F.desc_nulls_last("created_at"), F.asc("ord")]
        start = (page - 1) * page_size
        top = found.orderBy(*keys).limit(start + page_size).offset(start)
        return top.withColumn("place", F.row_number().over(Window.orderBy(*keys)) + start)
