"""Filters, sorts, pages, facets and totals of a record search.

Semantics differ by profile: `documented` applies every filter and sort of the
query's types; `live` and `legacy` reproduce two running pipelines, each with
the filters and sorts that it honours.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake import schema
from quirelake.functions.scores import relevance
from quirelake.functions.text import has_number, has_text

PROFILES = ("documented", "live", "legacy")


@dataclass(frozen=True)
class Filters:
    """What a search asks for; an empty list asks for nothing."""

    source: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    years: tuple[str, ...] = ()
    oa_status: tuple[str, ...] = ()
    venue: tuple[str, ...] = ()
    publisher: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    publication_type: tuple[str, ...] = ()
    open_access_only: bool = True


@dataclass(frozen=True)
class Search:
    query: str = ""
    filters: Filters = field(default_factory=Filters)
    page: int = 1
    page_size: int = 20
    sort: str = "relevance"


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    """Whether the value is listed; a missing one is not."""
    return F.coalesce(c.isin(*values), F.lit(False))


def year_between(year: Column, low: int | None, high: int | None) -> Column:
    """Whether the year is in range; a missing year (null or 0) is."""
    test = F.lit(True)
    if low:
        test = test & (~has_number(year) | (year >= low))
    if high:
        test = test & (~has_number(year) | (year <= high))
    return test


def any_topic(topics: Column, wanted: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(topics, F.array(*map(F.lit, wanted))), F.lit(False))


def publication_types(source: Column, wanted: tuple[str, ...], every: bool = False) -> Column:
    """Whether the source carries the wanted types: one of them, or, with `every`, each known one."""
    known = [schema.PUBLICATION_TYPES[t] for t in wanted if t in schema.PUBLICATION_TYPES]
    if every:
        test = F.lit(True)
        for sources in known:
            test = test & one_of(source, sources)
        return test
    return one_of(source, tuple(s for sources in known for s in sources)) if known else F.lit(False)


def is_open(status: Column) -> Column:
    return one_of(status, schema.OPEN_STATUSES)


def has_pdf(columns: list[str], live: bool = False) -> Column:
    own = F.coalesce(has_text(F.col("best_pdf_url")), F.lit(False))
    return own | F.coalesce(has_text(F.col("pdf_url")), F.lit(False)) if live and "pdf_url" in columns else own


def apply_filters(records: DataFrame, f: Filters, profile: str = "documented") -> DataFrame:
    """The records that pass all filters set; open access and a PDF are always required, except where `documented` is told not to."""
    live = profile == "live"
    tests = [year_between(F.col("year"), f.year_from, f.year_to)]
    if f.source:
        tests.append(one_of(F.col("source"), f.source))
    if f.years:
        tests.append(one_of(F.when(has_number(F.col("year")), F.col("year").cast("string")), f.years))
    if f.oa_status and not live:
        tests.append(one_of(F.col("oa_status"), f.oa_status))
    if f.venue:
        tests.append(one_of(F.col("venue"), f.venue))
    if f.publisher:
        tests.append(one_of(F.col("publisher"), f.publisher))
    if f.topics:
        tests.append(any_topic(F.col("topics"), f.topics))
    if f.publication_type:
        tests.append(publication_types(F.col("source"), f.publication_type, every=live))
    if profile != "documented" or f.open_access_only:
        tests += [is_open(F.col("oa_status")), has_pdf(records.columns, live)]
    for test in tests:
        records = records.where(test)
    return records


def contains_all(query: str) -> Column:
    """Whether title or abstract contain the whole query, in any case."""
    q = F.lit(query.lower())
    return F.coalesce(F.contains(F.lower("title"), q), F.lit(False)) | F.coalesce(F.contains(F.lower("abstract"), q), F.lit(False))


def matches_words(query: str) -> Column:
    """Whether each word of the query stands in title, authors or abstract: exact words, no typing errors forgiven."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("authors", F.array().cast("array<string>")), " "), F.coalesce("abstract", F.lit(""))))
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " ")
    test = F.lit(True)
    for w in dict.fromkeys(query.lower().split()):
        test = test & F.array_contains(words, w)
    return test


def order_of(sort: str, columns: list[str], profile: str = "documented") -> list[Column]:
    """Sort keys, ending in the order of arrival."""
    year, cites = F.coalesce("year", F.lit(0)), F.coalesce("citation_count", F.lit(0))
    words = lambda c: F.collate(F.coalesce(c, F.lit("")), "UNICODE")
    author = words(F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("")))
    known = {
        "date": [year.desc()], "date_asc": [year.asc()], "citations": [cites.desc()], "citations_asc": [cites.asc()], "author": [author.asc()], "author_desc": [author.desc()],
        "venue": [words(F.col("venue")).asc()], "venue_desc": [words(F.col("venue")).desc()], "title": [words(F.col("title")).asc()], "title_desc": [words(F.col("title")).desc()],
    }
    if profile == "live":
        known = {"year": [year.desc()], "title": known["title"], "author": known["author"]}
        return [*known.get(sort, []), F.col("ord").asc()]
    if profile == "legacy":
        known |= {"author": [], "author_desc": []}
    if sort in known:
        return [*known[sort], F.col("ord").asc()]
    score = F.col("score") if "score" in columns else relevance(columns)
    return [(F.col("source") != "openalex").asc(), score.desc(), F.col("ord").asc()]


def page_of(records: DataFrame, s: Search, profile: str = "documented") -> DataFrame:
    """The rows of one page with their place; beyond the last page there are none."""
    start = (max(1, s.page) - 1) * s.page_size
    top = records.orderBy(*order_of(s.sort, records.columns, profile)).limit(start + s.page_size).offset(start)
    # at most page_size rows are numbered
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order_of(s.sort, records.columns, profile))) + start)


def page_numbers(total: int, page: int, size: int, slots: int = 7) -> dict:
    """Number of pages, the first and last row shown, and the numbers of the pages offered."""
    pages = -(-total // size)
    first = max(1, min(page - slots // 2, pages - slots + 1))
    return {"pages": pages, "start": (page - 1) * size + 1 if total else 0, "end": min(page * size, total), "offered": list(range(first, min(pages, first + slots - 1) + 1))}


#: Facets and the column or list each counts.
FACETS = ("source", "year", "oa_status", "venue", "publisher", "topics")


def facet_values(records: DataFrame, profile: str = "documented", only: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value) of every record: one row a value, so that one shuffle counts all facets asked for; blank values are left out, but `live` keeps a missing status."""
    pair = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    single = {
        "source": F.col("source"), "year": F.when(has_number(F.col("year")), F.col("year").cast("string")), "oa_status": F.col("oa_status"),
        "venue": F.when(F.trim("venue") != "", F.col("venue")), "publisher": F.when(F.trim("publisher") != "", F.col("publisher")),
    }
    values = F.array(*(pair(f, single[f]) for f in FACETS if f in only and f in single)).cast("array<struct<facet:string,value:string>>")
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.struct(F.lit("topics").alias("facet"), F.when(F.trim(t) != "", t).alias("value")))
    every = F.concat(values, topics) if "topics" in only else values
    kept = F.col("value").isNotNull() | F.lit(profile == "live") & (F.col("facet") == "oa_status")
    return records.select(F.explode(every).alias("x")).select("x.facet", "x.value").where(kept)


def facets(records: DataFrame, most: int | None = None, profile: str = "documented", only: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, n), per occurrence; with `most`, the values most frequent in each facet (ties by value)."""
    counted = facet_values(records, profile, only).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    if most is None:
        return counted
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place).where(F.col("place") <= most).drop("place")


def newest_years(records: DataFrame, most: int = 10) -> DataFrame:
    """(value, n) of the newest years."""
    return records.where(has_number(F.col("year"))).groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("year")).limit(most).select(F.col("year").cast("string").alias("value"), "n")


def scaled(counts: DataFrame, total: int, fetched: int, most: float | None = None) -> DataFrame:
    """Counts of a sample of the hits scaled to their total: each step rounds, so the factor is rounded first."""
    factor = total / fetched if total > 0 and fetched > 0 else 1.0
    if most is not None:
        factor = min(factor, most)
    return counts.withColumn("n", F.col("n") * F.lit(int(factor + 0.5)))


def estimated_total(total: int, f: Filters, profile: str = "legacy") -> float:
    """How many of `total` hits the filters are assumed to leave; not a count."""
    share = 1.0
    if profile == "live":
        share *= 0.8 if f.year_from or f.year_to else 1
        share *= 0.3 if f.source else 1
        share *= 0.5 if f.oa_status else 1
        return float(int(total * share + 0.5))
    if f.publication_type:
        # Assumed shares of the publication types.
        share *= sum({"peer-reviewed": 0.4, "preprint": 0.45}.get(t, 0.15) for t in f.publication_type)
    if f.years:
        share *= sum(schema.YEAR_SHARES.get(int(y), 0.0) for y in f.years)
    for listed in (f.venue, f.publisher, f.topics):
        if listed:
            share *= min(0.1 * len(listed), 0.5)
    return float(int(total * share + 0.5))


def related(records: DataFrame, paper_id: str, query_topics: tuple[str, ...], most: int = 4) -> DataFrame:
    """Other titled records that share one of the first three topics, in order of arrival."""
    return records.where((F.col("id") != paper_id) & (F.trim("title") != "") & any_topic(F.col("topics"), query_topics[:3])).orderBy("ord").limit(most)
