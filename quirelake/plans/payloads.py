"""Every parser over payloads made of all records, so that nulls, blanks, empty lists and odd texts pass through each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.plans.common import R, Query, records
from quirelake.sources import parsers

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _key() -> Column:
    return F.col("ord").cast("string")


def _no_authors() -> Column:
    return F.array().cast("array<string>")


def _each(field: str) -> Column:
    """The authors as a list of objects with one member."""
    return F.transform(F.coalesce("authors", _no_authors()), lambda a: F.struct(a.alias(field)))


def _object(**members: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in members.items())))


def _payload(name: str, made: Callable[[], Column], id_: str, *, title: str = "title", authors: str = "a", year: str = "year", venue: str = "venue", abstract: str = "abstract", status: str, pdf: str, where: str = "true") -> None:
    def run(spark, d) -> DataFrame:
        raw = records(spark, d).select(made().alias("raw"))
        return parsers.parse(raw, name).select("id", "title", F.array_join("authors", "|").alias("authors"), "year", "venue", "abstract", "oa_status", "best_pdf_url")

    QUERIES[f"parse_{name}_rows"] = run
    known = "list_filter(coalesce(authors, []), lambda x: x IS NOT NULL AND x <> '')"
    SQL[f"parse_{name}_rows"] = R.rstrip() + f", k AS (SELECT *, ord::VARCHAR AS o, array_to_string({known}, '|') AS a FROM r) SELECT {id_} AS id, {title} AS title, {authors} AS authors, {year} AS year, {venue} AS venue, {abstract} AS abstract, {status} AS oa_status, {pdf} AS best_pdf_url FROM k WHERE {where}"


_PLACE = lambda **m: F.struct(*(c.alias(n) for n, c in m.items()))
_payload(
    "openalex", lambda: _object(id=F.concat(F.lit("https://openalex.org/W"), _key()), title=F.col("title"), authorships=F.transform(F.coalesce("authors", _no_authors()), lambda a: _PLACE(author=_PLACE(display_name=a))), publication_year=F.col("year"), primary_location=_PLACE(source=_PLACE(display_name=F.col("venue"))), open_access=_PLACE(is_oa=F.col("oa_status") == "published", oa_url=F.col("best_pdf_url"))),
    "'openalex:W' || o", abstract="NULL::VARCHAR", status="CASE WHEN oa_status = 'published' THEN 'published' ELSE 'other' END", pdf="best_pdf_url", where="title <> ''",
)
_payload(
    "crossref", lambda: F.to_json(F.struct(_key().alias("DOI"), F.array("title").alias("title"), _each("name").alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("published-print"), F.array("venue").alias("container-title"), "abstract", F.when(F.col("oa_status") == "published", F.array(F.struct(F.lit("u").alias("URL")))).alias("license"), F.array(F.struct(F.lit("https://x.org/h").alias("URL"), F.lit("text/html").alias("content-type")), F.struct(F.col("best_pdf_url").alias("URL"), F.lit("application/pdf").alias("content-type"))).alias("link"))),
    "'crossref:' || o", status="CASE WHEN oa_status = 'published' THEN 'published' ELSE 'other' END", pdf="best_pdf_url",
)
_payload(
    "europepmc", lambda: _object(id=_key(), title=F.col("title"), authorList=_PLACE(author=_each("fullName")), pubYear=F.col("year").cast("string"), journalTitle=F.col("venue"), abstractText=F.col("abstract"), isOpenAccess=F.when(F.col("oa_status") == "published", "Y").otherwise("N"), pmcid=F.when(F.col("ord") % 3 == 0, F.concat(F.lit("PMC"), _key()))),
    "'europepmc:' || CASE WHEN ord % 3 = 0 THEN 'PMC' || o ELSE o END", status="CASE WHEN oa_status = 'published' THEN 'published' ELSE 'other' END", pdf="CASE WHEN ord % 3 = 0 THEN 'https://europepmc.org/articles/PMC' || o || '?pdf=render' END",
)
_payload(
    "core", lambda: _object(id=_key(), title=F.col("title"), authors=_each("name"), yearPublished=F.col("year"), journal=F.col("venue"), abstract=F.col("abstract"), isOpenAccess=F.col("oa_status") == "published"),
    "'core:' || o", status="CASE WHEN oa_status = 'published' THEN 'published' ELSE 'other' END", pdf="'https://core.ac.uk/reader/' || o",
)
_payload(
    "datacite", lambda: _object(id=_key(), attributes=_PLACE(titles=F.array(F.struct("title")), creators=_each("name"), publicationYear=F.col("year"), publisher=F.col("venue"), descriptions=F.array(F.struct(F.lit("m").alias("description"), F.lit("Methods").alias("descriptionType")), F.struct(F.col("abstract").alias("description"), F.lit("Abstract").alias("descriptionType"))), url=F.col("best_pdf_url"), formats=F.array(F.lit("application/pdf")))),
    "'datacite:' || o", title="coalesce(title, 'Untitled')", venue="coalesce(venue, 'DataCite Repository')", status="'other'", pdf="best_pdf_url",
)
_payload(
    "doaj", lambda: _object(id=_key(), bibjson=_PLACE(title=F.col("title"), author=_each("name"), year=F.concat(F.col("year").cast("string"), F.lit("a")), abstract=F.col("abstract"), journal=_PLACE(title=F.col("venue")), link=F.array(_PLACE(type=F.lit("homepage"), url=F.lit("https://x.org"), content_type=F.lit("pdf")), _PLACE(type=F.lit("fulltext"), url=F.col("best_pdf_url"), content_type=F.lit("PDF"))))),
    "'doaj:' || o", title="coalesce(title, 'Untitled')", status="'published'", pdf="best_pdf_url",
)
_payload(
    "unpaywall", lambda: _object(doi=_key(), title=F.col("title"), journal_name=F.col("venue"), year=F.col("year"), is_oa=F.col("oa_status") == "published", best_oa_location=_PLACE(url_for_pdf=F.when(F.col("ord") % 2 == 0, F.col("best_pdf_url")), url_for_landing_page=F.col("landing_page")), oa_locations=F.array(_PLACE(url_for_pdf=F.when(F.col("ord") % 3 == 0, F.lit("https://x.org/a.pdf")))), z_authors=_each("family")),
    "'unpaywall:' || o", abstract="NULL::VARCHAR", status="CASE WHEN oa_status = 'published' THEN 'published' ELSE 'other' END", pdf="CASE WHEN oa_status = 'published' THEN coalesce(nullif(CASE WHEN ord % 2 = 0 THEN best_pdf_url END, ''), CASE WHEN ord % 3 = 0 THEN 'https://x.org/a.pdf' END, landing_page) END",
)
