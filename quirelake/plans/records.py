"""Queries over records: normal forms, filters, sorts, facets, merging and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import querylang, scores
from quirelake.functions import text as tx
from quirelake.operators import enrich, merge, search
from quirelake.operators.search import Filters, Search
from quirelake.plans.common import EDGE, HOST, R, Query, joined, records, rounded, sql_bare, sql_doi, sql_joined, sql_text, sql_trim

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return keep


def _filtered(name: str, test, sql: str) -> None:
    """A filter that gives the records' numbers."""
    QUERIES[name] = lambda spark, d: records(spark, d).where(test() if callable(test) else test).select("ord", "id")
    SQL[name] = R + f"SELECT ord, id FROM r WHERE {sql}"


@add("scan_normalize", R + f"SELECT ord, {sql_doi('doi')} AS doi, {sql_trim('title')} AS title, len(authors)::INT AS n_authors, year, lower(language) AS language, abstract IS NOT NULL AS has_abstract, split_part(id, ':', 1) AS source FROM r")
def _scan(spark, d):
    return records(spark, d).select("ord", tx.doi_merge(F.col("doi"), HOST).alias("doi"), tx.trim_all(F.col("title")).alias("title"), F.when(F.col("authors").isNotNull(), F.size("authors")).alias("n_authors"), "year", F.lower("language").alias("language"), F.col("abstract").isNotNull().alias("has_abstract"), tx.source_of_id(F.col("id")).alias("source"))


@add("norm_doi", R + rf"SELECT ord, {sql_doi('doi')} AS merge_form, regexp_replace({sql_doi('doi')}, '^doi:', '') AS lookup_form, regexp_replace(doi, '^(doi:|https?://.*?doi\.example\.org/)', '') AS bare_form FROM r")
def _norm_doi(spark, d):
    c = F.col("doi")
    return records(spark, d).select("ord", tx.doi_merge(c, HOST).alias("merge_form"), tx.doi_lookup(c, HOST).alias("lookup_form"), tx.doi_bare(c, HOST).alias("bare_form"))


@add("norm_query", R + f"SELECT ord, lower({sql_trim('title')}) AS plain, regexp_replace({sql_trim('lower(title)')}, '\\s+', ' ', 'g') AS warm FROM r")
def _norm_query(spark, d):
    return records(spark, d).select("ord", tx.query_plain(F.col("title")).alias("plain"), tx.query_warm(F.col("title")).alias("warm"))


@add("norm_title", R + f"SELECT ord, regexp_replace(regexp_replace({sql_trim('lower(title)')}, '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g') AS title_key FROM r")
def _norm_title(spark, d):
    return records(spark, d).select("ord", tx.query_cache(F.col("title")).alias("title_key"))


_filtered("filter_source", lambda: search.one_of(F.col("source"), ("arxiv", "crossref")), "source IN ('arxiv','crossref')")
_filtered("filter_year_range", lambda: search.year_between(F.col("year"), 2005, 2015), "year IS NULL OR year = 0 OR year BETWEEN 2005 AND 2015")
_filtered("filter_year_exact", lambda: search.one_of(F.when(tx.has_number(F.col("year")), F.col("year").cast("string")), ("2010", "2011")), "year::VARCHAR IN ('2010','2011')")
_filtered("filter_oa_status", lambda: search.one_of(F.col("oa_status"), ("published", "accepted")), "oa_status IN ('published','accepted')")
_filtered("filter_venue", lambda: search.one_of(F.col("venue"), ("Letters in Paediatric Lexicography", "Annals of Applied Mycology")), "venue IN ('Letters in Paediatric Lexicography','Annals of Applied Mycology')")
_filtered("filter_publisher", lambda: search.one_of(F.col("publisher"), ("Orchardson Institute of Research",)), "publisher IN ('Orchardson Institute of Research')")
_filtered("filter_topics_any", lambda: search.any_topic(F.col("topics"), ("ecology", "optics", "climate")), "coalesce(list_has_any(topics, ['ecology','optics','climate']), false)")
_filtered("filter_pubtype_or", lambda: search.publication_types(F.col("source"), ("peer-reviewed", "preprint")), "source IN ('europepmc','ncbi','arxiv')")
_filtered("filter_pubtype_and", lambda: search.publication_types(F.col("source"), ("peer-reviewed", "preprint"), every=True), "source IN ('europepmc','ncbi') AND source IN ('arxiv')")
_filtered("filter_pubtype_live", lambda: search.publication_types(F.col("source"), ("preprint", "unknown"), every=True), "source IN ('arxiv')")
_filtered("gate_oa_pdf", lambda: search.is_open(F.col("oa_status")) & search.has_pdf([]), f"oa_status IN ('published','preprint') AND {sql_text('best_pdf_url')}")
_filtered("keyword_contains", lambda: search.contains_all("Sediment transport"), "coalesce(contains(lower(title), 'sediment transport'), false) OR coalesce(contains(lower(abstract), 'sediment transport'), false)")
_filtered("doi_detect", lambda: tx.is_doi(F.col("doi")), f"regexp_matches(lower({sql_trim('doi')}), '^10\\.\\d{{4,}}/\\S+$')")
_filtered("doi_detect_legacy", lambda: tx.is_doi_like(F.col("doi")), f"regexp_matches(lower({sql_trim('doi')}), '^(https?://)?(dx\\.)?doi\\.org/|^doi:|^10\\.')")
_filtered("fulltext_match", lambda: search.matches_words("tidal marshes"), "list_has_all(string_split(regexp_replace(lower(coalesce(title,'') || ' ' || coalesce(array_to_string(authors,' '),'') || ' ' || coalesce(abstract,'')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), ['tidal','marshes'])")
_filtered("dsl_boolean", lambda: querylang.compile_query('title:"sediment transport" OR (venue:annals AND NOT source:arxiv) year:2000..2015'), "coalesce(contains(lower(title),'sediment transport'),false) OR (coalesce(contains(lower(venue),'annals'),false) AND NOT contains(lower(source),'arxiv') AND year BETWEEN 2000 AND 2015)")
_filtered("dsl_phrase_author", lambda: querylang.compile_query('author:smešokenko abstract:"missing values"'), "contains(lower(array_to_string(coalesce(authors,[]),' ')),'smešokenko') AND coalesce(contains(lower(abstract),'missing values'),false)")
def _near_sql(column: str) -> str:
    words = f"string_split(regexp_replace(lower(coalesce({column},'')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    return f"SELECT ord, id, unnest({words}) AS w, generate_subscripts({words}, 1) AS i FROM r"


QUERIES["dsl_near"] = lambda spark, d: records(spark, d).where(querylang.compile_query("groundwater NEAR transport")).select("ord", "id")
SQL["dsl_near"] = R + f", tt AS ({_near_sql('title')}), ta AS ({_near_sql('abstract')}), both_ AS (SELECT x.ord, x.id FROM tt x JOIN tt y ON x.ord = y.ord AND x.w = 'groundwater' AND y.w = 'transport' AND abs(x.i - y.i) <= 10 UNION SELECT x.ord, x.id FROM ta x JOIN ta y ON x.ord = y.ord AND x.w = 'groundwater' AND y.w = 'transport' AND abs(x.i - y.i) <= 10) SELECT ord, id FROM both_"

_F = Filters(source=("openalex", "crossref", "europepmc"), year_from=2000, year_to=2020, topics=("ecology", "climate", "genomics"))
_F_SQL = "source IN ('openalex','crossref','europepmc') AND (year IS NULL OR year = 0 OR year BETWEEN 2000 AND 2020) AND coalesce(list_has_any(topics,['ecology','climate','genomics']),false) AND oa_status IN ('published','preprint') AND coalesce(best_pdf_url <> '', false)"
QUERIES["filters_all"] = lambda spark, d: search.apply_filters(records(spark, d), _F).select("ord", "id")
SQL["filters_all"] = R + f"SELECT ord, id FROM r WHERE {_F_SQL}"

_SORTS = {
    "sort_date": ("date", "coalesce(year,0) DESC"),
    "sort_date_asc": ("date_asc", "coalesce(year,0) ASC"),
    "sort_citations": ("citations", "coalesce(citation_count,0) DESC"),
    "sort_citations_asc": ("citations_asc", "coalesce(citation_count,0) ASC"),
}
for _name, (_sort, _sql) in _SORTS.items():
    QUERIES[_name] = lambda spark, d, s=_sort: search.page_of(records(spark, d), Search(page=2, page_size=25, sort=s)).select("ord", "id", F.col("place").cast("bigint").alias("place"))
    SQL[_name] = R + f"SELECT ord, id, row_number() OVER (ORDER BY {_sql}, ord) AS place FROM r QUALIFY place BETWEEN 26 AND 50"
for _name, _sort, _sql, _way in (
    ("sort_title_page", "title", "title", ""), ("sort_venue_page", "venue", "venue", ""), ("sort_author_page", "author", "authors[1]", ""),
    ("sort_title_desc", "title_desc", "title", " DESC"), ("sort_venue_desc", "venue_desc", "venue", " DESC"), ("sort_author_desc", "author_desc", "authors[1]", " DESC"),
):
    QUERIES[_name] = lambda spark, d, s=_sort: search.page_of(records(spark, d), Search(page=1, page_size=40, sort=s)).select("ord", "id", F.col("place").cast("bigint").alias("place"))
    # words are compared by their sort keys in the root collation
    SQL[_name] = R + f"SELECT ord, id, row_number() OVER (ORDER BY icu_sort_key(coalesce({_sql}, ''), 'root'){_way}, ord) AS place FROM r QUALIFY place <= 40"

_SCORE = """(CASE WHEN title <> '' THEN 10 ELSE 0 END + CASE WHEN len(authors) > 0 THEN 10 ELSE 0 END + CASE WHEN year <> 0 THEN 5 ELSE 0 END + CASE WHEN venue <> '' THEN 5 ELSE 0 END + CASE WHEN abstract <> '' THEN 10 ELSE 0 END
 + CASE WHEN oa_status = 'published' THEN 10 WHEN oa_status = 'preprint' THEN 5 ELSE 0 END + CASE WHEN citation_count <> 0 THEN least(citation_count / 10, 10) ELSE 0 END)"""


@add("relevance_score", R + f"SELECT ord, round({_SCORE}, 6) AS score FROM r")
def _relevance(spark, d):
    r = records(spark, d)
    return rounded(r.select("ord", scores.relevance(r.columns).alias("score")), "score")


_BONUS = "CASE source WHEN 'crossref' THEN 10 WHEN 'openalex' THEN 8 WHEN 'unpaywall' THEN 7 WHEN 'europepmc' THEN 6 WHEN 'core' THEN 5 WHEN 'openaire' THEN 5 WHEN 'arxiv' THEN 3 WHEN 'doaj' THEN 2 WHEN 'ncbi' THEN 1 ELSE 0 END"


@add("record_score", R + f"SELECT ord, (CASE WHEN title <> '' THEN 10 ELSE 0 END + CASE WHEN len(authors) > 0 THEN 10 ELSE 0 END + CASE WHEN year <> 0 THEN 5 ELSE 0 END + CASE WHEN venue <> '' THEN 5 ELSE 0 END + CASE WHEN abstract <> '' THEN 10 ELSE 0 END + CASE WHEN citation_count <> 0 THEN 3 ELSE 0 END + {_BONUS})::INT AS score FROM r")
def _record_score(spark, d):
    r = records(spark, d)
    return r.select("ord", scores.record_score(r.columns).cast("int").alias("score"))


@add("sort_relevance_page", R + f"SELECT ord, id, row_number() OVER (ORDER BY (source <> 'openalex'), {_SCORE} DESC, ord) AS place FROM r QUALIFY place <= 20")
def _relevance_page(spark, d):
    return search.page_of(records(spark, d), Search()).select("ord", "id", F.col("place").cast("bigint").alias("place"))


_PRIO = "CASE source WHEN 'crossref' THEN 1 WHEN 'openalex' THEN 2 WHEN 'unpaywall' THEN 3 WHEN 'europepmc' THEN 4 WHEN 'core' THEN 5 WHEN 'openaire' THEN 6 WHEN 'plos' THEN 7 WHEN 'mdpi' THEN 8 WHEN 'elife' THEN 9 WHEN 'frontiers' THEN 10 WHEN 'arxiv' THEN 11 WHEN 'biorxiv' THEN 12 WHEN 'medrxiv' THEN 13 WHEN 'zenodo' THEN 14 WHEN 'osf' THEN 15 WHEN 'hal' THEN 16 WHEN 'scielo' THEN 17 WHEN 'redalyc' THEN 18 WHEN 'doaj' THEN 19 WHEN 'ncbi' THEN 20 WHEN 'opencitations' THEN 21 ELSE 100 END"


def _merge_sql(single: bool) -> str:
    pick = lambda f, t: f"list_filter(list({f} ORDER BY p, ord), lambda x: {t})"

    def lead(f: str) -> str:
        return f"list({f} ORDER BY p, ord)[1]"

    parts = []
    for f, t in (("title", "x <> ''"), ("year", "x <> 0"), ("venue", "x <> ''"), ("abstract", "x <> ''")):
        filled = f"{f} <> ''" if f != "year" else "year <> 0"
        one = f"(list({f} ORDER BY p, ord) FILTER (WHERE {filled}))[1]"
        two = f"(list({f} ORDER BY p, ord) FILTER (WHERE {filled}))[2]"
        own = lead(f)
        is_own = f"coalesce({own} <> {'0' if f == 'year' else chr(39) * 2}, false)"
        parts += [f"CASE WHEN {is_own} THEN {own} ELSE coalesce({two}, {own}) END AS {f}", f"coalesce({one}, {own}) AS canonical_{f}"]
    return (
        R.rstrip()
        + f", k AS (SELECT *, {sql_doi('doi')} AS dn, {_PRIO} AS p FROM r), g AS (SELECT min(ord) AS ord, {lead('id')} AS id, CASE WHEN count(*) > 1 OR {str(single).lower()} THEN any_value(dn) ELSE any_value(doi) END AS doi, {', '.join(parts)}, "
        f"coalesce((list(authors ORDER BY p, ord) FILTER (WHERE len(authors) > 0))[1], []) AS authors, {lead('authors')} AS canonical_authors, "
        f"list_reduce(list(coalesce(topics, []) ORDER BY p, ord), lambda a, b: list_concat(a, list_filter(b, lambda t: NOT list_contains(a, t)))) AS topics, "
        f"coalesce((list(best_pdf_url ORDER BY p, ord) FILTER (WHERE best_pdf_url <> ''))[1], {lead('best_pdf_url')}) AS pdf_url, coalesce((list(source ORDER BY p, ord) FILTER (WHERE best_pdf_url <> ''))[1], {lead('source')}) AS pdf_source, "
        f"(list(landing_page ORDER BY p, ord) FILTER (WHERE landing_page <> ''))[1] AS landing_page, {lead('source')} AS source, {lead('oa_status')} AS oa_status, {lead('citation_count')} AS citation_count, count(*) AS n_records FROM k WHERE dn <> '' GROUP BY dn), "
        "u AS (SELECT ord, id, doi, title, title AS canonical_title, year, year AS canonical_year, venue, venue AS canonical_venue, abstract, abstract AS canonical_abstract, authors, authors AS canonical_authors, topics, best_pdf_url AS pdf_url, CASE WHEN best_pdf_url <> '' THEN source END AS pdf_source, landing_page, source, oa_status, citation_count, 1 AS n_records FROM k WHERE dn IS NULL OR dn = ''), "
        "m AS (SELECT * FROM g UNION ALL BY NAME SELECT * FROM u) "
    )


def _merged(spark: SparkSession, d: str, single: bool = False) -> DataFrame:
    return merge.merge_groups(records(spark, d), HOST, normalise_single=single)


_LEAN = "ord, id, doi, source, oa_status, citation_count, n_records"
QUERIES["dedupe_doi"] = lambda spark, d: _merged(spark, d).selectExpr(*_LEAN.split(", "))
SQL["dedupe_doi"] = _merge_sql(False) + f"SELECT {_LEAN} FROM m"
QUERIES["dedupe_doi_norm_singletons"] = lambda spark, d: _merged(spark, d, True).selectExpr(*_LEAN.split(", "))
SQL["dedupe_doi_norm_singletons"] = _merge_sql(True) + f"SELECT {_LEAN} FROM m"
for _name, _columns in (("merge_titles_canonical", "ord, title, canonical_title, year, canonical_year"), ("merge_venue_abstract", "ord, venue, canonical_venue, abstract, canonical_abstract"), ("merge_pdf", "ord, pdf_url, pdf_source, landing_page")):
    QUERIES[_name] = lambda spark, d, c=_columns: _merged(spark, d).selectExpr(*c.split(", "))
    SQL[_name] = _merge_sql(False) + f"SELECT {_columns} FROM m"
QUERIES["merge_authors"] = lambda spark, d: _merged(spark, d).select("ord", joined("authors"), joined("canonical_authors"))
SQL["merge_authors"] = _merge_sql(False) + f"SELECT ord, {sql_joined('authors')}, {sql_joined('canonical_authors')} FROM m"
QUERIES["merge_topics"] = lambda spark, d: _merged(spark, d).select("ord", joined("topics"))
SQL["merge_topics"] = _merge_sql(False) + f"SELECT ord, {sql_joined('topics')} FROM m"
_MSCORE = f"""(CASE WHEN title <> '' THEN 10 ELSE 0 END + CASE WHEN len(authors) > 0 THEN 10 ELSE 0 END + CASE WHEN year <> 0 THEN 5 ELSE 0 END + CASE WHEN venue <> '' THEN 5 ELSE 0 END + CASE WHEN abstract <> '' THEN 10 ELSE 0 END
 + CASE WHEN canonical_title <> '' THEN 5 ELSE 0 END + CASE WHEN canonical_authors IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN canonical_year <> 0 THEN 3 ELSE 0 END + CASE WHEN canonical_venue <> '' THEN 3 ELSE 0 END + CASE WHEN canonical_abstract <> '' THEN 5 ELSE 0 END
 + CASE WHEN pdf_url <> '' THEN 15 ELSE 0 END + CASE WHEN oa_status IN ('published','preprint') THEN 3 ELSE 0 END + CASE WHEN citation_count <> 0 THEN 3 ELSE 0 END + {_BONUS})"""
QUERIES["merge_best_of"] = lambda spark, d: merge.merge_best_of(records(spark, d), HOST).select("ord", "id", F.col("score").cast("int").alias("score"))
SQL["merge_best_of"] = _merge_sql(False) + f"SELECT ord, id, {_MSCORE}::INT AS score FROM m ORDER BY score DESC, ord LIMIT 1"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Merge by DOI, gate on open access and PDF, rank, first page."""
    kept = search.apply_filters(_merged(spark, d), Filters(), "live")
    return search.page_of(kept, Search(), "documented").select("ord", "id", "title", "n_records", F.col("place").cast("bigint").alias("place"))


QUERIES["search_flagship"] = flagship
_MREL = f"""(CASE WHEN title <> '' THEN 10 ELSE 0 END + CASE WHEN len(authors) > 0 THEN 10 ELSE 0 END + CASE WHEN year <> 0 THEN 5 ELSE 0 END + CASE WHEN venue <> '' THEN 5 ELSE 0 END + CASE WHEN abstract <> '' THEN 10 ELSE 0 END
 + CASE WHEN canonical_title <> '' THEN 5 ELSE 0 END + CASE WHEN canonical_authors IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN canonical_year <> 0 THEN 3 ELSE 0 END + CASE WHEN canonical_venue <> '' THEN 3 ELSE 0 END + CASE WHEN canonical_abstract <> '' THEN 5 ELSE 0 END
 + CASE WHEN pdf_url <> '' THEN 15 ELSE 0 END + CASE WHEN oa_status = 'published' THEN 10 WHEN oa_status = 'preprint' THEN 5 ELSE 0 END + CASE WHEN oa_status IN ('published','preprint') THEN 3 ELSE 0 END + CASE WHEN citation_count <> 0 THEN least(citation_count / 10, 10) ELSE 0 END)"""
SQL["search_flagship"] = _merge_sql(False) + f"SELECT ord, id, title, n_records, row_number() OVER (ORDER BY (source <> 'openalex'), {_MREL} DESC, ord) AS place FROM m WHERE oa_status IN ('published','preprint') AND coalesce(pdf_url <> '', false) QUALIFY place <= 20"

# facets
_FACETS = R.rstrip() + """, f AS (SELECT 'source' AS facet, source AS value FROM r UNION ALL SELECT 'year', year::VARCHAR FROM r WHERE year <> 0 UNION ALL SELECT 'oa_status', oa_status FROM r UNION ALL SELECT 'venue', venue FROM r WHERE trim(venue) <> '' UNION ALL SELECT 'publisher', publisher FROM r WHERE trim(publisher) <> '' UNION ALL SELECT 'topics', t FROM (SELECT unnest(topics) AS t FROM r) WHERE trim(t) <> ''),
 c AS (SELECT facet, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY ALL) """
QUERIES["facets_all_long"] = lambda spark, d: search.facets(records(spark, d))
SQL["facets_all_long"] = _FACETS + "SELECT facet, value, n FROM c"
QUERIES["facets_top100"] = lambda spark, d: search.facets(records(spark, d), 100)
SQL["facets_top100"] = _FACETS + "SELECT facet, value, n FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 100"
for _f in ("source", "oa_status", "venue", "publisher", "topics"):
    QUERIES[f"facet_{_f}"] = lambda spark, d, f=_f: search.facets(records(spark, d), only=(f,)).select("value", "n")
    SQL[f"facet_{_f}"] = _FACETS + f"SELECT value, n FROM c WHERE facet = '{_f}'"
QUERIES["facet_year_top10"] = lambda spark, d: search.newest_years(records(spark, d))
SQL["facet_year_top10"] = R + "SELECT year::VARCHAR AS value, count(*) AS n FROM r WHERE year <> 0 GROUP BY year ORDER BY year DESC LIMIT 10"
QUERIES["facets_scaled"] = lambda spark, d: search.scaled(search.facets(records(spark, d)), 1_000_000, 2400)
SQL["facets_scaled"] = _FACETS + "SELECT facet, value, n * floor(1000000 / 2400.0 + 0.5)::BIGINT AS n FROM c"
QUERIES["total_count"] = lambda spark, d: records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
SQL["total_count"] = R + "SELECT count(*)::BIGINT AS total FROM r"


@add("total_estimate", "SELECT profile, total::DOUBLE AS total FROM (VALUES ('legacy', 2880.0), ('live', 1200.0)) t(profile, total)")
def _estimate(spark, d):
    f = Filters(source=("arxiv",), years=("2024", "2023"), publication_type=("peer-reviewed",), topics=("a", "b"), oa_status=("published",), year_from=2020)
    return spark.createDataFrame([("legacy", search.estimated_total(80_000, f)), ("live", search.estimated_total(10_000, f, "live"))], "profile string, total double")


# joins
_SIDE = "k AS (SELECT *, {key} AS k FROM r), s AS (SELECT k, arg_min(title, ord) AS st, min(ord) AS so FROM k WHERE source = 'crossref' AND k <> '' GROUP BY k), f AS (SELECT k, ord AS so, title AS s_title, authors AS s_authors, year AS s_year, venue AS s_venue, abstract AS s_abstract, best_pdf_url AS s_pdf, landing_page AS s_landing, citation_count AS s_cites, publisher AS s_publisher, oa_status AS s_status FROM k WHERE ord IN (SELECT so FROM s)) ".format(key=sql_bare("doi"))


def _sides(spark, d):
    r = records(spark, d)
    return r.where("source <> 'crossref'"), r.where("source = 'crossref'")


@add("enrich_crossref_fill", R.rstrip() + ", " + _SIDE + "SELECT k.ord, CASE WHEN title <> '' AND title <> 'Untitled' THEN title WHEN s_title <> '' THEN s_title ELSE title END AS title, " + sql_joined("CASE WHEN len(authors) > 0 THEN authors ELSE coalesce(s_authors, authors) END", "authors") + ", CASE WHEN year <> 0 THEN year ELSE coalesce(s_year, year) END AS year, CASE WHEN venue <> '' THEN venue ELSE coalesce(s_venue, venue) END AS venue, CASE WHEN s_cites <> 0 THEN s_cites ELSE citation_count END AS citation_count, CASE WHEN s_publisher <> '' THEN s_publisher ELSE publisher END AS publisher FROM k LEFT JOIN f ON k.k = f.k WHERE source <> 'crossref'")
def _crossref(spark, d):
    rest, side = _sides(spark, d)
    return enrich.fill_from_crossref(rest, side, HOST).select("ord", "title", joined("authors"), "year", "venue", "citation_count", "publisher")


@add("enrich_unpaywall_fill", R.rstrip() + ", " + _SIDE + "SELECT k.ord, CASE WHEN s_status IN ('published','preprint') THEN 'published' ELSE oa_status END AS oa_status, CASE WHEN best_pdf_url <> '' THEN best_pdf_url ELSE coalesce(s_pdf, best_pdf_url) END AS best_pdf_url, CASE WHEN landing_page <> '' THEN landing_page ELSE coalesce(s_landing, landing_page) END AS landing_page FROM k LEFT JOIN f ON k.k = f.k WHERE source <> 'crossref'")
def _unpaywall(spark, d):
    rest, side = _sides(spark, d)
    return enrich.fill_from_open_access(rest, side, HOST).select("ord", "oa_status", "best_pdf_url", "landing_page")


@add("semi_join_dois", R.rstrip() + f", asked AS (SELECT {sql_bare('doi')} AS k FROM r WHERE source <> 'crossref' AND doi <> '' ORDER BY ord LIMIT 20) SELECT ord, id FROM r WHERE source = 'crossref' AND {sql_bare('doi')} IN (SELECT k FROM asked)")
def _semi(spark, d):
    rest, side = _sides(spark, d)
    return enrich.looked_up(rest, side, 20, HOST).select("ord", "id")


@add("page_anti_join", R.rstrip() + ", p AS (SELECT *, row_number() OVER (ORDER BY coalesce(year,0) DESC, ord) AS n FROM r) SELECT ord, id FROM p WHERE n <= 60 AND id NOT IN (SELECT id FROM p WHERE n <= 20)")
def _anti(spark, d):
    r = records(spark, d)
    first, more = (search.page_of(r, Search(page_size=n, sort="date")) for n in (20, 60))
    return enrich.unseen(more, first).select("ord", "id")


@add("priority_join", R + f"SELECT ord, {_PRIO}::INT AS priority, {_BONUS}::INT AS bonus FROM r")
def _priority(spark, d):
    from quirelake import schema

    return records(spark, d).select("ord", schema.literal_map(schema.PRIORITY, 100)(F.col("source")).alias("priority"), schema.literal_map(schema.BONUS, 0)(F.col("source")).alias("bonus"))


@add("paper_lookup", R.rstrip() + f", w AS (SELECT * FROM (VALUES ('by id', 'doaj:000002190'), ('by doi', '10.9100/vuerm.000001114')) t(how, wanted)) SELECT how, ord, id FROM w, r WHERE CASE WHEN contains(wanted, '10.') THEN r.id = wanted OR {sql_bare('doi')} = wanted ELSE r.id = wanted END QUALIFY row_number() OVER (PARTITION BY how ORDER BY (r.id <> wanted), ord) = 1")
def _paper(spark, d):
    r = records(spark, d)
    found = [enrich.paper(r, wanted, HOST).select(F.lit(how).alias("how"), "ord", "id") for how, wanted in (("by id", "doaj:000002190"), ("by doi", "10.9100/vuerm.000001114"))]
    return found[0].unionByName(found[1])


@add("related_papers", R + "SELECT ord, id FROM r WHERE id <> 'openalex:000001267' AND trim(title) <> '' AND coalesce(list_has_any(topics, ['ecology','optics','climate']), false) ORDER BY ord LIMIT 4")
def _related(spark, d):
    return search.related(records(spark, d), "openalex:000001267", ("ecology", "optics", "climate", "ignored")).select("ord", "id")


@add("index_search", R + "SELECT ord, id, row_number() OVER (ORDER BY created_at DESC, ord) AS place FROM r WHERE list_has_all(string_split(regexp_replace(lower(coalesce(title,'') || ' ' || coalesce(array_to_string(authors,' '),'') || ' ' || coalesce(abstract,'')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), ['rice','paddies']) AND source IN ('openalex','crossref') AND oa_status IN ('published') QUALIFY place <= 20")
def _index(spark, d):
    from quirelake.engine import Index

    return Index(records(spark, d)).search("rice paddies", {"source": ["openalex", "crossref"], "oa_status": ["published"]}).select("ord", "id", F.col("place").cast("bigint").alias("place"))


@add("union_sources", R + "SELECT ord, id, source FROM r WHERE source IN ('arxiv','ncbi') OR (source = 'openalex' AND oa_status IN ('published','preprint') AND coalesce(best_pdf_url <> '', false))")
def _union(spark, d):
    r = records(spark, d)
    live = search.apply_filters(r.where("source = 'openalex'"), Filters(), "live")
    return live.unionByName(r.where("source in ('arxiv', 'ncbi')"), allowMissingColumns=True).select("ord", "id", "source")


@add("set_operations", R + "SELECT ord, array_to_string(list_sort(list_filter(list_distinct(coalesce(topics,[])), lambda t: t NOT IN ('ecology','optics') AND t IS NOT NULL)), '|') AS less, array_to_string(list_sort(list_filter(list_distinct(coalesce(topics,[])), lambda t: t IN ('ecology','optics','climate'))), '|') AS common FROM r")
def _sets(spark, d):
    t = F.coalesce("topics", F.array().cast("array<string>"))
    lit = lambda *v: F.array(*map(F.lit, v))
    return records(spark, d).select("ord", F.array_join(F.sort_array(F.array_except(t, lit("ecology", "optics"))), "|").alias("less"), F.array_join(F.sort_array(F.array_intersect(t, lit("ecology", "optics", "climate"))), "|").alias("common"))


@add("group_first_seen", R + "SELECT source, min(ord) AS first_ord, count(*) AS n, rank() OVER (ORDER BY min(ord))::INT AS place FROM r GROUP BY source")
def _first_seen(spark, d):
    from quirelake.operators.cache import first_seen

    return first_seen(records(spark, d), "source")


@add("grouping_sets_facets", R + "SELECT source, oa_status, count(*) AS n FROM r GROUP BY GROUPING SETS ((source), (oa_status), ())")
def _grouping(spark, d):
    records(spark, d).createOrReplaceTempView("quirelake_records")
    return spark.sql("SELECT source, oa_status, count(*) AS n FROM quirelake_records GROUP BY GROUPING SETS ((source), (oa_status), ())")


@add("top_by_source", R + f"SELECT ord, source, row_number() OVER (PARTITION BY source ORDER BY {_SCORE} DESC, ord)::INT AS rank FROM r QUALIFY rank <= 5")
def _top(spark, d):
    from pyspark.sql import Window

    r = records(spark, d)
    scored = r.select("ord", "source", scores.relevance(r.columns).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "ord"))).where("rank <= 5").select("ord", "source", "rank")
