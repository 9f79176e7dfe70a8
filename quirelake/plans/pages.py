"""Queries over result pages, resolution from several sources, configuration and the rest of the connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake import config, schema
from quirelake.engine import Index, index_schema
from quirelake.functions import citations
from quirelake.functions import text as tx
from quirelake.operators import cache, pages, resolution, routing, search, telemetry
from quirelake.operators.search import Filters, Search
from quirelake.plans.common import CALLS, HOST, POINTS, R, Query, calls, joined, points, records, rounded, sql_doi, sql_joined
from quirelake.plans.records import _FACETS, _merge_sql
from quirelake.sources import parsers
from quirelake.sources.registry import capped_by_source, upstream_filter
from quirelake.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# facets as shown
_SHOWN = "SELECT facet, value, (CASE WHEN eq OR s > 1.5 * {t} OR s < 0.5 * {t} THEN floor(n * (CASE WHEN s > 1.5 * {t} OR s < 0.5 * {t} THEN {t} / s::DOUBLE ELSE 0.5 END) + 0.5) ELSE n END)::BIGINT AS shown FROM w WHERE NOT (facet = 'source' AND (eq OR s > 1.5 * {t} OR s < 0.5 * {t})) UNION ALL SELECT 'source', v, k FROM (VALUES ('europepmc', floor({t} * 0.3 + 0.5)::BIGINT), ('ncbi', floor({t} * 0.45 + 0.5)::BIGINT), ('arxiv', floor({t} * 0.25 + 0.5)::BIGINT), ('openalex', floor({t} * 0.1 + 0.5)::BIGINT)) f(v, k) WHERE EXISTS (SELECT 1 FROM w WHERE facet = 'source' AND (eq OR s > 1.5 * {t} OR s < 0.5 * {t}))"
_WINDOWED = _FACETS.rstrip() + ", w AS (SELECT facet, value, n, sum(n) OVER (PARTITION BY facet) AS s, min(n) OVER (PARTITION BY facet) = max(n) OVER (PARTITION BY facet) AND count(*) OVER (PARTITION BY facet) > 1 AS eq FROM c) "
for _name, _total in (("facet_rescale_ui", 10_000), ("facet_rescale_ui_fitting", 2_400)):
    QUERIES[_name] = lambda spark, d, t=_total: pages.rescaled_counts(search.facets(records(spark, d)), t)
    SQL[_name] = _WINDOWED + _SHOWN.format(t=_total)


def _equal(spark, d):
    n = records(spark, d).select("source").distinct().select(F.lit("source").alias("facet"), F.col("source").alias("value"), F.lit(7).cast("bigint").alias("n"))
    return pages.rescaled_counts(n, 100)


QUERIES["facet_rescale_equal"] = _equal
SQL["facet_rescale_equal"] = "SELECT 'source' AS facet, v AS value, k AS shown FROM (VALUES ('europepmc', 30::BIGINT), ('ncbi', 45::BIGINT), ('arxiv', 25::BIGINT), ('openalex', 10::BIGINT)) f(v, k)"
_TYPES = _FACETS.rstrip() + ", p AS (SELECT coalesce(sum(n) FILTER (WHERE value IN ('europepmc','ncbi')), 0) AS peer, coalesce(sum(n) FILTER (WHERE value = 'arxiv'), 0) AS pre FROM c WHERE facet = 'source') "
QUERIES["pubtype_counts_ui"] = lambda spark, d: pages.publication_type_counts(search.facets(records(spark, d), only=("source",)).select("value", "n"), 12_345)
SQL["pubtype_counts_ui"] = _TYPES + "SELECT 'peer-reviewed' AS type, floor(peer * 12345 / (peer + pre)::DOUBLE + 0.5)::BIGINT AS n FROM p UNION ALL SELECT 'preprint', floor(pre * 12345 / (peer + pre)::DOUBLE + 0.5)::BIGINT FROM p"
QUERIES["pubtype_counts_unscaled"] = lambda spark, d: pages.publication_type_counts(search.facets(records(spark, d), only=("source",)).select("value", "n"), 0)
SQL["pubtype_counts_unscaled"] = _TYPES + "SELECT 'peer-reviewed' AS type, peer::BIGINT AS n FROM p UNION ALL SELECT 'preprint', pre::BIGINT FROM p"
QUERIES["facets_display"] = lambda spark, d: pages.display_order(search.facets(records(spark, d))).select("facet", "value", "n", "place")
SQL["facets_display"] = _FACETS + "SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN facet = 'year' THEN value::INT END DESC NULLS LAST, n DESC, value)::INT AS place FROM c QUALIFY place <= CASE facet WHEN 'year' THEN 10 WHEN 'venue' THEN 10 WHEN 'publisher' THEN 10 WHEN 'topics' THEN 15 ELSE 1000000 END"
QUERIES["facet_map"] = lambda spark, d: pages.facet_maps(search.facets(records(spark, d), only=("source", "oa_status"))).select("facet", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias("counts"))
SQL["facet_map"] = _FACETS + "SELECT facet, string_agg(value || '=' || n, '|' ORDER BY value) AS counts FROM c WHERE facet IN ('source', 'oa_status') GROUP BY facet"
QUERIES["facet_labels"] = lambda spark, d: records(spark, d).select("ord", pages.label("source", F.col("source")).alias("source_label"), pages.label("oa_status", F.col("oa_status")).alias("status_label"), pages.label("publisher", F.col("publisher")).alias("publisher_label"))
SQL["facet_labels"] = R + "SELECT ord, CASE source WHEN 'arxiv' THEN 'arXiv' WHEN 'core' THEN 'CORE' WHEN 'europepmc' THEN 'Europe PMC' WHEN 'ncbi' THEN 'NCBI/PMC' ELSE source END AS source_label, CASE oa_status WHEN 'preprint' THEN 'Preprint' WHEN 'accepted' THEN 'Author Accepted' WHEN 'published' THEN 'Published' WHEN 'other' THEN 'Other' ELSE oa_status END AS status_label, CASE publisher WHEN 'Nature Publishing Group' THEN 'Nature' WHEN 'Oxford University Press' THEN 'Oxford UP' WHEN 'Cambridge University Press' THEN 'Cambridge UP' ELSE publisher END AS publisher_label FROM r"
QUERIES["facet_oa_status_live"] = lambda spark, d: search.facets(records(spark, d), profile="live", only=("oa_status",)).select("value", "n")
SQL["facet_oa_status_live"] = R + "SELECT oa_status AS value, count(*) AS n FROM r GROUP BY oa_status"


def _scoped(spark, d):
    r = records(spark, d)
    return pages.scoped_scaled(search.facets(r), search.facets(search.apply_filters(r, Filters(year_from=2005), "legacy")), 90_000, 4_000)


QUERIES["facets_scaled_scoped"] = _scoped
_KEPT = R.rstrip() + ", all_ AS (SELECT * FROM r), kept AS (SELECT * FROM r WHERE (year IS NULL OR year = 0 OR year >= 2005) AND oa_status IN ('published','preprint') AND coalesce(best_pdf_url <> '', false)) "
SQL["facets_scaled_scoped"] = _KEPT + "SELECT facet, value, count(*) * 23 AS n FROM (SELECT 'source' AS facet, source AS value FROM all_ UNION ALL SELECT 'venue', venue FROM all_ WHERE trim(venue) <> '' UNION ALL SELECT 'publisher', publisher FROM all_ WHERE trim(publisher) <> '' UNION ALL SELECT 'year', year::VARCHAR FROM kept WHERE year <> 0 UNION ALL SELECT 'oa_status', oa_status FROM kept UNION ALL SELECT 'topics', t FROM (SELECT unnest(topics) AS t FROM kept) WHERE trim(t) <> '') WHERE value IS NOT NULL GROUP BY facet, value"


def _accurate(spark, d):
    r = records(spark, d)
    counts = r.groupBy("source").agg((F.count(F.lit(1)) * 100).alias("n"))
    return pages.accurate_facets(r, counts, search.facets(r), 1_000_000, 2_400)


QUERIES["facets_accurate"] = _accurate
SQL["facets_accurate"] = _FACETS + "SELECT facet, value, n * 100 AS n FROM c WHERE facet IN ('source', 'year', 'oa_status', 'venue')"


def _settled(spark, d):
    by = records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    own = F.when(F.col("source").isin("openalex", "crossref"), F.col("rows") * 10)
    return pages.settled_total(by.select("source", own.alias("n"), "rows", (F.col("source") == "core").alias("failed")))


QUERIES["total_settled"] = _settled
SQL["total_settled"] = R + "SELECT sum(CASE WHEN source = 'core' THEN 0 WHEN source IN ('openalex','crossref') THEN k * 10 ELSE 1000 END)::BIGINT AS total FROM (SELECT source, count(*) AS k FROM r GROUP BY source)"
QUERIES["source_counts"] = lambda spark, d: records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
SQL["source_counts"] = R + "SELECT source, count(*) AS n FROM r GROUP BY source"

# sorts of profiles and of the index
for _sort, _sql in (("year", "coalesce(year, 0) DESC, "), ("title", "icu_sort_key(coalesce(title, ''), 'root'), "), ("citations", ""), ("date", "")):
    QUERIES[f"sort_live_{_sort}"] = lambda spark, d, s=_sort: search.page_of(records(spark, d), Search(page_size=30, sort=s), "live").select("ord", F.col("place").cast("bigint").alias("place"))
    SQL[f"sort_live_{_sort}"] = R + f"SELECT ord, row_number() OVER (ORDER BY {_sql}ord) AS place FROM r QUALIFY place <= 30"
for _sort, _sql in (
    ("date", "year DESC NULLS LAST, "), ("date_asc", "year NULLS LAST, "), ("citations", ""), ("citations_asc", ""), ("author", "array_to_string(list_filter(authors, lambda a: a IS NOT NULL), ' ') NULLS LAST, "), ("author_desc", "array_to_string(list_filter(authors, lambda a: a IS NOT NULL), ' ') DESC NULLS LAST, "),
    ("venue", "venue NULLS LAST, "), ("venue_desc", "venue DESC NULLS LAST, "), ("title", "title NULLS LAST, "), ("title_desc", "title DESC NULLS LAST, "),
):
    QUERIES[f"index_sort_{_sort}"] = lambda spark, d, s=_sort: Index(records(spark, d)).search(sort=s, page_size=25).select("ord", F.col("place").cast("bigint").alias("place"))
    SQL[f"index_sort_{_sort}"] = R + f"SELECT ord, row_number() OVER (ORDER BY {_sql}created_at DESC NULLS LAST, ord) AS place FROM r QUALIFY place <= 25"


# resolution
def _attempts(spark, d):
    """Calls as attempts: a request is a user's day, a stage the remainder of the results, a source's priority known for some."""
    c = calls(spark, d)
    priority = F.when(F.col("source") == "crossref", 1).when(F.col("source") == "openalex", 2)
    return c.select(F.concat_ws("/", "user_id", F.floor(F.unix_timestamp("ts") / 604800).cast("string")).alias("request"), F.col("source").alias("src"), F.concat_ws(":", "source", "service").alias("name"), (F.col("results") % 3).alias("stage"), priority.alias("priority"), F.col("call_id").alias("place"), "ok", (F.col("latency") * 100).alias("ms"))


_ATTEMPTS = CALLS.rstrip() + ", a AS (SELECT user_id || '/' || floor(epoch(ts)::BIGINT // 604800)::BIGINT AS request, source || ':' || service AS name, results % 3 AS stage, CASE source WHEN 'crossref' THEN 1 WHEN 'openalex' THEN 2 ELSE 100 END AS p, call_id AS place, ok, latency * 100 AS ms FROM calls) "
QUERIES["resolve_early_return"] = lambda spark, d: rounded(resolution.early_return(_attempts(spark, d), 5000), "ms")
SQL["resolve_early_return"] = _ATTEMPTS + "SELECT request, arg_min(name, (p, place)) FILTER (WHERE ok AND ms <= 5000) AS name, round(arg_min(ms, (p, place)) FILTER (WHERE ok AND ms <= 5000), 6) AS ms FROM a GROUP BY request"
QUERIES["resolve_in_stages"] = lambda spark, d: rounded(resolution.in_stages(_attempts(spark, d), ((2000, 3), (5000, 5), (10000, 30))), "ms")
SQL["resolve_in_stages"] = _ATTEMPTS.rstrip() + ", s AS (SELECT request, count(*) FILTER (WHERE stage = 0) AS n0, count(*) FILTER (WHERE stage = 1) AS n1 FROM a GROUP BY request) SELECT a.request, stage, name, ok AND ms <= CASE stage WHEN 0 THEN 2000 WHEN 1 THEN 5000 ELSE 10000 END AS ok, round(least(ms, CASE stage WHEN 0 THEN 2000 WHEN 1 THEN 5000 ELSE 10000 END), 6) AS ms FROM a JOIN s ON a.request = s.request WHERE stage = 0 OR (stage = 1 AND n0 < 3) OR (stage = 2 AND n0 < 3 AND n0 + n1 < 5)"
QUERIES["resolve_retries"] = lambda spark, d: rounded(resolution.retried(_attempts(spark, d).withColumn("attempt", F.row_number().over(_by_place())), 2), "ms")
SQL["resolve_retries"] = _ATTEMPTS.rstrip() + ", n AS (SELECT *, row_number() OVER (PARTITION BY request, name ORDER BY place) AS attempt FROM a), k AS (SELECT * FROM n WHERE attempt <= 2) SELECT request, name, bool_or(ok) AS ok, coalesce(min(attempt) FILTER (WHERE ok), max(attempt))::INT AS attempt, round(coalesce(arg_min(ms, attempt) FILTER (WHERE ok), arg_max(ms, attempt)), 6) AS ms FROM k GROUP BY request, name"
QUERIES["fallback_order"] = lambda spark, d: _attempts(spark, d).groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(resolution.in_order(None).alias("o"), "name"))), lambda x: x["name"]), ",").alias("names"))
SQL["fallback_order"] = _ATTEMPTS + "SELECT request, string_agg(name, ',' ORDER BY p, place) AS names FROM a GROUP BY request"


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("request", "name").orderBy("place")


def _doi_union(spark, d):
    r = records(spark, d)
    return resolution.resolved(r, r.where("source = 'europepmc'").select("doi"), ("crossref", "openalex", "arxiv"), HOST).select("ord", "id", "doi", "title", "n_records")


QUERIES["doi_union"] = _doi_union
SQL["doi_union"] = _merge_sql(True).replace("AS p FROM r), g AS", f"AS p FROM r WHERE source IN ('crossref','openalex','arxiv') AND {sql_doi('doi')} IN (SELECT {sql_doi('doi')} FROM r WHERE source = 'europepmc' AND {sql_doi('doi')} <> '')), g AS") + "SELECT ord, id, doi, title, n_records FROM m WHERE doi IS NOT NULL AND doi <> ''"

# telemetry that looks at all sources at once
_NOW = "2025-02-22 00:00:00"
_RECENT = f"WITH rep AS (SELECT * FROM performance_reports WHERE recorded_at >= TIMESTAMPTZ '{_NOW}+00' - INTERVAL 7 DAY), b AS (SELECT unnest(source_breakdown) AS b FROM rep), s AS (SELECT b.source AS source, coalesce(b.latency, 0) AS latency, coalesce(b.success, false) AS success FROM b), t AS (SELECT source, avg(success::INT) AS rate, avg(success::INT) * (1 - least(avg(latency) / 3000, 1)) AS score FROM s GROUP BY source), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, source) AS rank FROM t), f AS (SELECT coalesce(avg(coalesce(total_latency, 0)), 0) AS mean_latency, coalesce(avg(CASE WHEN success_rate > 0.5 THEN 1.0 ELSE 0.0 END), 0) AS success_rate FROM rep), l AS (SELECT coalesce(string_agg(source, ',' ORDER BY rank) FILTER (WHERE rank <= 3), '') AS top, coalesce(string_agg(source, ', ' ORDER BY rank) FILTER (WHERE score < 0.7), '') AS under FROM k) "
QUERIES["trends_overall"] = lambda spark, d: rounded(telemetry.overall_trends(telemetry.recent(table(spark, d, "performance_reports"), F.lit(_NOW).cast("timestamp"))).select("mean_latency", "success_rate", F.array_join("top", ",").alias("top"), F.array_join("underperforming", ", ").alias("under")), "mean_latency", "success_rate")
SQL["trends_overall"] = _RECENT + "SELECT round(mean_latency, 6) AS mean_latency, round(success_rate, 6) AS success_rate, top, under FROM f, l"
QUERIES["recommendations"] = lambda spark, d: telemetry.advice(table(spark, d, "performance_reports"), F.lit(_NOW).cast("timestamp"))
_PIECES = "p AS (SELECT 1 AS place, 'Overall success rate is below 80%. Consider reviewing source reliability.' AS advice FROM f WHERE success_rate < 0.8 UNION ALL SELECT 2, 'Average latency is above 5 seconds. Consider optimizing source selection.' FROM f WHERE mean_latency > 5000 UNION ALL SELECT 3, 'Consider reducing usage of underperforming sources: ' || under FROM l WHERE under <> '' UNION ALL SELECT 4, 'Limited source diversity detected. Consider expanding source selection.' FROM d WHERE n < 3)"
_DISTINCT = "SELECT count(DISTINCT x) AS n FROM (SELECT unnest(selected_sources) AS x FROM {})"
SQL["recommendations"] = _RECENT.rstrip() + ", d AS (" + _DISTINCT.format("performance_reports") + "), " + _PIECES + " SELECT place, advice, CASE WHEN success_rate < 0.8 THEN 'high' WHEN mean_latency > 5000 OR under <> '' THEN 'medium' ELSE 'low' END AS priority FROM p, f, l"


def _slow(spark, d):
    slow = table(spark, d, "performance_reports").withColumns({"total_latency": F.lit(9000.0), "success_rate": F.lit(0.9), "selected_sources": F.array(F.lit("core"))})
    return telemetry.advice(slow, F.lit(_NOW).cast("timestamp"))


QUERIES["recommendations_slow"] = _slow
SQL["recommendations_slow"] = _RECENT.rstrip() + ", e AS (SELECT count(*) AS n FROM rep), g AS (SELECT CASE WHEN n > 0 THEN 9000.0 ELSE 0 END AS mean_latency, CASE WHEN n > 0 THEN 1.0 ELSE 0 END AS success_rate FROM e), d AS (SELECT 1 AS n), " + _PIECES.replace("FROM f ", "FROM g ") + " SELECT place, advice, CASE WHEN success_rate < 0.8 THEN 'high' WHEN mean_latency > 5000 OR under <> '' THEN 'medium' ELSE 'low' END AS priority FROM p, g, l"
QUERIES["distinct_sources"] = lambda spark, d: telemetry.selected_sources(table(spark, d, "performance_reports")).agg(F.count(F.lit(1)).alias("n"))
SQL["distinct_sources"] = _DISTINCT.format("performance_reports")


def _reused(spark, d):
    return telemetry.reuse_overview(points(spark, d).withColumn("reused", F.floor(F.col("requests") * 0.75)))


QUERIES["reuse_overview"] = lambda spark, d: rounded(_reused(spark, d), "reuse_rate", "mean_latency", "mean_error")
SQL["reuse_overview"] = POINTS + "SELECT sum(requests)::BIGINT AS requests, round(sum(floor(requests * 0.75)) / sum(requests), 6) AS reuse_rate, round(sum(latency * requests) / sum(requests), 6) AS mean_latency, round(avg(error_rate::DOUBLE), 6) AS mean_error FROM (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY service ORDER BY ts DESC, point_id DESC) = 1)"
_BASE = {"mean_ms": 1200.0, "per_second": 10.5, "error_rate": 0.08}
QUERIES["loadtest_overall"] = lambda spark, d: rounded(telemetry.load_summary(telemetry.load_test(calls(spark, d)), _BASE), "mean_ms", "per_second", "error_rate", "mean_ms_change", "per_second_change", "error_rate_change")
SQL["loadtest_overall"] = CALLS.rstrip() + ", t AS (SELECT service, count(*) AS requests, avg(latency) AS mean_ms, count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6) AS per_second, avg(1 - ok::INT) AS error_rate FROM calls GROUP BY service), s AS (SELECT count(*) AS services, avg(mean_ms) AS mean_ms, avg(per_second) AS per_second, avg(error_rate) AS error_rate FROM t) SELECT services, round(mean_ms, 6) AS mean_ms, round(per_second, 6) AS per_second, round(error_rate, 6) AS error_rate, round((1200.0 - mean_ms) / 1200.0 * 100, 6) AS mean_ms_change, round((per_second - 10.5) / 10.5 * 100, 6) AS per_second_change, round((0.08 - error_rate) / 0.08 * 100, 6) AS error_rate_change FROM s"
QUERIES["routing_tally"] = lambda spark, d: routing.tally(routing.self_test(spark))
SQL["routing_tally"] = "SELECT 1 AS passed, 5 AS failed"

# popularity with its order and limit
QUERIES["popular_queries_top"] = lambda spark, d: telemetry.popular(calls(spark, d).select(F.col("call_id").alias("use_id"), "ts", F.col("user_id").cast("string").alias("query")), "query", F.lit("2024-01-31").cast("timestamp"), 30, most=20).select("query", "uses")
SQL["popular_queries_top"] = CALLS + "SELECT user_id::VARCHAR AS query, count(*) AS uses FROM calls GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY ORDER BY uses DESC, query LIMIT 20"


def _trending(spark, d):
    a = table(spark, d, "paper_access").select(F.col("access_no").alias("use_id"), "id", "title", F.timestamp_millis("last_accessed").alias("ts"))
    return telemetry.popular(a, "id", F.lit("2025-03-01").cast("timestamp"), 180, "title", most=50).select("id", "uses")


QUERIES["trending_papers_top"] = _trending
SQL["trending_papers_top"] = "WITH u AS (SELECT id, epoch_ms(last_accessed) AS ts FROM paper_access) SELECT id, count(*) AS uses FROM u GROUP BY id HAVING max(ts) >= TIMESTAMP '2025-03-01 00:00:00' - INTERVAL 180 DAY ORDER BY uses DESC, id LIMIT 50"

# caches
for _strategy, _ttl in schema.LIFETIMES.items():
    QUERIES[f"cache_lifetimes_{_strategy}"] = lambda spark, d, t=_ttl: cache.fresh_at(cache.with_lifetimes(calls(spark, d).select("call_id", F.col("ts").alias("stored_at")), t), F.lit("2024-01-29 12:00:00").cast("timestamp")).select("call_id", "level")
_NOON = "epoch(TIMESTAMP '2024-01-29 12:00:00')"
for _strategy, _ttl in (("search_results", (300, 3600, 86400)), ("paper_details", (600, 7200, 604800)), ("api_responses", (60, 1800, 7200)), ("facets", (900, 3600, 21600)), ("metadata", (1800, 14400, 86400))):
    SQL[f"cache_lifetimes_{_strategy}"] = CALLS + "SELECT call_id, CASE " + " ".join(f"WHEN floor(epoch(ts)) + {s} >= {_NOON} THEN {i}" for i, s in enumerate(_ttl, 1)) + " END AS level FROM calls"
QUERIES["metadata_projection"] = lambda spark, d: cache.metadata(records(spark, d)).withColumn("authors", joined("authors"))
SQL["metadata_projection"] = R + f"SELECT ord, id, doi, title, {sql_joined('authors')}, year, venue, source, oa_status, citation_count, created_at FROM r"
QUERIES["similar_queries_gate"] = lambda spark, d: records(spark, d).where("title is not null").select("ord", tx.similar_enough(tx.query_cache(F.col("title")), F.concat(tx.query_cache(F.col("title")), F.lit(" again and"))).alias("same"))
SQL["similar_queries_gate"] = R.rstrip() + r", q AS (SELECT ord, regexp_replace(regexp_replace(regexp_replace(lower(title), '^[\s\x{FEFF}\p{Z}]+|[\s\x{FEFF}\p{Z}]+$', '', 'g'), '\s+', ' ', 'g'), '[^\w\s]', '', 'g') AS q FROM r WHERE title IS NOT NULL), w AS (SELECT ord, list_distinct(string_split(q, ' ')) AS x, list_distinct(string_split(q || ' again and', ' ')) AS y FROM q) SELECT ord, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.7 AS same FROM w"
QUERIES["cache_key_json"] = lambda spark, d: records(spark, d).select("ord", tx.json_key("api", {"q": F.coalesce("id", F.lit("")), "page": F.lit(1), "sources": F.sort_array(F.array("source", F.lit("arxiv")))}).alias("key"))
SQL["cache_key_json"] = R + """SELECT ord, 'api:' || md5('{"page":1,"q":"' || id || '","sources":["' || least(source, 'arxiv') || '","' || greatest(source, 'arxiv') || '"]}') AS key FROM r"""

# connectors
_UNPAYWALL = ('{"doi":"10.1/a","oa_locations":[{"url_for_pdf":"https://r.org/a.pdf","host_type":"repository","version":"acceptedVersion"},{"url_for_pdf":"https://p.org/a.pdf","host_type":"publisher","license":"cc-by","version":"publishedVersion"}],"best_oa_location":{"url_for_pdf":"https://b.org/a.pdf"}}', '{"doi":"10.1/b","best_oa_location":{"url_for_pdf":"https://b.org/b.pdf","license":"cc0","version":"submittedVersion"}}', '{"doi":"10.1/c","oa_locations":[]}')
QUERIES["unpaywall_best"] = lambda spark, d: parsers.unpaywall_best(spark.createDataFrame([(x,) for x in _UNPAYWALL], "raw string"))
SQL["unpaywall_best"] = "SELECT * FROM (VALUES ('10.1/a', 'https://p.org/a.pdf', 'cc-by', 'publishedVersion'), ('10.1/b', 'https://b.org/b.pdf', 'cc0', 'submittedVersion'), ('10.1/c', NULL, NULL, NULL)) t(doi, pdf, licence, version)"


def _servers(spark, d):
    """Records of two sources as the payloads of two servers, dated by their creation."""
    r = records(spark, d)
    raw = lambda source: r.where(F.col("source") == source).select(F.to_json(F.struct(F.col("doi").alias("doi"), F.col("title").alias("title"), F.lit("A. B.").alias("authors"), F.left("created_at", F.lit(10)).alias("date"), F.lit("1").alias("version"), "abstract")).alias("raw"))
    return {"biorxiv": raw("biorxiv"), "medrxiv": raw("arxiv")}


_DAY = "2024-06-30"
QUERIES["preprints_recent"] = lambda spark, d: parsers.recent_preprints(_servers(spark, d), "evidence", F.lit(_DAY).cast("date"), 2000, 2024, days=3650, most=10_000_000).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
SQL["preprints_recent"] = R + f"SELECT CASE source WHEN 'arxiv' THEN 'medrxiv' ELSE source END AS source, count(*) AS n FROM r WHERE source IN ('biorxiv', 'arxiv') AND (coalesce(contains(lower(title), 'evidence'), false) OR coalesce(contains(lower(abstract), 'evidence'), false)) AND try_cast(left(created_at, 10) AS DATE) BETWEEN DATE '{_DAY}' - 3650 AND DATE '{_DAY}' AND year(try_cast(left(created_at, 10) AS DATE)) BETWEEN 2000 AND 2024 GROUP BY 1"


def _both_servers(spark, d):  # noqa: ARG001
    raw = lambda doi: spark.createDataFrame([(f'{{"doi":"{doi}","title":"On fish","authors":"V. W.","date":"2020-01-01"}}',), ('{"doi":"10.1101/other","title":"x","authors":"","date":"2020-01-01"}',)], "raw string")
    return parsers.preprints({"biorxiv": raw("10.1101/A"), "medrxiv": raw("10.1101/a")}, " 10.1101/a ").select("source", "doi", "best_pdf_url")


QUERIES["preprints_by_doi"] = _both_servers
SQL["preprints_by_doi"] = "SELECT * FROM (VALUES ('biorxiv', '10.1101/A', 'https://www.biorxiv.org/content/10.1101/Av1.full.pdf'), ('medrxiv', '10.1101/a', 'https://www.medrxiv.org/content/10.1101/av1.full.pdf')) t(source, doi, best_pdf_url)"


def _two_steps(spark, d):  # noqa: ARG001
    from quirelake.plans.feeds import SAMPLES

    ids = spark.createDataFrame([('{"esearchresult":{"idlist":["11","99"]}}',), ('{"esearchresult":{}}',)], "raw string")
    other = SAMPLES["ncbi"].replace("<PMID>11<", "<PMID>13<")
    return parsers.pubmed_found(ids, spark.createDataFrame([(SAMPLES["ncbi"],), (other,)], "raw string")).select("id", "title")


QUERIES["ncbi_two_steps"] = _two_steps
SQL["ncbi_two_steps"] = "SELECT 'ncbi:11' AS id, 'On cells' AS title"


def _live(spark, d):  # noqa: ARG001
    from quirelake.plans.feeds import SAMPLES

    closed = SAMPLES["openalex"].replace('"is_oa":true', '"is_oa":false')
    return parsers.openalex(spark.createDataFrame([(SAMPLES["openalex"],), (closed,)], "raw string"), live=True).select("id", "oa_status", "landing_page", "best_pdf_url")


QUERIES["parse_openalex_live"] = _live
SQL["parse_openalex_live"] = "SELECT 'openalex:W1' AS id, 'published' AS oa_status, 'https://openalex.org/W1' AS landing_page, 'https://x.org/a.pdf' AS best_pdf_url"
_OPENAIRE = (
    '{"header":{"dri:objIdentifier":{"$":"o2"}},"metadata":{"oaf:entity":{"oaf:result":{"title":{"$":"Many"},"creator":[%s],"children":{"instance":[%s]}}}}}' % (",".join('{"$":"P%d"}' % i for i in range(14)), ",".join('{"webresource":[{"url":{"$":"https://x.org/%d"}},{"url":{"$":"https://x.org/%d.%s"}}]}' % (i, i, "pdf" if i == 5 else "html") for i in range(6))),
    '{"header":{"dri:objIdentifier":"o3"},"metadata":{"oaf:entity":{"oaf:result":{"title":"Plain","creator":"One","children":{"instance":{"webresource":{"url":"https://y.org/a.pdf"}}}}}}}',
    '{"header":{"dri:objIdentifier":{"$":"o4"}},"metadata":{"oaf:entity":{"oaf:result":{}}}}',
)
QUERIES["parse_openaire_many"] = lambda spark, d: parsers.openaire(spark.createDataFrame([(x,) for x in _OPENAIRE], "raw string")).select("id", "title", F.size("authors").alias("n_authors"), "best_pdf_url", "landing_page")
SQL["parse_openaire_many"] = "SELECT * FROM (VALUES ('openaire:o2', 'Many', 14, 'https://x.org/5.pdf', 'https://x.org/0'), ('openaire:o3', 'Plain', 1, 'https://y.org/a.pdf', NULL), ('openaire:o4', 'Untitled', 0, NULL, NULL)) t(id, title, n_authors, best_pdf_url, landing_page)"
QUERIES["seed_records"] = lambda spark, d: config.seeds(spark).select("id", "source", "oa_status", "year", F.size("authors").alias("n_authors"), F.size("topics").alias("n_topics"), "created_at")
SQL["seed_records"] = "SELECT * FROM (VALUES ('arxiv:2301.00001', 'arxiv', 'preprint', 2023, 2, 3, '2023-01-01T00:00:00Z'), ('core:12345', 'core', 'published', 2023, 2, 3, '2023-06-15T00:00:00Z'), ('europepmc:67890', 'europepmc', 'published', 2023, 2, 3, '2023-09-20T00:00:00Z')) t(id, source, oa_status, year, n_authors, n_topics, created_at)"
QUERIES["aggregator_stats"] = lambda spark, d: config.aggregator_table(spark, {})
SQL["aggregator_stats"] = "SELECT * FROM (VALUES ('core', false, 'https://api.core.ac.uk/v3'), ('openaire', true, 'https://api.openaire.eu/search'), ('europepmc', true, 'https://www.ebi.ac.uk/europepmc/webservices/rest'), ('ncbi', true, 'https://eutils.ncbi.nlm.nih.gov/entrez/eutils'), ('opencitations', true, 'https://opencitations.net/index/coci/api/v1'), ('datacite', true, 'https://api.datacite.org/dois')) t(source, enabled, base_url)"


def _upstream(spark, d):  # noqa: ARG001
    f = Filters(source=("arxiv", "core", "plos"), year_from=2001, year_to=2010)
    return spark.createDataFrame([("legacy", upstream_filter(f)), ("live", upstream_filter(f, live=True)), ("none", upstream_filter(Filters()))], "profile string, sent string")


QUERIES["upstream_filter"] = _upstream
SQL["upstream_filter"] = "SELECT * FROM (VALUES ('legacy', 'publication_year:>=2001,publication_year:<=2010,(type:preprint OR primary_location.source.publisher:PLOS)'), ('live', 'is_oa:true,publication_year:>=2001,publication_year:<=2010'), ('none', NULL)) t(profile, sent)"
QUERIES["source_caps"] = lambda spark, d: capped_by_source(records(spark, d), ["openalex", "crossref", "arxiv"]).select("ord", "source")
SQL["source_caps"] = R + "SELECT ord, source FROM r WHERE source IN ('openalex', 'crossref', 'arxiv') QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= CASE source WHEN 'openalex' THEN 50 WHEN 'crossref' THEN 20 ELSE 100 END"
QUERIES["index_schema"] = lambda spark, d: spark.createDataFrame([(f.name, f.nullable, *(f.metadata[k] for k in ("searched", "counted", "sorted"))) for f in index_schema().fields], "field string, optional boolean, searched boolean, counted boolean, sorted boolean").where("searched or counted or sorted or not optional")
SQL["index_schema"] = "SELECT * FROM (VALUES ('id', false, false, false, false), ('title', false, true, false, false), ('authors', false, true, false, false), ('abstract', true, true, false, false), ('source', false, false, true, false), ('source_id', false, false, false, false), ('oa_status', true, false, true, false), ('year', true, false, true, true), ('venue', true, false, true, false), ('topics', true, false, true, false), ('created_at', false, false, false, true)) t(field, optional, searched, counted, sorted)"
QUERIES["cite_media"] = lambda spark, d: spark.createDataFrame([(f, citations.media_type(f), citations.ending(f)) for f in (*citations.FORMATS, "unknown")], "format string, media string, ending string")
SQL["cite_media"] = "SELECT * FROM (VALUES ('bibtex', 'application/x-bibtex', 'bib'), ('endnote', 'application/x-research-info-systems', 'enw'), ('ris', 'application/x-research-info-systems', 'ris'), ('wos', 'application/x-research-info-systems', 'wos'), ('apa', 'text/plain', 'txt'), ('mla', 'text/plain', 'txt'), ('chicago', 'text/plain', 'txt'), ('harvard', 'text/plain', 'txt'), ('vancouver', 'text/plain', 'txt'), ('plain', 'text/plain', 'txt'), ('unknown', 'text/plain', 'txt')) t(format, media, ending)"
