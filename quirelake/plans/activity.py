"""Queries over routing, telemetry, popularity and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake import schema
from quirelake.functions import classify, scores
from quirelake.functions import text as tx
from quirelake.operators import cache, routing, telemetry
from quirelake.plans.common import CALLS, POINTS, R, Query, calls, points, records, rounded
from quirelake.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


# classification of titles as queries
def _sql_any(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _sql_hits(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower(q), '{w}')::INT" for w in words) + ")"


_ANALYSED = R.rstrip() + ", q AS (SELECT ord, trim(title) AS q FROM r WHERE title IS NOT NULL), s AS (SELECT *, " + ", ".join(f"{_sql_hits(w)} AS s{i}" for i, w in enumerate(classify.DOMAIN_WORDS.values())) + " FROM q), a AS (SELECT ord, q, CASE WHEN q = '' THEN 'mixed' WHEN regexp_matches(q, '(?i)^10\\.\\d{4,}/[^\\s]+$') THEN 'doi' WHEN regexp_matches(q, '^[A-Z][^.!?]*[.!?]?$') AND length(q) > 20 THEN 'title' WHEN regexp_matches(q, '\\b[A-Z][a-z]+\\s+[A-Z][a-z]+(?:,\\s*[A-Z][a-z]+\\s+[A-Z][a-z]+)*\\b') THEN 'author' WHEN regexp_matches(q, '(?i)\\b(?:cited|references?|citations?|bibliography)\\b') THEN 'citation' WHEN " + _sql_any("q", classify.KEYWORD_WORDS) + " THEN 'keywords' ELSE 'mixed' END AS type, CASE WHEN greatest(s0,s1,s2,s3,s4) = 0 THEN 'general' " + " ".join(f"WHEN s{i} = greatest(s0,s1,s2,s3,s4) THEN '{name}'" for i, name in enumerate(classify.DOMAIN_WORDS)) + " END AS domain, CASE WHEN q <> '' AND (" + _sql_any("lower(q)", classify.COMPLEX_WORDS) + " OR len(regexp_split_to_array(q, '\\s+')) > 10 OR contains(q,' and ') OR contains(q,' or ') OR contains(q,' vs ')) THEN 'complex' ELSE 'simple' END AS complexity, CASE WHEN " + _sql_any("lower(q)", classify.PRESENT_WORDS) + " THEN 'high' ELSE 'medium' END AS sensitivity FROM s) "


def _classified(spark, d):
    a = records(spark, d).where("title is not null").select("ord", classify.analysis(F.col("title")).alias("a"))
    return a.select("ord", "a.type", "a.domain", "a.complexity", "a.expected", "a.sensitivity")


QUERIES["classify_query"] = _classified
SQL["classify_query"] = _ANALYSED + "SELECT ord, type, domain, complexity, CASE WHEN type = 'doi' THEN 'low' WHEN type = 'author' OR domain IN ('biomedical','computerScience') THEN 'high' ELSE 'medium' END AS expected, sensitivity FROM a"
QUERIES["query_strategy"] = lambda spark, d: records(spark, d).where("title is not null").select("ord", classify.strategy(classify.analysis(F.col("title"))).alias("strategy"))
SQL["query_strategy"] = _ANALYSED + "SELECT ord, CASE WHEN type = 'doi' THEN 'doi' WHEN sensitivity = 'high' THEN 'fast' WHEN domain IN ('biomedical','computerScience','physics') THEN domain ELSE 'general' END AS strategy FROM a"

_DIMS = "src AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {la}, {re}, 0.5, {', '.join(map(str, cov))})" for n, (la, re, cov) in schema.SOURCES.items()) + ") t(source, latency, success, quality, biomedical, \"computerScience\", physics, chemistry, mathematics, general)), strat AS (SELECT * FROM (VALUES " + ", ".join(f"('{name}', {tier}, {i}, '{s}', {spec[3]})" for name, spec in schema.STRATEGIES.items() for tier, ss in enumerate(spec[:3]) for i, s in enumerate(ss)) + ") t(strategy, tier, place, source, most))"
_SCORE = "(0.4 * success + 0.3 * quality + 0.3 * (1 - least(latency / 3000, 1)))"
_PLAN = _ANALYSED.rstrip() + f", {_DIMS}, st AS (SELECT *, CASE WHEN type = 'doi' THEN 'doi' WHEN sensitivity = 'high' THEN 'fast' WHEN domain IN ('biomedical','computerScience','physics') THEN domain ELSE 'general' END AS strategy FROM a), pl AS (SELECT strat.*, src.* EXCLUDE (source), row_number() OVER (PARTITION BY strategy, tier ORDER BY {_SCORE} DESC, place) AS pos FROM strat JOIN src USING (source) QUALIFY tier = 2 OR pos <= 2), tr AS (SELECT st.ord, st.type, st.domain, pl.tier, pl.pos, pl.source, pl.success, pl.latency, pl.most, row_number() OVER (PARTITION BY ord ORDER BY tier, pos) AS k FROM st JOIN pl USING (strategy) WHERE CASE domain WHEN 'biomedical' THEN biomedical WHEN 'computerScience' THEN \"computerScience\" WHEN 'physics' THEN physics WHEN 'chemistry' THEN chemistry WHEN 'mathematics' THEN mathematics ELSE general END >= 0.3 AND success >= 0.5) "


def _selected(spark, d):
    q = records(spark, d).where("title is not null").select(F.col("ord").alias("query_id"), F.col("title").alias("query"))
    s = routing.select_sources(q, routing.source_table(spark))
    return rounded(s.select(F.col("query_id").alias("ord"), F.array_join("sources", ",").alias("sources"), "confidence", "latency"), "confidence", "latency")


QUERIES["select_sources"] = _selected
SQL["select_sources"] = _PLAN + "SELECT ord, string_agg(source, ',' ORDER BY k) AS sources, round(least(0.5 + CASE WHEN any_value(domain) <> 'general' THEN 0.2 ELSE 0 END + CASE WHEN any_value(type) <> 'mixed' THEN 0.1 ELSE 0 END + 0.3 * avg(success::DOUBLE), 1.0), 6) AS confidence, round(max(latency)::DOUBLE, 6) AS latency FROM tr WHERE k <= most GROUP BY ord"
QUERIES["source_rank"] = lambda spark, d: rounded(routing.source_rank(routing.source_table(spark)), "score")
SQL["source_rank"] = f"WITH {_DIMS} SELECT source, round({_SCORE}, 6) AS score, row_number() OVER (ORDER BY {_SCORE} DESC, source)::INT AS rank FROM src"
QUERIES["routing_selftest"] = lambda spark, d: routing.self_test(spark).select("query", "type", "domain", "passed")
SQL["routing_selftest"] = "SELECT * FROM (VALUES ('10.1038/nature12373','doi','general',true),('machine learning neural networks','mixed','computerScience',false),('cancer treatment immunotherapy','mixed','biomedical',false),('quantum mechanics entanglement','mixed','physics',false),('Smith, J. and Johnson, A.','mixed','general',false),('A novel approach to machine learning','keywords','computerScience',false)) t(query, type, domain, passed)"
QUERIES["routing_reasons"] = lambda spark, d: routing.select_sources(spark.createDataFrame([(1, "10.1038/nature12373"), (2, "latest cancer therapy"), (3, "quantum field")], "query_id int, query string"), routing.source_table(spark), "live").select("query", "strategy", "reasoning")
SQL["routing_reasons"] = "SELECT * FROM (VALUES ('10.1038/nature12373','doi','DOI query detected - prioritizing DOI authorities'),('latest cancer therapy','fast','Keyword search detected - using broad coverage sources; biomedical domain detected - using specialized sources; Time-sensitive query - prioritizing fast sources'),('quantum field','physics','Keyword search detected - using broad coverage sources; physics domain detected - using specialized sources')) t(query, strategy, reasoning)"

# learned costs and telemetry
_EMA = CALLS.rstrip() + f", {_DIMS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, call_id) AS pos, count(*) OVER (PARTITION BY source) AS n FROM calls) "


def _w(v: str) -> str:
    return f"sum({v} * 0.1 * pow(0.9, n.n - pos))"


QUERIES["ema_metrics"] = lambda spark, d: rounded(telemetry.learned_metrics(calls(spark, d), routing.source_table(spark)), "latency", "success", "quality")
SQL["ema_metrics"] = _EMA + f"SELECT n.source, any_value(n.n) AS n, round(any_value(src.latency) * pow(0.9, any_value(n.n)) + {_w('n.latency')}, 6) AS latency, round(any_value(src.success) * pow(0.9, any_value(n.n)) + {_w('n.ok::INT')}, 6) AS success, round(any_value(src.quality) * pow(0.9, any_value(n.n)) + {_w('least(n.results / 10, 1)')}, 6) AS quality FROM n JOIN src ON n.source = src.source GROUP BY n.source"
QUERIES["metrics_decay"] = lambda spark, d: rounded(telemetry.decayed(routing.source_table(spark).select("source", "latency", "success", "quality"), F.lit(40.5)), "latency", "success", "quality")
SQL["metrics_decay"] = f"WITH {_DIMS} SELECT source, round(latency * pow(0.95, 40), 6) AS latency, round(greatest(success * pow(0.95, 40), 0.1), 6) AS success, round(greatest(quality * pow(0.95, 40), 0.1), 6) AS quality FROM src"
QUERIES["metrics_join"] = lambda spark, d: rounded(telemetry.fallback_summary(calls(spark, d)).join(routing.source_table(spark).select("source", F.col("latency").alias("prior")), "source").select("source", "n_calls", "mean_ms", "prior"), "mean_ms", "prior")
SQL["metrics_join"] = CALLS.rstrip() + f", {_DIMS} SELECT source, count(*) AS n_calls, round(avg(calls.latency), 6) AS mean_ms, any_value(src.latency)::DOUBLE AS prior FROM calls JOIN src USING (source) GROUP BY source"
QUERIES["running_mean"] = lambda spark, d: telemetry.running_means(points(spark, d), "service", "latency").select("point_id", F.round(F.col("running_mean") + 1e-9, 4).alias("running_mean"))
SQL["running_mean"] = POINTS + "SELECT point_id, round(avg(latency) OVER (PARTITION BY service ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING) + 1e-9, 4) AS running_mean FROM points"
QUERIES["throughput_lag"] = lambda spark, d: rounded(telemetry.throughput(points(spark, d)).select("point_id", "throughput"), "throughput")
SQL["throughput_lag"] = POINTS.rstrip() + ", l AS (SELECT point_id, lag(requests,1) OVER w AS r1, lag(requests,2) OVER w AS r2, epoch_us(lag(ts,1) OVER w) AS t1, epoch_us(lag(ts,2) OVER w) AS t2 FROM points WINDOW w AS (PARTITION BY service ORDER BY ts, point_id)) SELECT point_id, round(coalesce(CASE WHEN t1 - t2 > 0 THEN (r1 - r2) / ((t1 - t2) / 1e6) END, 0.0), 6) AS throughput FROM l"
QUERIES["latest_per_service"] = lambda spark, d: telemetry.latest(points(spark, d), "service").select("service", "point_id", "requests")
SQL["latest_per_service"] = POINTS + "SELECT service, point_id, requests FROM points QUALIFY row_number() OVER (PARTITION BY service ORDER BY ts DESC, point_id DESC) = 1"
QUERIES["history_ring"] = lambda spark, d: telemetry.history(points(spark, d), "service", 100).select("service", "point_id")
SQL["history_ring"] = POINTS + "SELECT service, point_id FROM points QUALIFY row_number() OVER (PARTITION BY service ORDER BY ts DESC, point_id DESC) <= 100"
QUERIES["metric_sampling"] = lambda spark, d: telemetry.sampled(points(spark, d), "service", "1 hour").select("service", F.unix_timestamp("slice").alias("slice"), "point_id")
SQL["metric_sampling"] = POINTS + "SELECT service, epoch(date_trunc('hour', ts))::BIGINT AS slice, point_id FROM points QUALIFY row_number() OVER (PARTITION BY service, date_trunc('hour', ts) ORDER BY ts DESC, point_id DESC) = 1"
QUERIES["service_overview"] = lambda spark, d: rounded(telemetry.service_overview(points(spark, d)), "mean_latency", "mean_error", "throughput", "weighted_latency")
SQL["service_overview"] = POINTS.rstrip() + ", l AS (SELECT *, lag(requests,1) OVER w AS r1, lag(requests,2) OVER w AS r2, epoch_us(lag(ts,1) OVER w) AS t1, epoch_us(lag(ts,2) OVER w) AS t2, row_number() OVER (PARTITION BY service ORDER BY ts DESC, point_id DESC) AS k FROM points WINDOW w AS (PARTITION BY service ORDER BY ts, point_id)) SELECT count(*) AS n_services, round(avg(latency),6) AS mean_latency, round(avg(error_rate::DOUBLE),6) AS mean_error, round(sum(coalesce(CASE WHEN t1 - t2 > 0 THEN (r1 - r2) / ((t1 - t2) / 1e6) END, 0.0)),6) AS throughput, round(sum(latency * requests) / sum(requests),6) AS weighted_latency FROM l WHERE k = 1"
QUERIES["loadtest_summary"] = lambda spark, d: rounded(telemetry.load_test(calls(spark, d)), "mean_ms", "min_ms", "max_ms", "per_second", "error_rate")
SQL["loadtest_summary"] = CALLS + "SELECT service, count(*) AS requests, round(avg(latency),6) AS mean_ms, round(min(latency),6) AS min_ms, round(max(latency),6) AS max_ms, round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6),6) AS per_second, round(avg(1 - ok::INT),6) AS error_rate FROM calls GROUP BY service"
QUERIES["fallback_telemetry"] = lambda spark, d: rounded(telemetry.fallback_summary(calls(spark, d)), "success_rate", "mean_ms")
SQL["fallback_telemetry"] = CALLS + "SELECT source, count(*) AS n_calls, count(*) FILTER (WHERE ok) AS n_ok, round(avg(ok::INT),6) AS success_rate, round(avg(latency),6) AS mean_ms, sum(results)::BIGINT AS total_results FROM calls GROUP BY source"


def _baseline(spark, d):
    by = calls(spark, d).withColumn("half", F.col("ts") < "2024-01-15").groupBy("service", "half").agg(F.avg("latency").alias("latency"), F.avg(1 - F.col("ok").cast("double")).alias("error_rate"))
    return rounded(telemetry.against_baseline(by.where("not half"), by.where("half")), "latency_change", "error_change")


QUERIES["baseline_improvement"] = _baseline
SQL["baseline_improvement"] = CALLS.rstrip() + ", h AS (SELECT service, ts < TIMESTAMP '2024-01-15' AS half, avg(latency) AS latency, avg(1 - ok::INT) AS error_rate FROM calls GROUP BY ALL) SELECT a.service, round((a.latency - b.latency) / nullif(b.latency,0) * 100, 6) AS latency_change, round((a.error_rate - b.error_rate) / nullif(b.error_rate,0) * 100, 6) AS error_change FROM h a JOIN h b ON a.service = b.service AND NOT a.half AND b.half"
_BREAK = "WITH b AS (SELECT report_id, unnest(source_breakdown) AS b FROM performance_reports), s AS (SELECT b.source AS source, b.latency AS latency, b.result_count AS result_count, b.success AS success, b.error AS error FROM b) "
QUERIES["trends_by_source"] = lambda spark, d: rounded(telemetry.trends(table(spark, d, "performance_reports")), "mean_latency", "success_rate", "score")
SQL["trends_by_source"] = _BREAK.rstrip() + ", t AS (SELECT source, count(*) AS n_calls, avg(coalesce(latency, 0)) AS mean_latency, avg(coalesce(success, false)::INT) AS success_rate FROM s GROUP BY source) SELECT source, n_calls, round(mean_latency,6) AS mean_latency, round(success_rate,6) AS success_rate, round(success_rate * (1 - least(coalesce(mean_latency,0) / 3000, 1)),6) AS score, row_number() OVER (ORDER BY success_rate * (1 - least(coalesce(mean_latency,0) / 3000, 1)) DESC, source)::INT AS rank FROM t"
QUERIES["retry_delays"] = lambda spark, d: table(spark, d, "region").select("r_regionkey", scores.retry_delay(F.lit(1000.0), F.col("r_regionkey") + 1).alias("delay"))
SQL["retry_delays"] = "SELECT r_regionkey, least(1000.0 * pow(2.0, r_regionkey), 10000.0) AS delay FROM region"

# popularity
_REF = "2025-03-01 00:00:00"


def _uses(spark, d):
    a = table(spark, d, "paper_access")
    return a.select(F.col("access_no").alias("use_id"), "id", "title", F.timestamp_millis("last_accessed").alias("ts"))


QUERIES["trending_papers_ttl"] = lambda spark, d: telemetry.popular(_uses(spark, d), "id", F.lit(_REF).cast("timestamp"), 180, "title").select("id", "uses", F.unix_timestamp("last_used").alias("last_used"), "title")
SQL["trending_papers_ttl"] = f"WITH u AS (SELECT access_no AS use_id, id, title, epoch_ms(last_accessed) AS ts FROM paper_access) SELECT id, count(*) AS uses, floor(epoch(max(ts)))::BIGINT AS last_used, (list(title ORDER BY ts, use_id) FILTER (WHERE title IS NOT NULL AND ts IS NOT NULL))[1] AS title FROM u GROUP BY id HAVING max(ts) >= TIMESTAMP '{_REF}' - INTERVAL 180 DAY"
QUERIES["popular_queries_ttl"] = lambda spark, d: telemetry.popular(calls(spark, d).select(F.col("call_id").alias("use_id"), "ts", tx.query_warm(F.concat(F.lit(" "), F.col("service"), F.lit("  "), F.col("source"))).alias("query")), "query", F.lit("2024-01-31").cast("timestamp"), 30).select("query", "uses", F.unix_micros("last_used").alias("last_used"))
SQL["popular_queries_ttl"] = CALLS + "SELECT service || ' ' || source AS query, count(*) AS uses, epoch_us(max(ts)) AS last_used FROM calls GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY"
QUERIES["search_history"] = lambda spark, d: cache.latest_per(calls(spark, d).select("source", "ts", "call_id"), "source", "ts", "call_id", most=10).select("source", "call_id")
SQL["search_history"] = CALLS + "SELECT source, arg_max(call_id, (ts, call_id)) AS call_id FROM calls GROUP BY source ORDER BY max(ts) DESC LIMIT 10"

# caches
QUERIES["cache_lifetimes"] = lambda spark, d: cache.fresh_at(cache.with_lifetimes(calls(spark, d).select("call_id", F.col("ts").alias("stored_at"))), F.lit("2024-01-29 12:00:00").cast("timestamp")).select("call_id", "level")
SQL["cache_lifetimes"] = CALLS + "SELECT call_id, CASE WHEN floor(epoch(ts)) + 300 >= epoch(TIMESTAMP '2024-01-29 12:00:00') THEN 1 WHEN floor(epoch(ts)) + 3600 >= epoch(TIMESTAMP '2024-01-29 12:00:00') THEN 2 WHEN floor(epoch(ts)) + 86400 >= epoch(TIMESTAMP '2024-01-29 12:00:00') THEN 3 END AS level FROM calls"
QUERIES["cache_evict_fifo"] = lambda spark, d: cache.evicted(calls(spark, d).select(F.col("call_id").alias("seq")), 1000)
SQL["cache_evict_fifo"] = CALLS + "SELECT call_id AS seq FROM calls QUALIFY count(*) OVER () > 1000 AND row_number() OVER (ORDER BY call_id) <= floor(count(*) OVER () * 0.2)"
QUERIES["cache_metrics"] = lambda spark, d: rounded(cache.hit_metrics(calls(spark, d).select(F.when(F.col("results") % 4 != 0, (F.col("results") % 4).cast("int")).alias("level"), F.col("latency").alias("ms"))), "hit_rate", "mean_ms")
SQL["cache_metrics"] = CALLS.rstrip() + ", l AS (SELECT nullif(results % 4, 0) AS level, latency AS ms FROM calls) SELECT count(*) AS n, count(level) AS hits, count(*) FILTER (WHERE level IS NULL) AS misses, count(*) FILTER (WHERE level = 1) AS l1_hits, count(*) FILTER (WHERE level = 2) AS l2_hits, count(*) FILTER (WHERE level = 3) AS l3_hits, round(count(level) / count(*), 6) AS hit_rate, round(avg(ms), 6) AS mean_ms FROM l"
QUERIES["cache_key_md5"] = lambda spark, d: records(spark, d).select("ord", tx.cache_key("search", F.col("title"), F.array_join(F.sort_array(F.coalesce("topics", F.array().cast("array<string>"))), ",")).alias("key"))
SQL["cache_key_md5"] = R + "SELECT ord, 'search:' || md5(coalesce(title,'') || '|' || array_to_string(list_sort(coalesce(topics,[])), ',')) AS key FROM r"
QUERIES["cache_pruned"] = lambda spark, d: cache.pruned(records(spark, d))
SQL["cache_pruned"] = R + "SELECT ord, id, doi, title, year, venue, left(abstract, 500) AS abstract, source, oa_status, best_pdf_url FROM r"
QUERIES["multi_key_index"] = lambda spark, d: cache.paper_keys(records(spark, d))
SQL["multi_key_index"] = R.rstrip() + r", k AS (SELECT ord, id, 'paper' AS space, id AS key FROM r UNION ALL SELECT ord, id, 'doi', lower(trim(doi)) FROM r UNION ALL SELECT ord, id, 'title', regexp_replace(regexp_replace(regexp_replace(lower(title), '^[\s\x{FEFF}\p{Z}]+|[\s\x{FEFF}\p{Z}]+$', '', 'g'), '\s+', ' ', 'g'), '[^\w\s]', '', 'g') FROM r UNION ALL SELECT ord, id, 'metadata', id FROM r) SELECT ord, id, space, key FROM k WHERE key IS NOT NULL AND key <> ''"
QUERIES["upsert_latest"] = lambda spark, d: cache.latest_per(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))
SQL["upsert_latest"] = "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
QUERIES["upsert_index"] = lambda spark, d: cache.upserted(records(spark, d).select("ord", "id"), records(spark, d).where("updated_at is not null").select("ord", "id"))
SQL["upsert_index"] = R + "SELECT ord, id FROM r WHERE updated_at IS NOT NULL UNION ALL SELECT ord, id FROM r WHERE id NOT IN (SELECT id FROM r WHERE updated_at IS NOT NULL)"


# windows of time, beyond what searches need
QUERIES["win_tumbling"] = lambda spark, d: calls(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "service").agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("start"), "service", "n")
SQL["win_tumbling"] = CALLS + "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, service, count(*) AS n FROM calls GROUP BY ALL"
QUERIES["win_sliding"] = lambda spark, d: calls(spark, d).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("start"), "n")
SQL["win_sliding"] = CALLS.rstrip() + ", s AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS start FROM calls UNION ALL SELECT epoch(date_trunc('hour', ts))::BIGINT - 3600 FROM calls) SELECT start, count(*) AS n FROM s GROUP BY start"
QUERIES["win_session"] = lambda spark, d: calls(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")
SQL["win_session"] = CALLS.rstrip() + ", g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM calls), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k"
