"""Settings, searches read from addresses, single texts, and classification with and without the automaton."""

import random

import pytest
from pyspark.sql import functions as F

from quirelake import config, schema
from quirelake.functions import classify
from quirelake.functions.text import legacy_key, looks_like_doi
from quirelake.operators import cache, pages, resolution, telemetry
from quirelake.operators.search import Filters, Search


def test_pools():
    base = config.Pool()
    assert base.problems() == []
    assert base.high_volume() == config.Pool(max_connections=30, max_sockets=100, keep_alive=60_000)
    assert base.low_latency() == config.Pool(timeout=5_000, retry_attempts=2, retry_delay=500)
    assert base.batch() == config.Pool(max_connections=50, max_sockets=200, keep_alive=120_000, timeout=30_000)
    wrong = config.Pool(-1, 500, -5, 10, 11, 50)
    assert len(wrong.problems()) == 6
    assert config.Pool(0, 0, 0, 0, 0, 0).problems() == []
    assert config.pool_of("core", {"CORE_POOL_CONFIG": '{"timeout": 7000, "unknown": 1}'}).timeout == 7000
    assert config.pool_of("core", {"CORE_POOL_CONFIG": "{"}) == base


def test_choosing(spark):
    c = config.Choosing().updated(max_sources=2)
    assert (c.max_sources, c.enabled) == (2, True)
    shape = "report_id bigint, recorded_at timestamp, selected_sources array<string>, total_latency double, success_rate double, source_breakdown array<struct<source string, latency double, result_count int, success boolean, error string>>"
    out = c.exported(spark, spark.createDataFrame([], shape))
    assert out["config"]["max_sources"] == 2
    assert [tuple(r)[:2] for r in out["performance"].collect()] == [(0.0, 0.0)]
    assert [r.place for r in out["recommendations"].orderBy("place").collect()] == [1, 4]


def test_search_of_an_address():
    asked = config.search_of({"q": "ice", "sources": "arxiv,core", "yearFrom": "2001x", "yearTo": "", "page": "0", "topics": "a", "sort": "date"})
    assert asked == Search("ice", Filters(source=("arxiv", "core"), year_from=2001, topics=("a",)), 1, 20, "date")
    assert config.search_of({"q": ""}) is None
    assert config.search_of({"q": "x", "page": "abc"}).page == 1


@pytest.mark.parametrize(("text", "want"), [(" 10.1000/ABC ", True), ("10.1/abc", False), ("10.10000/a b", False), ("doi:10.1000/a", False), ("", False)])
def test_looks_like_doi(text, want):
    assert looks_like_doi(text) is want


def test_legacy_key():
    assert legacy_key("s", {"b": [2, 1], "a": {"z": 1, "y": "ü"}}) == 's:{"a":{"z":1,"y":"ü"},"b":[2,1]}'


def test_classifier_without_automaton():
    with_, without = classify.Classifier(False), classify.Classifier(False)
    without.automaton = None
    rng = random.Random(1)
    words = ["gene", "Quantum", "chain", "and", "novel", "data", "latest", "theorem", "Ada Lovelace", "x", "acid", "research"]
    for _ in range(200):
        q = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        assert with_.classified(q) == without.classified(q)
    assert with_.classified(None) == with_.classified("   ") == ("mixed", "general", "simple", "medium", "medium")


def test_analysis_of_nothing(spark):
    rows = spark.createDataFrame([(None,), ("",), ("quantum physics",)], "q string").select(classify.analysis(F.col("q")).alias("a")).select("a.*").collect()
    assert [r.domain for r in rows] == ["general", "general", "physics"]


def _numbers(spark, n, keys=2):
    rng = random.Random(3)
    rows = [(i, f"k{i % keys}", 1_700_000_000 + rng.randrange(5) * 1800 + rng.randrange(3), float(rng.randrange(100)), rng.random() < 0.8) for i in range(n)]
    df = spark.createDataFrame(rows, "point_id bigint, service string, s bigint, latency double, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    return sorted(rows, key=lambda r: (r[2], r[0])), df


def test_slices_give_what_the_whole_gives(spark):
    rows, df = _numbers(spark, 300)
    numbered = {r.point_id: r.requests for r in telemetry.numbered(df, "service", "requests", "point_id", every=600).collect()}
    means = {r.point_id: r.running_mean for r in telemetry.running_means(df, "service", "latency").collect()}
    rates = {r.point_id: r.throughput for r in telemetry.throughput(df.withColumn("requests", F.col("point_id"))).collect()}
    seen: dict[str, list] = {}
    for i, k, t, v, _ in rows:
        before = seen.setdefault(k, [])
        assert numbered[i] == len(before) + 1
        assert abs(means[i] - (sum(b[2] for b in before) + v) / (len(before) + 1)) < 1e-9
        want = (before[-1][0] - before[-2][0]) / (before[-1][1] - before[-2][1]) if len(before) > 1 and before[-1][1] > before[-2][1] else 0.0
        assert abs(rates[i] - want) < 1e-9
        before.append((i, t, v))


def test_rows_without_time_or_key_stay(spark):
    rows = spark.createDataFrame([(1, None, None, 5.0), (2, None, 10, 7.0), (3, "a", None, 1.0), (4, "a", 20, 3.0)], "point_id bigint, service string, s bigint, latency double").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.point_id: r.n for r in telemetry.numbered(rows, "service", "n", "point_id").collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
    assert {r.point_id: r.running_mean for r in telemetry.running_means(rows, "service", "latency").collect()} == {1: 5.0, 2: 6.0, 3: 1.0, 4: 2.0}
    assert telemetry.throughput(rows.withColumn("requests", F.col("point_id"))).count() == 4


def test_first_seen_across_ranges(spark):
    rows = spark.createDataFrame([(i * 70_000, f"g{i % 7}") for i in range(30)], "ord bigint, g string")
    got = {r.g: (r.first_ord, r.n, r.place) for r in cache.first_seen(rows, "g").collect()}
    assert got == {f"g{i}": (i * 70_000, len(range(i, 30, 7)), i + 1) for i in range(7)}


def test_pages_of_nothing(spark):
    none = spark.createDataFrame([], "facet string, value string, n bigint")
    assert pages.rescaled_counts(none, 10).count() == 0
    assert {r.type: r.n for r in pages.publication_type_counts(none.select("value", "n"), 10).collect()} == {"peer-reviewed": 0, "preprint": 0}
    equal = spark.createDataFrame([("arxiv", 5), ("ncbi", 5)], "value string, n bigint")
    assert {r.type: r.n for r in pages.publication_type_counts(equal, 10).collect()} == {"peer-reviewed": 8, "preprint": 3}
    assert pages.display_order(none).count() == 0


def test_resolution_of_nothing(spark):
    none = spark.createDataFrame([], "request string, name string, stage int, priority int, place bigint, ok boolean, ms double")
    assert resolution.early_return(none, 10).count() == 0
    assert resolution.in_stages(none).count() == 0
    late = spark.createDataFrame([("r", "a", 0, None, 1, True, 99.0)], none.schema)
    assert [tuple(r) for r in resolution.early_return(late, 10).collect()] == [("r", None, None)]
    asked = spark.createDataFrame([(" ",), (None,)], "doi string")
    shape = "ord bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.RECORD.fields)
    assert resolution.resolved(spark.createDataFrame([], shape), asked).count() == 0
