"""Choosing the sources that a query is sent to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake import schema
from quirelake.functions.classify import analysis, strategy
from quirelake.functions.scores import source_score

TIERS = ("primary", "secondary", "fallback")


def source_table(spark: SparkSession) -> DataFrame:
    """(source, latency, success, quality, and the coverage of each field) before anything was learned."""
    rows = [(name, latency, reliability, 0.5, *cover) for name, (latency, reliability, cover) in schema.SOURCES.items()]
    return spark.createDataFrame(rows, "source string, latency double, success double, quality double, " + ", ".join(f"{d} double" for d in schema.DOMAINS))


def strategy_table(spark: SparkSession) -> DataFrame:
    """(strategy, tier, place, source, most) of all strategies."""
    rows = [(name, tier, i, s, spec[3]) for name, spec in schema.STRATEGIES.items() for tier, sources in enumerate(spec[:3]) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "strategy string, tier int, place int, source string, most int")


def source_rank(metrics: DataFrame) -> DataFrame:
    """(source, score, rank), best first; ties by name."""
    scored = metrics.select("source", source_score(F.col("latency"), F.col("success"), F.col("quality")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source")))


def _cover(domain: Column) -> Column:
    cover = F.lit(None).cast("double")
    for d in schema.DOMAINS:
        cover = F.when(domain == d, F.col(d)).otherwise(cover)
    return cover


def select_sources(queries: DataFrame, metrics: DataFrame, profile: str = "documented", learning: bool = True) -> DataFrame:
    """The sources of each query (query_id, query) with confidence, estimated latency and reasoning.

    With learning, sources without metrics drop out, each tier is ordered by
    the metrics and the first two tiers keep their best two. Then the tiers are
    taken in turn as long as their sources cover the query's field (0.3 or
    more) and succeed often enough (0.5 or more), up to the strategy's number.
    """
    spark = queries.sparkSession
    analysed = queries.select("*", analysis(F.col("query"), profile).alias("a")).withColumn("strategy", strategy(F.col("a"))).withColumn("field", F.col("a.domain"))
    # a few dozen rows: six strategies of at most six sources, for each of six fields
    plan = strategy_table(spark).join(F.broadcast(metrics), "source", "inner" if learning else "left").withColumn("score", source_score(F.col("latency"), F.col("success"), F.col("quality")))
    if learning:
        plan = plan.withColumn("at", F.row_number().over(Window.partitionBy("strategy", "tier").orderBy(F.desc("score"), "place"))).where((F.col("tier") == 2) | (F.col("at") <= 2))
    else:
        plan = plan.withColumn("at", F.col("place"))
    fields = plan.select("*", F.explode(F.array(*map(F.lit, schema.DOMAINS))).alias("field"))
    fits = (_cover(F.col("field")) >= 0.3) & (F.coalesce("success", F.lit(1.0)) >= 0.5)
    gathered = fields.groupBy("strategy", "field").agg(F.array_sort(F.collect_list(F.when(fits, F.struct("tier", "at", "source", "success", "latency")))).alias("s"), F.max("most").alias("most"))
    chosen = gathered.withColumn("s", F.slice("s", F.lit(1), F.greatest(F.coalesce("most", F.lit(0)), F.lit(0))))
    chosen = analysed.join(F.broadcast(chosen), ["strategy", "field"], "left").withColumn("s", F.coalesce("s", F.array().cast(chosen.schema["s"].dataType)))
    n = F.size("s")
    success = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.coalesce(F.nullif(x["success"], F.lit(0.0)), F.lit(0.5)))
    sure = 0.5 + F.when(F.col("a.domain") != "general", 0.2).otherwise(0.0) + F.when(F.col("a.type") != "mixed", 0.1).otherwise(0.0) + 0.3 * success / n
    # How a choice is explained.
    reason = F.concat_ws(
        "; ",
        F.when(F.col("a.type") == "doi", "DOI query detected - prioritizing DOI authorities").when(F.col("a.type") == "author", "Author search detected - using comprehensive sources").when(F.col("a.type") == "title", "Title search detected - using metadata-rich sources").otherwise("Keyword search detected - using broad coverage sources"),
        F.when(F.col("a.domain") != "general", F.concat(F.col("a.domain"), F.lit(" domain detected - using specialized sources"))),
        F.when(F.col("a.sensitivity") == "high", "Time-sensitive query - prioritizing fast sources"),
        F.when(n < F.col("most"), F.concat(F.lit("Limited to "), n.cast("string"), F.lit(" sources based on query characteristics"))),
    )
    return chosen.select(
        "query_id", "query", F.col("a.type").alias("type"), F.col("a.domain").alias("domain"), "strategy", F.transform("s", lambda x: x["source"]).alias("sources"),
        F.when(n == 0, 0.0).otherwise(F.least(sure, F.lit(1.0))).alias("confidence"), F.when(n == 0, 0.0).otherwise(F.array_max(F.transform("s", lambda x: x["latency"]))).alias("latency"), reason.alias("reasoning"),
    )


# The self-test's queries with the field, type and sources expected of each.
SELF_TEST = (
    ("10.1038/nature12373", "general", "doi", ("crossref", "openalex")),
    ("machine learning neural networks", "computerScience", "keywords", ("openalex", "arxiv")),
    ("cancer treatment immunotherapy", "biomedical", "keywords", ("europepmc", "ncbi", "openalex")),
    ("quantum mechanics entanglement", "physics", "keywords", ("arxiv", "openalex")),
    ("Smith, J. and Johnson, A.", "general", "author", ("openalex", "crossref")),
    ("A novel approach to machine learning", "computerScience", "title", ("openalex", "crossref")),
)


def self_test(spark: SparkSession, profile: str = "live", threshold: float = 0.7) -> DataFrame:
    """(query, type, domain, passed) of the built-in queries."""
    rows = [(i, q, d, t, list(s)) for i, (q, d, t, s) in enumerate(SELF_TEST)]
    wanted = spark.createDataFrame(rows, "query_id int, query string, want_domain string, want_type string, want_sources array<string>")
    got = select_sources(wanted.select("query_id", "query"), source_table(spark), profile)
    passed = (F.col("domain") == F.col("want_domain")) & (F.col("type") == F.col("want_type")) & F.arrays_overlap("sources", "want_sources") & (F.col("confidence") >= threshold)
    return wanted.drop("query").join(got, "query_id").select("query", "type", "domain", passed.alias("passed"))


def tally(results: DataFrame) -> DataFrame:
    """One row: how many of the self-test's queries passed and failed; a test without a result failed."""
    return results.agg(F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed"))
