"""What is known of sources and services from their past: windows, learned costs, trends, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.scores import improvement
from quirelake.functions.text import round_half_up

RATE = 0.1


def moving_average(value: Column, at: Column, n: Column, start: Column, rate: float = RATE) -> Column:
    """Exponential moving average after `n` values, as a sum: value number `at` weighs rate·(1−rate)^(n−at)."""
    return start * F.pow(F.lit(1 - rate), n) + F.sum(value * rate * F.pow(F.lit(1 - rate), n - at))


#: Seconds of the slices of time in which rows of one key are numbered and summed; a key's slices are worked on apart.
SLICE = 3600


def _slice(every: int = SLICE) -> Column:
    """Number of the slice of `ts`; rows without a time come first, in a slice of their own."""
    return F.coalesce(F.floor(F.unix_micros("ts") / (every * 1e6)), F.lit(-(1 << 62)))


def _slices(rows: DataFrame, key: str, *parts: Column, every: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(`rows` with their slice, a row for each key and slice with `parts`)."""
    sliced = rows.withColumn("slice", _slice(every))
    return sliced, sliced.groupBy(key, "slice").agg(*parts)


def _beside(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """`rows` with the facts of their key and slice; a null key is one too."""
    named = facts.withColumnsRenamed({key: "__key", "slice": "__slice"})
    return rows.join(named, F.col(key).eqNullSafe(F.col("__key")) & (F.col("slice") == F.col("__slice"))).drop("__key", "__slice")


def numbered(rows: DataFrame, key: str, number: str, *order: str, every: int = SLICE) -> DataFrame:
    """`rows` with their place within the key, from 1 on, in the order of `ts` and `order`.

    Slices are numbered apart and moved up by how many rows came before them,
    so that no task holds all rows of a key.
    """
    sliced, sizes = _slices(rows, key, F.count(F.lit(1)).alias("size"), every=every)
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy(key, "slice").orderBy("ts", *order))
    return _beside(sliced.withColumn("place", place), key, offsets).withColumn(number, F.col("place") + F.col("offset")).drop("slice", "place", "offset")


def learned_metrics(calls: DataFrame, priors: DataFrame) -> DataFrame:
    """(source, n, latency, success, quality) after all calls (source, ts, call_id, latency, ok, results), from the priors on.

    Each slice of a source gives its length and its decayed sums; those of the
    slices after it decay them further. So the recursion is an aggregate of
    aggregates.
    """
    keep = F.lit(1 - RATE)
    sliced, sizes = _slices(calls, "source", F.count(F.lit(1)).alias("size"))
    placed = _beside(sliced.withColumn("at", F.row_number().over(Window.partitionBy("source", "slice").orderBy("ts", "call_id"))), "source", sizes)
    weigh = lambda v: F.sum(v * RATE * F.pow(keep, F.col("size") - F.col("at")))
    sums = placed.groupBy("source", "slice", "size").agg(weigh(F.col("latency")).alias("l"), weigh(F.col("ok").cast("double")).alias("s"), weigh(F.least(F.col("results") / 10, F.lit(1.0))).alias("q"))
    later = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = sums.withColumn("f", F.pow(keep, later)).groupBy("source").agg(F.sum("size").alias("n"), *(F.sum(F.col(c) * F.col("f")).alias(c) for c in ("l", "s", "q")))
    old = F.pow(keep, F.col("n"))
    known = F.broadcast(priors.select("source", F.col("latency").alias("l0"), F.col("success").alias("s0"), F.col("quality").alias("q0")))
    return total.join(known, "source").select("source", "n", (F.col("l0") * old + F.col("l")).alias("latency"), (F.col("s0") * old + F.col("s")).alias("success"), (F.col("q0") * old + F.col("q")).alias("quality"))


def decayed(metrics: DataFrame, days: Column) -> DataFrame:
    """Metrics after whole days without calls: 5 % less each day, success and quality not under 0.1."""
    f = F.pow(F.lit(0.95), F.floor(days))
    return metrics.withColumns({"latency": F.col("latency") * f, "success": F.greatest(F.col("success") * f, F.lit(0.1)), "quality": F.greatest(F.col("quality") * f, F.lit(0.1))})


def running_means(points: DataFrame, key: str, value: str) -> DataFrame:
    """`points` with the mean of all values of the key up to each, in order of time."""
    sliced, sums = _slices(points, key, F.sum(value).alias("sum"), F.count(value).alias("size"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "slice", F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("sum0"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size0"))
    within = Window.partitionBy(key, "slice").orderBy("ts", "point_id").rowsBetween(Window.unboundedPreceding, 0)
    running = _beside(sliced.withColumns({"sum1": F.coalesce(F.sum(value).over(within), F.lit(0.0)), "size1": F.count(value).over(within)}), key, offsets)
    return running.withColumn("running_mean", F.try_divide(F.col("sum0") + F.col("sum1"), F.col("size0") + F.col("size1"))).drop("slice", "sum0", "size0", "sum1", "size1")


def throughput(points: DataFrame) -> DataFrame:
    """Requests a second between the two points before each; 0 without them or without time between.

    A slice's first points look back to the last two points of the slices before.
    """
    w = Window.partitionBy("service", "slice")
    up, down = w.orderBy("ts", "point_id"), w.orderBy(F.desc("ts"), F.desc("point_id"))
    sliced = points.withColumn("slice", _slice())
    now = F.struct(F.unix_micros("ts").alias("t"), F.col("requests").alias("r"))
    ends = sliced.withColumn("back", F.row_number().over(down)).where("back <= 2").groupBy("service", "slice").agg(F.max(F.when(F.col("back") == 1, now)).alias("last"), F.max(F.when(F.col("back") == 2, now)).alias("last2"))
    by = Window.partitionBy("service").orderBy("slice")
    one, two = F.lag("last", 1).over(by), F.coalesce(F.lag("last2", 1).over(by), F.lag("last", 2).over(by))
    carried = ends.select("service", "slice", one.alias("c1"), two.alias("c2"))
    rows = _beside(sliced.withColumns({"p1": F.lag(now, 1).over(up), "p2": F.lag(now, 2).over(up)}), "service", carried)
    first, second = F.coalesce("p1", "c1"), F.when(F.col("p1").isNull(), F.col("c2")).otherwise(F.coalesce("p2", "c1"))
    rate = F.when((first["t"] - second["t"]) > 0, (first["r"] - second["r"]) / ((first["t"] - second["t"]) / 1e6))
    return rows.withColumn("throughput", F.coalesce(rate, F.lit(0.0))).drop("slice", "p1", "p2", "c1", "c2")


def latest(points: DataFrame, key: str) -> DataFrame:
    """The last point of each key: one struct a key, no sort."""
    return points.groupBy(key).agg(F.max_by(F.struct(*(c for c in points.columns if c != key)), F.struct("ts", "point_id")).alias("x")).select(key, "x.*")


def history(points: DataFrame, key: str, most: int) -> DataFrame:
    """The last `most` points of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("point_id"))
    return points.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most).drop("age")


def sampled(points: DataFrame, key: str, every: str = "30 seconds") -> DataFrame:
    """The last point of each key and time slice."""
    sliced = points.withColumn("slice", F.window("ts", every)["start"])
    return sliced.groupBy(key, "slice").agg(F.max_by(F.struct(*(c for c in points.columns if c != key)), F.struct("ts", "point_id")).alias("x")).select(key, "slice", "x.*")


def breakdown(reports: DataFrame) -> DataFrame:
    """One row for each source of each report."""
    return reports.select("report_id", F.explode("source_breakdown").alias("b")).select("report_id", "b.source", "b.latency", "b.result_count", "b.success", "b.error")


def trends(reports: DataFrame) -> DataFrame:
    """(source, n_calls, mean_latency, success_rate, score, rank) of the sources in the reports' breakdowns, best first; missing latencies count as none."""
    by = breakdown(reports).groupBy("source").agg(F.count(F.lit(1)).alias("n_calls"), F.avg(F.coalesce("latency", F.lit(0.0))).alias("mean_latency"), F.avg(F.coalesce(F.col("success"), F.lit(False)).cast("double")).alias("success_rate"))
    scored = by.withColumn("score", F.col("success_rate") * (1 - F.least(F.col("mean_latency") / 3000, F.lit(1.0))))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source")))


#: Score below which a source underperforms.
UNDERPERFORMING = 0.7


def recent(reports: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The reports of the last `days` before `now`."""
    return reports.where(F.col("recorded_at") >= now - F.make_dt_interval(F.lit(days)))


def overall_trends(reports: DataFrame) -> DataFrame:
    """One row (mean_latency, success_rate, top, underperforming) over all reports given; zeros and empty lists without any."""
    facts = reports.agg(F.coalesce(F.avg(F.coalesce("total_latency", F.lit(0.0))), F.lit(0.0)).alias("mean_latency"), F.coalesce(F.avg(F.when(F.col("success_rate") > 0.5, 1.0).otherwise(0.0)), F.lit(0.0)).alias("success_rate"))
    # a row for each source, the few sources of one table
    ranked = F.array_sort(F.collect_list(F.struct("rank", "source", "score")))
    lists = trends(reports).agg(ranked.alias("r")).select(F.transform(F.slice("r", 1, 3), lambda x: x["source"]).alias("top"), F.transform(F.filter("r", lambda x: x["score"] < UNDERPERFORMING), lambda x: x["source"]).alias("underperforming"))
    return facts.crossJoin(lists)  # one row each


# Pieces of advice and their priorities.
ADVICE = (
    ("Overall success rate is below 80%. Consider reviewing source reliability.", "high"),
    ("Average latency is above 5 seconds. Consider optimizing source selection.", "medium"),
    ("Consider reducing usage of underperforming sources: ", "medium"),
    ("Limited source diversity detected. Consider expanding source selection.", "low"),
)


def selected_sources(reports: DataFrame) -> DataFrame:
    """(source) of all reports' selections, each once."""
    return reports.select(F.explode("selected_sources").alias("source")).where("source is not null").distinct()


def advice(reports: DataFrame, now: Column) -> DataFrame:
    """(place, advice, priority): what should be changed, with the one priority of all of it, the highest given.

    Latency, success and underperforming sources are those of the last seven
    days before `now`, the diversity of sources that of all reports.
    """
    one = overall_trends(recent(reports, now)).crossJoin(selected_sources(reports).agg(F.count(F.lit(1)).alias("sources")))  # one row each
    tests = (F.col("success_rate") < 0.8, F.col("mean_latency") > 5000, F.size("underperforming") > 0, F.col("sources") < 3)
    texts = [F.lit(text) for text, _ in ADVICE]
    texts[2] = F.concat(texts[2], F.array_join("underperforming", ", "))
    given = F.filter(F.array(*(F.when(test, F.struct(F.lit(i).alias("place"), text.alias("advice"))) for i, (test, text) in enumerate(zip(tests, texts, strict=True), 1))), lambda x: x.isNotNull())
    highest = F.when(tests[0], "high").when(tests[1] | tests[2], "medium").otherwise("low")
    return one.select(F.explode(given).alias("x"), highest.alias("priority")).select("x.place", "x.advice", "priority")


def fallback_summary(calls: DataFrame) -> DataFrame:
    """(source, n_calls, n_ok, success_rate, mean_ms, total_results)."""
    return calls.groupBy("source").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if("ok").alias("n_ok"), F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg("latency").alias("mean_ms"), F.sum("results").alias("total_results"))


def load_test(calls: DataFrame) -> DataFrame:
    """(service, requests, mean_ms, min_ms, max_ms, per_second, error_rate) over each service's span of time."""
    span = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    return calls.groupBy("service").agg(
        F.count(F.lit(1)).alias("requests"), F.avg("latency").alias("mean_ms"), F.min("latency").alias("min_ms"), F.max("latency").alias("max_ms"),
        F.coalesce(F.try_divide(F.count(F.lit(1)).cast("double"), span), F.lit(0.0)).alias("per_second"), F.avg(1 - F.col("ok").cast("int")).alias("error_rate"),
    )


def reuse_overview(points: DataFrame) -> DataFrame:
    """One row over the latest point of each service: (requests, reuse_rate, mean_latency, mean_error); the rate of reused connections and latency by requests, errors not."""
    now = latest(points, "service")
    return now.agg(
        F.sum("requests").alias("requests"), F.coalesce(F.try_divide(F.sum("reused").cast("double"), F.sum("requests")), F.lit(0.0)).alias("reuse_rate"),
        F.coalesce(F.try_divide(F.sum(F.col("latency") * F.col("requests")), F.sum("requests")), F.lit(0.0)).alias("mean_latency"), F.coalesce(F.avg("error_rate"), F.lit(0.0)).alias("mean_error"),
    )


def load_summary(tests: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """One row over load tests (mean_ms, per_second, error_rate): plain means over the services, and how much better than `baseline` they are in percent."""
    sums = tests.agg(F.count(F.lit(1)).alias("services"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("mean_ms", "per_second", "error_rate")))
    better = {c: improvement(F.lit(baseline[c]), F.col(c)) * (1 if c == "per_second" else -1) for c in baseline}
    return sums.select("*", *(c.alias(f"{n}_change") for n, c in better.items()))


def service_overview(points: DataFrame) -> DataFrame:
    """One row over the latest point of each service: plain means, summed throughput; weighted forms beside them."""
    now = latest(throughput(points), "service")
    return now.agg(
        F.count(F.lit(1)).alias("n_services"), F.avg("latency").alias("mean_latency"), F.avg("error_rate").alias("mean_error"), F.sum("throughput").alias("throughput"),
        F.try_divide(F.sum(F.col("latency") * F.col("requests")), F.sum("requests")).alias("weighted_latency"),
    )


def against_baseline(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """(service, latency_change, error_change) in percent of the baseline; services without one are left out."""
    b = baseline.select("service", F.col("latency").alias("b_latency"), F.col("error_rate").alias("b_error"))
    return now.join(b, "service").select("service", improvement(F.col("b_latency"), F.col("latency")).alias("latency_change"), improvement(F.col("b_error"), F.col("error_rate")).alias("error_change"))


def popular(uses: DataFrame, key: str, reference: Column, days: int, title: str | None = None, most: int | None = None) -> DataFrame:
    """(key, uses, last_used) of what was used within `days` before `reference`; with a title, the first seen; with `most`, so many of the most used."""
    parts = [F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last_used")]
    if title:
        parts.append(F.min_by(title, F.when(F.col(title).isNotNull(), F.struct("ts", "use_id"))).alias(title))
    kept = uses.groupBy(key).agg(*parts).where(F.col("last_used") >= reference - F.make_dt_interval(F.lit(days)))
    return kept if most is None else kept.orderBy(F.desc("uses"), key).limit(most)
