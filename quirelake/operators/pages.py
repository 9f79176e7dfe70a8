"""What a result page shows of facets: repaired counts, publication types, display order, labels, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake import schema
from quirelake.functions.text import round_half_up

#: Assumed share of peer-reviewed records where counts of sources can't be trusted.
PEER_REVIEWED = 0.75
# Assumed shares of the sources then.
SOURCE_SHARES = {"europepmc": PEER_REVIEWED * 0.4, "ncbi": PEER_REVIEWED * 0.6, "arxiv": 1 - PEER_REVIEWED, "openalex": 0.1}
#: How many values of a facet are shown, and in which order.
SHOWN = {"year": 10, "venue": 10, "publisher": 10, "topics": 15}


def rescaled_counts(facets: DataFrame, total: int) -> DataFrame:
    """(facet, value, shown): counts repaired for display.

    Counts that are all equal, or whose sum is out of proportion to `total`,
    can't be right. Sources are replaced by the assumed shares of the total;
    other facets are scaled to it, or halved where they are merely equal.
    """
    total = max(0, total)
    w = Window.partitionBy("facet")
    positive = F.when(F.col("n") > 0, F.col("n"))
    sums, low, high, k = F.coalesce(F.sum(positive).over(w), F.lit(0)), F.min(positive).over(w), F.max(positive).over(w), F.count(positive).over(w)
    equal, above, below = F.coalesce((low == high) & (k > 1), F.lit(False)), sums > 1.5 * total, sums < 0.5 * total
    scale = F.when(above | below, F.try_divide(F.lit(float(total)), sums)).otherwise(0.5)
    judged = facets.select("facet", "value", "n", (equal | above | below).alias("wrong"), scale.alias("scale"))
    kept = judged.where(~(F.col("wrong") & (F.col("facet") == "source"))).select("facet", "value", F.when(F.col("wrong"), round_half_up(F.col("n") * F.col("scale"))).otherwise(F.col("n")).cast("bigint").alias("shown"))
    shares = F.array(*(F.struct(F.lit(s).alias("value"), F.lit(int(total * share + 0.5)).cast("bigint").alias("shown")) for s, share in SOURCE_SHARES.items()))
    replaced = judged.where(F.col("wrong") & (F.col("facet") == "source")).groupBy("facet").agg(F.count(F.lit(1)).alias("k")).select("facet", F.explode(shares).alias("x")).select("facet", "x.value", "x.shown")
    return kept.unionByName(replaced)


def publication_type_counts(sources: DataFrame, total: int) -> DataFrame:
    """(type, n) from the counts (value, n) of sources: scaled to `total`, by assumption where all sources are equal, 0 without any."""
    total = max(0, total)
    of = lambda t: F.coalesce(F.sum(F.when(F.col("value").isin(*schema.PUBLICATION_TYPES[t]), F.col("n"))), F.lit(0))
    positive = F.when(F.col("n") > 0, F.col("n"))
    facts = sources.agg(of("peer-reviewed").alias("peer"), of("preprint").alias("pre"), F.min(positive).alias("low"), F.max(positive).alias("high"), F.count(positive).alias("k"))
    equal = F.coalesce((F.col("low") == F.col("high")) & (F.col("k") > 1), F.lit(False))
    both = F.col("peer") + F.col("pre")

    def count(raw: str, share: float) -> Column:
        scaled = round_half_up(F.col(raw) * F.try_divide(F.lit(float(total)), both))
        return F.when(equal, F.lit(int(total * share + 0.5))).when(both == 0, 0).when(F.lit(total == 0), F.col(raw)).otherwise(scaled).cast("bigint")

    types = F.array(F.struct(F.lit("peer-reviewed").alias("type"), count("peer", PEER_REVIEWED).alias("n")), F.struct(F.lit("preprint").alias("type"), count("pre", 1 - PEER_REVIEWED).alias("n")))
    return facts.select(F.explode(types).alias("x")).select("x.type", "x.n")


def display_order(facets: DataFrame) -> DataFrame:
    """(facet, value, n, place) as shown: the newest years, and the most frequent of the other values (ties by value)."""
    year = F.when(F.col("facet") == "year", F.col("value").try_cast("int"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(year.desc_nulls_last(), F.desc("n"), "value"))
    most = F.coalesce(schema.literal_map(SHOWN, 1 << 30)(F.col("facet")), F.lit(1 << 30))
    return facets.withColumn("place", place).where(F.col("place") <= most)


def facet_maps(facets: DataFrame) -> DataFrame:
    """(facet, counts): each facet's values with their counts as a map; give facets of a bounded number of values."""
    return facets.groupBy("facet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


def label(kind: str, c: Column) -> Column:
    """How a source, status or publisher is shown; others as they are."""
    table = {"source": schema.FACET_SOURCE_LABELS, "oa_status": schema.STATUS_LABELS, "publisher": schema.PUBLISHER_LABELS}[kind]
    return F.coalesce(schema.literal_map(table, None)(c), c)


def settled_total(counts: DataFrame) -> DataFrame:
    """(total) over sources (source, n, rows, failed).

    A source that failed gives nothing; one without a count of its own is taken
    for a thousand if it gave any row.
    """
    known = F.when(F.col("failed"), 0).when(F.col("n").isNotNull(), F.col("n")).when(F.col("rows") > 0, 1000).otherwise(0)
    return counts.agg(F.coalesce(F.sum(known), F.lit(0)).cast("bigint").alias("total"))


def accurate_facets(records: DataFrame, source_counts: DataFrame, facets: DataFrame, total: int, fetched: int, most: float = 100.0) -> DataFrame:
    """(facet, value, n): the sources' own counts (source, n), other facets scaled to their sum, by `most` at most."""
    factor = min(total / fetched, most) if total > 0 and fetched > 0 else 1.0
    others = facets.where("facet in ('year', 'oa_status', 'venue')").withColumn("n", F.col("n") * F.lit(int(factor + 0.5)))
    return source_counts.where("n > 0").select(F.lit("source").alias("facet"), F.col("source").alias("value"), "n").unionByName(others.select("facet", "value", "n"))


def scoped_scaled(everything: DataFrame, filtered: DataFrame, total: int, fetched: int) -> DataFrame:
    """(facet, value, n) scaled from the fetched hits to their total: sources, venues and publishers of all hits, the other facets of the filtered ones."""
    factor = total / fetched if total > 0 and fetched > 0 else 1.0
    wide = everything.where("facet in ('source', 'venue', 'publisher')").unionByName(filtered.where("facet in ('year', 'oa_status', 'topics')"))
    return wide.withColumn("n", F.col("n") * F.lit(int(factor + 0.5)))
