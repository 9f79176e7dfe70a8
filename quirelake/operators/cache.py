"""Result caches as tables: keys, lifetimes, eviction, metrics, and latest-wins tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake import schema
from quirelake.functions.text import query_cache


def with_lifetimes(entries: DataFrame, ttl: tuple[int, int, int] = schema.SEARCH_TTL) -> DataFrame:
    """Entries (stored_at) with the end of their life at each level; `schema.LIFETIMES` has the lifetimes of what is cached."""
    return entries.withColumns({f"expires_l{i}": F.timestamp_seconds(F.unix_timestamp("stored_at") + s) for i, s in enumerate(ttl, 1)})


def fresh_at(entries: DataFrame, now: Column) -> DataFrame:
    """Entries with the fastest level that still holds them, null if none does."""
    level = F.lit(None).cast("int")
    for i in (3, 2, 1):
        level = F.when(F.col(f"expires_l{i}") >= now, i).otherwise(level)
    return entries.withColumn("level", level)


def nth_smallest(rows: DataFrame, column: str, n: int, bins: int = 4096) -> int | None:
    """The n-th smallest value of a whole-number column, without sorting: each round counts bins and looks into the one that holds it."""
    low, high = rows.agg(F.min(column), F.max(column)).collect()[0]
    if low is None or n < 1:
        return None
    while low < high:
        width = -(-(high - low + 1) // bins)
        within = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        counts = within.groupBy(F.floor((F.col(column) - low) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # at most `bins` rows
        for r in counts:
            if n <= r.n:
                low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width - 1)
                break
            n -= r.n
        else:
            return high
    return low


def evicted(entries: DataFrame, most: int, share: float = 0.2) -> DataFrame:
    """The oldest fifth, if there are more than `most` entries; entries need a `seq`, the order of insertion."""
    n = entries.count()
    out = int(n * share)
    if n <= most or out == 0:
        return entries.where(F.lit(False))
    return entries.where(F.col("seq") <= nth_smallest(entries, "seq", out))


def pruned(records: DataFrame, most: int = 500) -> DataFrame:
    """Records as cached: abstracts cut at `most` characters, a few fields only."""
    return records.select("ord", "id", "doi", "title", "year", "venue", F.left("abstract", F.lit(most)).alias("abstract"), "source", "oa_status", "best_pdf_url")


def paper_keys(records: DataFrame) -> DataFrame:
    """(space, key, id): the keys under which a paper is found: id, DOI and normalised title, and its metadata by id."""
    pair = lambda space, key: F.struct(F.lit(space).alias("space"), key.alias("key"))
    keys = F.array(pair("paper", F.col("id")), pair("doi", F.lower(F.trim("doi"))), pair("title", query_cache(F.col("title"))), pair("metadata", F.col("id")))
    return records.select("ord", "id", F.explode(keys).alias("k")).select("ord", "k.space", "k.key", "id").where("key is not null and key <> ''")


def hit_metrics(lookups: DataFrame) -> DataFrame:
    """One row: lookups (level or null, ms) by level, misses, hit rate and mean time."""
    return lookups.agg(
        F.count(F.lit(1)).alias("n"), F.count("level").alias("hits"), F.count_if(F.col("level").isNull()).alias("misses"), *(F.count_if(F.col("level") == i).alias(f"l{i}_hits") for i in (1, 2, 3)),
        F.try_divide(F.count("level").cast("double"), F.count(F.lit(1))).alias("hit_rate"), F.avg("ms").alias("mean_ms"),
    )


def latest_per(rows: DataFrame, key: str, *order: str, most: int | None = None) -> DataFrame:
    """The latest row of each key by `order`; with `most`, the latest keys."""
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("x")).select(key, "x.*")
    return kept if most is None else kept.orderBy(*(F.desc(c) for c in order), key).limit(most)


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`old` with the rows of `new` in place of those of the same key; nothing changes for no new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def metadata(records: DataFrame) -> DataFrame:
    """The fields of a record that are kept apart from it."""
    return records.select("ord", "id", "doi", "title", "authors", "year", "venue", "source", "oa_status", "citation_count", "created_at")


def first_seen(rows: DataFrame, key: str) -> DataFrame:
    """(key, first_ord, n, place): groups in the order in which they first come.

    Groups are numbered within ranges of their first place, each range by a task
    of its own, and moved up by the groups of the ranges before.
    """
    groups = rows.groupBy(key).agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"))
    width = 100_000
    ranged = groups.withColumn("range", F.floor(F.col("first_ord") / width))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranged.withColumn("at", F.rank().over(Window.partitionBy("range").orderBy("first_ord"))).join(before, "range")
    return placed.select(key, "first_ord", "n", (F.col("at") + F.col("before")).cast("int").alias("place"))
