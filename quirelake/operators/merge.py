"""Merging the records of one work by DOI.

Records without a DOI are never grouped: they take their own branch, so null
keys neither meet nor skew. Each group is folded by aggregates whose buffers
hold one value a field, not the group: the first and second filled value in the
order of trust are the least and second least of (rank, value), and only the
lists of topics are gathered, as far as they are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake import schema
from quirelake.functions.scores import record_score
from quirelake.functions.text import DOI_HOST, doi_merge, has_number, has_text


def enriched(records: DataFrame) -> DataFrame:
    """Records with canonical copies of their fields, the PDF's address and source, and whether they may be passed on."""
    return records.withColumns(
        {f"canonical_{f}": F.col(f) for f in ("title", "authors", "year", "venue", "abstract")}
        | {"pdf_url": F.col("best_pdf_url"), "pdf_source": F.when(has_text(F.col("best_pdf_url")), F.col("source")), "is_redistributable": F.coalesce(F.col("oa_status").isin(*schema.OPEN_STATUSES), F.lit(False))}
    )


def _rank() -> Column:
    return F.struct(schema.literal_map(schema.PRIORITY, schema.DEFAULT_PRIORITY)(F.col("source")).alias("p"), F.col("ord").alias("o"))


_FILLED = {"title": has_text, "year": has_number, "venue": has_text, "abstract": has_text}


def _folded(grouped) -> DataFrame:
    rank = F.col("rank")
    parts = [F.count(F.lit(1)).alias("n_records"), F.min("ord").alias("first_ord")]
    lead = ("ord", "id", "doi", "source", "source_id", "best_pdf_url", "oa_status", "citation_count", "publisher", "language", "created_at", "updated_at", "authors", "title", "year", "venue", "abstract", "topics")
    parts.append(F.min_by(F.struct(*lead), rank).alias("lead"))
    for f, filled in _FILLED.items():
        parts.append(F.min(F.when(filled(F.col(f)), F.struct(rank.alias("r"), F.col(f).alias("v")))).alias(f"one_{f}"))
    parts.append(F.min(F.when(F.size("authors") > 0, F.struct(rank.alias("r"), F.col("authors").alias("v")))).alias("one_authors"))
    parts.append(F.min(F.when(has_text(F.col("best_pdf_url")), F.struct(rank.alias("r"), F.struct("best_pdf_url", "source").alias("v")))).alias("one_pdf"))
    parts.append(F.min(F.when(has_text(F.col("landing_page")), F.struct(rank.alias("r"), F.col("landing_page").alias("v")))).alias("one_landing"))
    return grouped.agg(*parts)


def merge_groups(records: DataFrame, host: str = DOI_HOST, normalise_single: bool = False, best_of: bool = False) -> DataFrame:
    """One record for each DOI, and every record without one.

    Of the records of a DOI the most trusted leads (ties: the earlier one). A
    field that it lacks takes the second filled value in that order, the
    canonical field the first; lists of authors, addresses and PDF take the
    first filled one; topics are united in order, without dropping what one
    record lists twice. A DOI held by one record keeps its raw form unless
    `normalise_single`. Output columns are the record's, the canonical ones,
    `n_records`, and `ord`, the place of the group's first record.
    """
    keyed = records.withColumn("doi_norm", doi_merge(F.col("doi"), host))
    named = keyed.where(has_text(F.col("doi_norm"))).withColumn("rank", _rank())
    unnamed = keyed.where(~F.coalesce(has_text(F.col("doi_norm")), F.lit(False)))

    one = _folded(named.groupBy("doi_norm"))
    # the second filled value is the least beyond the first; only groups whose leader lacks a field that another record has need it
    needed = F.lit(False)
    for f, filled in _FILLED.items():
        needed = needed | (~F.coalesce(filled(F.col(f"lead.{f}")), F.lit(False)) & F.col(f"one_{f}").isNotNull())
    lacking = one.where((F.col("n_records") > 1) & needed).select("doi_norm", *(F.col(f"one_{f}.r").alias(f"r_{f}") for f in _FILLED))
    second = named.join(lacking, "doi_norm").groupBy("doi_norm").agg(
        *(F.min(F.when(filled(F.col(f)) & (F.col("rank") > F.col(f"r_{f}")), F.struct(F.col("rank").alias("r"), F.col(f).alias("v")))).alias(f"two_{f}") for f, filled in _FILLED.items())
    )
    topics = _topics(named)
    folded = one.join(second, "doi_norm", "left").join(topics, "doi_norm", "left")

    def merged(f: str) -> Column:
        own = F.col(f"lead.{f}")
        return F.when(_FILLED[f](own), own).otherwise(F.coalesce(F.col(f"two_{f}.v"), own)).alias(f)

    def canonical(f: str) -> Column:
        return F.coalesce(F.col(f"one_{f}.v"), F.col(f"lead.{f}")).alias(f"canonical_{f}")

    several = folded.select(
        F.col("first_ord").alias("ord"), F.col("lead.id").alias("id"), F.when((F.col("n_records") > 1) | F.lit(normalise_single), F.col("doi_norm")).otherwise(F.col("lead.doi")).alias("doi"),
        *(merged(f) for f in _FILLED), *(canonical(f) for f in _FILLED),
        F.coalesce(F.col("one_authors.v"), F.array().cast("array<string>")).alias("authors"), F.col("lead.authors").alias("canonical_authors"), F.coalesce("topics", F.col("lead.topics")).alias("topics"),
        F.coalesce(F.col("one_pdf.v.best_pdf_url"), F.col("lead.best_pdf_url")).alias("pdf_url"), F.coalesce(F.col("one_pdf.v.source"), F.col("lead.source")).alias("pdf_source"), F.col("one_landing.v").alias("landing_page"),
        *(F.col(f"lead.{f}").alias(f) for f in ("source", "source_id", "best_pdf_url", "oa_status", "citation_count", "publisher", "language", "created_at", "updated_at")),
        F.coalesce(F.col("lead.oa_status").isin(*schema.OPEN_STATUSES), F.lit(False)).alias("is_redistributable"), F.col("n_records"), F.col("lead.ord").alias("lead_ord"),
    )
    single = enriched(unnamed.drop("doi_norm")).withColumns({"n_records": F.lit(1).cast("bigint"), "lead_ord": F.col("ord")})
    # groups of one record keep an empty list of topics and their own PDF source
    return several.unionByName(single.select(*several.columns)).drop("lead_ord") if not best_of else _best(several.unionByName(single.select(*several.columns)))


def _topics(named: DataFrame) -> DataFrame:
    """(doi_norm, topics): the leader's topics and what later records add, in order of trust.

    A topic is placed where it first stands; the record that brings it keeps its
    repetitions.
    """
    places = F.transform(F.array_distinct("topics"), lambda t: F.struct(t.alias("topic"), F.filter(F.sequence(F.lit(0), F.size("topics") - 1), lambda i: F.get("topics", i).eqNullSafe(t)).alias("at")))
    spread = named.where(F.size("topics") > 0).select("doi_norm", "rank", F.explode(places).alias("x"))
    first = spread.groupBy("doi_norm", "x.topic").agg(F.min(F.struct("rank", "x.at")).alias("y"))
    each = first.select("doi_norm", F.transform("y.at", lambda i: F.struct(F.col("y.rank").alias("rank"), i.alias("at"), F.col("topic"))).alias("z"))
    return each.groupBy("doi_norm").agg(F.transform(F.array_sort(F.flatten(F.collect_list("z"))), lambda x: x["topic"]).alias("topics"))


def _best(merged: DataFrame) -> DataFrame:
    return merged.withColumn("score", record_score(merged.columns)).orderBy(F.desc("score"), "ord").limit(1).drop("lead_ord")


def merge_best_of(records: DataFrame, host: str = DOI_HOST) -> DataFrame:
    """The highest-scored record after merging, the earliest of equals; nothing for no records."""
    return merge_groups(records, host, best_of=True)
