"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import bpe, canon, matching, mixing, mojibake, names, residue, survivor, truncation
from quirelake.sources.tables import table


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's ids in the 50k byte-level vocabulary."""
    return bpe.encode_corpus(table(spark, directory, "documents"))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The row whose value survives, for each work and field."""
    return survivor.find_survivors(table(spark, directory, "enriched_records"))


def p1_records(spark: SparkSession, directory: str) -> DataFrame:
    """The surviving record of each work, built field by field."""
    return survivor.surviving_records(table(spark, directory, "enriched_records"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of spellings of the same author or group."""
    return names.find_variants(table(spark, directory, "oa_records"), "authors")


def p2_entities(spark: SparkSession, directory: str) -> DataFrame:
    """Every spelling with the number of its entity."""
    return names.entities(table(spark, directory, "oa_records"), "authors")


def p3_restored(spark: SparkSession, directory: str) -> DataFrame:
    """Fields that were decoded wrongly, as stored and as restored."""
    found = mojibake.find_damage(table(spark, directory, "oa_records"), "rec_no", ("title", "abstract", "authors"))
    return found.withColumnRenamed("key", "rec_no")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return p3_restored(spark, directory).select("rec_no", "field_name")


def p4_evidence(spark: SparkSession, directory: str) -> DataFrame:
    """Rows whose abstract was cut, with what shows it."""
    found = truncation.find_cut(table(spark, directory, "oa_records"), "rec_no", "abstract", "source")
    return found.withColumnRenamed("key", "rec_no")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return p4_evidence(spark, directory).select("rec_no")


def p4_sources(spark: SparkSession, directory: str) -> DataFrame:
    """The share of cut abstracts of each source."""
    rows = table(spark, directory, "oa_records")
    cut = truncation.find_cut(rows, "rec_no", "abstract", "source")
    return truncation.report(rows, cut, "rec_no", "abstract", "source")


def p5_mapped(spark: SparkSession, directory: str) -> DataFrame:
    """Typed venues and publishers with the entry meant and the score of the choice."""
    venues = canon.read_list(table(spark, directory, "venue_list"), "venue_id", "venue_name", "issn_code")
    publishers = canon.read_list(table(spark, directory, "publisher_list"), "publisher_id", "publisher_name")
    typed = [
        ("venue", canon.map_values(table(spark, directory, "oa_records"), "rec_no", "venue", venues)),
        ("canonical_publisher", canon.map_values(table(spark, directory, "enriched_records"), "rec_no", "canonical_publisher", publishers)),
    ]
    named = [df.select(F.lit(field).alias("field_name"), F.col("key").alias("rec_no"), "value", "ref_id", "score") for field, df in typed]
    return named[0].unionByName(named[1])


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return p5_mapped(spark, directory).select("field_name", "rec_no", "ref_id")


def p5_unmatched(spark: SparkSession, directory: str) -> DataFrame:
    """The values that no entry matches, with the number of their rows."""
    left = p5_mapped(spark, directory).where("ref_id = 0")
    return left.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p6_matches(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of both tables that describe the same work, with a confidence."""
    return matching.find_matches(table(spark, directory, "oa_records"), table(spark, directory, "repo_records"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return p6_matches(spark, directory).select("rec_no", "repo_rec_no")


def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    """Every document of each plan's mix, how often it occurs, and the shares wanted and reached."""
    return mixing.find_mix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    """For each line of the plans, the share reached and the size of its part."""
    docs, plans = table(spark, directory, "documents"), table(spark, directory, "mix_targets")
    return mixing.shares(mixing.find_mix(docs, plans), plans, mixing.count_tokens(docs, "text", ("doc_id", "source")))


def p8_margins(spark: SparkSession, directory: str) -> DataFrame:
    """Languages and kinds of documents of each mix, wanted and reached."""
    docs, plans = table(spark, directory, "documents"), table(spark, directory, "mix_targets")
    return mixing.margins(mixing.find_mix(docs, plans), mixing.count_tokens(docs, "text", ("doc_id", "source", "lang", "doc_kind")))


def p9_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with residue in place of content, the share of it and its kinds."""
    return residue.find_residue(table(spark, directory, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return p9_coverage(spark, directory).select("doc_id")


def p9_kept(spark: SparkSession, directory: str) -> DataFrame:
    """The corpus without these documents."""
    docs = table(spark, directory, "documents")
    return residue.without_residue(docs, residue.find_residue(docs, "doc_id", "text"), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_records": p1_records, "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p4_evidence": p4_evidence, "p4_sources": p4_sources, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p6_found": p6_found, "p6_matches": p6_matches, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_margins": p8_margins, "p9_found": p9_found, "p9_coverage": p9_coverage, "p9_kept": p9_kept}


def oracle_sql() -> dict[str, str]:
    """None of these operators can be stated in SQL; tests/llm holds them against brute force."""
    return {}
