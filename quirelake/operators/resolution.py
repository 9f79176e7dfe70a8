"""Asking several sources for the same thing: order, retries, stages, early return, and the union of what they say of a DOI.

Attempts are rows (request, name, stage, priority, place, ok, ms): what each
source gave and how long it took. Whether it would have been asked at all
depends on the others, which is counted, not tried in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import DOI_HOST, doi_merge, has_text
from quirelake.operators import merge

#: Priority of a source that has none.
DEFAULT_PRIORITY = 100
# For fast, medium and slow sources, the milliseconds waited for one, and the results from which no further stage is begun.
STAGES = ((2000, 10), (5000, 20), (10000, 30))


def in_order(attempts: DataFrame) -> F.Column:
    return F.struct(F.coalesce("priority", F.lit(DEFAULT_PRIORITY)), "place")


def retried(attempts: DataFrame, tries: int = 2) -> DataFrame:
    """(request, name, ok, attempt, ms): a source's first success within so many tries, else its last failure."""
    kept = attempts.where(F.col("attempt") <= tries)
    one = F.struct("attempt", "ms")
    best = kept.groupBy("request", "name").agg(F.min(F.when(F.col("ok"), one)).alias("good"), F.max(one).alias("last"))
    won = F.coalesce("good", "last")
    return best.select("request", "name", F.col("good").isNotNull().alias("ok"), won["attempt"].alias("attempt"), won["ms"].alias("ms"))


def early_return(attempts: DataFrame, timeout: int) -> DataFrame:
    """(request, name, ms) of the first source, by priority and then by place, that answers in time; nulls if none does."""
    good = F.col("ok") & (F.col("ms") <= timeout)
    first = attempts.groupBy("request").agg(F.min(F.when(good, F.struct(in_order(attempts).alias("o"), "name", "ms"))).alias("x"))
    return first.select("request", "x.name", "x.ms")


def in_stages(attempts: DataFrame, stages: tuple[tuple[int, int], ...] = STAGES) -> DataFrame:
    """(request, stage, name, ok, ms) of what is asked: a stage is begun while the ones before it gave too few results.

    Every source asked gives a result, failures too; one that takes longer than
    its stage waits has failed when the time is over.
    """
    sizes = attempts.groupBy("request").agg(*(F.count_if(F.col("stage") == i).alias(f"n{i}") for i in range(len(stages))))
    open_, so_far, begun = F.lit(True), F.lit(0), F.lit(False)
    for i, (_, most) in enumerate(stages):
        begun = F.when(F.col("stage") == i, open_).otherwise(begun)
        so_far = so_far + F.when(open_, F.col(f"n{i}")).otherwise(0)
        open_ = open_ & (so_far < most)
    wait = F.lit(0)
    for i, (ms, _) in enumerate(stages):
        wait = F.when(F.col("stage") == i, ms).otherwise(wait)
    asked = attempts.join(sizes, "request").where(begun)
    return asked.select("request", "stage", "name", (F.col("ok") & (F.col("ms") <= wait)).alias("ok"), F.least("ms", wait.cast("double")).alias("ms"))


def resolved(records: DataFrame, asked: DataFrame, sources: tuple[str, ...] = ("crossref", "unpaywall", "openalex"), host: str = DOI_HOST) -> DataFrame:
    """What the sources say of the DOIs in `asked` (doi), merged to one record each."""
    wanted = asked.select(doi_merge(F.col("doi"), host).alias("wanted")).where(has_text(F.col("wanted"))).distinct()
    found = records.where(F.col("source").isin(*sources)).join(wanted, doi_merge(F.col("doi"), host) == F.col("wanted"), "left_semi")
    return merge.merge_groups(found, host, normalise_single=True)
