"""Mixing sources to target weights.

Method: iterative proportional fitting. The corpus is reduced to a table of
cells (source, language, topic) with their tokens and documents. For each plan
the cells' weights are raked in turn to the source shares of the plan and to
the language and topic marginals of the plan's own sources in the corpus, and
capped by `max_repeats`. A cell's weight over its tokens is how often each of
its documents is expected in the mix. Each document then comes out that often:
the whole part for sure, the rest with that probability, drawn from a hash of
its number and calibrated on the tokens that the draw really takes.

Source shares come last in every round, so they hold to the calibration's
grain; language and topic give way where they contradict them. Tokens are
counted with the public tokenizer of `bpe`.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import bpe
from quirelake.operators.staging import staged

ROUNDS = 60
#: Steps of the hash by which the draws are calibrated, per plan and cell: coarse, then within the step.
STEPS = 256
#: More cells than this are refused: they are the contingency table on the driver.
MAX_CELLS = 500_000
NONE = "\x00none"


def capped_shares(wanted: dict[str, float], most: dict[str, float], size: float) -> dict[str, float]:
    """Tokens of each source: the wanted share of `size`, at most what it can give.

    What capped sources can't give is spread over the others in proportion to
    their targets, so that the mix keeps its size while anything is left.
    """
    given = {s: 0.0 for s in wanted}
    open_ = {s for s, w in wanted.items() if w > 0 and most.get(s, 0) > 0}
    left = size
    while open_ and left > 1e-9:
        total = sum(wanted[s] for s in open_)
        over = {s for s in open_ if wanted[s] / total * left >= most[s] - 1e-9}
        if not over:
            for s in open_:
                given[s] = wanted[s] / total * left
            break
        for s in over:
            given[s] = most[s]
            left -= most[s]
        open_ -= over
    return given


def rake(tokens: dict[tuple[str, str, str], float], goal: dict[str, float], repeats: dict[str, float], rounds: int = ROUNDS) -> dict[tuple[str, str, str], float]:
    """Tokens that each cell gives: raked to the sources' goals and the corpus marginals of language and topic, capped."""
    cells = [c for c, t in tokens.items() if goal.get(c[0], 0) > 0 and t > 0]
    if not cells:
        return {}
    size = np.array([tokens[c] for c in cells])
    whole, aim = size.sum(), sum(goal.values())
    axes: list[tuple[np.ndarray, np.ndarray]] = []
    for axis in (1, 2):
        _, of = np.unique([c[axis] for c in cells], return_inverse=True)
        axes.append((of, np.bincount(of, weights=size) / whole * aim))
    names, of_source = np.unique([c[0] for c in cells], return_inverse=True)
    goals = np.array([goal[s] for s in names])
    axes.append((of_source, goals))
    weight = size * goals[of_source] / np.bincount(of_source, weights=size)[of_source]
    most = size * np.array([repeats[s] for s in names])[of_source]
    for _ in range(rounds):
        for of, margin in axes:
            sums = np.bincount(of, weights=weight, minlength=len(margin))
            factor = np.divide(margin, sums, out=np.ones_like(sums), where=sums > 0)
            weight = np.where(sums[of] > 0, np.minimum(most, weight * factor[of]), weight)
    # capping may have left a source short although other cells of it have room
    for _ in range(len(cells) + 1):
        short = goals - np.bincount(of_source, weights=weight)
        room = weight < most - 1e-9
        needs = (short > 1e-9 * np.maximum(1.0, goals)) & (np.bincount(of_source, weights=room) > 0)
        if not needs.any():
            break
        share = np.where(weight > 0, weight, most) * room
        base = np.bincount(of_source, weights=share)
        add = np.divide(short, base, out=np.zeros_like(base), where=needs & (base > 0))
        weight = np.minimum(most, weight + share * add[of_source])
    return dict(zip(cells, weight.tolist(), strict=True))


def count_tokens(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    return bpe.encode_corpus(docs, text, keep, "n_tokens", counts_only=True)


def find_mix(docs: DataFrame, plans: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", topic: str = "doc_kind", source: str = "source") -> DataFrame:
    """(plan_name, source, doc_id, n_tokens, copies, target_share, reached_share) of every document in each plan's mix.

    `plans` has plan_name, source, target_share, max_repeats and size_ratio; a
    source that a plan leaves out gives nothing to it, one without documents
    reaches share 0 and its part goes to the others. Documents without tokens
    are in no mix. Null languages and topics are marginals of their own; null
    sources belong to no plan. Equal numbers of a document draw alike, so
    repeated rows of one document come out or stay out together. No documents
    or no plans give an empty mix. Plans are few by nature and are read to the
    driver.
    """
    spark = docs.sparkSession
    kept = docs.select(docs[key].alias("doc_id"), docs[source].alias("source"), F.coalesce(docs[language], F.lit(NONE)).alias("lang"), F.coalesce(docs[topic], F.lit(NONE)).alias("topic"), docs[text].alias("text"))
    sized = count_tokens(kept, "text", ("doc_id", "source", "lang", "topic")).where("n_tokens > 0")
    step = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(STEPS * STEPS)).cast("int")
    sized = staged(sized.withColumn("draw", step))

    by_cell = sized.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n"))
    cells = by_cell.limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    whole = sum(r.n for r in cells)
    tokens = {(r.source, r.lang, r.topic): float(r.n) for r in cells if r.source is not None}
    of_source: dict[str, float] = defaultdict(float)
    for c, n in tokens.items():
        of_source[c[0]] += n

    rates: list[tuple[str, str, str, str, float]] = []
    goals: list[tuple[str, str, float, float]] = []
    chosen: dict[str, list] = defaultdict(list)
    for r in plans.where("plan_name is not null and source is not null").orderBy("plan_name", "source").collect():
        chosen[r.plan_name].append(r)
    for plan, rows in chosen.items():
        wanted = {r.source: float(r.target_share or 0) for r in rows}
        repeats = {r.source: float(r.max_repeats or 0) for r in rows}
        size = max((float(r.size_ratio or 0) for r in rows), default=0.0) * whole
        goal = capped_shares(wanted, {s: of_source[s] * repeats[s] for s in wanted if s in of_source}, size)
        weight = rake(tokens, goal, repeats)
        rates += [(plan, *c, w / tokens[c]) for c, w in weight.items() if w > 0]
        goals += [(plan, s, goal[s], wanted[s]) for s in wanted]
    rated = spark.createDataFrame(rates, "plan_name string, source string, lang string, topic string, rate double")
    aims = spark.createDataFrame(goals, "plan_name string, source string, goal double, target_share double")

    # a document joins its own cell once for each plan
    drawn = sized.join(rated, ["source", "lang", "topic"])
    whole_part, rest = F.floor("rate").cast("int"), F.col("rate") - F.floor("rate")
    drawn = drawn.withColumn("copies", whole_part + (F.col("draw") < rest * (STEPS * STEPS)).cast("int"))
    # calibration: by how much each source's draw misses its goal, made good in order of the draw among those left out or in
    taken = drawn.groupBy("plan_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("took"))
    miss = aims.join(taken, ["plan_name", "source"], "left").select("plan_name", "source", "target_share", (F.col("goal") - F.coalesce("took", F.lit(0))).alias("miss"))
    repeats = plans.select("plan_name", "source", F.col("max_repeats").cast("int").alias("most")).dropDuplicates(["plan_name", "source"])
    settled = drawn.join(F.broadcast(miss), ["plan_name", "source"]).join(F.broadcast(repeats), ["plan_name", "source"])
    # documents just beyond their threshold come in while tokens are missing, those just within go out while there are too many
    threshold = rest * (STEPS * STEPS)
    can_grow = (F.col("miss") > 0) & (F.col("draw") >= threshold) & (F.col("copies") < F.col("most"))
    can_fall = (F.col("miss") < 0) & (F.col("draw") < threshold)
    distance = F.when(can_grow, F.col("draw") - threshold).when(can_fall, threshold - F.col("draw"))
    settled = settled.withColumn("far", F.floor(distance).cast("int"))
    histogram = settled.where("far is not null").groupBy("plan_name", "source", "far").agg(F.sum("n_tokens").alias("n")).groupBy("plan_name", "source").agg(F.array_sort(F.collect_list(F.struct("far", "n"))).alias("bins"))
    # documents are taken as long as that brings the sum nearer to what is missing; then no more
    reach = F.expr("aggregate(bins, named_struct('sum', 0D, 'far', -1, 'over', false), (s, b) -> if(not s.over and s.sum + b.n <= abs(miss) + b.n / 2, named_struct('sum', s.sum + b.n, 'far', b.far, 'over', false), named_struct('sum', s.sum, 'far', s.far, 'over', true))).far")
    limits = histogram.join(miss, ["plan_name", "source"]).select("plan_name", "source", reach.alias("reach"))
    final = settled.join(F.broadcast(limits), ["plan_name", "source"], "left")
    within = F.col("far") <= F.coalesce("reach", F.lit(-1))
    final = staged(final.withColumn("copies", F.when(within & (F.col("miss") > 0), F.col("copies") + 1).when(within & (F.col("miss") < 0), F.col("copies") - 1).otherwise(F.col("copies"))).where("copies > 0").select("plan_name", "source", "doc_id", "n_tokens", "copies", "target_share"))
    return final.join(F.broadcast(_reached(final)), ["plan_name", "source"])


def _reached(mix: DataFrame) -> DataFrame:
    """(plan_name, source, reached_share) of a mix; as many rows as the plans have."""
    sums = mix.groupBy("plan_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n"))
    totals = sums.groupBy("plan_name").agg(F.sum("n").alias("total"))
    return sums.join(totals, "plan_name").select("plan_name", "source", (F.col("n") / F.col("total")).alias("reached_share"))


def shares(mix: DataFrame, plans: DataFrame, docs_tokens: DataFrame) -> DataFrame:
    """(plan_name, source, target_share, reached_share, n_docs, n_copies, n_tokens, size_ratio, size_reached, capped) of each line of the plans.

    capped tells sources of which nothing more could be taken: nearly all their
    tokens are in the mix as often as the plan lets them.
    """
    sums = mix.groupBy("plan_name", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"))
    whole = docs_tokens.agg(F.sum("n_tokens").alias("whole"))
    have = docs_tokens.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    totals = sums.groupBy("plan_name").agg(F.sum("n_tokens").alias("total")).crossJoin(F.broadcast(whole))
    lines = plans.select("plan_name", "source", "target_share", "size_ratio", "max_repeats")
    joined = lines.join(sums, ["plan_name", "source"], "left").join(totals, "plan_name", "left").join(have, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    capped = F.coalesce("n_tokens", F.lit(0)) >= 0.99 * F.coalesce("have", F.lit(0)) * F.col("max_repeats")
    return joined.select("plan_name", "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"), zero("n_docs"), zero("n_copies"), zero("n_tokens"), "size_ratio", F.coalesce(F.col("total") / F.col("whole"), F.lit(0.0)).alias("size_reached"), capped.alias("capped"))


def margins(mix: DataFrame, docs: DataFrame, key: str = "doc_id", language: str = "lang", topic: str = "doc_kind") -> DataFrame:
    """(plan_name, margin, value, wanted_share, reached_share): languages and topics of each mix, against those of its sources in the corpus.

    `docs` has n_tokens beside key, source, language and topic. Nulls are a value of their own.
    """
    named = docs.select(docs[key].alias("doc_id"), "source", "n_tokens", F.explode(F.array(*(F.struct(F.lit(c).alias("margin"), F.coalesce(docs[c], F.lit("")).alias("value")) for c in (language, topic)))).alias("m")).select("doc_id", "source", "n_tokens", "m.margin", "m.value")
    kept = mix.select("plan_name", "source").distinct()
    of_corpus = named.groupBy("source", "margin", "value").agg(F.sum("n_tokens").alias("n")).join(kept, "source").groupBy("plan_name", "margin", "value").agg(F.sum("n").alias("n"))
    of_mix = mix.select("plan_name", "doc_id", "copies").join(named.select("doc_id", "n_tokens", "margin", "value").distinct(), "doc_id").groupBy("plan_name", "margin", "value").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("m"))
    both = of_corpus.join(of_mix, ["plan_name", "margin", "value"], "left")
    whole = both.groupBy("plan_name", "margin").agg(F.sum("n").alias("n_all"), F.sum("m").alias("m_all"))
    return both.join(whole, ["plan_name", "margin"]).select("plan_name", "margin", "value", (F.col("n") / F.col("n_all")).alias("wanted_share"), F.coalesce(F.col("m") / F.col("m_all"), F.lit(0.0)).alias("reached_share"))
