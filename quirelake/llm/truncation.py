"""Texts that were cut off: by a field's limit or in transfer.

Method: self-join by prefix. All distinct texts are sorted (range-partitioned,
so no group has to fit anywhere); whatever extends a text follows it directly
in that order, and so one look at the next distinct text tells whether the text
is a strict prefix of a longer copy, and how the copy goes on. What goes on
inside a sentence, word or number proves a cut; what goes on with a full stop
shows a complete text without one. Texts without a longer copy can't be judged
by prefixes. They are judged by their last words: if hardly any of the places in
which the corpus has these words are ends of sentences, this one isn't either.
Nor do texts end that show where they were left, or stop at a length at which
open texts of their source pile up.

Texts are compared with encoding damage and character references undone and
white space and case evened out, whole and at any length. Only the last row of
each sorted partition meets the first row of the next one outside its task, as
many rows as there are partitions.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.held import held
from quirelake.llm.mojibake import repaired
from quirelake.operators.staging import staged

#: Share of the places of two words that must be ends of sentences, different ones, for a text to end with them.
ENDING_SHARE = 0.02
#: Texts sampled for each partition to divide the sorted order; only the partitions' sizes depend on them.
SAMPLED_FOR_ORDER = 20
#: A length is a source's limit if open texts of it are so many times as frequent as texts of a length up to `BESIDE` characters off, and that by so many standard deviations.
LIMIT_TIMES, LIMIT_SURE, BESIDE = 6.0, 6.0, 12
#: Bits by which two words are told while their places are counted.
PLACE_BITS = 22
#: Digests a task remembers to send each text once.
REMEMBERED = 500_000

# How the notes begin that are appended to abstracts without a full stop.
NOTE = r"(?:keywords?|key words|palabras clave|mots[- ]cl[ée]s|palavras[- ]chave|schlagw[öo]rter|ключевые слова|available (?:from|at|online)|\(?(?:trial )?registration|\(?registered|funding|doi|https?:|copyright|©)"
_NOTE_END = re.compile(rf"(?:^|[.!?)\]]\s+|\n){NOTE}\b(?:(?![.!?]\s).)*$", re.S)

# A raw text that ends a sentence: a stop, perhaps in quotes or brackets, that is no ellipsis.
_ENDED = r"(?s)(?:^|[^.…])[.!?。]['\"”’»)\]]*\s*$"
# It may still stop inside a number.
_NUMBER = r"(?s)\d\.\s*$"
_REFERENCE = re.compile(r"&#?\w{0,8}$")
# Signs that something was left out.
_DOTS = re.compile(r"(?:\s*(?:…|\.{2,}|[\[(](?:…|\.{2,}|more)[\])]|\b(?:read|show|view|see) more\b))+\s*$", re.I)
#: Characters at the end of a text in which its end marks are looked for.
_TAIL = 48
_DIGIT = re.compile(r"[1-9]")


def evened(text: str) -> str:
    """The form in which texts are compared: damage undone, space and case even, end marks of a cut removed."""
    text = repaired(text) or ""
    if "&" in text:
        text = _REFERENCE.sub("", html.unescape(html.unescape(text).strip()))
    text = " ".join(text.split()).casefold()
    return text[:-_TAIL] + _DOTS.sub("", text[-_TAIL:])


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


def last_words(text: str) -> str:
    """The last two words of an evened text, digits as 0."""
    return _DIGIT.sub("0", " ".join(text.rstrip(" .!?\"”’»)]").rsplit(" ", 2)[-2:]))


def _open(text: F.Column) -> F.Column:
    end = F.right(F.rtrim(text), F.lit(_TAIL))
    return ~end.rlike(_ENDED) | end.rlike(_NUMBER)


def _filled(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(rows[text].rlike(r"\S"))


def _keys(texts: DataFrame, cuts, even: Callable[[str], str]) -> DataFrame:
    """(part, key, cand) of the texts, each once for a task; cand tells the texts that may be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, flags = [], []
            for text, cand in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = even(text)
                mark = digest(key + "\x00" * cand)
                if key and mark not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(mark)
                    keys.append(key)
                    flags.append(cand)
            parts = [bisect.bisect_right(cuts.value, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.string()), pa.array(flags, pa.bool_())], names=["part", "key", "cand"])

    return texts.mapInArrow(run, "part int, key string, cand boolean")


_SCANNED = ("kind", "part", "digest", "key", "rest")
_SCANNED_KINDS = (pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string())


def _scan_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: each candidate with what follows it in its extension, the first key, and the last one if it waits."""
    part = TaskContext.get().partitionId()
    last: str | None = None
    waits = False

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_SCANNED_KINDS)], names=list(_SCANNED))

    for batch in batches:
        out: list[tuple] = []
        for key, cand in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last:
                if last is None:
                    out.append(("first", part, None, key, None))
                elif waits and key.startswith(last):
                    out.append(("hit", part, digest(last), None, key[len(last) : len(last) + 4]))
                last, waits = key, cand
            else:
                waits = waits or cand
        yield given(out)
    if last is not None and waits:
        yield given([("last", part, digest(last), last, None)])


def _cuts(texts: DataFrame, parts: int, even: Callable[[str], str]) -> list[str]:
    """Keys that divide the sorted texts into about equal parts, from a bounded sample."""
    share = min(1.0, SAMPLED_FOR_ORDER * parts / max(1, texts.count()))
    taken = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))
    keys = sorted(even(r.text) for r in taken.select("text").limit(2 * SAMPLED_FOR_ORDER * parts).collect())
    return keys[len(keys) // parts :: max(1, len(keys) // parts)][: parts - 1]


def longer_copies(texts: DataFrame, even: Callable[[str], str] = evened) -> DataFrame:
    """(digest, rest): each text that may be cut and is a strict prefix of another, with the first characters of what follows.

    `texts` has the columns text and cand (whether it may be cut); `even` gives
    the form that is compared and digested.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = texts.sparkSession.sparkContext.broadcast(_cuts(texts, parts, even))
    ordered = _keys(texts, shared, even).repartitionById(parts, F.col("part")).sortWithinPartitions("key").select("key", "cand")
    found = staged(ordered.mapInArrow(_scan_sorted, "kind string, part int, digest binary, key string, rest string"))
    # one row a partition: the first key that follows the partition
    firsts = found.where("kind = 'first'").select("part", F.col("key").alias("first"))
    lasts = found.where("kind = 'last'").select("part", "digest", F.col("key").alias("last"))
    edges = firsts.join(lasts, "part", "left").withColumn("next", F.lead("first").over(Window.orderBy("part")))
    across = edges.where(F.col("last").isNotNull() & F.startswith(F.col("next"), F.col("last")))
    return found.where("kind = 'hit'").select("digest", "rest").unionByName(across.select("digest", F.expr("substring(next, length(last) + 1, 4)").alias("rest")))


def _candidates(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, size, digest, tail, place, note, marked, stopped) of the rows that may be cut."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys = [evened(t) for t in texts]
            tails = [last_words(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([digest(k) for k in keys], pa.binary()),
                    pa.array(tails, pa.string()),
                    pa.array([_place(t) for t in tails], pa.int64()),
                    pa.array([_NOTE_END.search(k) is not None or k.endswith((")", "]")) for k in keys], pa.bool_()),
                    pa.array([_DOTS.search(t) is not None for t in texts], pa.bool_()),
                    pa.array([k.endswith(".") for k in keys], pa.bool_()),
                ],
                names=["key", "source", "size", "digest", "tail", "place", "note", "marked", "stopped"],
            )

    taken = rows.select(rows[key].alias("key"), rows[source].cast("string").alias("source"), rows[text].alias("text")).where(_open(F.col("text")))
    return taken.mapInArrow(run, f"key {kind}, source string, size bigint, digest binary, tail string, place bigint, note boolean, marked boolean, stopped boolean")


def ending_counts(rows: DataFrame, text: str) -> DataFrame:
    """(tail, ends): how often sentences of the corpus end with the same two words, where two different sentences do."""
    sentences = F.split(rows[text], r"[.!?][\"”’»)]*\s+(?=\S)")
    ends = F.transform(F.slice(sentences, 1, F.greatest(F.size(sentences) - 1, F.lit(0))), lambda s: F.struct(F.substring_index(s, " ", -2).alias("tail"), F.xxhash64(s).alias("h")))
    one = rows.select(F.explode(ends).alias("e")).groupBy("e.tail").agg(F.count(F.lit(1)).alias("n"), F.min("e.h").alias("low"), F.max("e.h").alias("high"))
    tails = one.groupBy(F.translate(F.lower("tail"), "123456789", "0" * 9).alias("tail")).agg(F.sum("n").alias("ends"), F.min("low").alias("low"), F.max("high").alias("high"))
    return tails.where("low <> high").select("tail", "ends")


def _place(tail: str) -> int:
    return xxhash.xxh3_64_intdigest(tail) & ((1 << PLACE_BITS) - 1)


def place_counts(rows: DataFrame, text: str, tails: DataFrame) -> DataFrame:
    """(tail, places): in how many places of the corpus the words of each tail stand.

    Which tails are asked for goes to the workers as a table of bits, of a fixed
    size; others that share a bit are counted for nothing.
    """
    wanted = np.zeros(1 << PLACE_BITS, bool)
    for r in tails.select(F.pmod("place", F.lit(1 << PLACE_BITS)).cast("int").alias("p")).distinct().collect():
        wanted[r.p] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held("places", shared.value, lambda v: np.unpackbits(v).astype(bool).tolist())
        known: dict[str, bool] = {}
        for batch in batches:
            counts: Counter[str] = Counter()
            for value in batch.column(0).to_pylist():
                words = [w.rstrip(".!?\"”’»)],;:") for w in _DIGIT.sub("0", value.casefold()).split()]
                counts.update(map(" ".join, zip(words, words[1:], strict=False)))
            kept = {}
            for tail, n in counts.items():
                fine = known.get(tail)
                if fine is None:
                    if len(known) > REMEMBERED:
                        known.clear()
                    fine = known[tail] = asked[_place(tail)]
                if fine:
                    kept[tail] = n
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["tail", "n"])

    counted = rows.select(rows[text]).mapInArrow(run, "tail string, n bigint")
    return counted.groupBy("tail").agg(F.sum("n").alias("places"))


def limits_of(shown: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, size) at which open texts pile up beyond what texts of nearly that size let expect."""
    at = shown.where("alone").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n_open"))
    offsets = F.array(*(F.lit(i) for i in range(-BESIDE, BESIDE + 1) if i))
    near = sizes.select("source", F.explode(F.transform(offsets, lambda i: F.col("size") + i)).alias("size"), "n").groupBy("source", "size").agg(F.sum("n").alias("near"))
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    mean = F.coalesce("near", F.lit(0)) / (2.0 * BESIDE)
    found = at.alias("a").join(near.alias("b"), same, "left").where((F.col("n_open") >= LIMIT_TIMES * (mean + 0.5)) & (F.col("n_open") - mean >= LIMIT_SURE * F.sqrt(mean + 0.5)))
    return found.select("a.source", "a.size", F.lit(True).alias("limit"))


def find_cut(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, evidence) of each row whose `text` was cut inside a sentence, word or number.

    evidence is `longer copy`, `mark` (dots or a link to the rest, after an
    unended sentence), `limit` (the text stops at a length at which open texts
    of its source pile up) or `last words`. Null, empty
    and blank texts are never cut, nor are texts that end with a full stop, a
    bracket or an appended note, unless a longer copy goes on inside the number
    or note. Repeated rows count by themselves; an empty table gives an empty
    table; texts of any length are compared whole. A null source is a source of
    its own. Other columns aren't read.
    """
    filled = _filled(rows, text)
    texts = filled.select(filled[text].alias("text"), _open(filled[text]).alias("cand"))
    copies = longer_copies(texts).groupBy("digest").agg(F.min("rest").alias("rest"))
    judged = _candidates(filled, key, text, source).join(copies, "digest", "left")
    goes_on = F.when(F.col("stopped"), F.col("rest").rlike(r"^\d")).otherwise(~F.col("rest").rlike(r"^[\"”’»)\]]*[.!?]"))
    alone = F.col("rest").isNull() & ~F.col("stopped")
    shown = staged(judged.select("key", "source", "size", "tail", "place", "note", (alone & ~F.col("note")).alias("alone"), F.when(goes_on, "longer copy").when(alone & F.col("marked"), "mark").alias("evidence")))
    asked = shown.where("alone and evidence is null")
    counted = asked.select("tail").distinct().join(ending_counts(filled, text), "tail").join(place_counts(filled, text, asked), "tail", "left")
    ends = counted.where(F.col("ends") >= ENDING_SHARE * F.greatest(F.coalesce("places", F.lit(0)), F.col("ends"))).select("tail", F.lit(True).alias("ends"))
    sizes = filled.select(filled[source].cast("string").alias("source"), F.length(filled[text]).cast("bigint").alias("size")).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    limits = limits_of(shown, sizes)
    at = F.col("shown.source").eqNullSafe(F.col("limits.source")) & (F.col("shown.size") == F.col("limits.size"))
    joined = shown.join(ends, "tail", "left").alias("shown").join(limits.alias("limits"), at, "left")
    left_open = F.when(F.col("alone") & F.col("limit"), "limit").when(F.col("alone") & F.col("ends").isNull(), "last words")
    return joined.select("key", F.coalesce("evidence", left_open).alias("evidence")).where("evidence is not null")


def report(rows: DataFrame, cut: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(source, n_texts, n_cut, cut_share): how often each source cuts its texts."""
    filled = _filled(rows, text).select(rows[key].alias("key"), rows[source].alias("source"))
    marked = filled.join(cut.select("key", F.lit(1).alias("is_cut")), "key", "left")
    counts = marked.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count("is_cut").alias("n_cut"))
    return counts.withColumn("cut_share", F.col("n_cut") / F.col("n_texts"))
