"""The best value of each field among the rows that describe one work.

Method: currency reasoning. What comes after what is learned from the rows that
have believable times, over the whole table: in how many works a state of a
field is seen wholly before another one (`Precedence`). For counts the states
are magnitudes. Which way counts move, and which magnitudes take no part in
that movement and so are no counts, follows from what was learned. In each work
the magnitudes form a partial order, by their times where they have any and by
what was learned where they haven't; what contradicts the others goes, and the
topologically latest survives. Versions of files are ordered the same way where
the times of the table show an order of them.

Texts have no such order: a text is superseded by the whole, undamaged one. Each
row votes for the core of its text, the text with repairable damage undone;
cores that are strict prefixes of other cores of the work are incomplete; of the
others the one with the most votes survives, then the one whose letters are the
most probable in the corpus, if some row holds it undamaged.

All of it is aggregation with partial sums and one sorted scan: a work may have
any number of rows, and what is gathered of it is a row for each magnitude.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.canon import edits
from quirelake.llm.channels import LOST
from quirelake.llm.held import held
from quirelake.llm.mojibake import examine
from quirelake.llm.residue import BITS, grams, plain
from quirelake.llm.truncation import digest, longer_copies
from quirelake.operators.staging import staged_table

#: Words of several works that the workers hold to tell typing errors; where there are more, all of them are joined as a table.
FREQUENT_WORDS = 50_000
#: Groups that must have a word for it to count as frequent.
FREQUENT_GROUPS = 5
#: Share of the labelled rows that a version label must have to be a state of its own.
LABEL_SHARE = 0.001
#: Standard deviations by which one order of two states must prevail, and how many times as often, to be learned.
SURE, CLEARLY = 3.0, 2.0
#: Share of the comparisons with smaller magnitudes that may go against the direction of counts.
FALLS = 0.25
#: Powers of two between neighbouring magnitudes beyond which the upper one, without comparisons of its own, is no count.
GAP = 4

# Versions of an article's file, as the field's definition orders them; used where times show no order.
VERSIONS = ("submittedVersion", "acceptedVersion", "publishedVersion")
# What stands in place of a title or abstract.
_EMPTY = re.compile(r"^[\W_]*(?:(?:untitled|title|abstract|unknown|none|null|n/?a|missing|empty|document|record|item|available|no|not|tba|tbd|the|is|given|provided|supplied|unavailable|see|full|text|article|pdf|for|click|here)(?![^\W_])[\W_]*)*$", re.I)
# What publishers, repositories and page scrapers put around a title.
_TITLE_FRAME = re.compile(
    r"^\s*(?:\[(?:preprint|article|pdf|html|paper|manuscript|retracted|in press|title)\]|(?:article|preprint|paper|title|pdf|review article|research article)\s*:)\s*"
    r"|\s*\((?:accepted manuscript|author'?s? (?:manuscript|copy|version)|preprint|pdf|in press|online first|full text)\)\s*$"
    r"|\s*\|\s*(?:download|pdf|full text|article|home|abstract|read|view|journal)[^|]*$"
    r"|\s+[-–—]\s*(?:article|full text|abstract|pdf|download)(?:\s*[-–—|]\s*(?:article|full text|abstract|pdf|download)(?: pdf)?)*\s*$",
    re.I,
)
# What scrapers leave before or behind an abstract.
_TEXT_TAIL = re.compile(
    r"\s*(?:©|\(c\)|copyright)\s*(?:©\s*)?\d{4}.{0,200}$|\s*all rights reserved\b.{0,120}$|\s*skip to (?:main )?content\b.{0,300}$|\s*(?:share|cite|export|related articles|metrics|download pdf|view pdf|full text|sign in)(?:\s+(?:share|cite|export|related articles|metrics|download pdf|view pdf|full text|sign in)){1,8}\s*$",
    re.I | re.S,
)
_TEXT_HEAD = re.compile(r"^\s*(?:abstract|summary|background)\s*[:.]\s+(?=[A-ZÀ-Ý])", re.I)
# All that `_TEXT_TAIL` matches is shorter than this.
_TAIL_SIZE = 400
_TAG = re.compile(r"</?[a-zA-Z][\w:-]*(?:\s[^<>]*)?/?>")
_REFERENCE = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]{2,8});")
_DOTS = re.compile(r"(?:…|\.{2,}|\[…\])\s*$")
_ENDED = re.compile(r"[.!?。]['\"”’»)\]]*$|\)$")
_WORD = re.compile(r"[^\W\d_]{4,}")


def doubled(text: str) -> str | None:
    """The half of a text that is written twice."""
    n = len(text)
    for gap in (1, 0, 2):
        half = (n - gap) // 2
        if half > 8 and 2 * half + gap == n and text[:half] == text[half + gap :] and not text[half : half + gap].strip():
            return text[:half]
    return None


# A part of whatever `_TEXT_TAIL` matches, in lower case.
_TAIL_SIGNS = ("©", "(c)", "copyright", "all rights reserved", "skip to ", "share", "cite", "export", "related articles", "metrics", "download pdf", "view pdf", "full text", "sign in")
_FRAME_SIGNS = frozenset("[(|-–—:")


def _title_bare(text: str) -> str:
    return text if _FRAME_SIGNS.isdisjoint(text) else _TITLE_FRAME.sub("", text)


def _abstract_bare(text: str) -> str:
    text = _TEXT_HEAD.sub("", text.rstrip())
    cut = max(0, len(text) - _TAIL_SIZE)
    tail = text[cut:]
    low = tail.lower()
    return text[:cut] + _TEXT_TAIL.sub("", tail) if any(s in low for s in _TAIL_SIGNS) else text


def core(text: str, bare_of: Callable[[str], str]) -> tuple[str, bool]:
    """(text with repairable damage undone, in one case; whether it had none)."""
    original = text
    text, damaged = examine(text)
    fine = not damaged and LOST not in text
    if _REFERENCE.search(text):
        text, fine = html.unescape(text), False
    if _TAG.search(text):
        text, fine = _TAG.sub(" ", text), False
    if "_" in text and " " not in text.strip():
        text, fine = text.replace("_", " "), False
    for _ in range(3):
        bare = bare_of(text)
        if bare == text or bare == text.rstrip():
            break
        text, fine = bare, False
    text = " ".join(text.split())
    half = doubled(text)
    if half is not None:
        text, fine = half, False
    if _DOTS.search(text):
        text, fine = _DOTS.sub("", text).rstrip(), False
    low, up = text.lower(), text.upper()
    if low != up and (text == low or text == up and sum(map(str.isalpha, text)) > 3):
        fine = False
    return text.casefold(), fine and original.strip() == original


class WordModel:
    """Frequent words and the probability of letter sequences in titles."""

    def __init__(self, words: dict[str, int], sequences: np.ndarray):
        self.words = words
        self.log = np.log((sequences + 0.05) / (sequences.sum() + 0.05 * len(sequences)))
        self.by_size: dict[tuple[int, str], list[str]] = {}
        for w, n in words.items():
            if n >= FREQUENT_GROUPS:
                for k in {w[:2], w[-2:]}:
                    self.by_size.setdefault((len(w), k), []).append(w)
        self.cache: dict[str, bool] = {}

    def mistyped(self, word: str) -> bool:
        """Whether a word that no other work has is a frequent one with a typing error; not for names."""
        if self.words.get(word, 0) > 1:
            return False
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            most = 1 if len(word) < 7 else 2
            near = {w for d in range(-most, most + 1) for k in (word[:2], word[-2:]) for w in self.by_size.get((len(word) + d, k), ())}
            known = self.cache[word] = any(edits(word, w, most) <= most for w in near)
        return known

    def probability(self, text: str) -> float:
        at = grams(plain(text))
        return float(self.log[at].mean()) if len(at) else -20.0


_FEATURES = "grp bigint, rec_no bigint, field_name string, value binary, core binary, fine boolean, key string, words array<string>"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.bool_(), pa.string(), pa.list_(pa.string())]


def _texts(rows: DataFrame) -> DataFrame:
    """A row for each usable title and abstract: digests of value and core, whether it is fine, the core, and a title's words that may be mistyped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for g, rec, title, abstract in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bare = ""
                if title and not _EMPTY.match(title):
                    bare, fine = core(title, _title_bare)
                    words = [w.casefold() for k, w in enumerate(_WORD.findall(title)) if k == 0 or w.islower()]
                    key = f"{g}\x01t\x01{bare}"
                    out.append((g, rec, "canonical_title", digest(title), digest(key), fine, key, words))
                if abstract and not _EMPTY.match(abstract):
                    text, fine = core(abstract, _abstract_bare)
                    if text != bare:
                        key = f"{g}\x01a\x01{text}"
                        out.append((g, rec, "canonical_abstract", digest(abstract), digest(key), fine and _ENDED.search(text) is not None, key, None))
            columns = list(zip(*out, strict=True)) if out else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True)], names=_FEATURES.replace("array<string>", "").split()[::2])

    return rows.select(rows["dup_group"].cast("bigint"), rows["rec_no"].cast("bigint"), "canonical_title", "canonical_abstract").mapInArrow(run, _FEATURES)


def _bare(key: str) -> str:
    return key.split("\x01", 2)[2]


def learn_words(texts: DataFrame) -> tuple[dict[str, int] | None, np.ndarray, DataFrame]:
    """In how many works each title word of several works stands, None if they are too many to be held; counts of letter sequences; the words as a table. All of it over the titles of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            groups, words = [], []
            for g, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bare = _bare(key)
                np.add.at(sequences, grams(plain(bare)), 1)
                for w in set(_WORD.findall(bare)):
                    groups.append(g)
                    words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(words, pa.string()), pa.array([0] * len(words), pa.int64())], names=["grp", "word", "n"])
        at = np.flatnonzero(sequences)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([None] * len(at), pa.string()), pa.array(sequences[at])], names=["grp", "word", "n"])

    counted = texts.where("field_name = 'canonical_title'").select("grp", "key").mapInArrow(count, "grp bigint, word string, n bigint")
    sums = counted.groupBy("grp", "word").agg(F.sum("n").alias("n"))
    several = sums.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = several.orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS + 1).coalesce(1).collect()
    table = sums.where("word is null").select("grp", "n").toPandas()
    sequences = np.zeros(1 << BITS, np.int64)
    sequences[table["grp"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return {r.word: r.n for r in words} if len(words) <= FREQUENT_WORDS else None, sequences, several


def _mistyped_titles(texts: DataFrame, several: DataFrame) -> DataFrame:
    """(field_name, value, mistyped) of the fine titles with a mistyped word, as `WordModel.mistyped`, for any number of words."""
    known = staged_table(several)
    titles = texts.where("field_name = 'canonical_title' and fine").select("value", F.explode("words").alias("word")).distinct()
    ends = lambda w: F.explode(F.array_distinct(F.array(F.substring(w, 1, 2), F.substring(w, -2, 2)))).alias("end")
    size, most = F.length("word"), F.when(F.length("word") < 7, 1).otherwise(2)
    rare = titles.select("word").distinct().join(known.select("word").hint("merge"), "word", "left_anti").select("word", most.alias("most"), ends("word"))
    asked = rare.select("word", "most", "end", F.explode(F.sequence(size - F.col("most"), size + F.col("most"))).alias("size"))
    filed = known.where(F.col("n") >= FREQUENT_GROUPS).select(F.col("word").alias("frequent"), size.alias("size"), ends("word"))
    # a transposition is one error, but two for Spark
    near = F.when(F.col("most") == 1, F.levenshtein("word", "frequent", 2)).otherwise(F.levenshtein("word", "frequent", 4)) >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list({w for w, f, m in pairs if edits(w, f, m) <= m}), pa.string())], names=["word"])

    wrong = asked.join(filed.hint("merge"), ["size", "end"]).where(near).select("word", "frequent", "most").mapInArrow(run, "word string").distinct()
    return titles.join(wrong.hint("merge"), "word").select(F.lit("canonical_title").alias("field_name"), "value", F.lit(True).alias("mistyped")).distinct()


def _judged(texts: DataFrame, shared) -> DataFrame:
    """`texts` with `sure`, how probable the core is, and without fine titles that have a mistyped word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held("words", shared.value, lambda v: WordModel(*v))
        for batch in batches:
            seen: dict[bytes, float] = {}
            sure, fine = [], []
            for at, good, key, words in zip(*(batch.column(c).to_pylist() for c in ("core", "fine", "key", "words")), strict=True):
                if at not in seen:
                    seen[at] = model.probability(_bare(key))
                sure.append(seen[at])
                fine.append(good and not any(map(model.mistyped, words or ())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "rec_no", "field_name", "value", "core")), pa.array(fine, pa.bool_()), pa.array(sure, pa.float64())], names=["grp", "rec_no", "field_name", "value", "core", "fine", "sure"])

    return texts.mapInArrow(run, "grp bigint, rec_no bigint, field_name string, value binary, core binary, fine boolean, sure double")


def best_texts(rows: DataFrame) -> DataFrame:
    """(dup_group, field_name, rec_no) of the surviving titles and abstracts."""
    texts = staged_table(_texts(rows))
    words, sequences, several = learn_words(texts)
    shared = rows.sparkSession.sparkContext.broadcast((words or {}, sequences))
    values = _judged(texts, shared).groupBy("grp", "field_name", "core", "value").agg(F.count(F.lit(1)).alias("n"), F.min("rec_no").alias("rec_no"), F.max("fine").alias("fine"), F.max("sure").alias("sure"))
    if words is None:
        values = values.join(_mistyped_titles(texts, several).hint("merge"), ["field_name", "value"], "left").withColumn("fine", F.col("fine") & F.col("mistyped").isNull())
    cores = values.groupBy("grp", "field_name", "core").agg(
        F.sum("n").alias("votes"), F.max("sure").alias("sure"), F.max(F.when(F.col("fine"), F.struct("n", (-F.col("rec_no")).alias("neg")))).alias("best")
    )
    shorter = longer_copies(texts.select(F.col("key").alias("text"), F.lit(True).alias("cand")), _as_it_is).select(F.col("digest").alias("core")).distinct()
    whole = cores.join(shorter, "core", "left_anti")
    top = whole.groupBy("grp", "field_name").agg(F.max(F.struct("votes", F.col("best").isNotNull().alias("held"), "sure", "core", "best")).alias("top"))
    return top.where("top.best is not null").select(F.col("grp").alias("dup_group"), "field_name", (-F.col("top.best.neg")).alias("rec_no"))


def _as_it_is(text: str) -> str:
    return text


# Words in an address that tell it from the file of the whole article.
_PART = r"(?i)suppl|preview|first-?page|cover|/fig|figure|thumb|graphical|appendi|checkout|price|cart|login|signin|sso|abstract|handle|landing|poster|slides|errat|sample|toc|javascript:|doi\."
_FILE = r"(?i)^https?://[^/\s]+\.[a-z]{2,}/(?:[^\s]*\.pdf(?:[?#][^\s]*)?|[^\s]*/pdf/?(?:[?#][^\s]*)?|[^\s]*[?&](?:format|type)=pdf(?:[&#][^\s]*)?)$"


def believable_time(time: Column, newest: Column) -> Column:
    """`time`, null where it lies after what the table can know."""
    return F.when((time <= newest) & (time >= F.lit("1990-01-01").cast("timestamp")), time)


def newest_time(rows: DataFrame, time: str) -> Column:
    """A time after which clock values are wrong: the 95th percentile and as much again of the span before it."""
    span = rows.select(F.percentile_approx(F.unix_timestamp(time), [0.05, 0.95], 1000).alias("p")).collect()[0].p
    if not span:
        return F.lit(None).cast("timestamp")
    return F.timestamp_seconds(F.lit(2 * span[1] - span[0]))


class Precedence:
    """In how many groups one state of a field was seen wholly before another."""

    def __init__(self, seen: dict[tuple[str, str], int]):
        self.seen = seen

    def before(self, a: str, b: str) -> int:
        return self.seen.get((a, b), 0)

    def learned(self, a: str, b: str) -> bool:
        """Whether the times show that `a` comes before `b`."""
        x, y = self.before(a, b), self.before(b, a)
        return x >= CLEARLY * y and x - y > SURE * (x + y) ** 0.5

    def order(self, states: list[str], given: tuple[str, ...] = ()) -> list[str]:
        """The states, earliest first, by how many others come before and after them; `given` orders those between which nothing was learned."""

        def edge(a: str, b: str) -> bool:
            if self.learned(a, b) or self.learned(b, a):
                return self.learned(a, b)
            return a in given and b in given and given.index(a) < given.index(b)

        rank = {s: sum(edge(t, s) - edge(s, t) for t in states if t != s) for s in states}
        return sorted(states, key=lambda s: (rank[s], given.index(s) if s in given else -1, s))


def learn_precedence(rows: DataFrame, group: str, state: str, at: str) -> Precedence:
    """How often each state comes before each other one, over the groups of all rows that have times for both.

    `state` must have a bounded number of values: of each group a row for each
    of them is gathered, and of the table a row for each two.
    """
    spans = rows.where(F.col(at).isNotNull() & F.col(state).isNotNull()).groupBy(group, state).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    gathered = spans.groupBy(group).agg(F.collect_list(F.struct(F.col(state).cast("string").alias("s"), "first", "last")).alias("l")).where(F.size("l") > 1)
    pairs = gathered.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a.last < b.first")
    return Precedence({(r.a, r.b): r.n for r in pairs.groupBy(F.col("a.s").alias("a"), F.col("b.s").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()})


def learn_version_order(rows: DataFrame, newest: Column) -> list[str]:
    """Version labels, earliest first; labels of less than `LABEL_SHARE` of the labelled rows are no states."""
    counts = rows.where("pdf_version is not null").groupBy("pdf_version").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    labels = [r.pdf_version for r in counts.where(F.col("n") >= LABEL_SHARE * total).collect()]
    if len(labels) < 2:
        return labels
    timed = rows.where(F.col("pdf_version").isin(labels)).select("dup_group", "pdf_version", F.unix_timestamp(believable_time(F.col("updated_at"), newest)).alias("at"))
    return learn_precedence(timed, "dup_group", "pdf_version", "at").order(labels, VERSIONS)


def best_links(rows: DataFrame, newest: Column) -> DataFrame:
    """(dup_group, field_name, rec_no) of the addresses of the published file.

    A label on a row may be missing or wrong, so an address is published if the
    last version in the learned order prevails among the labels of addresses of
    its shape (digits as one sign).
    """
    order = learn_version_order(rows, newest)
    last = order[-1] if order else ""
    shape = F.regexp_replace(F.regexp_replace("pdf_url", r"[0-9]+", "#"), r"[?&#]page=#", "")
    files = rows.where(F.col("pdf_url").rlike(_FILE) & ~F.col("pdf_url").rlike(_PART)).select("dup_group", "rec_no", "pdf_url", "pdf_version", believable_time(F.col("updated_at"), newest).alias("at"), shape.alias("shape"))
    shapes = files.groupBy("shape").agg(F.count("pdf_version").alias("labelled"), F.count(F.when(F.col("pdf_version") == last, 1)).alias("published"))
    good = shapes.where("labelled = 0 or published >= 0.5 * labelled").select("shape")
    urls = files.join(good, "shape").groupBy("dup_group", "pdf_url").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), F.min("rec_no").alias("rec_no"))
    top = urls.groupBy("dup_group").agg(F.max(F.struct("n", "at", (-F.col("rec_no")).alias("neg"))).alias("top"))
    return top.select("dup_group", F.lit("pdf_url").alias("field_name"), (-F.col("top.neg")).alias("rec_no"))


def magnitude(count: Column) -> Column:
    """The power of two below a count, 0 for none."""
    return F.when(count == 0, 0).otherwise(F.floor(F.log2(count.cast("double"))) + 1).cast("int")


class Movement:
    """What the times of the table show of counts: their direction, the magnitudes that are no counts, and how well each one fits."""

    def __init__(self, seen: Precedence, rows: dict[int, int]):
        present = sorted(rows)
        up = sum(n for (a, b), n in seen.seen.items() if int(a) < int(b))
        down = sum(n for (a, b), n in seen.seen.items() if int(a) > int(b))
        self.sign = 1 if up >= down else -1
        with_, against = (lambda a, b: seen.before(str(a), str(b))), (lambda a, b: seen.before(str(b), str(a)))
        if self.sign < 0:
            with_, against = against, with_
        self.misfit: dict[int, float] = {}
        fine: set[int] = set()
        odd: set[int] = set()
        for k in present:
            falls, moves = (sum(f(j, k) for j in present if 0 < j < k) for f in (against, with_))
            others = sum(against(min(j, k), max(j, k)) for j in present if j != k)
            total = others + sum(with_(min(j, k), max(j, k)) for j in present if j != k)
            self.misfit[k] = (others + 1) / (total + 8)  # few comparisons tell little
            n = falls + moves
            if n and falls > FALLS * n + (FALLS * n) ** 0.5:
                odd.add(k)
            elif n or k == 0:
                fine.add(k)
        if not fine - {0} and present:
            fine.add(max((k for k in present if k not in odd), key=lambda k: (rows[k], -k), default=0))
        reached = max(fine, default=0)
        for k in present:
            if k > reached and k not in odd and k - reached <= GAP:
                reached = k
        self.believable = {k for k in present if k not in odd and k <= reached}

    def latest(self, cells: list[tuple[int, int, float | None, float | None]]) -> int | None:
        """The topologically latest of a work's magnitudes, given as (magnitude, rows, first and last time).

        Where the times of two magnitudes contradict the direction, one of them
        is wrong: one that fits badly in the whole table, then the one that more
        rows contradict, then the one that fits less, then the one further on.
        """
        left = [c for c in cells if c[0] in self.believable]
        while len(left) > 1:
            against = {}
            for k, _, first, last in left:
                against[k] = 0
                for j, n, f, l in left:
                    if j != k and None not in (first, f):
                        sooner = last < f if (j - k) * self.sign < 0 else first > l
                        against[k] += n * sooner
            contradicted = [c for c in left if against[c[0]]]
            if not contradicted:
                break
            worst = max(contradicted, key=lambda c: (self.misfit[c[0]] > FALLS, against[c[0]] - c[1], self.misfit[c[0]], c[0] * self.sign))
            left.remove(worst)
        return max(left, key=lambda c: c[0] * self.sign)[0] if left else None


def best_counts(rows: DataFrame, newest: Column) -> DataFrame:
    """(dup_group, field_name, rec_no) of the latest believable citation counts.

    Negative counts are none. Which magnitudes are counts at all, and which way
    counts move, is learned (`Movement`); of the latest magnitude of a work the
    count furthest on survives, whatever the rows' own clocks say.
    """
    kept = rows.where("citation_count >= 0").select("dup_group", "rec_no", F.col("citation_count").alias("c"), magnitude(F.col("citation_count")).alias("k"), F.unix_timestamp(believable_time(F.col("updated_at"), newest)).alias("at"))
    of_rows = {r.k: r.n for r in kept.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    movement = Movement(learn_precedence(kept, "dup_group", "k", "at"), of_rows)
    cells = kept.groupBy("dup_group", "k").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.max(F.struct((F.col("c") * movement.sign).alias("c"), (-F.col("rec_no")).alias("neg"))).alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, cells_ in enumerate(batch.column(1).to_pylist()):
                k = movement.latest([(c["k"], c["n"], c["first"], c["last"]) for c in cells_])
                if k is not None:
                    at.append(i)
                    found.append(next(c["rec_no"] for c in cells_ if c["k"] == k))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], names=["dup_group", "rec_no"])

    # a row for each magnitude of a work, 64 at most
    works = cells.groupBy(F.col("dup_group").cast("bigint").alias("dup_group")).agg(F.collect_list(F.struct("k", "n", "first", "last", (-F.col("best.neg")).cast("bigint").alias("rec_no"))).alias("cells"))
    found = works.mapInArrow(run, "dup_group bigint, rec_no bigint")
    return found.select("dup_group", F.lit("citation_count").alias("field_name"), "rec_no")


def find_survivors(rows: DataFrame) -> DataFrame:
    """(dup_group, field_name, rec_no): the row whose value survives, for each group of two rows or more and each field.

    Equal values are held by the smallest rec_no. Fields for which no row has a
    usable value give no row, nor do null groups; an empty table gives an empty
    table. Repeated rows count as votes. Ties of texts go to the more probable
    text. Columns other than the enriched record's aren't read.
    """
    rows = rows.select("dup_group", "rec_no", "canonical_title", "canonical_abstract", "pdf_url", "pdf_version", "citation_count", F.col("updated_at").cast("timestamp").alias("updated_at")).where("dup_group is not null")
    newest = newest_time(rows, "updated_at")
    several = rows.groupBy("dup_group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dup_group")
    found = best_texts(rows).unionByName(best_links(rows, newest)).unionByName(best_counts(rows, newest))
    return found.join(several, "dup_group", "left_semi").select("dup_group", "field_name", "rec_no")


def surviving_records(rows: DataFrame) -> DataFrame:
    """One built record for each group: the surviving value of each field, null where none is usable."""
    found = find_survivors(rows)
    values = found.join(rows.select("rec_no", "canonical_title", "canonical_abstract", "pdf_url", "citation_count"), "rec_no")
    pick = lambda f: F.max(F.when(F.col("field_name") == f, F.col(f))).alias(f)
    return values.groupBy("dup_group").agg(*(pick(f) for f in ("canonical_title", "canonical_abstract", "pdf_url", "citation_count")))
