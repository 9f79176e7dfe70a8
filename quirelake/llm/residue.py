"""Template residue, filler, error messages and notices in place of content.

Method: character n-gram models. One model each is fitted for filler, error
messages and notices from the seed lines (`residue_seeds`), and one for natural
prose from all documents, each different line once but for short ones such as
headings: a page that a third of the documents repeat must not become probable
prose by that. The likelihood ratio of the best residue model to
prose, taken over the windows that lines and sentences form, localises residue.
A window counts as residue where it stands for itself: as a line or sentence
among no prose of the same paragraph. So prose that mentions or quotes such
text stays. Unfilled slots are localised by their delimiters and count wherever
a sentence doesn't talk about them. A document is excluded by the number of
characters that residue windows cover (`coverage`).

The models are tables of 2^18 buckets of hashed 4-grams, whatever the size of
the corpus; the prose counts are summed over all different lines before they
reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import residue_seeds
from quirelake.llm.held import held
from quirelake.operators.staging import staged_table

BITS = 18
#: Log likelihood ratio a character from which a line, and from which a sentence among others, is residue.
LINE_RATIO = 0.35
#: Lines under so many characters need a higher ratio, as titles and menus do too.
SHORT, SHORT_RATIO = 30, 1.2
#: Ratio of a line's first characters from which it is filler, if what follows is no prose.
OPENING, OPENING_RATIO = 24, 1.6
SENTENCE_RATIO = 0.9
#: A sentence is plain prose below this ratio, if its probability a character is not so far below the corpus's mean.
PROSE_RATIO = -0.4
STRANGE = 2.0
#: Ratio of a whole window, in nats, that residue needs.
WEIGHT = 14.0
_SMOOTH = 0.05
#: Grams that are looked up at once, and characters of the documents that are taken together.
BLOCK, TOGETHER = 1 << 19, 300_000

_DIGIT = re.compile(r"\d")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\sa-zа-я])")
_LETTER = re.compile(r"[^\W\d_]")

_NAME = r"[^\W\d]\w*(?:[. ]\w+){0,3}"
# The delimiters between which template languages and forms leave slots.
_SLOT = re.compile(
    rf"\{{\{{[-~]?\s*{_NAME}\s*[-~]?\}}\}}|\{{%[-+]?\s*{_NAME}\s*[-+]?%\}}|[$#]\{{\s*{_NAME}\s*\}}|<%[=-]?\s*{_NAME}\s*-?%>"
    rf"|\[\[\s*{_NAME}\s*\]\]|\[\s*(?i:insert|enter|add|type|your)\s[^\[\]\n]{{1,60}}\]|\[[^\[\]\n]{{1,60}}\s(?i:to be (?:added|completed|inserted|announced|determined)|goes here|here)\]"
    rf"|<[^<>\n]{{1,60}}\s(?i:goes here|here|to be added)>|%\({_NAME}\)[sd]|%%\s*{_NAME}\s*%%|@@\s*{_NAME}\s*@@|(?<!\w)__{_NAME}__(?!\w)"
    rf"|«[^\W\d]\w*(?:[_.]\w+)+»|&\w+_placeholder;|(?<![\w'\"{{])\{{\d\}}|\bX{{2,}}-(?:TBD|TBA|TBC|TODO)-X{{2,}}\b|\bX{{4,}}\b(?=[\s.,;:])"
)
# How all of them begin.
_MAY_BE_SLOT = re.compile(r"\{\{|\{%|[$#]\{|<%|\[\[|\[\s*[^\W\d]|<[^<>\n]+ |%\(|%%|@@|__|«|&\w+_|\{\d|XX")
_FIELD = re.compile(r"^\W*[^\W\d][\w ]{2,40}:\s*(?:TODO|TBC|TBD|TBA|FIXME|XXX+)\b", re.M)
_NAMED = re.compile(r"^«(?:title|abstract|authors?|year|journal|volume|license|doi|issue|keywords?|affiliation|publisher)»$", re.I)
_GUILLEMETS = re.compile(r"«[^«»\n]{2,40}»")
_MATHS = re.compile(r"\\[a-z]+\s*\{|\$[^$\n]{1,200}\$|\\\(|\\\[")
_BIBTEX = re.compile(r"\w\s*=\s*\{*$")


def grams(text: str) -> np.ndarray:
    """Buckets of the 4-grams of a text, one for each character."""
    codes = np.frombuffer(f"  {text} ".encode("utf-32-le", "replace"), np.uint32)
    if len(codes) < 4:
        return np.zeros(0, np.int64)
    return buckets(codes)


def buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of the 4-grams of code points."""
    codes = codes.astype(np.uint64)
    mixed = codes[:-3] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:-1] * np.uint64(0x165667B19E3779F9) ^ codes[3:] * np.uint64(0x27D4EB2F165667C5)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def grams_of(texts: list[str]) -> np.ndarray:
    """Buckets of the 4-grams of several texts, as `grams` of each gives them."""
    flat = " \x00  ".join(plain(t.replace("\x00", " ")) for t in texts)
    apart = np.frombuffer(f"  {flat} ".encode("utf-32-le", "replace"), np.uint32) == 0
    return grams(flat)[~(apart[:-3] | apart[1:-2] | apart[2:-1] | apart[3:])] if len(apart) > 3 else grams(flat)


def plain(text: str) -> str:
    """Lower case, even white space, digits as 0."""
    return " ".join(_DIGIT.sub("0", text.casefold()).split())


#: Bits by which lines that stand in several places are told.
LINE_BITS = 22
_ENDS = re.compile(r"[\r\n]+")
_COUNTED = re.compile("[1-9]")


def _line_hash(line: str) -> int:
    """As Spark's xxhash64 of a line."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), seed=42) & ((1 << LINE_BITS) - 1)


def _summed(counted: DataFrame) -> np.ndarray:
    total = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << BITS, np.int64)
    counts[total["bucket"].to_numpy(np.int64)] = total["n"].to_numpy(np.int64)
    return counts


def prose_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of the 4-grams of all documents, by bucket, each different line counted once, lines under `SHORT` characters each time.

    Hashes tell which lines stand in several places; as bits of a fixed number
    they go to the workers. What has such a bit is set aside and counted once,
    all other lines where they stand: so only repeated lines are shuffled.
    """
    lines = docs.select(F.explode(F.split(docs[text], r"[\r\n]+")).alias("line")).select(F.trim(F.translate("line", "123456789", "0" * 9)).alias("line"))
    hashes = lines.where(F.length("line") >= SHORT).select(F.xxhash64("line").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    often = np.zeros(1 << LINE_BITS, bool)
    for r in hashes.where("n > 1").select(F.col("h").bitwiseAND((1 << LINE_BITS) - 1).cast("int").alias("p")).distinct().collect():
        often[r.p] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(often))

    def counted(texts: list[str], seen: np.ndarray) -> None:
        for _, some in _together(texts):
            seen += np.bincount(grams_of(some), minlength=1 << BITS)

    def given(seen: np.ndarray, aside: list[str]) -> pa.RecordBatch:
        at = np.flatnonzero(seen)
        none = len(aside)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, np.zeros(none, np.int64)]).astype(np.int32)), pa.array(np.concatenate([seen[at], np.zeros(none, np.int64)])), pa.array([None] * len(at) + aside, pa.string())], names=["bucket", "n", "line"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = held("lines", shared.value, lambda v: np.unpackbits(v).astype(bool).tolist())
        for batch in batches:
            here, aside = [], set()
            for value in batch.column(0).to_pylist():
                for line in _ENDS.split(value):
                    even = _COUNTED.sub("0", line).strip(" ")
                    if len(even) >= SHORT and repeated[_line_hash(even)]:
                        aside.add(even)
                    elif even:
                        here.append(even)
            seen = np.zeros(1 << BITS, np.int64)
            counted(here, seen)
            yield given(seen, sorted(aside))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(1 << BITS, np.int64)
            counted(batch.column(0).to_pylist(), seen)
            yield given(seen, [])

    shape = "bucket int, n bigint, line string"
    both = staged_table(docs.select(docs[text]).mapInArrow(first, shape))
    once = both.where("line is not null").select("line").distinct()
    return _summed(both.where("line is null")) + _summed(once.mapInArrow(again, shape))


def seed_counts(lines: str) -> np.ndarray:
    counts = np.zeros(1 << BITS, np.int64)
    for line in lines.strip().splitlines():
        for part in re.split(r"(?<=[.!?])\s", line):
            np.add.at(counts, grams(plain(part)), 1)
    return counts


class ResidueModel:
    """Likelihood ratios of the residue models to prose."""

    def __init__(self, prose: np.ndarray):
        background = np.log((prose + _SMOOTH) / (prose.sum() + _SMOOTH * len(prose)))
        self.background = background.astype(np.float32)
        self.mean = float((prose * background).sum() / max(1, prose.sum()))
        seeds = [seed_counts(s) for s in (residue_seeds.FILLER, residue_seeds.ERRORS, residue_seeds.NOTICES)]
        seeds.append(sum(seeds))
        self.ratios = np.stack([np.log(0.7 * c / c.sum() + 0.3 * np.exp(background) + 1e-7) - background for c in seeds]).astype(np.float32)

        self.table = np.concatenate([self.ratios, self.background[None]])

    def sums(self, flat: str, bounds: np.ndarray) -> np.ndarray:
        """Sums of the ratios to each residue model, and of the logarithm of prose, over the grams that begin between neighbouring bounds."""
        codes = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32)
        out = np.zeros((len(self.table), len(bounds) - 1))
        for start in range(0, int(bounds[-1]), BLOCK):
            at = buckets(codes[start : min(start + BLOCK, int(bounds[-1])) + 3])
            first, last = np.searchsorted(bounds, start, "right") - 1, np.searchsorted(bounds, start + len(at), "left")
            out[:, first:last] += np.add.reduceat(self.table[:, at], np.maximum(bounds[first:last], start) - start, axis=1)
        return out

    def windows(self, texts: list[str]) -> list[list[tuple[int, str]]]:
        """(characters, kind) of each residue window of each text.

        The grams of all texts are looked up together; what a window has is a
        sum over a stretch of them. Lines without a stretch that reaches a
        threshold, nearly all, need no further look.
        """
        found = [[(len(s), "slot") for s in slots(t)] for t in texts]
        flat: list[str] = []
        bounds: list[int] = [0]
        lines: list[tuple[int, str, list[str], list[int]]] = []
        place = 0
        for i, text in enumerate(texts):
            for line in lines_of(text):
                bare = _MARKUP.sub(" ", line) if "<" in line else line
                if not _LETTER.search(bare):
                    continue
                parts = [p for p in _SENTENCE.split(bare) if p.strip()]
                bodies = [plain(p) for p in parts]
                at = []
                here = place
                for k, body in enumerate(bodies):
                    at.append(len(bounds) - 1)
                    if len(bodies) == 1 and len(body) > OPENING:
                        bounds.append(here + OPENING)
                    # the space between two sentences belongs to the first
                    here += len(body) + (k < len(bodies) - 1)
                    bounds.append(here)
                at.append(len(bounds) - 1)
                joined = " ".join(bodies)
                flat.append(f"  {joined} ")
                place += len(joined) + 3
                bounds.append(place)
                lines.append((i, line, parts, at))
        if not lines:
            return found
        edges = np.array(bounds, np.int64)
        sums, sizes = self.sums("".join(flat), edges), np.diff(edges)
        best = sums[:-1].max(axis=0) / sizes
        starts, ends = np.array([x[3][0] for x in lines]), np.array([x[3][-1] for x in lines])
        reach = np.concatenate([np.zeros((len(sums), 1)), np.cumsum(sums, axis=1)], axis=1)
        length = edges[ends] - edges[starts]
        mean = (reach[:-1, ends] - reach[:-1, starts]).max(axis=0) / length
        top = np.maximum.reduceat(np.append(best, 0.0), np.stack([starts, ends], axis=1).ravel())[::2]
        for k in np.flatnonzero((mean >= LINE_RATIO) | (top >= SENTENCE_RATIO)):
            i, line, parts, at = lines[k]
            found[i] += self._judged(line, parts, at, float(mean[k]), int(length[k]), sums, sizes)
        return found

    def _judged(self, line: str, parts: list[str], at: list[int], mean: float, size: int, sums: np.ndarray, sizes: np.ndarray) -> list[tuple[int, str]]:
        """(characters, kind) of the residue windows of a line, from the sums over its parts."""

        def of(a: int, b: int) -> tuple[float, int, bool]:
            """(mean ratio of the best residue model, characters, whether they are about as probable as prose is on average)."""
            n = int(sizes[a:b].sum())
            total = sums[:, a:b].sum(axis=1)
            return float(total[:-1].max()) / n, n, float(total[-1]) / n > self.mean - STRANGE

        if len(parts) == 1:
            least = SHORT_RATIO if size < SHORT else LINE_RATIO
            opens = mean < least and at[1] - at[0] == 2 and of(at[0], at[0] + 1)[0] >= OPENING_RATIO and not of(at[0] + 1, at[1])[2]
            return [(len(line), "line")] if (mean >= least and mean * size >= WEIGHT or opens) and not talks(parts[0]) else []
        scored = [(p, *of(a, b)) for p, a, b in zip(parts, at, at[1:], strict=False)]
        if any(m < PROSE_RATIO and n > 40 and natural for _, m, n, natural in scored):
            return []
        if mean >= LINE_RATIO and mean * size >= WEIGHT:
            return [(len(line), "line")]
        return [(len(p), "sentence") for p, m, n, _ in scored if m >= SENTENCE_RATIO and m * n >= WEIGHT and not talks(p)]


def lines_of(text: str) -> list[str]:
    """The lines of a text; words that stand one a line are taken together."""
    lines = [x for x in text.splitlines() if x.strip()]
    short = sum(len(x.split()) <= 2 for x in lines)
    return [" ".join(lines)] if len(lines) > 4 and short > 0.8 * len(lines) else lines


def talks(sentence: str) -> bool:
    """Whether a sentence talks about such text."""
    low = sentence.casefold()
    return any(cue in low for cue in residue_seeds.MENTIONS)


def slots(text: str) -> list[str]:
    """Unfilled slots, but for those that a sentence talks about, formulas and BibTeX values have."""
    found = [m.group() for m in _FIELD.finditer(text)]
    if not _MAY_BE_SLOT.search(text):
        return found
    for line in text.splitlines():
        if not _MAY_BE_SLOT.search(line):
            continue
        for part in _SENTENCE.split(line):
            hits = list(_SLOT.finditer(part))
            hits += [m for m in _GUILLEMETS.finditer(part) if _NAMED.match(m.group())]
            if not hits or talks(part) or _MATHS.search(part):
                continue
            for m in hits:
                if not (m.group().startswith("{") and _BIBTEX.search(part[: m.start()])):
                    found.append(m.group())
    return found


def find_residue(docs: DataFrame, key: str, text: str, least: float = 0.0) -> DataFrame:
    """(key, coverage, kinds) of each document in which residue stands for content.

    coverage is the share of the text's characters in residue windows, kinds
    names the windows found; documents with a coverage of `least` or more come
    out, by default all that have a window, since a single unfilled slot spoils
    a document. Null, empty and blank texts are never residue; repeated
    documents count by themselves; an empty table gives an empty one. Texts are
    read whole; other columns aren't read.
    """
    filled = docs.where(docs[text].rlike(r"\S")).select(docs[key].alias("key"), docs[text].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(prose_counts(filled, "text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held("residue", shared.value, ResidueModel)
        for batch in batches:
            at, cover, kinds = [], [], []
            texts = batch.column(1).to_pylist()
            for first, some in _together(texts):
                for i, windows in enumerate(model.windows(some), first):
                    share = min(1.0, sum(n for n, _ in windows) / len(texts[i]))
                    if windows and share >= least:
                        at.append(i)
                        cover.append(share)
                        kinds.append(",".join(sorted({k for _, k in windows})))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cover, pa.float64()), pa.array(kinds, pa.string())], names=["key", "coverage", "kinds"])

    return filled.mapInArrow(run, f"key {kind}, coverage double, kinds string")


def _together(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of stretches of about `TOGETHER` characters, or one text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def without_residue(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """`docs` without the documents in `found`; rows with a null key stay."""
    return docs.join(found.select(F.col("key").alias(key)), key, "left_anti")
