"""Finding text that was decoded wrongly, and restoring it.

Method: noisy-channel decoding. The wrong readings that a damaged text can come
from are the paths of a byte lattice: one channel for each table through which
the bytes may have been read (`channels`), and wildcards for bytes that were
lost (`lattice`). Viterbi search over the lattice picks the most probable
original under the words of the corpus, and under its letter pairs for words it
doesn't have. A reading through a table stands only if it makes the text more
probable than it was as it stood; lost bytes are damage whatever they were.

The lexicon is counted over all rows, from fields without damage that is plain
to see. Only the `LEXICON_WORDS` most frequent words go to the workers: a bound
on a model's size, which no row depends on to be examined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.channels import LOST, channels, confusions, cyrillic
from quirelake.llm.held import held
from quirelake.llm.lattice import CONTEXT, Lexicon, most_probable

#: The most words of the corpus, and places of special characters, that the lexicon holds.
LEXICON_WORDS = 120_000
#: Natural logarithm of how much likelier another script's reading must be.
MARGIN = 6.0
#: Mean logarithm of the probability of a letter from which a text of another script is natural as it stands.
NATURAL = -1.8
#: Distinct words a task counts before it hands them on.
WORDS_AT_ONCE = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[À-ÿ¸¨]{4,}")
_BEYOND = re.compile(r"[^\x00-\x7f]{2,}")
_FOREIGN_RUN = re.compile(r"[^\x00-\x7f]+")
_STRANGE = re.compile(r"[^\x00-\x7f\s]\S?[^\x00-\x7f\s]\S?[^\x00-\x7f\s]")
_CONTROL = re.compile("[\u0080-\u009f]")
_SPECIAL_BETWEEN = re.compile(r"(?=([^\x00].[^\x00]))(?=.[^\x00-\x7f])", re.S)
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(rf"\S*{LOST}\S*")
_LOST_ALONE = re.compile(rf"(?<!{LOST})(?<![À-ÿ]){LOST}(?!{LOST})")
# "à" whose second byte, a no-break space, became a plain one
_BARE_LEAD = re.compile(r"(\w*)Ã ([^\W\d_]*)")


@lru_cache(maxsize=200_000)
def _may_be_utf8(run: str) -> bool:
    """Whether some table makes a common character of part of a run of characters beyond ASCII."""
    return any(c.decoded(m.group()) is not None for c in channels() for m in c.pattern.finditer(run))


def unread_utf8(text: str) -> tuple[str, bool]:
    """`text` with UTF-8 that was read through other tables decoded, as often as that happened, and whether there was any."""
    if not any(_may_be_utf8(run) for run in set(_BEYOND.findall(text))):
        return text, False
    found = False
    while True:  # each round makes the text shorter
        best, most = None, 0
        for channel in channels():
            n = channel.sure(text)
            if n > most:
                best, most = channel, n
        if best is None:
            return text, found
        less = best.unread(text)
        if len(less) >= len(text):
            return text, found
        text, found = less, True


def _tidied(text: str, lexicon: Lexicon | None) -> str:
    """`text` with the "à" back whose no-break space is a plain one now; the words of the corpus tell whether a space follows."""

    def put(m: re.Match) -> str:
        before, after = m.groups()
        if not after:
            return before + "à"
        joined = lexicon is not None and lexicon.score(before + "à" + after) > lexicon.score(before + "à") + lexicon.score(after)
        return before + "à" + ("" if joined else " ") + after

    return _BARE_LEAD.sub(put, text)


def _confused(text: str, lexicon: Lexicon) -> tuple[str, bool]:
    """Text of another script that was read through the table of a third one."""
    if not _STRANGE.search(text):
        return text, False
    words = [w for w in set(text.split()) if not w.isascii() and 2 * sum(c > "\x7f" for c in w) > len(w) and _STRANGE.search(w)]
    if not words:
        return text, False
    plain = sum(lexicon.weigh(w) - 4.0 * _odd(w) for w in words)
    if plain > NATURAL * sum(map(len, words)):
        return text, False
    best, gain = None, MARGIN
    for _, _, table in confusions():
        readings = [w.translate(table) for w in words]
        letters = [c for r in readings for c in r if c > "\x7f"]
        if 4 * sum(map(cyrillic, letters)) < 3 * len(letters) or any(c.isalpha() and not cyrillic(c) for c in letters):
            continue
        # an unusual mix of capitals costs as much as a rare letter pair
        better = sum(lexicon.weigh(r) - 4.0 * _odd(r) for r in readings) - plain
        if better > gain:
            best, gain = table, better
    if best is None:
        return text, False
    return _FOREIGN_RUN.sub(lambda m: _translated(text, m, best), text), True


def _translated(text: str, run: re.Match, table: dict[int, str]) -> str:
    """A run of characters beyond ASCII read through `table`, if that gives the other script and no Latin letter touches it."""
    reading = run.group().translate(table)
    beside = text[max(0, run.start() - 1) : run.start()] + text[run.end() : run.end() + 1]
    fine = any(map(cyrillic, reading)) and all(cyrillic(c) or not c.isalpha() for c in reading) and not any(c.isascii() and c.isalpha() for c in beside)
    return reading if fine else run.group()


def _odd(word: str) -> bool:
    bare = "".join(c for c in word if c.isalpha())
    return len(bare) > 2 and not (bare.islower() or bare.isupper() or bare[1:].islower())


def _gain(before: str, after: str, lexicon: Lexicon) -> float:
    """How much more probable a text became, by the tokens that changed."""
    old, new = Counter(before.split()), Counter(after.split())
    return sum(n * lexicon.weigh(t) for t, n in (new - old).items()) - sum(n * lexicon.weigh(t) for t, n in (old - new).items())


def examine(text: str, lexicon: Lexicon | None = None) -> tuple[str, bool]:
    """(restored text, whether any of it was decoded wrongly).

    Without a lexicon only the damage that is plain from the characters is
    seen, and lost bytes stay as they are.
    """
    if text.isascii():
        return text, False
    lost = LOST in text
    damaged = lost or _CONTROL.search(text) is not None
    restored, unread = unread_utf8(text)
    if unread:
        restored = _tidied(restored, lexicon)
    if lexicon is None:
        return restored, damaged or unread
    if unread and not damaged and _gain(text, restored, lexicon) <= 0:
        restored, unread = text, False
    other, confused = _confused(text, lexicon)
    if confused and (not unread or _gain(restored, other, lexicon) > 0):
        restored = other
    if lost:
        # a text whose lost signs stand alone lost one for each character
        merged = not _LOST_ALONE.search(restored)
        restored = _TOKEN.sub(lambda m: most_probable(m.group(), lexicon, merged), restored)
    return restored, damaged or unread or confused


def repaired(text: str | None) -> str | None:
    """`text` with plainly wrong decodings undone; for operators that compare texts."""
    return text if text is None or text.isascii() else examine(text)[0]


def _texts(value) -> list[str]:
    return [t for t in value if t] if isinstance(value, list) else [value] if value else []


def learn_lexicon(rows: DataFrame, fields: tuple[str, ...], most: int = LEXICON_WORDS) -> dict[str, int]:
    """Counts of the words of the corpus, and of the places of special characters, over all rows."""
    taken = rows.select(*fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        places: Counter[str] = Counter()
        for batch in batches:
            for column in batch.columns:
                for value in column.to_pylist():
                    for text in _texts(value):
                        if text.isascii():
                            words.update(_WORD.findall(text))
                        elif LOST not in text and not _CONTROL.search(text) and not _RUN.search(text) and not unread_utf8(text)[1]:
                            words.update(_WORD.findall(text))
                            places.update(_SPECIAL_BETWEEN.findall(f" {text} "))
            if len(words) > WORDS_AT_ONCE:
                yield _counted(words, places)
                words, places = Counter(), Counter()
        yield _counted(words, places)

    counts = taken.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()}


def _counted(words: Counter[str], places: Counter[str]) -> pa.RecordBatch:
    seen = Counter({w: n for w, n in words.items() if not _odd(w)})
    for place, n in places.items():
        seen[CONTEXT + _DIGIT.sub("0", place)] += n
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def find_damage(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field_name, damaged, restored) of each field in which text was decoded wrongly.

    `fields` are string or array<string> columns; the elements of an array are
    given one a line. A row with several damaged fields gives several rows, and
    repeated rows count by themselves. Null and empty values are never damaged;
    an empty table gives an empty table. Texts of any length are examined
    whole. What can't be restored is given as far as it can be.
    """
    shared = rows.sparkSession.sparkContext.broadcast(learn_lexicon(rows, fields))
    kind = rows.schema[key].dataType.simpleString()
    taken = rows.select(rows[key].alias("__key"), *(rows[f].alias(f"__f{i}") for i, f in enumerate(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held("lexicon", shared.value, Lexicon)
        for batch in batches:
            at, names, before, after = [], [], [], []
            for name, column in zip(fields, batch.columns[1:], strict=True):
                for i, value in enumerate(column.to_pylist()):
                    texts = _texts(value)
                    if all(map(str.isascii, texts)):
                        continue
                    results = [examine(t, lexicon) for t in texts]
                    if any(bad for _, bad in results):
                        at.append(i)
                        names.append(name)
                        before.append("\n".join(texts))
                        after.append("\n".join(t for t, _ in results))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["key", "field_name", "damaged", "restored"])

    return taken.mapInArrow(run, f"key {kind}, field_name string, damaged string, restored string")
