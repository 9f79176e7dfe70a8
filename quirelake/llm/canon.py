"""Mapping freely typed values to a reference list.

Method: a multi-pattern automaton over the canonical names, their inverted
forms and their codes finds embedded mentions; the longest non-overlapping
match wins if nothing but edition, volume or date remains around it. Values
without such a mention go to token-set similarity: each token of an entry takes
its best partner in the value (equal, abbreviated, or mistyped), weighted by
how rare the token is in the list; tokens left over on either side count
against the entry. A token that is, or abbreviates, a word of the list is never
taken for a mistyped other word. The best entry must reach `floor` and lead by
`lead`. What is left, mostly words run together or torn apart, is aligned with
the letters of the entries that share most of its tokens, where a word may stop
early and function words may be absent (`MOST_EDITS`).

The reference list is small by nature. Its size is checked before it is read to
the driver (`MAX_ENTRIES`); a larger list is refused, not cut. The values are
classified where they are read: no shuffle, so a value that a third of all rows
share costs one look-up a row in a worker's cache.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.held import held

#: More entries than this are no reference list to broadcast.
MAX_ENTRIES = 200_000
#: Values remembered by a worker; beyond it the cache starts anew.
CACHED_VALUES = 300_000
FLOOR = 0.86
LEAD = 0.008
#: Likeness from which a token counts as a word of the list.
KNOWN = 0.95
#: Typing errors allowed when a whole value is aligned letter by letter.
MOST_EDITS = 2.3

# Words that carry no meaning of their own in a name.
FUNCTION_WORDS = {"of", "in", "on", "the", "and", "for", "at", "de", "la", "der", "und", "et"}
# What is written beside a name to tell edition, volume or medium.
EDITION_WORDS = {"vol", "volume", "no", "nr", "issue", "print", "online", "ed", "edition", "issn", "electronic", "suppl", "series", "pp", "p"}


def words_of(value: str, keep: bool = False) -> list[str]:
    """Lower-case words without accents, punctuation and, unless `keep`, function words."""
    flat = value.casefold()
    if not flat.isascii():
        flat = "".join(c for c in unicodedata.normalize("NFKD", flat) if not unicodedata.combining(c))
    return [w for w in re.findall(r"[^\W_]+", flat) if keep or w not in FUNCTION_WORDS]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions (restricted), `most` + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def likeness(token: str, word: str) -> float:
    """How well a typed token stands for a word of a name, 0 to 1."""
    if token == word:
        return 1.0
    n = len(token)
    if word.startswith(token):
        return 0.98 if n >= 3 else 0.95
    best = 0.0
    if n >= 4:
        most = 1 if n < 6 else 2 if n < 12 else 3
        d = edits(token, word, most)
        if d <= most:
            best = 1 - d / max(n, len(word))
        for size in (n - 1, n, n + 1):
            if 3 <= size < len(word) and best < 0.9:
                d = edits(token, word[:size], 1)
                if d <= 1:
                    best = max(best, 0.98 - d / (n + 2))
    elif n == 3 and len(word) > 3 and edits(token, word[:3], 1) <= 1:
        best = 0.6
    return best


def abbreviated_edits(letters: str, words: list[str], most: float) -> float:
    """Typing errors between `letters` and `words`, each of which may stop early.

    A word may be cut after three letters or more, or to its first letter at a
    quarter of an error; function words may be left out. Above `most` the value
    only says that it is larger.
    """
    n = len(letters)
    reached = [0.0] + [float(i) for i in range(1, n + 1)]
    for word in words:
        row = reached
        ends = list(row) if word in FUNCTION_WORDS else [most + 1] * (n + 1)
        older: list[float] | None = None
        for k, c in enumerate(word, 1):
            new = [row[0] + 1]
            for j in range(1, n + 1):
                d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (letters[j - 1] != c))
                if older is not None and j > 1 and letters[j - 1] == word[k - 2] and letters[j - 2] == c:
                    d = min(d, older[j - 2] + 1)
                new.append(d)
            older, row = row, new
            if k == len(word) or k >= 3 and word not in FUNCTION_WORDS:
                ends = [min(a, b) for a, b in zip(ends, row, strict=True)]
            elif k == 1 and word not in FUNCTION_WORDS:
                ends = [min(a, b + 0.25) for a, b in zip(ends, row, strict=True)]
        reached = ends
        if min(reached) > most:
            return most + 1
    return reached[n]


#: Letters and digits that are told apart when letters are counted; all others are one.
_LETTER_KINDS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}
_KINDS = len(_LETTER_KINDS) + 1


def _letters(word: str) -> int:
    """The letters of a word as bits."""
    mask = 0
    for c in word:
        mask |= 1 << _LETTER_KINDS.get(c, _KINDS - 1)
    return mask


def _letter_counts(text: str) -> np.ndarray:
    counts = np.zeros(_KINDS, np.int16)
    for c in text:
        counts[_LETTER_KINDS.get(c, _KINDS - 1)] += counts[_LETTER_KINDS.get(c, _KINDS - 1)] < 30_000
    return counts


class ReferenceMatcher:
    """Finds the entry of one reference list that a typed value means."""

    def __init__(self, entries: list[tuple[int, str, str | None]], floor: float = FLOOR, lead: float = LEAD):
        self.floor, self.lead = floor, lead
        self.ids = [i for i, _, _ in entries]
        self.words = [words_of(name) for _, name, _ in entries]
        self.spelled = [words_of(name, keep=True) for _, name, _ in entries]
        document = Counter(w for words in self.words for w in set(words))
        self.vocabulary = sorted(document)
        at = {w: i for i, w in enumerate(self.vocabulary)}
        self.weight = np.array([np.log(1 + len(entries) / document[w]) for w in self.vocabulary]) if entries else np.zeros(0)
        self.mean_weight = float(self.weight.mean()) if entries else 1.0
        self.columns = [[at[w] for w in words] for words in self.words]
        held = [(c, row) for row, columns in enumerate(self.columns) for c in columns]
        held.sort()
        self.holders = np.array([row for _, row in held], np.int64)
        self.starts = np.searchsorted(np.array([c for c, _ in held], np.int64), np.arange(len(self.vocabulary) + 1)) if held else np.zeros(len(self.vocabulary) + 1, np.int64)
        self.total = np.array([sum(self.weight[c] for c in columns) for columns in self.columns])
        self.letters = np.array([_letters(w) for w in self.vocabulary], np.int64)
        self.counts = np.array([_letter_counts("".join(words)) for words in self.spelled], np.int16).reshape(-1, _KINDS)
        self.token_cache: dict[str, dict[int, float]] = {}
        self.value_cache: dict[str, tuple[int, float]] = {}
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, set[int]] = {}
        for row, ((_, name, code), words) in enumerate(zip(entries, self.words, strict=True)):
            for alias in self._aliases(name, words, code):
                owners.setdefault(alias, set()).add(row)
        for alias, rows in owners.items():
            if alias.strip() and len(rows) == 1:
                self.automaton.add_word(alias, (len(alias), next(iter(rows))))
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def _aliases(name: str, words: list[str], code: str | None) -> list[str]:
        found = [words]
        cut = re.split(r"\s+(?:of|in|on|for)\s+", name.casefold(), maxsplit=1)
        if len(cut) == 2:
            found.append(words_of(cut[1]) + words_of(cut[0]))
        if code:
            found.append(words_of(code))
        return [f" {' '.join(x)} " for x in found if x]

    def _likenesses(self, token: str) -> dict[int, float]:
        """The words of the list that a token is like, and how much."""
        known = self.token_cache.get(token)
        if known is None:
            if len(self.token_cache) > CACHED_VALUES:
                self.token_cache.clear()
            # a letter that the word lacks costs an error at least, and no more than three are ever forgiven
            near = np.flatnonzero(np.bitwise_count(_letters(token) & ~self.letters) <= (3 if len(token) >= 12 else 2))
            known = {int(i): v for i in near if (v := likeness(token, self.vocabulary[i])) > 0}
            if len(token) > 2 and max(known.values(), default=0.0) >= KNOWN:
                known = {i: v for i, v in known.items() if v >= KNOWN}
            self.token_cache[token] = known
        return known

    def _most(self, token: str) -> float:
        return max(self._likenesses(token).values(), default=0.0)

    def _is_word(self, token: str) -> bool:
        return not token.isdigit() and token not in EDITION_WORDS and len(token) > 2 and self._most(token) >= 0.7

    def _mention(self, words: list[str]) -> int | None:
        """The entry mentioned by the longest match, if the rest says nothing else."""
        if not len(self.automaton):
            return None
        text = f" {' '.join(words)} "
        spans = sorted(((end - size + 1, end + 1, row) for end, (size, row) in self.automaton.iter(text)), key=lambda s: (s[0] - s[1], s[0]))
        taken: list[tuple[int, int, int]] = []
        for start, stop, row in spans:
            if all(stop <= a + 1 or start >= b - 1 for a, b, _ in taken):
                taken.append((start, stop, row))
        rows = {row for _, _, row in taken}
        if len(rows) != 1:
            return None
        rest = text
        for start, stop, _ in sorted(taken, reverse=True):
            rest = rest[:start] + " " + rest[stop:]
        return None if any(self._is_word(t) for t in rest.split()) else rows.pop()

    def _similar(self, words: list[str]) -> tuple[int | None, float]:
        tokens = [t for t in words if not t.isdigit() and t not in EDITION_WORDS]
        if not tokens or not self.ids or not len(self.vocabulary):
            return None, 0.0
        like = [self._likenesses(t) for t in tokens]
        found = self._scored(tokens, like)
        if found[0] >= self.floor:
            return (found[1], found[0]) if found[0] - found[2] >= self.lead else (None, found[0])
        return self._aligned(tokens, like)

    def _scored(self, tokens: list[str], like: list[dict[int, float]]) -> tuple[float, int, float]:
        """(best score, its row, next best score) of the entries that can reach the floor.

        No entry scores more than the weights of its words, each by the token
        most like it, over their sum; entries are scored in that order until
        what is left can neither win nor come near.
        """
        best_like: dict[int, float] = {}
        for known in like:
            for c, v in known.items():
                if v > best_like.get(c, 0.0):
                    best_like[c] = v
        if not best_like:
            return 0.0, -1, 0.0
        rows = np.concatenate([self.holders[self.starts[c] : self.starts[c + 1]] for c in best_like])
        gains = np.repeat([v * self.weight[c] for c, v in best_like.items()], [self.starts[c + 1] - self.starts[c] for c in best_like])
        some, where = np.unique(rows, return_inverse=True)
        upper = np.bincount(where, weights=gains) / self.total[some]
        best, at, second = 0.0, -1, 0.0
        for k in np.lexsort((some, -upper)):
            if upper[k] < max(self.floor, best) - self.lead:
                break
            score = self._score(tokens, like, int(some[k]))
            if score > best:
                best, at, second = score, int(some[k]), best
            else:
                second = max(second, score)
        return best, at, second

    def _aligned(self, tokens: list[str], like: list[dict[int, float]]) -> tuple[int | None, float]:
        """The entry whose letters the value has, but for a few typing errors."""
        letters = "".join(tokens)
        fixed = [known for t, known in zip(tokens, like, strict=True) if len(t) > 2 and max(known.values(), default=0.0) >= KNOWN]
        most = min(MOST_EDITS, 0.2 * len(letters))
        best: list[tuple[float, int]] = []
        # letters that an entry lacks cost an error each
        lacking = np.maximum(_letter_counts(letters) - self.counts, 0).sum(axis=1)
        for row in np.flatnonzero(lacking <= most):
            if all(any(known.get(c, 0.0) >= KNOWN for c in self.columns[row]) for known in fixed):
                cost = abbreviated_edits(letters, self.spelled[row], most)
                if cost <= most:
                    best.append((cost, int(row)))
        best.sort()
        if not best or len(best) > 1 and best[1][0] - best[0][0] < 0.7:
            return None, 0.0
        return best[0][1], 1 - best[0][0] / len(letters)

    def _score(self, tokens: list[str], like: list[dict[int, float]], row: int) -> float:
        pairs = sorted(((v, i, k) for i, known in enumerate(like) for k, c in enumerate(self.columns[row]) if (v := known.get(c, 0.0)) > 0), reverse=True)
        used, filled, got = set(), set(), 0.0
        for value, i, k in pairs:
            if i not in used and k not in filled:
                used.add(i)
                filled.add(k)
                got += value * self.weight[self.columns[row][k]]
        spare = sum(self.mean_weight * min(1.0, len(t) / 6) * (0.3 if len(t) <= 2 else 1.0) for i, t in enumerate(tokens) if i not in used)
        return float(got / (self.total[row] + spare))

    def find(self, value: str) -> tuple[int, float]:
        """(id, score) of the entry meant; id 0 if the list has none."""
        known = self.value_cache.get(value)
        if known is None:
            if len(self.value_cache) > CACHED_VALUES:
                self.value_cache.clear()
            words = words_of(value)
            row = self._mention(words)
            score = 1.0
            if row is None:
                row, score = self._similar(words)
            known = (0 if row is None else self.ids[row], float(score))
            self.value_cache[value] = known
        return known


def read_list(reference: DataFrame, key: str, name: str, code: str | None = None) -> list[tuple[int, str, str | None]]:
    """The entries of a reference list; refuses what is too large to be one."""
    columns = [reference[key], reference[name], reference[code] if code else F.lit(None).cast("string")]
    rows = reference.select(*columns).where(reference[name].isNotNull()).orderBy(key).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a reference list of more than {MAX_ENTRIES} entries can't be broadcast")
    return [(r[0], r[1], r[2]) for r in rows]


def map_values(rows: DataFrame, key: str, value: str, entries: list[tuple[int, str, str | None]], floor: float = FLOOR, lead: float = LEAD) -> DataFrame:
    """(key, value, ref_id, score) of each row whose value isn't null, blank or a canonical name as it stands.

    ref_id is 0 for values that no entry matches. Repeated rows are repeated;
    with an empty list every value is unmatched; an empty table gives an empty
    table. Ties between entries are unmatched. Values of any length are read
    whole. Columns other than the two named aren't read.
    """
    shared = rows.sparkSession.sparkContext.broadcast(entries)
    taken = rows.select(rows[key].alias("__key"), rows[value].alias("__value")).where(F.trim(F.regexp_replace("__value", r"\s+", " ")) != "")
    kind = taken.schema["__key"].dataType.simpleString()
    token = f"list/{key}/{value}/{floor}/{lead}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held(token, shared.value, lambda entries_: ReferenceMatcher(entries_, floor, lead))
        exact = {name for _, name, _ in shared.value}
        for batch in batches:
            keep, ids, scores = [], [], []
            values = batch.column(1).to_pylist()
            for i, text in enumerate(values):
                if text not in exact:
                    keep.append(i)
                    ref, score = matcher.find(text)
                    ids.append(ref)
                    scores.append(score)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(ids, pa.int32()), pa.array(scores, pa.float64())], names=["key", "value", "ref_id", "score"])

    return taken.mapInArrow(run, f"key {kind}, value string, ref_id int, score double")
