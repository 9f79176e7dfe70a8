"""Comparing two descriptions of works exactly, field by field."""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache

from quirelake.llm.canon import edits as _edits
from quirelake.llm.canon import words_of
from quirelake.llm.mojibake import repaired
from quirelake.llm.names import fold, formal_names, name_parts
from quirelake.llm.names import token_cost as _token_cost


# titles and names repeat the same words, so the same pairs are compared again and again
@lru_cache(maxsize=400_000)
def edits(a: str, b: str, most: int) -> int:
    """As `canon.edits`, of what is left of two words without the beginning and the end that they share."""
    short, long = min(len(a), len(b)), max(len(a), len(b))
    if long - short > most:
        return most + 1
    start = end = 0
    while start < short and a[start] == b[start]:
        start += 1
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    if short - start - end == 0:
        return long - short
    return _edits(a[start : len(a) - end], b[start : len(b) - end], most)


token_cost = lru_cache(maxsize=400_000)(_token_cost)

_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"(?:…|\.{2,})\W*$")
# Words by which a title names another work than the one it quotes.
OTHERWISE = {"reply", "replies", "response", "comment", "comments", "commentary", "follow", "followup", "erratum", "corrigendum", "correction", "corrections", "retraction", "rejoinder", "addendum", "review", "discussion", "letter", "sequel", "revisited", "supplement", "part", "réponse", "respuesta", "antwort", "resposta", "ответ", "комментарий", "note"}
_BREAK = re.compile(r"[:;?!(\[–—]|\s-\s|\. ")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,40}>")
# A short note in brackets behind a title.
_NOTE = re.compile(r"(?<=\S)\s*\[[^\[\]]{1,24}\]\s*$")
_NUMERAL = re.compile(r"^(?:\d+|[ivx]{1,4})$")


def _plain(text: str) -> str:
    """A title, its damage undone, without marks and notes, folded."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = fold(text)
    return _NOTE.sub("", text) if text.endswith("]") else text


def words_of_title(title: str | None) -> list[str]:
    return _WORD.findall(_plain(repaired(title) or ""))


def title_words(title: str | None) -> tuple[list[str], bool, frozenset[int]]:
    """(folded words, whether the title shows that it was cut, the numbers of words before a break)."""
    text = repaired(title) or ""
    cut = ("…" in text or ".." in text) and _CUT.search(text) is not None
    text = _plain(text)
    if not _BREAK.search(text):
        return _WORD.findall(text), cut, frozenset()
    words, breaks = [], set()
    end = 0
    for m in _WORD.finditer(text):
        gap = text[end : m.start()]
        if gap != " " and words and _BREAK.search(gap):
            breaks.add(len(words))
        words.append(m.group())
        end = m.end()
    return words, cut, frozenset(breaks)


def surnames(authors: list[str] | None) -> list[tuple[list[str], list[str]]]:
    """(full tokens, initials) of each person or group named."""
    found = []
    for a in authors or []:
        if a and fold(a).strip(" .") not in ("et al", "others", "and others", "u.a", "et coll"):
            full, initials, _, _ = name_parts(a)
            if full:
                found.append((full, initials))
    return found


@lru_cache(maxsize=400_000)
def _letters(token: str) -> int:
    """A token's set of letters as bits; letters that share one only make two sets look nearer."""
    found = 0
    for c in token:
        found |= 1 << (ord(c) & 63)
    return found


def _near(x: str, y: str) -> bool:
    """Whether a whole name part can be the other one mistyped; each typing error changes two letters of the set at most."""
    if abs(len(x) - len(y)) > 2:
        return False
    most = 2 if min(len(x), len(y)) >= 6 else 1
    formal = formal_names()
    return x in formal.get(y, ()) or y in formal.get(x, ()) or (_letters(x) ^ _letters(y)).bit_count() <= 2 * most and token_cost(x, y) <= most


def _begins(token: str, initial: str) -> bool:
    """Whether an initial can stand for a given name, or for one that it is short for."""
    return token[0] == initial or any(f[0] == initial for f in formal_names().get(token, ()))


def same_person(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]]) -> bool:
    """Whether two names can be one person's: a whole token agrees, and no other contradicts it."""
    (fa, ia), (fb, ib) = a, b
    pairs = [(x, x) for x in fa if x in fb] or [(x, y) for x in fa for y in fb if _near(x, y)]
    if not pairs:
        return False
    x, y = max(pairs, key=lambda p: (p[0] == p[1], len(p[0])))
    ra, rb = [t for t in fa if t != x], [t for t in fb if t != y]
    if ra and rb:
        return any(token_cost(s, t) <= (2.0 if x == y else 1.0) for s in ra for t in rb)
    if ra and ib:
        return any(_begins(t, ib[0]) for t in ra)
    if rb and ia:
        return any(_begins(t, ia[0]) for t in rb)
    return True


def author_agreement(a: list, b: list) -> float | None:
    """Share of the shorter list's persons found in the longer one; None where a list is empty."""
    if not a or not b:
        return None
    if len(a) > len(b):
        a, b = b, a
    by_token: dict[str, list] = {}
    for y in b:
        for t in y[0]:
            by_token.setdefault(t, []).append(y)
    return sum(any(same_person(x, y) for t in x[0] for y in by_token.get(t, ())) or any(same_person(x, y) for y in b) for x in a) / len(a)


def _mistyped(x: str, y: str, most: int) -> bool:
    """Whether two words of titles are so many typing errors apart; each changes two letters of the set at most."""
    return abs(len(x) - len(y)) <= most and (_letters(x) ^ _letters(y)).bit_count() <= 2 * most and not _NUMERAL.match(y) and edits(x, y, most) <= most


def _equal_words(wa: list[str], wb: list[str]) -> tuple[list[int], list[int], int, int]:
    """(words of either title without an equal one in the other, the last words of either that have one)."""
    if len(wa) == len(wb):
        # nearly all candidates differ in a word or two of the same place
        other = [i for i, (x, y) in enumerate(zip(wa, wb, strict=True)) if x != y]
        if len(other) <= 3 and not any(wa[i] in wb or wb[i] in wa for i in other):
            last = next((i for i in range(len(wa) - 1, -1, -1) if i not in other), -1)
            return other, other.copy(), last, last
    places: dict[str, list[int]] = {}
    for j in range(len(wb) - 1, -1, -1):
        places.setdefault(wb[j], []).append(j)
    missed, taken = [], set()
    reach_a = reach_b = -1
    for i, w in enumerate(wa):
        at = places.get(w)
        if at:
            j = at.pop()
            taken.add(j)
            reach_a, reach_b = i, max(reach_b, j)
        else:
            missed.append(i)
    return missed, [j for j in range(len(wb)) if j not in taken], reach_a, reach_b


def title_agreement(mine: tuple, other: tuple) -> tuple[float, bool, int, bool]:
    """(agreement 0 to 1, whether one title is the beginning of the other, words that only `mine` has, whether a word that one of them lacks tells of another work).

    Words agree when equal or mistyped; numerals and short words only when
    equal. A title may lack what follows a break of the other, or anything
    after the place where it shows that it was cut; everything else that one
    of them lacks counts.
    """
    (wa, ca, ba), (wb, cb, bb) = mine, other
    if not wa or not wb:
        return 0.0, False, 0, False
    if wa == wb:
        return 1.0, False, 0, False
    missed, free, reach_a, reach_b = _equal_words(wa, wb)
    lost, own = 0.0, 0
    spare: list[int] = []
    for i in missed:
        w = wa[i]
        at = None
        if not _NUMERAL.match(w) and len(w) > 2:
            most = 1 if len(w) < 5 else 2 if len(w) < 8 else 3
            at = next((j for j in free if _mistyped(w, wb[j], most)), None)
        if at is None and ca and i == len(wa) - 1 and not _NUMERAL.match(w):
            at = next((j for j in free if wb[j].startswith(w)), None)
        if at is None:
            spare.append(i)
            continue
        free.remove(at)
        reach_a, reach_b = max(reach_a, i), max(reach_b, at)
        lost += 0.06 * len(w)
    # letters of words torn in two, or run together, against each other
    for i in list(spare):
        w = wa[i]
        joined = next((j for j in free if min(len(w), len(wb[j])) > 2 and (wb[j] in w or w in wb[j])), None)
        if joined is not None:
            spare.remove(i)
            free.remove(joined)
            reach_a, reach_b = max(reach_a, i), max(reach_b, joined)
            lost += 0.3 * len(w)
    part = False
    tail_a, tail_b = [i for i in spare if i > reach_a], [j for j in free if j > reach_b]
    if tail_b and not tail_a and (ca or reach_b + 1 in bb) and reach_b >= 2:
        part, free = True, [j for j in free if j < reach_b]
    elif tail_a and not tail_b and cb and reach_a >= 2:
        part, spare = True, [i for i in spare if i < reach_a]
    talks = any(wa[i] in OTHERWISE for i in spare) or any(wb[j] in OTHERWISE for j in free)
    own = sum(1 for i in spare if len(wa[i]) > 2 or _NUMERAL.match(wa[i]))
    lost += sum(len(wa[i]) for i in spare) + sum(len(wb[j]) for j in free if len(wb[j]) > 2 or _NUMERAL.match(wb[j]))
    total = min(sum(map(len, wa)), sum(map(len, wb)))
    return max(0.0, 1.0 - lost / total), part, own, talks


@lru_cache(maxsize=200_000)
def venue_words(venue: str) -> tuple[str, ...]:
    return tuple(w for w in words_of(venue) if not w.isdigit() and w not in ("vol", "print", "online", "the"))


@lru_cache(maxsize=200_000)
def venue_agreement(a: str | None, b: str | None) -> float | None:
    """How far two typed venues can be one; None where one is missing."""
    wa, wb = venue_words(a or ""), venue_words(b or "")
    if not wa or not wb:
        return None
    if len(wa) > len(wb):
        wa, wb = wb, wa
    hits = 0
    for w in wa:
        hits += any(x == w or x.startswith(w) or w.startswith(x) or edits(w[:6], x[: max(len(w), 4)][:6], 1) <= 1 for x in wb)
    return hits / len(wa)


#: What stands between the authors where they are given as one string.
BETWEEN = "\x1f"


class Described:
    """One record's description; names are read only when asked for."""

    __slots__ = ("title", "authors", "year", "venue", "_persons")

    def __init__(self, title: str | None, authors: list[str] | str | None, year: int | None, venue: str | None):
        self.title = title or ""
        self.authors, self.year, self.venue = authors, year or None, venue
        self._persons: list | None = None

    @property
    def persons(self) -> list:
        if self._persons is None:
            self._persons = surnames(self.authors.split(BETWEEN) if isinstance(self.authors, str) else self.authors)
        return self._persons


#: Words of a title that the other may lack or write otherwise, besides a tenth of them.
MOST_STRANGE = 3
#: Agreement of titles below which no other field can make a match.
LEAST_TITLE = 0.6

_title_words = lru_cache(maxsize=100_000)(title_words)


@lru_cache(maxsize=100_000)
def title_pair(mine: str, other: str) -> tuple[float, bool, int, bool, int] | None:
    """(agreement, part, own words, whether one talks of another work, words of the shorter) of two titles; None for titles far apart.

    A work's rows share their titles, so the same two titles are compared
    again for each of them.
    """
    x, y = _title_words(mine), _title_words(other)
    a, b = x[0], y[0]
    if a != b and len(set(a).difference(b)) > MOST_STRANGE + 0.1 * len(a):
        return None
    title, part, own, talks = title_agreement(x, y)
    if title < LEAST_TITLE:
        return None
    return title, part, own, talks, min(len(a), len(b))


def compare(mine: Described, other: Described) -> dict | None:
    """Agreements of two records; None where titles and years are so far apart that no other field can make a match."""
    titles = title_pair(mine.title, other.title)
    if titles is None:
        return None
    title, part, own, talks, words = titles
    found = {"title": title, "part": part, "own": own, "otherwise": talks, "authors": 1.0, "years": abs(mine.year - other.year) if mine.year and other.year else None, "venue": 1.0, "words": words}
    if confidence(found) <= 0:
        return None
    return found | {"authors": author_agreement(mine.persons, other.persons), "venue": venue_agreement(mine.venue, other.venue)}


#: Rows that may share a title before it says less about the work.
COMMON = 16
#: The most that year and venue can add to the odds of equal titles, where authors are missing.
WITHOUT_AUTHORS = 9.0 * 0.16 + 0.9 + 1.4 * 0.4


def common_title(rows: int) -> float:
    """What the odds of a match lose, where authors are missing, if so many rows share the title."""
    return max(0.0, math.log(rows / COMMON))


def confidence(c: dict, rows: int = 1) -> float:
    """Logarithm of the odds that two records describe one work, from their agreements and how many rows share the title."""
    score = 9.0 * (c["title"] - 0.84) - 0.8 * c["part"] - 1.6 * c["own"] - 3.5 * c["otherwise"]
    if c["words"] < 5:
        score -= 0.75 * (5 - c["words"])
    a = c["authors"]
    if a is not None:
        whole = c["words"] > 5 and c["title"] > 0.96 and not c["part"]
        # other authors of the same title write another work, unless it stands in the same place
        score += 3.2 * (a - 0.45) if a >= 0.34 else -1.2 if whole and (c["venue"] or 0.0) >= 0.6 else -3.5
    else:
        score -= common_title(rows)
    y = c["years"]
    score += 0.0 if y is None else 0.9 if y == 0 else 0.4 if y == 1 else -0.6 if y == 2 else -2.0
    v = c["venue"]
    score += 0.0 if v is None else 1.4 * (v - 0.6)
    return score
