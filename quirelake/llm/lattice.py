"""Byte lattices of damaged text, and the search for their most probable path.

The characters of a damaged token are read as bytes that came through a channel.
Where bytes were lost, a wildcard stands for them: a replacement character is
one lost letter or sign, two or three of them may be the bytes of one, and a
lead byte before (or a continuation behind) a replacement character tells part
of the character that was lost. Viterbi search, with the best few paths for each
last letter, goes by the letter pairs of the corpus; the paths that reach the
end are weighed again by how often the corpus has their words, and their signs
between such neighbours.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

from quirelake.llm.channels import LOST, channels, common

#: First character of a lexicon key that is no word but a special character between its neighbours.
CONTEXT = "\x00"
#: Paths kept for each last letter, and paths weighed by whole words.
PATHS, WEIGHED = 12, 160
#: Logarithms of the probability that a word is unknown, and that two lost signs were one, three of them twice that.
UNKNOWN, MERGED = -5.0, -2.0
#: The least that a special character's neighbours may speak against it.
RARELY = -5.0

_WORDS = re.compile(r"[^\W\d_]+")
_CACHED = 300_000


def neighbour(char: str) -> str:
    return "0" if char.isdigit() else char


class Lexicon:
    """Words of the corpus with their counts, their letter pairs, and what stands between two characters.

    `counts` has words as they are written, and under a key that starts with
    `CONTEXT` a special character between its neighbours.
    """

    def __init__(self, counts: dict[str, int]):
        self.counts: Counter[str] = Counter()
        self.form: dict[str, tuple[int, str]] = {}
        self.between: dict[str, Counter[str]] = defaultdict(Counter)
        self.signs: Counter[str] = Counter()
        self.behind: dict[str, Counter[str]] = defaultdict(Counter)
        self.ahead: dict[str, Counter[str]] = defaultdict(Counter)
        for word, n in counts.items():
            if word[0] == CONTEXT:
                self.between[word[1].lower() + word[3].lower()][word[2].lower()] += n
                self.signs[word[2].lower()] += n
                self.behind[word[1].lower()][word[2].lower()] += n
                self.ahead[word[3].lower()][word[2].lower()] += n
                continue
            low = word.lower()
            self.counts[low] += n
            self.form[low] = max(self.form.get(low, (0, "")), (n, word))
        self.total = sum(self.counts.values()) or 1
        pairs: Counter[str] = Counter()
        firsts: Counter[str] = Counter()
        for word, n in self.counts.items():
            text = f"^{word}$"
            for a, b in zip(text, text[1:], strict=False):
                pairs[a + b] += n
                firsts[a] += n
        letters = {c for w in self.counts for c in w}
        self.special = [c for c, _ in self.signs.most_common()] or sorted(c for c in letters if ord(c) > 127)
        self.pairs = {p: math.log((n + 0.01) / (firsts[p[0]] + 0.01 * (len(letters) + 1))) for p, n in pairs.items()}
        self.floor = {a: math.log(0.01 / (n + 0.01 * (len(letters) + 1))) for a, n in firsts.items()}
        self.cache: dict[str, float] = {}
        self.restored: dict[tuple[str, bool], str] = {}

    def pair(self, a: str, b: str) -> float:
        return self.pairs.get(a + b) or self.floor.get(a, -12.0)

    def score(self, word: str) -> float:
        """Logarithm of the word's probability."""
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) > _CACHED:
                self.cache.clear()
            low = word.lower()
            text = f"^{low}$"
            spelled = sum(self.pair(a, b) for a, b in zip(text, text[1:], strict=False)) + UNKNOWN
            n = self.counts.get(low, 0)
            known = self.cache[word] = max(spelled, math.log(n / self.total)) if n else spelled
        return known

    def around(self, char: str, before: str, after: str) -> float:
        """How often a special character stands between two others, with a tenth of what its neighbours on either side let expect."""
        a, b = neighbour(before), neighbour(after)
        seen = self.between[a + b][char] if a + b in self.between else 0
        n = self.signs[char]
        expected = self.behind[a][char] * self.ahead[b][char] / n if n and a in self.behind and b in self.ahead else 0.0
        return seen + 0.1 * expected + 1e-4 * n + 1e-6

    def sign(self, char: str, before: str, after: str) -> float:
        """Logarithm of the probability of a sign between two characters, on the scale of words."""
        return math.log(self.around(char, before, after) / self.total)

    def place(self, char: str, before: str, after: str) -> float:
        """Logarithm of the share of a special character among those between two others; never very low, since the corpus can't have all."""
        a = neighbour(before) + neighbour(after)
        whole = sum(self.between[a].values()) if a in self.between else 0
        return max(RARELY, 0.5 * math.log(self.around(char, before, after) / (whole + 1.0)))

    def alone(self, char: str) -> float:
        """Logarithm of the probability of a sign wherever it stands; signs that weren't lost cost nothing."""
        return math.log((self.signs[char] + 1e-3) / self.total) if char > "\x7f" else 0.0

    def weigh(self, token: str) -> float:
        """Logarithm of the probability of a token: its words, and its special characters that are no letters."""
        total = sum(self.score(w) for w in _WORDS.findall(token))
        padded = f" {token} "
        return total + sum(self.sign(c, padded[i].lower(), padded[i + 2].lower()) for i, c in enumerate(token) if c > "\x7f" and not c.isalpha())


@lru_cache(maxsize=4096)
def _partial(span: str) -> tuple[str, ...]:
    """Common characters whose UTF-8 a span may be: each of its characters a byte under one table, or lost."""
    found: set[str] = set()
    for channel in channels():
        known = [None if c == LOST else channel.bytes.get(c, -1) for c in span]
        if -1 in known or all(b is None for b in known):
            continue
        for c in _encoded(len(span)):
            if all(b is None or b == x for b, x in zip(known, c.encode(), strict=True)):
                found.add(c)
    return tuple(sorted(found))


@lru_cache(maxsize=4)
def _encoded(size: int) -> tuple[str, ...]:
    """Common characters of so many bytes in UTF-8."""
    return tuple(c for c in map(chr, range(0x80, 0x2300)) if not 0xD800 <= ord(c) < 0xE000 and len(c.encode()) == size and common(c))


def edges(token: str, at: int, lexicon: Lexicon, merged: bool) -> list[tuple[int, list[str]]]:
    """(length, characters) that may be read from position `at` of a token; `merged` tells whether several lost signs may have been one."""
    char = token[at]
    found: list[tuple[int, list[str]]] = []
    for size in (2, 3):
        span = token[at : at + size]
        if len(span) == size and LOST in span:
            if span == LOST * size and merged:
                found.append((size, lexicon.special if size == 2 else [c for c in lexicon.special if not c.isalpha()]))
            elif span != LOST * size and (part := _partial(span)):
                found.append((size, list(part)))
    if char == LOST:
        found.append((1, lexicon.special))
    else:
        found.append((1, [char.lower() if len(char.lower()) == 1 else char]))
    return found


def most_probable(token: str, lexicon: Lexicon, merged: bool = True) -> str:
    """The most probable original of a token that lost some of its bytes."""
    known = lexicon.restored.get((token, merged))
    if known is None:
        if len(lexicon.restored) > _CACHED:
            lexicon.restored.clear()
        known = lexicon.restored[token, merged] = _searched(token, lexicon, merged)
    return known


def _searched(token: str, lexicon: Lexicon, merged: bool) -> str:
    if not lexicon.special:
        return token
    # at each position, by the last character: (score, text so far, where lost characters stand in it)
    reached: list[dict[str, list[tuple[float, str, tuple[int, ...]]]]] = [{} for _ in range(len(token) + 1)]
    reached[0] = {"^": [(0.0, "", ())]}
    for at in range(len(token)):
        if not reached[at]:
            continue
        for size, chars in edges(token, at, lexicon, merged):
            lost = LOST in token[at : at + size]
            there = reached[at + size]
            for last, paths in reached[at].items():
                for c in chars:
                    step = (lexicon.pair(last, c) if c.isalpha() else (lexicon.pair(last, "$") if last != "^" else 0.0) + lexicon.alone(c)) + MERGED * (size - 1) * (token[at : at + size] == LOST * size)
                    there.setdefault(c if c.isalpha() else "^", []).extend((score + step, text + c, marks + (len(text),) if lost else marks) for score, text, marks in paths)
        for later in reached[at + 1 : at + 4]:
            for last, paths in later.items():
                if len(paths) > PATHS:
                    later[last] = sorted(paths, reverse=True)[:PATHS]
    ends = [(score + (lexicon.pair(last, "$") if last != "^" else 0.0), text, marks) for last, paths in reached[-1].items() for score, text, marks in paths]
    if not ends:
        return token
    best = max(sorted(ends, reverse=True)[:WEIGHED], key=lambda e: (lexicon.weigh(e[1]) + _places(e[1], e[2], lexicon) + MERGED * (len(token) - len(e[1])), e[1]))
    return _cased(token, best[1], best[2], lexicon)


def _places(text: str, marks: tuple[int, ...], lexicon: Lexicon) -> float:
    padded = f" {text} "
    return sum(lexicon.place(text[i], padded[i], padded[i + 2]) for i in marks)


def _cased(token: str, text: str, marks: tuple[int, ...], lexicon: Lexicon) -> str:
    """`text` with the case of the token, and of the corpus where the letter was lost."""
    kept = iter(c for c in token if c != LOST)
    shouted = token.upper() == token and token.lower() != token
    lost = set(marks)
    if len(token) == len(text):
        out = [c if i in lost else t for i, (c, t) in enumerate(zip(text, token, strict=True))]
    else:
        out = [c if i in lost else next(kept, c) for i, c in enumerate(text)] if all(c == LOST or c.lower() in text for c in token) else list(text)
    for m in _WORDS.finditer(text):
        form = lexicon.form.get(m.group(), (0, m.group()))[1]
        rest = [c for i, c in enumerate(out[m.start() : m.end()], m.start()) if i not in lost]
        for i in range(m.start(), m.end()):
            if i in lost and (shouted or m.end() - m.start() == 1 and text[m.end() : m.end() + 1] == "." or form[i - m.start()].isupper() or len(rest) > 1 and all(map(str.isupper, rest))):
                upper = text[i].upper()
                out[i] = upper if len(upper) == 1 else text[i]
    return "".join(out)
