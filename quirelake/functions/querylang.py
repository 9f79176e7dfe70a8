"""A boolean, fielded query language compiled to a filter.

    expression := term ((AND | OR | juxtaposition) term)*   NOT binds before AND before OR
    term       := NOT term | ( expression ) | [field:] value | value NEAR value
    value      := word | "phrase" | low..high (years)

Words beside each other mean AND. Fields: all, title, abstract, author(s),
keywords, doi, venue, source, year. A phrase or word matches as a substring in
any case; NEAR needs both words within ten words of each other, in title or
abstract.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 10
_TOKEN = re.compile(r'\s*(?:(\()|(\))|((?:\w+:)?"[^"]*")|([^\s()]+))')


class QueryError(ValueError):
    """The query can't be read; the message names the place."""


def _tokens(text: str) -> list[str]:
    found, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            break
        found.append(next(g for g in m.groups() if g is not None))
        at = m.end()
    return found


def _joined(name: str) -> Column:
    return F.array_join(F.coalesce(name, F.array().cast("array<string>")), " ")


def _field_text(field: str) -> list[Column]:
    plain = {"title": ["title"], "abstract": ["abstract"], "doi": ["doi"], "venue": ["venue"], "source": ["source"]}
    if field in plain:
        return [F.coalesce(c, F.lit("")) for c in plain[field]]
    if field in ("author", "authors"):
        return [_joined("authors")]
    if field == "keywords":
        return [_joined("topics")]
    return [F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), _joined("authors"), _joined("topics"), F.coalesce("venue", F.lit("")), F.coalesce("doi", F.lit(""))]


_FIELDS = ("all", "title", "abstract", "author", "authors", "keywords", "doi", "venue", "source", "year")


def _words(c: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " ")


def _near(a: str, b: str) -> Column:
    def close(c: Column) -> Column:
        w = _words(c)
        places = lambda x: F.filter(F.transform(w, lambda t, i: F.when(t == x.lower(), i)), lambda i: i.isNotNull())
        return F.exists(places(a), lambda i: F.exists(places(b), lambda j: F.abs(i - j) <= NEAR))

    return close(F.coalesce("title", F.lit(""))) | close(F.coalesce("abstract", F.lit("")))


class _Parser:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        token = self.peek()
        if token is None:
            raise QueryError("the query ends where a term is missing")
        self.at += 1
        return token

    def either(self) -> Column:
        terms = [self.both()]
        while self.peek() == "OR":
            self.take()
            terms.append(self.both())
        return reduce(lambda a, b: a | b, terms)

    def both(self) -> Column:
        terms = [self.term()]
        while self.peek() not in (None, ")", "OR"):
            if self.peek() == "AND":
                self.take()
            terms.append(self.term())
        return reduce(lambda a, b: a & b, terms)

    def term(self) -> Column:
        token = self.take()
        if token == "NOT":
            return ~self.term()
        if token == "(":
            inner = self.either()
            if self.peek() != ")":
                raise QueryError("a parenthesis isn't closed")
            self.take()
            return inner
        if token in (")", "AND", "OR", "NEAR"):
            raise QueryError(f"{token} stands where a term is missing")
        if self.peek() == "NEAR":
            self.take()
            return _near(token.strip('"'), self.take().strip('"'))
        return self.value(token)

    def value(self, token: str) -> Column:
        field, colon, rest = token.partition(":")
        if not colon or field.lower() not in _FIELDS:
            field, rest = "all", token
        field, rest = field.lower(), rest.strip('"')
        if not rest:
            if self.peek() is None:
                raise QueryError(f"{field}: has no value")
            rest = self.take().strip('"')
        span = re.fullmatch(r"(\d{4})?\.\.(\d{4})?", rest)
        if field == "year" or field == "all" and span:
            if span:
                low, high = span.groups()
                year = F.coalesce("year", F.lit(0))
                return (year >= int(low) if low else F.lit(True)) & (year <= int(high) if high else F.lit(True)) & (year > 0)
            if not rest.isdigit():
                raise QueryError(f"{rest} is no year")
            return F.coalesce(F.col("year") == int(rest), F.lit(False))
        return reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(rest.lower())) for c in _field_text(field)))


def compile_query(text: str) -> Column:
    """The filter that a query stands for; an empty one passes every record."""
    tokens = _tokens(text)
    if not tokens:
        return F.lit(True)
    parser = _Parser(tokens)
    made = parser.either()
    if parser.peek() is not None:
        raise QueryError(f"{parser.peek()} is left over")
    return made


def build_query(rows: list[tuple[str, str, str]]) -> str:
    """Query of up to ten rows (operator, field, value) of a form; values with spaces are quoted."""
    parts: list[str] = []
    for operator, field, value in rows[:10]:
        value = value.strip()
        if not value:
            continue
        if " " in value and not (value.startswith('"') and value.endswith('"')):
            value = f'"{value}"'
        term = value if field == "all" else f"{field}:{value}"
        parts.append(f"{operator} {term}" if parts else f"NOT {term}" if operator == "NOT" else term)
    return " ".join(parts)
