"""Classifying queries by rules.

Nearly two hundred words are looked for in every query, wherever they stand in
it. One automaton finds them all in one pass, in Arrow batches; as column
expressions each would be a search of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # found one by one without it
    ahocorasick = None

# Words by which a query's field of research is told; a word listed twice counts twice.
DOMAIN_WORDS = {
    "biomedical": (
        "medicine", "medical", "clinical", "patient", "disease", "treatment", "therapy", "drug", "pharmaceutical", "biomedical", "health", "cancer",
        "tumor", "gene", "protein", "dna", "rna", "cell", "tissue", "organ", "surgery", "diagnosis", "symptom", "pathology", "immunology",
        "neurology", "cardiology", "oncology", "epidemiology", "pharmacology", "anatomy", "physiology", "biochemistry", "microbiology", "virology",
        "bacteriology", "pathogen", "infection",
    ),
    "computerScience": (
        "algorithm", "software", "programming", "computer", "computing", "data", "machine learning", "artificial intelligence", "ai",
        "neural network", "deep learning", "database", "system", "network", "security", "cryptography", "blockchain", "distributed", "parallel",
        "optimization", "complexity", "computational", "cyber", "digital", "information", "technology", "tech", "programming", "code",
        "software engineering", "computer vision", "nlp", "natural language processing", "robotics", "automation",
    ),
    "physics": (
        "physics", "quantum", "relativity", "thermodynamics", "mechanics", "electromagnetic", "optics", "particle", "nuclear", "atomic", "molecular",
        "energy", "force", "momentum", "wave", "frequency", "wavelength", "photon", "electron", "proton", "neutron", "field", "magnetic", "electric",
        "gravitational", "cosmology", "astrophysics", "plasma", "solid state", "condensed matter", "statistical mechanics",
    ),
    "chemistry": (
        "chemistry", "chemical", "molecule", "compound", "reaction", "synthesis", "catalyst", "organic", "inorganic", "analytical",
        "physical chemistry", "biochemistry", "polymer", "crystal", "crystallography", "spectroscopy", "chromatography", "electrochemistry",
        "thermochemistry", "kinetics", "equilibrium", "acid", "base", "ph", "oxidation", "reduction",
    ),
    "mathematics": (
        "mathematics", "math", "mathematical", "algebra", "geometry", "calculus", "statistics", "probability", "analysis", "topology",
        "number theory", "differential", "integral", "equation", "function", "theorem", "proof", "optimization", "linear", "nonlinear", "discrete",
        "continuous", "algorithm", "computation", "numerical", "approximation",
    ),
}
# Words that mark keyword queries, complex queries and queries about the present.
KEYWORD_WORDS = ("research", "study", "analysis", "method", "approach", "technique")
COMPLEX_WORDS = ("complex", "advanced", "sophisticated", "detailed", "comprehensive", "multidisciplinary", "interdisciplinary", "novel", "innovative", "cutting-edge", "state-of-the-art")
PRESENT_WORDS = ("urgent", "emergency", "critical", "immediate", "real-time", "live", "current", "recent", "latest", "newest")
# Patterns of the query types.
DOI_PATTERN = r"(?i)^10\.\d{4,}/[^\s]+$"
TITLE_PATTERN = r"^[A-Z][^.!?]*[.!?]?$"
AUTHOR_PATTERN = r"\b[A-Z][a-z]+\s+[A-Z][a-z]+(?:,\s*[A-Z][a-z]+\s+[A-Z][a-z]+)*\b"
CITATION_PATTERN = r"(?i)\b(?:cited|references?|citations?|bibliography)\b"

#: What an empty query is.
_EMPTY = ("mixed", "general", "simple", "medium", "medium")
_FIELDS = ("type", "domain", "complexity", "expected", "sensitivity")
#: Queries remembered by a worker.
_REMEMBERED = 100_000


class Classifier:
    """The rules of one profile; `documented` looks for a query's type in its own case, running pipelines in lower case."""

    def __init__(self, lower: bool):
        self.lower = lower
        self.patterns = [(kind, re.compile(p, re.ASCII)) for kind, p in (("doi", DOI_PATTERN), ("title", TITLE_PATTERN), ("author", AUTHOR_PATTERN), ("citation", CITATION_PATTERN))]
        listed = {w for words in DOMAIN_WORDS.values() for w in words} | set(COMPLEX_WORDS) | set(PRESENT_WORDS)
        self.listed = sorted(listed)
        self.automaton = None
        if ahocorasick is not None:
            self.automaton = ahocorasick.Automaton()
            for w in self.listed:
                self.automaton.add_word(w, w)
            self.automaton.make_automaton()

    def found(self, low: str) -> set[str]:
        """The listed words that a text contains, within other words too."""
        if self.automaton is None:
            return {w for w in self.listed if w in low}
        return {w for _, w in self.automaton.iter(low)}

    def kind(self, q: str) -> str:
        for kind, pattern in self.patterns:
            if pattern.search(q) and (kind != "title" or len(q) > 20):
                return kind
        return "keywords" if any(w in q for w in KEYWORD_WORDS) else "mixed"

    def classified(self, query: str | None) -> tuple[str, str, str, str, str]:
        """(type, domain, complexity, expected, sensitivity)."""
        q = (query or "").strip(" ")
        if not q:
            return _EMPTY
        low = q.lower()
        if self.lower:
            q = low
        words = self.found(low)
        kind = self.kind(q)
        # the field with most of its words, the first of equals
        hits = {name: sum(w in words for w in listed) for name, listed in DOMAIN_WORDS.items()}
        most = max(hits.values())
        field = next(name for name, n in hits.items() if n == most) if most else "general"
        several = any(w in q for w in (" and ", " or ", " vs "))
        complex_ = any(w in words for w in COMPLEX_WORDS) or len(re.split(r"[ \t\n\x0b\f\r]+", q)) > 10 or several
        expected = "low" if kind == "doi" else "high" if kind == "author" or field in ("biomedical", "computerScience") else "medium"
        return kind, field, "complex" if complex_ else "simple", expected, "high" if any(w in words for w in PRESENT_WORDS) else "medium"


@lru_cache(maxsize=2)
def classifier(lower: bool) -> Classifier:
    return Classifier(lower)


def _analysed(lower: bool):
    @F.pandas_udf(", ".join(f"{f} string" for f in _FIELDS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules = classifier(lower)
        known: dict[str | None, tuple] = {}
        for batch in batches:
            rows = []
            for q in batch:
                q = q if isinstance(q, str) else None
                if q not in known:
                    if len(known) > _REMEMBERED:
                        known.clear()
                    known[q] = rules.classified(q)
                rows.append(known[q])
            yield pd.DataFrame(rows, columns=list(_FIELDS))

    return run


def analysis(q: Column, profile: str = "documented") -> Column:
    """type, domain, complexity, expected and sensitivity of a query; an empty or null one is mixed, general, simple, medium, medium."""
    return _analysed(profile != "documented")(q)


def strategy(a: Column) -> Column:
    """Name of the routing strategy of an analysed query."""
    return F.when(a["type"] == "doi", "doi").when(a["sensitivity"] == "high", "fast").when(a["domain"].isin("biomedical", "computerScience", "physics"), a["domain"]).otherwise("general")
