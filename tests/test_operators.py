"""Operators on small tables: merging against a sequential simulation, the query language, citations, and cases that break naive forms."""

import random

import pytest
from pyspark.sql import functions as F

from quirelake import schema
from quirelake.engine import Engine, Index
from quirelake.functions import citations, querylang
from quirelake.functions.text import round_half_up, strip_html, trim_all
from quirelake.operators import cache, merge, search
from quirelake.operators.search import Filters, Search
from quirelake.sources import parsers

FIELDS = [f.name for f in schema.RECORD.fields]
SHAPE = "ord bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.RECORD.fields)


def record(ord_, **values):
    base = dict.fromkeys(FIELDS) | {"id": f"x:{ord_}", "source": "arxiv", "authors": [], "oa_status": "published", "best_pdf_url": "u"} | values
    return (ord_, *(base[f] for f in FIELDS))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SHAPE)


def simulated(rows):
    """The merge, record by record."""
    out, groups = [], {}
    for r in rows:
        d = dict(zip(["ord", *FIELDS], r, strict=True))
        key = (d["doi"] or "").strip().lower().removeprefix("https://doi.org/")
        if key:
            groups.setdefault(key, []).append(d)
        else:
            out.append((d["ord"], d["title"], d["title"], tuple(d["authors"]), tuple(d["topics"] or ())))
    for group in groups.values():
        first = min(d["ord"] for d in group)
        group.sort(key=lambda d: (schema.PRIORITY.get(d["source"], 100), d["ord"]))
        lead, topics = group[0], list(group[0]["topics"] or [])
        filled = [d["title"] for d in group if d["title"]]
        for d in group[1:]:
            topics += [t for t in d["topics"] or [] if t not in topics]
        title = lead["title"] or (filled[1] if len(filled) > 1 else lead["title"])
        authors = next((d["authors"] for d in group if d["authors"]), [])
        out.append((first, title, filled[0] if filled else lead["title"], tuple(authors), tuple(topics)))
    return sorted(out, key=lambda x: x[0])


def test_merge_equals_simulation(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        doi = rng.choice([None, "", f"10.1/{rng.randrange(90)}", f" https://doi.org/10.1/{rng.randrange(90)}", f"10.1/{rng.randrange(90)} "])
        rows.append(record(i, doi=doi, title=rng.choice(["", None, f"t{i}"]), authors=rng.choice([[], ["a"], ["b", "c"]]), source=rng.choice(["crossref", "arxiv", "unknown", "core"]), topics=rng.choice([None, [], ["x", "x"], ["y", "z"], ["x", "w"]])))
    got = merge.merge_groups(table(spark, *rows)).select("ord", "title", "canonical_title", "authors", "topics").orderBy("ord").collect()
    assert [(r.ord, r.title, r.canonical_title, tuple(r.authors), tuple(r.topics or ())) for r in got] == simulated(rows)


def test_merge_of_nothing(spark):
    assert merge.merge_groups(table(spark)).count() == 0
    assert merge.merge_best_of(table(spark)).count() == 0


def test_filters_by_profile(spark):
    rows = table(spark, record(1, year=2000, source="arxiv"), record(2, year=None, source="ncbi", oa_status="other"), record(3, year=0, source="ncbi", best_pdf_url=""), record(4, year=2010, source="ncbi", topics=[None, "a"]))
    ids = lambda f, p="documented": [r.ord for r in search.apply_filters(rows, f, p).orderBy("ord").collect()]
    assert ids(Filters(year_from=2005, open_access_only=False)) == [2, 3, 4]
    assert ids(Filters()) == [1, 4]
    both = Filters(publication_type=("peer-reviewed", "preprint"))
    assert ids(both, "legacy") == [1, 4]
    assert ids(both, "live") == []
    assert ids(Filters(topics=("a",))) == [4]
    assert ids(Filters(oa_status=("other",)), "live") == [1, 4]


def test_pages(spark):
    rows = table(spark, *(record(i, year=i % 3) for i in range(7)))
    assert [r.ord for r in search.page_of(rows, Search(page=2, page_size=3, sort="date")).orderBy("place").collect()] == [4, 0, 3]
    assert search.page_of(rows, Search(page=9, page_size=3, sort="date")).count() == 0
    assert search.page_numbers(95, 5, 20) == {"pages": 5, "start": 81, "end": 95, "offered": [1, 2, 3, 4, 5]}


@pytest.mark.parametrize(
    ("query", "want"),
    [("rivers", [1, 2]), ("NOT rivers", [3]), ('title:"deep rivers" OR year:..1990', [1, 3]), ("(rivers year:2000..2010) OR author:ada", [2, 3]), ("deep NEAR rivers", [1]), ("", [1, 2, 3])],
)
def test_query_language(spark, query, want):
    rows = table(spark, record(1, title="Deep rivers", year=1999), record(2, title="Rivers", year=2005), record(3, title="Lakes", year=1980, authors=["Ada"]))
    assert [r.ord for r in rows.where(querylang.compile_query(query)).orderBy("ord").collect()] == want


@pytest.mark.parametrize("query", ["(a", "a OR", ")", "NEAR a", "year:abc"])
def test_query_errors(spark, query):
    with pytest.raises(querylang.QueryError):
        querylang.compile_query(query)


def test_query_builder():
    assert querylang.build_query([("AND", "title", "two words"), ("NOT", "all", "x"), ("OR", "author", " ")]) == 'title:"two words" NOT x'


def test_citations(spark):
    rows = table(spark, record(1, title="A {b} & c", authors=["Ada Lovelace", "B C", "D E", "F G"], year=2001, venue="Proceedings of X, vol. 3, no. 2, pp. 5-9", doi="10.1/a", source="core"))
    made = {s: citations.cite(rows, s).collect()[0].citation for s in citations.FORMATS}
    assert made["bibtex"].startswith("@inproceedings{Lovelace2001A,\n  title = {A \\{b\\} \\& c}")
    assert made["apa"] == "Ada Lovelace, B C, D E, & F G (2001) A {b} & c. Proceedings of X, vol. 3, no. 2, pp. 5-9, 3(2), 5-9. https://doi.org/10.1/a"
    assert made["mla"].startswith('Ada Lovelace, B C, et al.. "A {b} & c."')
    assert made["ris"].splitlines()[0] == "TY  - CONF"
    assert made["ris"].endswith("ER  - ")


def test_export_writes_all_in_order(spark, tmp_path):
    rows = table(spark, *(record(i, title=f"Title {i:03d}", authors=["Ada Lovelace"], year=2000) for i in (5, 1, 4, 2, 3)))
    citations.export(rows, str(tmp_path / "out"), "plain")
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert [f"Title {i:03d}" in t for i, t in zip(range(1, 6), text.strip().split("\n\n"), strict=True)] == [True] * 5


def test_engine_and_index(spark):
    rows = table(spark, record(1, title="Deep rivers", doi="10.1000/a"), record(2, title="Rivers", doi="10.1000/A", source="crossref"), record(3, title="Lakes"))
    found = Engine(rows).search(Search("rivers"))
    assert (found.total, found.hits.count()) == (1, 1)
    found.close()
    assert Engine(rows).search(Search("10.1000/a")).total == 1
    assert Engine(rows).paper("10.1000/a").count() == 1
    index = Index(rows).upsert(table(spark, record(9, id="x:1", title="Seas")))
    assert index.search("seas").count() == 1
    assert index.search("deep").count() == 0


def test_texts(spark):
    one = spark.range(1).select(trim_all(F.lit(" ﻿ a  ")).alias("t"), round_half_up(F.lit(-0.5)).alias("r"), strip_html(F.lit("<b>a</b>  &amp;lt; b")).alias("h")).collect()[0]
    assert (one.t, one.r, one.h) == ("a", 0, "a &lt; b")


def test_invalid_payloads(spark):
    raw = spark.createDataFrame([("not json",), ("",), (None,), ("{}",)], "raw string")
    assert parsers.parse(raw, "openalex").count() == 0
    assert parsers.parse(raw, "nowhere").count() == 0


@pytest.mark.parametrize("n", [1, 2, 500, 999, 1000])
def test_nth_smallest(spark, n):
    values = [(i * 7919) % 100_003 for i in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values], "seq bigint")
    assert cache.nth_smallest(rows, "seq", n, bins=16) == sorted(values)[n - 1]


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    assert sorted((r.id, r.v) for r in cache.upserted(old, old.limit(0)).collect()) == [("a", 1), ("b", 1)]
    new = spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int")
    assert sorted((r.id, r.v) for r in cache.upserted(old, new).collect()) == [("a", 1), ("b", 2), ("c", 2)]
