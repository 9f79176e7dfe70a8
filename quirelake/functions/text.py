"""Text functions as columns: trimming, normal forms, identifiers, dates.

Blank means what the records' origin takes as missing: null, an empty string,
zero; an empty list is present.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\x{FEFF}\p{Z}]+|[\s\x{FEFF}\p{Z}]+$"


def has_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def has_number(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def trim_all(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, _EDGE, "")


def collapse(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"\s+", " "))


def round_half_up(c: Column) -> Column:
    """Rounded to a whole number, halves towards plus infinity."""
    return F.floor(c + 0.5)


def query_plain(c: Column) -> Column:
    return F.lower(trim_all(c))


def query_cache(c: Column) -> Column:
    """Normal form of cached queries and titles: single spaces, no signs, letters of a-z only."""
    return F.regexp_replace(F.regexp_replace(trim_all(F.lower(c)), r"\s+", " "), r"[^\w\s]", "")


def query_warm(c: Column) -> Column:
    return F.regexp_replace(trim_all(F.lower(c)), r"\s+", " ")


#: Host of the DOI resolver in addresses.
DOI_HOST = r"doi\.org"


def doi_merge(c: Column, host: str = DOI_HOST) -> Column:
    """DOI as merging compares it: without the resolver's address, no other prefix."""
    return F.regexp_replace(trim_all(F.lower(c)), rf"^https?://{host}/", "")


def doi_lookup(c: Column, host: str = DOI_HOST) -> Column:
    """DOI as look-ups send it: without address or `doi:`."""
    return F.regexp_replace(F.regexp_replace(trim_all(F.lower(c)), rf"^https?://{host}/", ""), r"^doi:", "")


def doi_bare(c: Column, host: str = DOI_HOST) -> Column:
    """DOI as enrichment cleans it: any host that ends in the resolver's, or `doi:`."""
    return F.regexp_replace(c, rf"^(doi:|https?://.*?{host}/)", "")


def is_doi(c: Column) -> Column:
    return query_plain(c).rlike(r"^10\.\d{4,}/\S+$")


def looks_like_doi(text: str) -> bool:
    """`is_doi` of a single text."""
    return re.match(r"10\.\d{4,}/\S+$", text.strip().lower(), re.ASCII) is not None


def is_doi_like(c: Column) -> Column:
    return query_plain(c).rlike(r"^(https?://)?(dx\.)?doi\.org/|^doi:|^10\.")


def strip_html(c: Column) -> Column:
    """Without tags, five character references decoded in a fixed order, single spaces."""
    bare = F.regexp_replace(c, r"<[^>]*>", "")
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        bare = F.replace(bare, F.lit(old), F.lit(new))
    return collapse(bare)


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index (word -> positions), words of one position in order of the words."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def author_name(given: Column, family: Column, name: Column) -> Column:
    """The name if there is one, else given and family name."""
    return F.coalesce(F.when(name != "", name), trim_all(F.concat_ws(" ", F.coalesce(given, F.lit("")), F.coalesce(family, F.lit("")))))


def source_of_id(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def rest_of_id(c: Column) -> Column:
    """What follows the first colon of an id; it may hold colons itself."""
    return F.regexp_replace(c, r"^[^:]*:?", "")


def is_arxiv_id(c: Column) -> Column:
    return c.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$")


def url_origin(c: Column) -> Column:
    """Scheme and host with port of an address, the raw text if it is none."""
    found = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(found != "", found).otherwise(c)


# Parts of Creative Commons addresses and their codes, tried in this order.
LICENCES = (("by/4.0", "CC-BY-4.0"), ("by-nc/4.0", "CC-BY-NC-4.0"), ("by-sa/4.0", "CC-BY-SA-4.0"), ("by-nd/4.0", "CC-BY-ND-4.0"), ("by/3.0", "CC-BY-3.0"), ("by-nc/3.0", "CC-BY-NC-3.0"))


def licence_code(url: Column) -> Column:
    code = F.when(~has_text(url), F.lit(None).cast("string"))
    for part, name in LICENCES:
        code = code.when(F.contains(url, F.lit("creativecommons.org")) & F.contains(url, F.lit(part)), name)
    return code.otherwise("Custom License")


def year_of_date(c: Column) -> Column:
    """Year of an ISO date or time, UTC."""
    return F.year(F.try_to_timestamp(c))


def leading_year(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")


def leading_int(c: Column) -> Column:
    """The number at the start of a text, null without one."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def time_ago(seconds: Column) -> Column:
    """How long ago, in the largest whole unit."""
    minutes, hours, days = (F.floor(seconds / n) for n in (60, 3600, 86400))
    return F.when(minutes < 1, "Just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def long_date(c: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "MMMM d, yyyy"), F.lit("N/A"))


def file_name(title: Column, size: int = 50) -> Column:
    """A title as a file name: letters, digits and underscores, lower case."""
    return F.left(F.lower(F.regexp_replace(F.regexp_replace(title, r"[^a-zA-Z0-9\s]", ""), r"\s+", "_")), F.lit(size))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the word sets of two texts split at spaces."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def similar_enough(a: Column, b: Column, least: float = 0.7) -> Column:
    """Whether a cached query may answer another one: equal, or similar in its words."""
    return (a == b) | (jaccard(a, b) >= least)


def json_key(space: str, fields: dict[str, Column]) -> Column:
    """`space` and the digest of the fields as JSON, by name; lists are sorted first, missing fields left out."""
    return F.concat(F.lit(space + ":"), F.md5(F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields))))))


def legacy_key(space: str, params: dict) -> str:
    """`space` and the parameters as JSON by name, as the older caches keep them."""
    return f"{space}:" + json.dumps({k: params[k] for k in sorted(params)}, separators=(",", ":"), ensure_ascii=False)


def cache_key(space: str, *parts: Column) -> Column:
    """`space` and the digest of the parts; list parts are sorted first."""
    return F.concat(F.lit(space + ":"), F.md5(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))))


def first_where(items: Column, test, field: str | None = None) -> Column:
    """The first element that passes `test`, or its field; null without one."""
    one = F.try_element_at(F.filter(items, test), F.lit(1))
    return one[field] if field else one
