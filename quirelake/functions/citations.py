"""Citations of records in ten formats, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import has_number, has_text

FORMATS = ("bibtex", "endnote", "ris", "wos", "apa", "mla", "chicago", "harvard", "vancouver", "plain")
# Media types and file endings of the formats.
MEDIA_TYPES = {"bibtex": "application/x-bibtex", "endnote": "application/x-research-info-systems", "ris": "application/x-research-info-systems", "wos": "application/x-research-info-systems"}
ENDINGS = {"bibtex": "bib", "endnote": "enw", "ris": "ris", "wos": "wos"}
# How each format calls preprints, conference papers and articles.
KINDS = {
    "document": ("Preprint", "Conference Paper", "Journal Article"),
    "bibtex": ("misc", "inproceedings", "article"),
    "endnote": ("Generic", "Conference Proceedings", "Journal Article"),
    "ris": ("GEN", "CONF", "JOUR"),
    "wos": ("Generic", "Conference Proceedings", "Journal Article"),
}
# Field tags: kind, title, author, year, venue, publisher, volume, issue, pages, DOI, URL, abstract, keyword, language, citations; and the last line.
TAGS = {
    "endnote": ("%0 ", "%T ", "%A ", "%D ", "%J ", "%I ", "%V ", "%N ", "%P ", "%R ", "%U ", "%X ", "%K ", "%G ", None, ""),
    "ris": ("TY  - ", "TI  - ", "AU  - ", "PY  - ", "T2  - ", "PB  - ", "VL  - ", "IS  - ", "SP  - ", "DO  - ", "UR  - ", "AB  - ", "KW  - ", "LA  - ", None, "ER  - "),
    "wos": ("PT ", "TI ", "AU ", "PY ", "SO ", "PU ", "VL ", "IS ", "BP ", "DI ", "UR ", "AB ", "DE ", "LA ", "TC ", "ER"),
}
# Replacements that make a text safe for BibTeX, in this order.
ESCAPES = (("\\", r"\textbackslash{}"), ("{", r"\{"), ("}", r"\}"), ("$", r"\$"), ("&", r"\&"), ("%", r"\%"), ("#", r"\#"), ("^", r"\textasciicircum{}"), ("_", r"\_"), ("~", r"\textasciitilde{}"))


def media_type(style: str) -> str:
    return MEDIA_TYPES.get(style, "text/plain")


def ending(style: str) -> str:
    return ENDINGS.get(style, "txt")


@dataclass(frozen=True)
class Options:
    """What a citation holds; `most_authors` 0 takes the format's own limit."""

    abstract: bool = False
    keywords: bool = False
    doi: bool = True
    url: bool = True
    most_authors: int = 0


def kind_of(label: str) -> Column:
    """What a record is, in a format's words."""
    preprint, conference, article = KINDS[label]
    venue = F.lower(F.coalesce("venue", F.lit("")))
    held = F.lit(False)
    for w in ("conference", "proceedings", "workshop", "symposium"):
        held = held | F.contains(venue, F.lit(w))
    early = F.coalesce(F.col("oa_status") == "preprint", F.lit(False)) | F.coalesce(F.col("source").isin("arxiv", "biorxiv", "medrxiv"), F.lit(False))
    return F.when(early, preprint).when(held, conference).otherwise(article)


def with_venue_parts(records: DataFrame) -> DataFrame:
    """Records with volume, issue and pages read from the venue, where they have a DOI."""
    named = F.when(has_text(F.col("doi")), F.coalesce("venue", F.lit("")))
    part = lambda p: F.nullif(F.regexp_extract(named, p, 1), F.lit(""))
    pages = r"(?i)(?:pp\.?\s*)?(\d+)\s*[-–]\s*(\d+)"
    first, last = F.nullif(F.regexp_extract(named, pages, 1), F.lit("")), F.nullif(F.regexp_extract(named, pages, 2), F.lit(""))
    return records.withColumns({"volume": part(r"(?i)(?:vol\.?\s*|volume\s*)(\d+)"), "issue": part(r"(?i)(?:no\.?\s*|issue\s*|number\s*)(\d+)"), "pages": F.concat(first, F.lit("-"), last)})


def escaped(c: Column) -> Column:
    for old, new in ESCAPES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def bibtex_key() -> Column:
    """Last word of the first author, year, first word of the title; letters of a-z only."""
    letters = lambda c: F.regexp_replace(c, "[^a-zA-Z]", "")
    author = F.when(F.size("authors") > 0, letters(F.element_at(F.split(F.try_element_at("authors", F.lit(1)), " "), -1))).otherwise("Unknown")
    year = F.when(has_number(F.col("year")), F.col("year").cast("string")).otherwise("")
    return F.concat(author, year, F.when(has_text(F.col("title")), letters(F.element_at(F.split("title", " "), 1))).otherwise(""))


def _year() -> Column:
    return F.when(has_number(F.col("year")), F.col("year").cast("string"))


def _text(name: str) -> Column:
    return F.when(has_text(F.col(name)), F.col(name))


def _link() -> Column:
    return F.coalesce(_text("landing_page"), _text("best_pdf_url"))


def _add(before: str, c: Column, after: str = "") -> Column:
    """`c` between two texts, null without it."""
    return F.concat(F.lit(before), c, F.lit(after))


def _opt(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _names(most: int, last: str, cut: str, final_after_cut: bool = False) -> Column:
    """The authors in one text: `last` before the last one, `cut` after most - 1 of too many."""
    a, n = F.col("authors"), F.size("authors")
    first = F.array_join(F.slice(a, F.lit(1), F.lit(most - 1)), ", ")
    too_many = F.concat(first, F.lit(cut), F.element_at(a, -1)) if final_after_cut else F.concat(first, F.lit(cut))
    few = F.concat(F.array_join(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(last), F.element_at(a, -1)) if last else F.array_join(a, ", ")
    return F.when(n == 1, F.element_at(a, 1)).when((n > 1) & (n <= most), few).when(n > most, too_many)


def _bibtex(o: Options) -> Column:
    a = F.col("authors")
    names = F.array_join(a, " and ")
    if o.most_authors:
        names = F.when(F.size(a) > o.most_authors, F.concat(F.array_join(F.slice(a, 1, o.most_authors), " and "), F.lit(" and others"))).otherwise(names)
    kind = kind_of("bibtex")
    field = lambda name, c: _add(f"  {name} = {{", c, "}")
    long = F.when(F.length("abstract") > 500, F.concat(F.left("abstract", F.lit(500)), F.lit("..."))).otherwise(_text("abstract"))
    note = F.concat_ws(", ", _add("Retrieved from ", F.upper(_text("source"))), _add("OA Status: ", _text("oa_status")), _add("Citations: ", F.when(has_number(F.col("citation_count")), F.col("citation_count").cast("string"))))
    fields = F.concat_ws(
        ",\n", field("title", escaped(_text("title"))), F.when(F.size(a) > 0, field("author", names)), field("year", _year()),
        F.when(kind == "article", field("journal", escaped(_text("venue")))).when(kind == "inproceedings", field("booktitle", escaped(_text("venue")))),
        field("volume", F.col("volume")), field("number", F.col("issue")), field("pages", F.col("pages")),
        field("doi", _text("doi")) if o.doi else F.lit(None).cast("string"), field("url", _link()) if o.url else F.lit(None).cast("string"),
        field("abstract", escaped(long)) if o.abstract else F.lit(None).cast("string"),
        F.when(F.size("topics") > 0, field("keywords", F.array_join("topics", ", "))) if o.keywords else F.lit(None).cast("string"),
        F.when(note != "", field("note", note)),
    )
    return F.concat(F.lit("@"), kind, F.lit("{"), bibtex_key(), F.lit(",\n"), fields, F.lit("\n}"))


def _tagged(style: str, o: Options) -> Column:
    kind, title, author, year, venue, _, volume, issue, pages, doi, url, abstract, keyword, language, cites, end = TAGS[style]
    one = lambda tag, c: F.array(_add(tag, c))
    many = lambda tag, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(tag), x))
    lines = [one(kind, kind_of(style)), one(title, _text("title")), many(author, F.col("authors")), one(year, _year()), one(venue, _text("venue")), one(volume, F.col("volume")), one(issue, F.col("issue")), one(pages, F.col("pages"))]
    if o.doi:
        lines.append(one(doi, _text("doi")))
    if o.url:
        lines.append(one(url, _link()))
    if o.abstract:
        lines.append(one(abstract, _text("abstract")))
    if o.keywords:
        lines.append(many(keyword, F.col("topics")))
    lines.append(one(language, _text("language")))
    if cites:
        lines.append(one(cites, F.when(has_number(F.col("citation_count")), F.col("citation_count").cast("string"))))
    lines.append(F.array(F.lit(end)))
    return F.array_join(F.filter(F.flatten(F.array(*lines)), lambda x: x.isNotNull()), "\n")


def _styled(style: str, o: Options) -> Column:
    title, venue, vol, iss, pag, year = _text("title"), _text("venue"), F.col("volume"), F.col("issue"), F.col("pages"), _year()
    doi = _text("doi") if o.doi else F.lit(None).cast("string")
    m = o.most_authors
    if style == "apa":
        parts = [_names(m or 20, ", & ", ", ... ", True), _add("(", year, ")"), _add("", title, "."), F.concat(venue, _opt(_add(", ", vol)), _opt(_add("(", iss, ")")), _opt(_add(", ", pag)), F.lit(".")), _add("https://doi.org/", doi)]
    elif style == "mla":
        parts = [_add("", _names(m or 3, "", ", et al."), "."), _add('"', title, '."'), F.concat(venue, _opt(_add(", vol. ", vol)), _opt(_add(", no. ", iss)), _opt(_add(", ", year)), _opt(_add(", pp. ", pag)), F.lit(".")), _add("DOI: ", doi, ".")]
    elif style == "chicago":
        parts = [_add("", _names(m or 10, ", and ", ", et al."), "."), _add('"', title, '."'), F.concat(venue, _opt(_add(" ", vol)), _opt(_add(", no. ", iss)), _opt(_add(" (", year, ")")), _opt(_add(": ", pag)), F.lit(".")), _add("https://doi.org/", doi, ".")]
    elif style == "harvard":
        parts = [_names(m or 3, "", " et al."), _add("(", year, ")"), _add("", title, "."), F.concat(venue, _opt(_add(", ", vol)), _opt(_add("(", iss, ")")), _opt(_add(", pp. ", pag)), F.lit(".")), _add("DOI: ", doi, ".")]
    elif style == "vancouver":
        parts = [_add("", _names(m or 6, "", " et al."), "."), _add("", title, "."), F.concat(venue, _opt(_add(". ", year)), _opt(_add(";", vol)), _opt(_add("(", iss, ")")), _opt(_add(":", pag)), F.lit(".")), _add("DOI: ", doi, ".")]
    else:
        return F.concat_ws(". ", _names(m or 3, "", " et al."), _add("(", year, ")"), title, venue, _add("DOI: ", doi))
    return F.concat_ws(" ", *parts)


def cite(records: DataFrame, style: str = "plain", options: Options = Options()) -> DataFrame:
    """Records with `citation`; an unknown format gives the plain one."""
    made = _bibtex(options) if style == "bibtex" else _tagged(style, options) if style in TAGS else _styled(style, options)
    return with_venue_parts(records).withColumn("citation", made)


def quick() -> Column:
    """Three authors, year or n.d., title, venue in one line."""
    a = F.col("authors")
    names = F.concat(F.array_join(F.slice(a, 1, 3), ", "), F.when(F.size(a) > 3, " et al.").otherwise(""))
    return F.concat(names, F.lit(" ("), F.coalesce(_year(), F.lit("n.d.")), F.lit("). "), F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("venue", F.lit("")))


def export(records: DataFrame, path: str, style: str = "bibtex", options: Options = Options()) -> None:
    """Write the citations as text files, in the order of `ord`, a blank line between them."""
    cite(records, style, options).orderBy("ord").select("citation").write.option("lineSep", "\n\n").text(path)
