"""Raw payloads of the upstream services to records.

Each parser takes a table with one payload a row in `raw` (JSON or XML text)
and gives the record columns. Schemas are explicit; members that come as text,
object or list are read as variants. Payloads that aren't valid give no record.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake import schema
from quirelake.functions.text import abstract_from_index, author_name, collapse, first_where, has_text, leading_int, leading_year, strip_html, trim_all, year_of_date

Parser = Callable[[DataFrame], DataFrame]
def _record(df: DataFrame, source: str | Column, **columns: Column) -> DataFrame:
    """The record columns, null where a parser gives none."""
    src = F.lit(source) if isinstance(source, str) else source
    given = columns | {"source": src}
    if "id" not in given:
        given["id"] = F.concat(src, F.lit(":"), given["source_id"])
    out = []
    for f in schema.RECORD.fields:
        c = given.get(f.name, F.lit(None))
        if f.name == "authors":
            c = F.coalesce(c, F.array())
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def _json(df: DataFrame, shape: str) -> DataFrame:
    return df.select(F.from_json("raw", shape, {"mode": "PERMISSIVE"}).alias("p")).where("p is not null")


def _names(items: Column, name) -> Column:
    return F.filter(F.transform(items, name), lambda x: x.isNotNull() & (x != ""))


def openalex(df: DataFrame, live: bool = False) -> DataFrame:
    """Works; live keeps open works with an address only, and calls all of them published."""
    p = _json(df, "id string, doi string, title string, authorships array<struct<author:struct<display_name:string>>>, publication_year int, primary_location struct<source:struct<display_name:string,host_organization_name:string>>, host_venue struct<display_name:string,publisher:string>, concepts array<struct<display_name:string>>, abstract_inverted_index map<string,array<int>>, open_access struct<is_oa:boolean,oa_url:string>, cited_by_count bigint, language string, created_date string")
    p = p.where(has_text(F.col("p.title")))
    if live:
        p = p.where(F.col("p.open_access.is_oa") & has_text(F.col("p.open_access.oa_url")))
    status = F.lit("published") if live else F.when(F.col("p.open_access.is_oa"), "published").otherwise("other")
    landing = F.col("p.id") if live else F.when(has_text(F.col("p.doi")), F.concat(F.lit("https://doi.org/"), F.col("p.doi"))).otherwise(F.col("p.id"))
    return _record(
        p, "openalex", source_id=F.element_at(F.split("p.id", "/"), -1), doi=F.col("p.doi"), title=F.col("p.title"), authors=_names(F.col("p.authorships"), lambda a: a["author"]["display_name"]), year=F.col("p.publication_year"),
        venue=F.coalesce("p.primary_location.source.display_name", "p.host_venue.display_name"), publisher=F.coalesce("p.primary_location.source.host_organization_name", "p.host_venue.publisher"), abstract=abstract_from_index(F.col("p.abstract_inverted_index")),
        oa_status=status, best_pdf_url=F.col("p.open_access.oa_url"), landing_page=landing, topics=F.transform("p.concepts", lambda c: c["display_name"]), language=F.coalesce("p.language", F.lit("en")), citation_count=F.col("p.cited_by_count"), created_at=F.col("p.created_date"),
    )


def crossref(df: DataFrame) -> DataFrame:
    p = _json(df, "DOI string, title array<string>, author array<struct<given:string,family:string,name:string>>, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, publisher string, `container-title` array<string>, abstract string, subject array<string>, language string, license array<struct<URL:string>>, link array<struct<URL:string,`content-type`:string>>, `is-referenced-by-count` bigint")
    year = lambda part: F.get(F.get(F.col(f"p.`{part}`.`date-parts`"), 0), 0)
    return _record(
        p, "crossref", source_id=F.col("p.DOI"), doi=F.col("p.DOI"), title=F.get("p.title", 0), authors=_names(F.col("p.author"), lambda a: author_name(a["given"], a["family"], a["name"])), year=F.coalesce(year("published-print"), year("published-online")),
        venue=F.get(F.col("p.`container-title`"), 0), publisher=F.col("p.publisher"), abstract=F.col("p.abstract"), oa_status=F.when(F.size("p.license") > 0, "published").otherwise("other"),
        best_pdf_url=first_where(F.col("p.link"), lambda x: x["content-type"] == "application/pdf", "URL"), landing_page=F.concat(F.lit("https://doi.org/"), F.col("p.DOI")), topics=F.col("p.subject"), language=F.col("p.language"), citation_count=F.col("p.`is-referenced-by-count`"),
    )


def unpaywall(df: DataFrame) -> DataFrame:
    """Open-access facts of a DOI; the PDF is the best location's, the first with one, else the best landing page; none if the work isn't open."""
    place = "struct<url_for_pdf:string,url_for_landing_page:string,host_type:string,license:string,version:string>"
    p = _json(df, f"doi string, title string, journal_name string, oa_locations array<{place}>, best_oa_location {place}, year int, is_oa boolean, z_authors array<struct<given:string,family:string>>")
    some = first_where(F.coalesce("p.oa_locations", F.array().cast(f"array<{place}>")), lambda x: has_text(x["url_for_pdf"]), "url_for_pdf")
    found = F.coalesce(F.nullif("p.best_oa_location.url_for_pdf", F.lit("")), some, F.col("p.best_oa_location.url_for_landing_page"))
    return _record(
        p, "unpaywall", source_id=F.col("p.doi"), doi=F.col("p.doi"), title=F.col("p.title"), authors=_names(F.col("p.z_authors"), lambda a: author_name(a["given"], a["family"], F.lit(None).cast("string"))), year=F.col("p.year"), venue=F.col("p.journal_name"),
        oa_status=F.when(F.col("p.is_oa"), "published").otherwise("other"), best_pdf_url=F.when(F.col("p.is_oa"), found), landing_page=F.col("p.best_oa_location.url_for_landing_page"),
    )


def arxiv(df: DataFrame) -> DataFrame:
    """Atom feeds; one row an entry."""
    shape = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,link:array<struct<_type:string,_href:string>>,category:array<struct<_term:string>>>>"
    e = df.select(F.explode(F.from_xml("raw", shape)["entry"]).alias("e"))
    pdf = first_where(F.col("e.link"), lambda x: x["_type"] == "application/pdf", "_href")
    return _record(
        e, "arxiv", source_id=F.element_at(F.split("e.id", "/"), -1), title=collapse(F.col("e.title")), authors=F.transform("e.author", lambda a: a["name"]), year=year_of_date(F.col("e.published")), venue=F.lit("arXiv"), abstract=collapse(F.col("e.summary")),
        oa_status=F.lit("preprint"), best_pdf_url=F.regexp_replace(pdf, r"^http://([^/]*arxiv\.org)", "https://$1"), landing_page=F.col("e.id"), topics=F.transform("e.category", lambda c: c["_term"]), language=F.lit("en"), created_at=F.col("e.published"),
    )


def pubmed(df: DataFrame) -> DataFrame:
    """Article sets; one row an article with a title."""
    text = "struct<_VALUE:string,_Label:string>"
    shape = f"PubmedArticle array<struct<MedlineCitation:struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<{text}>>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string>>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>,Language:string>>,PubmedData:struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>>>"
    a = df.select(F.explode(F.from_xml("raw", shape, {"valueTag": "_VALUE"})["PubmedArticle"]).alias("a"))
    art = F.col("a.MedlineCitation.Article")
    a = a.where(trim_all(art["ArticleTitle"]) != "")
    pmc = first_where(F.col("a.PubmedData.ArticleIdList.ArticleId"), lambda x: x["_IdType"] == "pmc", "_VALUE")
    return _record(
        a, "ncbi", source_id=F.col("a.MedlineCitation.PMID"), title=trim_all(art["ArticleTitle"]), authors=_names(art["AuthorList"]["Author"], lambda x: trim_all(F.concat_ws(" ", x["LastName"], F.coalesce(x["ForeName"], x["Initials"])))),
        year=leading_int(art["Journal"]["JournalIssue"]["PubDate"]["Year"]), venue=art["Journal"]["Title"], abstract=F.array_join(F.transform(art["Abstract"]["AbstractText"], lambda t: t["_VALUE"]), " "), oa_status=F.when(pmc.isNotNull(), "published").otherwise("other"),
        best_pdf_url=F.when(pmc.isNotNull(), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), pmc, F.lit("/pdf/"))), landing_page=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("a.MedlineCitation.PMID"), F.lit("/")), language=art["Language"],
    )


def europepmc(df: DataFrame) -> DataFrame:
    p = _json(df, "id string, doi string, title string, authorList struct<author:array<struct<fullName:string,firstName:string,lastName:string>>>, pubYear string, journalTitle string, abstractText string, isOpenAccess string, pmcid string, fullTextUrlList struct<fullTextUrl:array<struct<documentStyle:string,url:string>>>, keywordList struct<keyword:array<string>>, language string, firstPublicationDate string")
    link = first_where(F.coalesce("p.fullTextUrlList.fullTextUrl", F.array().cast("array<struct<documentStyle:string,url:string>>")), lambda x: (x["documentStyle"] == "pdf") | x["url"].contains(".pdf"), "url")
    return _record(
        p, "europepmc", source_id=F.coalesce("p.pmcid", "p.id"), doi=F.col("p.doi"), title=F.col("p.title"), authors=_names(F.col("p.authorList.author"), lambda a: author_name(a["firstName"], a["lastName"], a["fullName"])), year=leading_int(F.col("p.pubYear")), venue=F.col("p.journalTitle"),
        abstract=F.col("p.abstractText"), oa_status=F.when(F.col("p.isOpenAccess") == "Y", "published").otherwise("other"), best_pdf_url=F.coalesce(link, F.when(F.col("p.pmcid").isNotNull(), F.concat(F.lit("https://europepmc.org/articles/"), F.col("p.pmcid"), F.lit("?pdf=render")))),
        landing_page=F.concat(F.lit("https://europepmc.org/article/MED/"), F.col("p.id")), topics=F.col("p.keywordList.keyword"), language=F.col("p.language"), created_at=F.col("p.firstPublicationDate"),
    )


def core(df: DataFrame) -> DataFrame:
    p = _json(df, "id string, doi string, title string, authors array<struct<name:string>>, yearPublished int, publishedVenue string, journal string, abstract string, isOpenAccess boolean, fullTextIdentifier string, links array<struct<type:string,url:string>>, topics array<struct<label:string>>, language struct<name:string>, depositedDate string")
    elsewhere = first_where(F.coalesce("p.links", F.array().cast("array<struct<type:string,url:string>>")), lambda x: (x["type"] == "download") & ~x["url"].contains("core.ac.uk"), "url")
    reader = F.when(has_text(F.col("p.id")), F.concat(F.lit("https://core.ac.uk/reader/"), F.col("p.id")))
    return _record(
        p, "core", source_id=F.col("p.id"), doi=F.col("p.doi"), title=F.col("p.title"), authors=_names(F.col("p.authors"), lambda a: a["name"]), year=F.col("p.yearPublished"), venue=F.coalesce("p.publishedVenue", "p.journal"), abstract=F.col("p.abstract"), oa_status=F.when(F.col("p.isOpenAccess"), "published").otherwise("other"),
        best_pdf_url=F.coalesce(reader, F.when(~F.col("p.fullTextIdentifier").contains("fileserver.core.ac.uk"), F.col("p.fullTextIdentifier")), elsewhere), landing_page=first_where(F.col("p.links"), lambda x: x["type"] == "display", "url"), topics=F.transform("p.topics", lambda t: t["label"]), language=F.col("p.language.name"), created_at=F.col("p.depositedDate"),
    )


def datacite(df: DataFrame) -> DataFrame:
    p = _json(df, "id string, attributes struct<doi:string,titles:array<struct<title:string>>,creators:array<struct<name:string,givenName:string,familyName:string>>,publisher:string,publicationYear:int,descriptions:array<struct<description:string,descriptionType:string>>,subjects:array<struct<subject:string>>,language:string,url:string,formats:array<string>,dates:array<struct<date:string,dateType:string>>,relatedIdentifiers:array<struct<relationType:string>>>")
    a = F.col("p.attributes")
    described = first_where(a["descriptions"], lambda x: (x["descriptionType"] == "Abstract") | x["descriptionType"].isNull(), "description")
    dated = lambda kind: first_where(a["dates"], lambda x: x["dateType"] == kind, "date")
    return _record(
        p, "datacite", source_id=F.col("p.id"), doi=a["doi"], title=F.coalesce(F.get(a["titles"], 0)["title"], F.lit("Untitled")), authors=_names(a["creators"], lambda c: author_name(c["givenName"], c["familyName"], c["name"])), year=a["publicationYear"], venue=F.coalesce(a["publisher"], F.lit("DataCite Repository")), publisher=a["publisher"],
        abstract=described, oa_status=F.when(F.exists(a["relatedIdentifiers"], lambda r: r["relationType"] == "IsPublishedIn"), "published").otherwise("other"), best_pdf_url=F.when(F.array_contains(a["formats"], "application/pdf"), a["url"]), landing_page=a["url"], topics=F.transform(a["subjects"], lambda s: s["subject"]),
        language=a["language"], created_at=F.coalesce(dated("Created"), dated("Issued")), updated_at=dated("Updated"),
    )


def doaj(df: DataFrame) -> DataFrame:
    p = _json(df, "id string, created_date string, last_updated string, bibjson struct<title:string,author:array<struct<name:string>>,year:string,abstract:string,journal:struct<title:string,publisher:string,language:array<string>>,identifier:array<struct<type:string,id:string>>,link:array<struct<type:string,url:string,content_type:string>>,keywords:array<string>>")
    b = F.col("p.bibjson")
    return _record(
        p, "doaj", source_id=F.col("p.id"), doi=first_where(b["identifier"], lambda x: x["type"] == "doi", "id"), title=F.coalesce(b["title"], F.lit("Untitled")), authors=_names(b["author"], lambda a: a["name"]), year=leading_int(b["year"]), venue=b["journal"]["title"], publisher=b["journal"]["publisher"], abstract=b["abstract"], oa_status=F.lit("published"),
        best_pdf_url=first_where(b["link"], lambda x: (x["type"] == "fulltext") & (F.lower(x["content_type"]) == "pdf"), "url"), landing_page=F.coalesce(first_where(b["link"], lambda x: x["type"] == "fulltext", "url"), F.concat(F.lit("https://doaj.org/article/"), F.col("p.id"))), topics=b["keywords"], language=F.get(b["journal"]["language"], 0), created_at=F.col("p.created_date"), updated_at=F.col("p.last_updated"),
    )


def _plain(v: Column, path: str) -> Column:
    """Text at a path that holds it as text, in a member `$`, or as the first of a list of these."""
    get = lambda q: F.try_variant_get(v, q, "string")
    first = get(f"{path}[0]['$']"), get(f"{path}[0]")
    whole = get(path)
    return F.coalesce(get(f"{path}['$']"), *first, F.when(~whole.rlike(r"^[\[{]"), whole))


def _listed(v: Column, path: str) -> Column:
    """What stands at a path as a list: its elements, or itself as the only one; empty if nothing does."""
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def openaire(df: DataFrame) -> DataFrame:
    """Results of the graph, given as JSON made from XML."""
    p = df.select(F.try_parse_json("raw").alias("v")).where("v is not null")
    root = "$.metadata['oaf:entity']['oaf:result']"
    places = F.flatten(F.transform(_listed(F.col("v"), f"{root}.children.instance"), lambda i: _listed(i, "$.webresource")))
    known = F.filter(F.array_distinct(F.flatten(F.transform(places, lambda w: F.transform(_listed(w, "$.url"), lambda u: _plain(u, "$"))))), lambda u: u.isNotNull())
    is_pdf = lambda u: F.lower(u).contains("pdf")
    return _record(
        p, "openaire", source_id=_plain(F.col("v"), "$.header['dri:objIdentifier']"), doi=_plain(F.col("v"), f"{root}.pid"), title=F.coalesce(_plain(F.col("v"), f"{root}.title"), F.lit("Untitled")), authors=F.filter(F.transform(_listed(F.col("v"), f"{root}.creator"), lambda c: _plain(c, "$")), lambda a: a.isNotNull()),
        year=leading_year(_plain(F.col("v"), f"{root}.dateofacceptance")), venue=_plain(F.col("v"), f"{root}.journal"), publisher=_plain(F.col("v"), f"{root}.publisher"), abstract=strip_html(_plain(F.col("v"), f"{root}.description")), oa_status=F.lit("published"),
        best_pdf_url=first_where(known, is_pdf), landing_page=first_where(known, lambda u: ~is_pdf(u)), language=F.coalesce(F.try_variant_get(F.col("v"), f"{root}.language['@classid']", "string"), F.lit("en")),
    )


def biorxiv(df: DataFrame, server: str = "biorxiv") -> DataFrame:
    p = _json(df, "doi string, title string, authors string, date string, version string, category string, abstract string, published string")
    version = F.coalesce(F.nullif("p.version", F.lit("")), F.lit("1"))
    page = F.concat(F.lit(f"https://www.{server}.org/content/"), F.col("p.doi"), F.lit("v"), version)
    return _record(
        p, server, source_id=F.col("p.doi"), doi=F.col("p.doi"), title=F.col("p.title"), authors=F.filter(F.transform(F.split("p.authors", ";"), trim_all), lambda a: a != ""), year=year_of_date(F.col("p.date")), venue=F.lit(server), abstract=F.col("p.abstract"), oa_status=F.lit("preprint"),
        best_pdf_url=F.concat(page, F.lit(".full.pdf")), landing_page=page, topics=F.when(has_text(F.col("p.category")), F.array("p.category")), language=F.lit("en"), created_at=F.col("p.date"),
    )


def plos(df: DataFrame) -> DataFrame:
    """Articles; they come under the source core, as upstream has them."""
    p = _json(df, "id string, title string, title_display string, author array<string>, author_display array<string>, abstract array<string>, publication_date string, journal string, article_type string, doi string")
    doi = F.coalesce("p.doi", "p.id")
    return _record(
        p, "core", source_id=F.col("p.id"), doi=doi, title=F.coalesce("p.title_display", "p.title", F.lit("Untitled")), authors=F.coalesce("p.author_display", "p.author"), year=leading_year(F.col("p.publication_date")), venue=F.col("p.journal"), publisher=F.lit("PLOS"), abstract=trim_all(F.get("p.abstract", 0)), oa_status=F.lit("published"),
        best_pdf_url=F.concat(F.lit("https://journals.plos.org/plosone/article/file?id="), doi, F.lit("&type=printable")), landing_page=F.concat(F.lit("https://journals.plos.org/plosone/article?id="), doi), language=F.lit("en"), created_at=F.col("p.publication_date"),
    )


def opencitations(df: DataFrame) -> DataFrame:
    """Citations of a DOI: a record for each citing DOI, with year and venue of its first citation."""
    p = df.select(F.explode(F.from_json("raw", "map<string,array<struct<oci:string,citing:string,cited:string,creation:string,timespan:string,journal_sc:string,author_sc:string>>>")).alias("citing", "list"))
    first = F.get("list", 0)
    return _record(p, "opencitations", source_id=F.col("citing"), doi=F.col("citing"), title=F.concat(F.lit("Paper cited by "), F.col("citing")), year=leading_year(first["creation"]), venue=first["journal_sc"], oa_status=F.lit("other"), landing_page=F.concat(F.lit("https://doi.org/"), F.col("citing")), created_at=first["creation"])


def pubmed_found(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """The second of two steps: articles of the ids that a search gave; `ids` holds its answers as JSON, `articles` the sets fetched."""
    found = ids.select(F.explode(F.from_json("raw", "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]).alias("source_id")).distinct()
    return pubmed(articles).join(found, "source_id", "left_semi")


def preprints(by_server: dict[str, DataFrame], doi: str) -> DataFrame:
    """The records of a DOI on all servers."""
    found = [biorxiv(raw, server) for server, raw in by_server.items()]
    return reduce(DataFrame.unionByName, found).where(F.lower("doi") == doi.strip().lower())


def recent_preprints(by_server: dict[str, DataFrame], words: str, today: Column, year_from: int | None = None, year_to: int | None = None, days: int = 30, most: int = 50) -> DataFrame:
    """Preprints of the last days whose title or abstract contains the words in any case, the first so many of each server."""
    low = F.lit(words.lower())
    day = F.try_to_timestamp("created_at").cast("date")
    test = (F.coalesce(F.contains(F.lower("title"), low), F.lit(False)) | F.coalesce(F.contains(F.lower("abstract"), low), F.lit(False))) & day.between(F.date_sub(today, days), today)
    for bound, side in ((year_from, "ge"), (year_to, "le")):
        if bound:
            test = test & (F.col("year") >= bound if side == "ge" else F.col("year") <= bound)
    found = [biorxiv(raw, server).where(test).orderBy("created_at", "id").limit(most) for server, raw in by_server.items()]
    return reduce(DataFrame.unionByName, found)


def unpaywall_best(df: DataFrame) -> DataFrame:
    """(doi, pdf, licence, version): the publisher's address and licence and the published version first, else the best location's."""
    place = "struct<url_for_pdf:string,host_type:string,license:string,version:string>"
    p = _json(df, f"doi string, oa_locations array<{place}>, best_oa_location {place}")
    places = F.coalesce("p.oa_locations", F.array().cast(f"array<{place}>"))
    publisher = lambda f: first_where(places, lambda x: (x["host_type"] == "publisher") & has_text(x[f]), f)
    version = first_where(places, lambda x: x["version"] == "publishedVersion", "version")
    return p.select("p.doi", F.coalesce(publisher("url_for_pdf"), "p.best_oa_location.url_for_pdf").alias("pdf"), F.coalesce(publisher("license"), "p.best_oa_location.license").alias("licence"), F.coalesce(version, "p.best_oa_location.version").alias("version"))


#: Parsers by the name of the source.
PARSERS: dict[str, Parser] = {
    "openalex": openalex, "crossref": crossref, "unpaywall": unpaywall, "arxiv": arxiv, "ncbi": pubmed, "europepmc": europepmc, "core": core, "datacite": datacite, "doaj": doaj, "openaire": openaire, "biorxiv": biorxiv, "plos": plos, "opencitations": opencitations,
}


def parse(df: DataFrame, source: str) -> DataFrame:
    """Records of a source; an unknown one gives none."""
    if source in PARSERS:
        return PARSERS[source](df)
    return df.sparkSession.createDataFrame([], schema.RECORD)
