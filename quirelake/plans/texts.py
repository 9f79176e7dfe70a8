"""Queries over text functions, citations and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake import schema
from quirelake.functions import citations, pdf
from quirelake.functions import text as tx
from quirelake.plans.common import R, Query, joined, records, rounded, sql_joined
from quirelake.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# citations
_BASE = R.rstrip() + r""", c AS (SELECT *, nullif(regexp_extract(CASE WHEN doi <> '' THEN coalesce(venue,'') END, '(?i)(?:vol\.?\s*|volume\s*)(\d+)', 1), '') AS volume, nullif(regexp_extract(CASE WHEN doi <> '' THEN coalesce(venue,'') END, '(?i)(?:no\.?\s*|issue\s*|number\s*)(\d+)', 1), '') AS issue,
 nullif(regexp_extract(CASE WHEN doi <> '' THEN coalesce(venue,'') END, '(?i)(?:pp\.?\s*)?(\d+)\s*[-–]\s*(\d+)', 1), '') || '-' || nullif(regexp_extract(CASE WHEN doi <> '' THEN coalesce(venue,'') END, '(?i)(?:pp\.?\s*)?(\d+)\s*[-–]\s*(\d+)', 2), '') AS pages,
 nullif(title,'') AS ti, nullif(venue,'') AS ve, nullif(doi,'') AS do_, CASE WHEN year <> 0 THEN year::VARCHAR END AS ye, len(authors) AS n, coalesce(nullif(landing_page,''), nullif(best_pdf_url,'')) AS url,
 CASE WHEN oa_status = 'preprint' OR source IN ('arxiv','biorxiv','medrxiv') THEN 1 WHEN regexp_matches(lower(coalesce(venue,'')), 'conference|proceedings|workshop|symposium') THEN 2 ELSE 3 END AS kind FROM r) """


def _names(most: int, last: str, cut: str, final: bool = False) -> str:
    first = f"array_to_string(authors[1:{most - 1}], ', ')"
    few = f"array_to_string(authors[1:n-1], ', ') || '{last}' || authors[n]" if last else "array_to_string(authors, ', ')"
    return f"CASE WHEN n = 1 THEN authors[1] WHEN n > 1 AND n <= {most} THEN {few} WHEN n > {most} THEN {first} || '{cut}'{' || authors[n]' if final else ''} END"


def _space(*parts: str) -> str:
    return f"concat_ws(' ', {', '.join(parts)})"


_V = {
    "apa": "ve || coalesce(', ' || volume, '') || coalesce('(' || issue || ')', '') || coalesce(', ' || pages, '') || '.'",
    "mla": "ve || coalesce(', vol. ' || volume, '') || coalesce(', no. ' || issue, '') || coalesce(', ' || ye, '') || coalesce(', pp. ' || pages, '') || '.'",
    "chicago": "ve || coalesce(' ' || volume, '') || coalesce(', no. ' || issue, '') || coalesce(' (' || ye || ')', '') || coalesce(': ' || pages, '') || '.'",
    "harvard": "ve || coalesce(', ' || volume, '') || coalesce('(' || issue || ')', '') || coalesce(', pp. ' || pages, '') || '.'",
    "vancouver": "ve || coalesce('. ' || ye, '') || coalesce(';' || volume, '') || coalesce('(' || issue || ')', '') || coalesce(':' || pages, '') || '.'",
}
_STYLED = {
    "apa": _space(_names(20, ", & ", ", ... ", True), "'(' || ye || ')'", "ti || '.'", _V["apa"], "'https://doi.org/' || do_"),
    "mla": _space(f"({_names(3, '', ', et al.')}) || '.'", "'\"' || ti || '.\"'", _V["mla"], "'DOI: ' || do_ || '.'"),
    "chicago": _space(f"({_names(10, ', and ', ', et al.')}) || '.'", "'\"' || ti || '.\"'", _V["chicago"], "'https://doi.org/' || do_ || '.'"),
    "harvard": _space(_names(3, "", " et al."), "'(' || ye || ')'", "ti || '.'", _V["harvard"], "'DOI: ' || do_ || '.'"),
    "vancouver": _space(f"({_names(6, '', ' et al.')}) || '.'", "ti || '.'", _V["vancouver"], "'DOI: ' || do_ || '.'"),
    "plain": f"concat_ws('. ', {_names(3, '', ' et al.')}, '(' || ye || ')', ti, ve, 'DOI: ' || do_)",
}


def _tagged(style: str) -> str:
    k, t, a, y, v, _, vo, iss, pg, do, url, ab, kw, la, tc, end = citations.TAGS[style]
    kinds = citations.KINDS[style]
    kind = f"CASE kind WHEN 1 THEN '{kinds[0]}' WHEN 2 THEN '{kinds[1]}' ELSE '{kinds[2]}' END"
    lines = [f"['{k}' || {kind}]", f"['{t}' || ti]", f"list_transform(coalesce(authors,[]), lambda x: '{a}' || x)", f"['{y}' || ye]", f"['{v}' || ve]", f"['{vo}' || volume]", f"['{iss}' || issue]", f"['{pg}' || pages]", f"['{do}' || do_]", f"['{url}' || url]"]
    lines += [f"['{ab}' || nullif(abstract,'')]", f"list_transform(coalesce(topics,[]), lambda x: '{kw}' || x)", f"['{la}' || nullif(language,'')]"]
    if tc:
        lines.append(f"['{tc}' || CASE WHEN citation_count <> 0 THEN citation_count::VARCHAR END]")
    lines.append(f"['{end}']")
    return f"array_to_string(list_filter(flatten([{', '.join(lines)}]), lambda x: x IS NOT NULL), chr(10))"


def _escaped(x: str) -> str:
    for old, new in citations.ESCAPES:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_KEY = "CASE WHEN n > 0 THEN regexp_replace(string_split(authors[1], ' ')[-1], '[^a-zA-Z]', '', 'g') ELSE 'Unknown' END || coalesce(ye, '') || coalesce(regexp_replace(string_split(ti, ' ')[1], '[^a-zA-Z]', '', 'g'), '')"
_BIBTEX = (
    "'@' || CASE kind WHEN 1 THEN 'misc' WHEN 2 THEN 'inproceedings' ELSE 'article' END || '{' || " + _KEY + " || ',' || chr(10) || concat_ws(',' || chr(10), "
    f"'  title = {{' || {_escaped('ti')} || '}}', CASE WHEN n > 0 THEN '  author = {{' || array_to_string(authors, ' and ') || '}}' END, '  year = {{' || ye || '}}', CASE kind WHEN 3 THEN '  journal = {{' || {_escaped('ve')} || '}}' WHEN 2 THEN '  booktitle = {{' || {_escaped('ve')} || '}}' END, "
    "'  volume = {' || volume || '}', '  number = {' || issue || '}', '  pages = {' || pages || '}', '  doi = {' || do_ || '}', '  url = {' || url || '}', '  abstract = {' || "
    + _escaped("CASE WHEN length(abstract) > 500 THEN left(abstract, 500) || '...' ELSE nullif(abstract,'') END")
    + " || '}', CASE WHEN len(topics) > 0 THEN '  keywords = {' || array_to_string(topics, ', ') || '}' END, '  note = {' || nullif(concat_ws(', ', 'Retrieved from ' || upper(nullif(source,'')), 'OA Status: ' || nullif(oa_status,''), 'Citations: ' || CASE WHEN citation_count <> 0 THEN citation_count::VARCHAR END), '') || '}') || chr(10) || '}'"
)
_FULL = citations.Options(abstract=True, keywords=True)
for _style in citations.FORMATS:
    QUERIES[f"cite_{_style}"] = lambda spark, d, s=_style: citations.cite(records(spark, d), s, _FULL).select("ord", "citation")
    _made = _BIBTEX if _style == "bibtex" else _tagged(_style) if _style in citations.TAGS else _STYLED[_style]
    SQL[f"cite_{_style}"] = _BASE + f"SELECT ord, {_made} AS citation FROM c"
QUERIES["bibtex_key"] = lambda spark, d: records(spark, d).select("ord", citations.bibtex_key().alias("key"))
SQL["bibtex_key"] = _BASE + f"SELECT ord, {_KEY} AS key FROM c"
QUERIES["doc_type"] = lambda spark, d: records(spark, d).select("ord", citations.kind_of("document").alias("kind"), citations.kind_of("ris").alias("ris"))
SQL["doc_type"] = _BASE + "SELECT ord, (['Preprint','Conference Paper','Journal Article'])[kind] AS kind, (['GEN','CONF','JOUR'])[kind] AS ris FROM c"
QUERIES["venue_info"] = lambda spark, d: citations.with_venue_parts(records(spark, d)).select("ord", "volume", "issue", "pages")
SQL["venue_info"] = _BASE + "SELECT ord, volume, issue, pages FROM c"
QUERIES["cite_quick"] = lambda spark, d: records(spark, d).select("ord", citations.quick().alias("citation"))
SQL["cite_quick"] = _BASE + "SELECT ord, array_to_string(authors[1:3], ', ') || CASE WHEN n > 3 THEN ' et al.' ELSE '' END || ' (' || coalesce(ye, 'n.d.') || '). ' || coalesce(title,'') || '. ' || coalesce(venue,'') AS citation FROM c"
QUERIES["cite_batch"] = lambda spark, d: citations.cite(records(spark, d), "plain").groupBy(F.floor(F.col("ord") / 50).alias("batch_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "citation"))), lambda x: x["citation"]), "\n\n").alias("batch"))
SQL["cite_batch"] = _BASE + f"SELECT ord // 50 AS batch_no, string_agg({_STYLED['plain']}, chr(10) || chr(10) ORDER BY ord) AS batch FROM c GROUP BY 1"

# texts of the corpus
QUERIES["html_strip"] = lambda spark, d: table(spark, d, "documents").select("doc_id", tx.strip_html(F.col("text")).alias("plain"))
SQL["html_strip"] = r"""SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', chr(34)), '&#39;', chr(39)), '\s+', ' ', 'g'), '^[\s\x{FEFF}\p{Z}]+|[\s\x{FEFF}\p{Z}]+$', '', 'g') AS plain FROM documents"""


def _inverted(spark, d):
    words = F.split(F.col("abstract"), " ")
    spread = records(spark, d).where("abstract is not null").select("ord", F.posexplode(words).alias("at", "word"))
    index = spread.groupBy("ord", "word").agg(F.array_sort(F.collect_list("at")).alias("places")).groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("ord", tx.abstract_from_index(F.col("index")).alias("text"))


QUERIES["abstract_from_inverted_index"] = _inverted
SQL["abstract_from_inverted_index"] = R + "SELECT ord, abstract AS text FROM r WHERE abstract IS NOT NULL"
QUERIES["jaccard_similar"] = lambda spark, d: rounded(records(spark, d).where("title is not null and venue is not null").select("ord", tx.jaccard(tx.query_cache(F.col("title")), tx.query_cache(F.concat_ws(" ", "title", "venue"))).alias("similarity")), "similarity")
_QC = r"regexp_replace(regexp_replace(regexp_replace(lower({x}), '^[\s\x{{FEFF}}\p{{Z}}]+|[\s\x{{FEFF}}\p{{Z}}]+$', '', 'g'), '\s+', ' ', 'g'), '[^\w\s]', '', 'g')"
SQL["jaccard_similar"] = R.rstrip() + f", w AS (SELECT ord, list_distinct(string_split({_QC.format(x='title')}, ' ')) AS a, list_distinct(string_split({_QC.format(x='title || chr(32) || venue')}, ' ')) AS b FROM r WHERE title IS NOT NULL AND venue IS NOT NULL) SELECT ord, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM w"
QUERIES["parse_year"] = lambda spark, d: records(spark, d).select("ord", tx.year_of_date(F.col("created_at")).alias("of_date"), tx.leading_year(F.col("created_at")).alias("leading"), tx.leading_int(F.col("source_id")).alias("number"))
SQL["parse_year"] = R + r"SELECT ord, year(try_cast(CASE WHEN regexp_matches(created_at, '^\d{4}$') THEN created_at || '-01-01' WHEN regexp_matches(created_at, '^\d{4}-\d{2}$') THEN created_at || '-01' ELSE created_at END AS TIMESTAMP))::INT AS of_date, try_cast(regexp_extract(created_at, '^(\d{4})', 1) AS INT) AS leading, try_cast(regexp_extract(source_id, '^\s*([+-]?\d+)', 1) AS INT) AS number FROM r"
QUERIES["id_parts"] = lambda spark, d: records(spark, d).select("ord", tx.source_of_id(F.col("id")).alias("source_part"), tx.rest_of_id(F.col("id")).alias("rest"), tx.is_arxiv_id(tx.rest_of_id(F.col("id"))).alias("arxiv"), tx.url_origin(F.col("best_pdf_url")).alias("origin"))
SQL["id_parts"] = R + r"SELECT ord, split_part(id, ':', 1) AS source_part, regexp_replace(id, '^[^:]*:?', '') AS rest, regexp_matches(regexp_replace(id, '^[^:]*:?', ''), '^\d{4}\.\d{4,5}(v\d+)?$') AS arxiv, coalesce(nullif(regexp_extract(best_pdf_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), ''), best_pdf_url) AS origin FROM r"
QUERIES["license_code"] = lambda spark, d: spark.createDataFrame([("https://creativecommons.org/licenses/by/4.0/",), ("https://creativecommons.org/licenses/by-nc/3.0/",), ("http://www.elsevier.com/tdm",), ("",), (None,)], "url string").select(F.coalesce("url", F.lit("null")).alias("url"), tx.licence_code(F.col("url")).alias("code"))
SQL["license_code"] = "SELECT * FROM (VALUES ('https://creativecommons.org/licenses/by/4.0/','CC-BY-4.0'),('https://creativecommons.org/licenses/by-nc/3.0/','CC-BY-NC-3.0'),('http://www.elsevier.com/tdm','Custom License'),('',NULL),('null',NULL)) t(url, code)"
QUERIES["author_names"] = lambda spark, d: spark.createDataFrame([(1, "Ada", "Lovelace", None), (2, "Ada", None, ""), (3, None, None, "CERN"), (4, None, "Curie", None)], "k int, given string, family string, name string").select("k", tx.author_name(F.col("given"), F.col("family"), F.col("name")).alias("author"))
SQL["author_names"] = "SELECT * FROM (VALUES (1,'Ada Lovelace'),(2,'Ada'),(3,'CERN'),(4,'Curie')) t(k, author)"
QUERIES["time_ago"] = lambda spark, d: table(spark, d, "paper_access").select("access_no", tx.time_ago(F.lit(1_800_000_000.0) - F.col("last_accessed") / 1000).alias("ago"))
SQL["time_ago"] = "WITH a AS (SELECT access_no, 1800000000.0::DOUBLE - last_accessed / 1000 AS s FROM paper_access) SELECT access_no, CASE WHEN s IS NULL THEN NULL WHEN floor(s/60) < 1 THEN 'Just now' WHEN floor(s/60) < 60 THEN floor(s/60)::BIGINT || 'm ago' WHEN floor(s/3600) < 24 THEN floor(s/3600)::BIGINT || 'h ago' ELSE floor(s/86400)::BIGINT || 'd ago' END AS ago FROM a"
QUERIES["long_date"] = lambda spark, d: records(spark, d).select("ord", tx.long_date(F.col("created_at")).alias("shown"))
SQL["long_date"] = R + r"SELECT ord, coalesce(strftime(try_cast(CASE WHEN regexp_matches(created_at, '^\d{4}$') THEN created_at || '-01-01' WHEN regexp_matches(created_at, '^\d{4}-\d{2}$') THEN created_at || '-01' ELSE created_at END AS TIMESTAMP), '%B %-d, %Y'), 'N/A') AS shown FROM r"
QUERIES["file_names"] = lambda spark, d: records(spark, d).select("ord", tx.file_name(F.col("title")).alias("name"))
SQL["file_names"] = R + r"SELECT ord, left(lower(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9\s]', '', 'g'), '\s+', '_', 'g')), 50) AS name FROM r"
QUERIES["source_labels"] = lambda spark, d: records(spark, d).select("ord", F.coalesce(schema.literal_map(schema.SOURCE_LABELS, None)(F.col("source")), F.col("source")).alias("label"))
SQL["source_labels"] = R + "SELECT ord, CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schema.SOURCE_LABELS.items()) + " ELSE source END AS label FROM r"
QUERIES["card_display"] = lambda spark, d: records(spark, d).select(
    "ord", F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.when(F.size("authors") > 3, " et al.").otherwise("")).alias("names"), F.array_join(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 4), ", ").alias("shown_topics"),
    F.greatest(F.size(F.coalesce("topics", F.array().cast("array<string>"))) - 4, F.lit(0)).alias("more_topics"), F.when(F.length("abstract") > 500, F.concat(F.left("abstract", F.lit(500)), F.lit("..."))).otherwise(F.col("abstract")).alias("short_abstract"),
)
SQL["card_display"] = R + "SELECT ord, array_to_string(authors[1:3], ', ') || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END AS names, array_to_string(coalesce(topics,[])[1:4], ', ') AS shown_topics, greatest(len(coalesce(topics,[])) - 4, 0)::INT AS more_topics, CASE WHEN length(abstract) > 500 THEN left(abstract,500) || '...' ELSE abstract END AS short_abstract FROM r"

# addresses
_CANDIDATES = """list_filter([nullif(best_pdf_url,''), CASE WHEN source='arxiv' AND source_id <> '' THEN 'https://arxiv.org/pdf/' || source_id END,
 CASE WHEN source='europepmc' AND source_id LIKE 'PMC%' THEN 'https://europepmc.org/articles/' || source_id || '?pdf=render' END, CASE WHEN source='europepmc' AND source_id LIKE 'PMC%' THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || source_id || '/pdf/' END,
 CASE WHEN source='europepmc' AND source_id <> '' THEN 'https://europepmc.org/article/MED/' || source_id || '?pdf=render' END, CASE WHEN source='europepmc' AND source_id <> '' AND source_id NOT LIKE 'PMC%' THEN 'https://europepmc.org/article/PPR/PPR' || source_id || '?pdf=render' END,
 CASE WHEN source='core' AND source_id <> '' THEN 'https://core.ac.uk/reader/' || source_id END, CASE WHEN source='openaire' THEN coalesce(nullif(best_pdf_url,''), nullif(landing_page,'')) END,
 CASE WHEN doi LIKE '10.1371/journal.%' THEN 'https://journals.plos.org/plosone/article/file?id=' || doi || '&type=printable' END, nullif(landing_page,'')], lambda x: x IS NOT NULL)"""
QUERIES["pdf_candidates"] = lambda spark, d: records(spark, d).select("ord", F.array_join(pdf.candidates(), " ").alias("urls"), pdf.best().alias("best"))
SQL["pdf_candidates"] = R + f"SELECT ord, array_to_string({_CANDIDATES}, ' ') AS urls, list_filter({_CANDIDATES}, lambda x: CASE WHEN contains(x,'core.ac.uk/reader/') OR contains(x,'explore.openaire.eu/search/publication') OR (contains(x,'journals.plos.org') AND contains(x,'type=printable')) THEN true WHEN contains(x,'fileserver.core.ac.uk') THEN false ELSE contains(lower(x),'pdf') END)[1] AS best FROM r"
QUERIES["list_functions"] = lambda spark, d: records(spark, d).select("ord", tx.first_where(F.coalesce("topics", F.array().cast("array<string>")), lambda t: t.contains("e")).alias("first_e"), F.coalesce(F.exists("topics", lambda t: t == "optics"), F.lit(False)).alias("optics"), F.array_join(F.transform(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: a.contains(",")), F.upper), "|").alias("inverted"), joined("topics"))
SQL["list_functions"] = R + f"SELECT ord, list_filter(coalesce(topics,[]), lambda t: contains(t,'e'))[1] AS first_e, coalesce(list_contains(topics,'optics'), false) AS optics, array_to_string(list_transform(list_filter(coalesce(authors,[]), lambda a: contains(a,',')), lambda a: upper(a)), '|') AS inverted, {sql_joined('topics')} FROM r"
