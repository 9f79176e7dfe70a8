"""Queries over payload parsers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quirelake import schema
from quirelake.operators.staging import ensure_checkpoint_dir
from quirelake.plans.activity import SQL as ACTIVITY_SQL
from quirelake.plans.common import CALLS, Query, rounded
from quirelake.sources import parsers
from quirelake.streaming import jobs

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Payloads in each source's shape, with the record that must come out.
SAMPLES = {
    "openalex": '{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1/A","title":"On wells","authorships":[{"author":{"display_name":"Ada L."}}],"publication_year":2020,"primary_location":{"source":{"display_name":"Wells J.","host_organization_name":"WP"}},"abstract_inverted_index":{"deep":[1],"very":[0,2]},"open_access":{"is_oa":true,"oa_url":"https://x.org/a.pdf"},"cited_by_count":7,"concepts":[{"display_name":"hydrology"}]}',
    "crossref": '{"DOI":"10.1/b","title":["On tides","x"],"author":[{"given":"B.","family":"Curie"},{"name":"CERN"}],"published-print":{"date-parts":[[2019,4]]},"container-title":["Tide Notes"],"publisher":"TP","license":[{"URL":"u"}],"link":[{"URL":"https://x.org/h","content-type":"text/html"},{"URL":"https://x.org/b.pdf","content-type":"application/pdf"}],"is-referenced-by-count":3}',
    "unpaywall": '{"doi":"10.1/c","title":"On ice","journal_name":"Ice","year":2018,"is_oa":true,"best_oa_location":{"url_for_pdf":"","url_for_landing_page":"https://x.org/c"},"oa_locations":[{"url_for_pdf":"https://x.org/c.pdf"}],"z_authors":[{"given":"C.","family":"Dee"}]}',
    "arxiv": '<feed><entry><id>http://arxiv.org/abs/2301.00001v2</id><title>On\n  nets</title><summary> Small  nets. </summary><published>2023-01-02T00:00:00Z</published><author><name>D. Eff</name></author><author><name>E. Gee</name></author><link type="text/html" href="http://arxiv.org/abs/2301.00001v2"/><link type="application/pdf" href="http://arxiv.org/pdf/2301.00001v2"/><category term="cs.LG"/></entry></feed>',
    "ncbi": '<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>11</PMID><Article><ArticleTitle> On cells </ArticleTitle><Abstract><AbstractText Label="A">One.</AbstractText><AbstractText Label="B">Two.</AbstractText></Abstract><AuthorList><Author><LastName>Haa</LastName><ForeName>Ida</ForeName></Author></AuthorList><Journal><Title>Cells</Title><JournalIssue><PubDate><Year>2017</Year></PubDate></JournalIssue></Journal><Language>eng</Language></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">11</ArticleId><ArticleId IdType="pmc">PMC9</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle> </ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>',
    "europepmc": '{"id":"21","doi":"10.1/d","title":"On genes","authorList":{"author":[{"firstName":"J.","lastName":"Kay"}]},"pubYear":"2016","journalTitle":"Genes","isOpenAccess":"Y","pmcid":"PMC21","fullTextUrlList":{"fullTextUrl":[{"documentStyle":"html","url":"https://x.org/d"}]},"keywordList":{"keyword":["dna"]}}',
    "core": '{"id":"31","title":"On roads","authors":[{"name":"L. Em"}],"yearPublished":2015,"journal":"Roads","isOpenAccess":false,"links":[{"type":"display","url":"https://x.org/e"}],"topics":[{"label":"transport"}],"language":{"name":"English"}}',
    "datacite": '{"id":"10.1/f","attributes":{"doi":"10.1/f","titles":[],"creators":[{"familyName":"En","givenName":"O."}],"publicationYear":2014,"descriptions":[{"description":"m","descriptionType":"Methods"},{"description":"a","descriptionType":"Abstract"}],"url":"https://x.org/f","formats":["application/pdf"],"relatedIdentifiers":[{"relationType":"IsPublishedIn"}]}}',
    "doaj": '{"id":"41","created_date":"2013-01-01","bibjson":{"title":"On birds","author":[{"name":"P. Qu"}],"year":"2013a","journal":{"title":"Birds","publisher":"BP"},"identifier":[{"type":"issn","id":"1"},{"type":"doi","id":"10.1/g"}],"link":[{"type":"fulltext","url":"https://x.org/g","content_type":"HTML"}],"keywords":["birds"]}}',
    "openaire": '{"header":{"dri:objIdentifier":{"$":"o1"}},"metadata":{"oaf:entity":{"oaf:result":{"title":[{"$":"On soil"}],"creator":[{"$":"R. Es"},{"$":"T. Uu"}],"dateofacceptance":{"$":"2012-05-05"},"publisher":{"$":"SP"},"description":{"$":"<p>Wet &amp; dry</p>"},"pid":[{"$":"10.1/h"}],"children":{"instance":[{"webresource":{"url":{"$":"https://x.org/h"}}},{"webresource":{"url":{"$":"https://x.org/h.pdf"}}}]}}}}}',
    "biorxiv": '{"doi":"10.1101/i","title":"On fish","authors":"V. W.; ;X. Y.","date":"2011-03-03","version":"2","category":"zoology","abstract":"a"}',
    "plos": '{"id":"10.1371/journal.pone.1","title_display":"On bees","author_display":["Z. A."],"abstract":[" b "],"publication_date":"2010-02-02T00:00:00Z","journal":"PLOS ONE"}',
    "opencitations": '{"10.1/j":[{"creation":"2009-01","journal_sc":"no"},{"creation":"2001"}]}',
}
_EXPECTED = """SELECT * FROM (VALUES
('openalex','openalex:W1','https://doi.org/10.1/A','On wells','Ada L.',2020,'Wells J.','very deep very','published','https://x.org/a.pdf'),
('crossref','crossref:10.1/b','10.1/b','On tides','B. Curie|CERN',2019,'Tide Notes',NULL,'published','https://x.org/b.pdf'),
('unpaywall','unpaywall:10.1/c','10.1/c','On ice','C. Dee',2018,'Ice',NULL,'published','https://x.org/c.pdf'),
('arxiv','arxiv:2301.00001v2',NULL,'On nets','D. Eff|E. Gee',2023,'arXiv','Small nets.','preprint','https://arxiv.org/pdf/2301.00001v2'),
('ncbi','ncbi:11',NULL,'On cells','Haa Ida',2017,'Cells','One. Two.','published','https://www.ncbi.nlm.nih.gov/pmc/articles/PMC9/pdf/'),
('europepmc','europepmc:PMC21','10.1/d','On genes','J. Kay',2016,'Genes',NULL,'published','https://europepmc.org/articles/PMC21?pdf=render'),
('core','core:31',NULL,'On roads','L. Em',2015,'Roads',NULL,'other','https://core.ac.uk/reader/31'),
('datacite','datacite:10.1/f','10.1/f','Untitled','O. En',2014,'DataCite Repository','a','published','https://x.org/f'),
('doaj','doaj:41','10.1/g','On birds','P. Qu',2013,'Birds',NULL,'published',NULL),
('openaire','openaire:o1','10.1/h','On soil','R. Es|T. Uu',2012,NULL,'Wet & dry','published','https://x.org/h.pdf'),
('biorxiv','biorxiv:10.1101/i','10.1101/i','On fish','V. W.|X. Y.',2011,'biorxiv','a','preprint','https://www.biorxiv.org/content/10.1101/iv2.full.pdf'),
('plos','core:10.1371/journal.pone.1','10.1371/journal.pone.1','On bees','Z. A.',2010,'PLOS ONE','b','published','https://journals.plos.org/plosone/article/file?id=10.1371/journal.pone.1&type=printable'),
('opencitations','opencitations:10.1/j','10.1/j','Paper cited by 10.1/j','',2009,'no',NULL,'other',NULL)
) t(parser, id, doi, title, authors, year, venue, abstract, oa_status, best_pdf_url)"""
_SHOWN = ("id", "doi", "title", "year", "venue", "abstract", "oa_status", "best_pdf_url")


def _parsed(name: str) -> Query:
    def run(spark, d):  # noqa: ARG001
        raw = spark.createDataFrame([(SAMPLES[name],)], "raw string")
        return parsers.parse(raw, name).select(F.lit(name).alias("parser"), F.array_join("authors", "|").alias("authors"), *_SHOWN)

    return run


for _name in SAMPLES:
    QUERIES[f"parse_{_name}"] = _parsed(_name)
    SQL[f"parse_{_name}"] = f"{_EXPECTED} WHERE parser = '{_name}'"


def _shared_folder(spark) -> str:
    """A new folder that all executors share, below the checkpoint folder; only on one machine may that be one of its own."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark, d):
    names = F.array(*(F.lit(s) for s in ("openalex", "crossref", "europepmc", "ncbi", "arxiv", "core")))
    shape = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.element_at(names, (F.col("user_id") % 6 + 1).cast("int")).alias("source"), F.col("event_type").alias("service"), F.col("value").alias("latency"), (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("int").alias("results"), "user_id")


def _stream_costs(spark, d):
    priors = {s: (la, re, 0.5) for s, (la, re, _) in schema.SOURCES.items()}
    out = jobs.run_once(jobs.average_cost(_stream(spark, d), priors), _shared_folder(spark), "update")
    last = out.groupBy("source").agg(F.max_by(F.struct("n", "latency", "success", "quality"), "batch").alias("x")).select("source", "x.*")
    return rounded(last, "latency", "success", "quality")


QUERIES["stream_costs"] = _stream_costs
SQL["stream_costs"] = ACTIVITY_SQL["ema_metrics"]


def _stream_popular(spark, d):
    out = jobs.run_once(jobs.popularity(_stream(spark, d), "service"), _shared_folder(spark), "update")
    return out.groupBy("key").agg(F.max("uses").alias("uses"), F.max("last_used").alias("last_used"))


QUERIES["stream_popular"] = _stream_popular
SQL["stream_popular"] = CALLS + "SELECT service AS key, count(*) AS uses, epoch_us(max(ts)) AS last_used FROM calls GROUP BY service"


def _stream_sampled(spark, d):
    out = jobs.run_once(jobs.sampled(_stream(spark, d)), _shared_folder(spark), "update")
    last = out.groupBy("slice", "service").agg(F.max_by(F.struct("call_id", "n"), "batch").alias("x"))
    return last.select(F.unix_timestamp("slice").alias("slice"), "service", "x.call_id", "x.n")


QUERIES["stream_sampled"] = _stream_sampled
SQL["stream_sampled"] = CALLS + "SELECT epoch(date_trunc('hour', ts))::BIGINT AS slice, service, arg_max(call_id, (ts, call_id)) AS call_id, count(*) AS n FROM calls GROUP BY ALL"


def _stream_popular_ttl(spark, d):
    out = jobs.run_once(jobs.popularity(_stream(spark, d), "user_id", 1), _shared_folder(spark), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("uses", "last_used"), "batch").alias("x"))
    return last.select("key", "x.uses", "x.last_used").where("uses > 0")


QUERIES["stream_popular_ttl"] = _stream_popular_ttl
SQL["stream_popular_ttl"] = CALLS.rstrip() + ", m AS (SELECT max(ts) AS newest FROM calls) SELECT user_id::VARCHAR AS key, count(*) AS uses, epoch_us(max(ts)) AS last_used FROM calls, m GROUP BY user_id HAVING max(ts) + INTERVAL 1 DAY > any_value(newest)"

_STEPS = CALLS.replace("WITH calls", "WITH RECURSIVE calls").rstrip() + ", o AS (SELECT call_id, {key} AS k, epoch_us(ts) AS t, ok, row_number() OVER (PARTITION BY {key} ORDER BY ts, call_id) AS i FROM calls), "


def _stepped(job, *arguments) -> Query:
    def run(spark, d):
        rows = _stream(spark, d).select(F.col("call_id").alias("id"), "ts", "ok", "user_id", "source")
        return jobs.run_once(job(rows, *arguments), _shared_folder(spark)).select(F.col("id").alias("call_id"), "result")

    return run


QUERIES["stream_cache_levels"] = _stepped(jobs.cache_levels, "user_id", (3600, 10800, 86400))
SQL["stream_cache_levels"] = _STEPS.format(key="user_id") + """s AS (SELECT call_id, k, i, t + 3600000000 AS a, t + 10800000000 AS b, 0 AS result FROM o WHERE i = 1 UNION ALL
 SELECT o.call_id, o.k, o.i, CASE WHEN o.t <= s.a THEN s.a ELSE o.t + 3600000000 END, CASE WHEN o.t <= s.a OR o.t <= s.b THEN s.b ELSE o.t + 10800000000 END, CASE WHEN o.t <= s.a THEN 1 WHEN o.t <= s.b THEN 2 ELSE 3 END FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1) SELECT call_id, result FROM s"""
QUERIES["stream_cached_errors"] = _stepped(jobs.cached_errors, "source", 7200)
SQL["stream_cached_errors"] = _STEPS.format(key="source") + """s AS (SELECT call_id, k, i, CASE WHEN ok THEN 0 ELSE t END AS e, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS result FROM o WHERE i = 1 UNION ALL
 SELECT o.call_id, o.k, o.i, CASE WHEN s.e > 0 AND o.t - s.e <= 7200000000 THEN s.e WHEN o.ok THEN 0 ELSE o.t END, CASE WHEN s.e > 0 AND o.t - s.e <= 7200000000 THEN 'suppressed' WHEN o.ok THEN 'ok' ELSE 'failed' END FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1) SELECT call_id, result FROM s"""
QUERIES["stream_ring"] = _stepped(jobs.ring, "source", 100)
SQL["stream_ring"] = CALLS + "SELECT call_id, coalesce(lag(call_id, 100) OVER (PARTITION BY source ORDER BY ts, call_id), -1) AS result FROM calls"
QUERIES["stream_single_flight"] = _stepped(jobs.single_flights, "source", 1200)
SQL["stream_single_flight"] = _STEPS.format(key="source") + """s AS (SELECT call_id, k, i, t + 1200000000 AS u, 'started' AS result FROM o WHERE i = 1 UNION ALL
 SELECT o.call_id, o.k, o.i, CASE WHEN o.t < s.u THEN s.u ELSE o.t + 1200000000 END, CASE WHEN o.t < s.u THEN 'joined' ELSE 'started' END FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1) SELECT call_id, result FROM s"""


def _stream_counted(spark, d):
    out = jobs.run_once(jobs.counted(_stream(spark, d)), _shared_folder(spark), "complete")
    last = out.join(out.agg(F.max("batch").alias("batch")), "batch")
    return rounded(last.select("service", "requests", "errors", "mean_ms"), "mean_ms")


QUERIES["stream_counted"] = _stream_counted
SQL["stream_counted"] = CALLS + "SELECT service, count(*) AS requests, count(*) FILTER (WHERE NOT ok) AS errors, round(avg(latency), 6) AS mean_ms FROM calls GROUP BY service"
