"""Addresses under which a record's PDF may lie, best first, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.text import has_text


def candidates() -> Column:
    """All candidate addresses of a record."""
    sid, src = F.col("source_id"), F.col("source")
    own = lambda name: (src == name) & has_text(sid)
    pmc = F.startswith(sid, F.lit("PMC"))
    options = [
        F.when(has_text(F.col("best_pdf_url")), F.col("best_pdf_url")),
        F.when(own("arxiv"), F.concat(F.lit("https://arxiv.org/pdf/"), sid)),
        F.when(own("europepmc") & pmc, F.concat(F.lit("https://europepmc.org/articles/"), sid, F.lit("?pdf=render"))),
        F.when(own("europepmc") & pmc, F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), sid, F.lit("/pdf/"))),
        F.when(own("europepmc"), F.concat(F.lit("https://europepmc.org/article/MED/"), sid, F.lit("?pdf=render"))),
        F.when(own("europepmc") & ~pmc, F.concat(F.lit("https://europepmc.org/article/PPR/PPR"), sid, F.lit("?pdf=render"))),
        F.when(own("core"), F.concat(F.lit("https://core.ac.uk/reader/"), sid)),
        F.when(src == "openaire", F.when(has_text(F.col("best_pdf_url")), F.col("best_pdf_url")).otherwise(F.when(has_text(F.col("landing_page")), F.col("landing_page")))),
        F.when(F.startswith(F.col("doi"), F.lit("10.1371/journal.")), F.concat(F.lit("https://journals.plos.org/plosone/article/file?id="), F.col("doi"), F.lit("&type=printable"))),
        F.when(has_text(F.col("landing_page")), F.col("landing_page")),
    ]
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def plausible(url: Column) -> Column:
    """Whether an address looks like a PDF's, as far as can be told without asking for it."""
    has = lambda s: F.contains(url, F.lit(s))
    sure = has("core.ac.uk/reader/") | has("explore.openaire.eu/search/publication") | (has("journals.plos.org") & has("type=printable"))
    return F.when(sure, True).when(has("fileserver.core.ac.uk"), False).otherwise(F.contains(F.lower(url), F.lit("pdf")))


def best(looked_up: Column | None = None) -> Column:
    """The first plausible candidate, else the address that a look-up by DOI gave."""
    found = F.try_element_at(F.filter(candidates(), plausible), F.lit(1))
    return found if looked_up is None else F.coalesce(found, looked_up)
