"""Crawl connectors: the requests a crawl would make, and the answers of services brought to one table of papers.

Nothing here opens a connection. A crawl is two tables: requests, planned from a list of fields, categories or venues, and answers
(body string, field string), stored by whatever fetches them. Each service's answer has its own shape; all come out as PAPERS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.extract import inverted_index_text
from citeloom.session import blank_to_null

#: The columns of every connector.
PAPERS = ["title", "authors", "year", "venue", "abstract", "arxiv_id", "doi", "field", "source_api"]
#: How many categories of a field and venues of a list are asked for, and how many venues share a request.
CATEGORIES_OF_A_FIELD, VENUES_OF_A_CRAWL, VENUES_OF_A_REQUEST = 3, 5, 5


def category_requests(categories: DataFrame, newest: str) -> DataFrame:
    """(field, category, query): one request for each of the first categories of a field. categories: (field, pos, category)."""
    kept = categories.where(F.col("pos") < CATEGORIES_OF_A_FIELD)
    return kept.select("field", "category", F.concat(F.lit("cat:"), "category", F.lit(f" AND submittedDate:[{newest} TO *]")).alias("query"))


def venue_requests(venues: DataFrame, since: str, until: str) -> DataFrame:
    """(batch, query): venues joined by OR in batches, within a range of dates. venues: (pos from 0, venue)."""
    batch = F.floor(F.col("pos") / VENUES_OF_A_REQUEST).cast("int").alias("batch")
    named = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit('jr:"'), "venue", F.lit('"')).alias("q"))))
    joined = F.array_join(F.transform("names", lambda x: x["q"]), " OR ")
    grouped = venues.groupBy(batch).agg(named.alias("names"))
    return grouped.select("batch", F.concat(F.lit("("), joined, F.lit(f") AND submittedDate:[{since} TO {until}]")).alias("query"))


def _as_papers(rows: DataFrame, **cols: Column) -> DataFrame:
    return rows.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in PAPERS])


def _bare_arxiv_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+/\d{7})", 1), F.lit(""))


def _bare_doi(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?i)^https?://(?:dx\.)?doi\.org/", ""), F.lit(""))


def from_atom(answers: DataFrame) -> DataFrame:
    """Papers of Atom feeds; a paper met twice in one crawl (by its id) comes out once, with the field of the first by name."""
    entry = F.split("body", r"(?=<entry>)|(?<=</entry>)")
    e = answers.select("field", F.explode(F.filter(entry, lambda x: x.startswith("<entry>"))).alias("e"))
    clean = lambda c: blank_to_null(F.regexp_replace(c, r"\s+", " "))
    one = lambda path: clean(F.xpath_string("e", F.lit(path)))
    rows = e.select(
        one("entry/title").alias("title"), F.array_join(F.xpath("e", F.lit("entry/author/name/text()")), "; ").alias("authors"), F.substring(one("entry/published"), 1, 4).try_cast("int").alias("year"),
        one("entry/journal_ref").alias("venue"), one("entry/summary").alias("abstract"), _bare_arxiv_id(one("entry/id")).alias("arxiv_id"), one("entry/doi").alias("doi"), "field", F.lit("arxiv").alias("source_api"),
    )
    first = F.min(F.struct("field", *[c for c in PAPERS if c not in ("field", "arxiv_id")])).alias("r")
    met = rows.where("arxiv_id is not null").groupBy("arxiv_id").agg(first).select("arxiv_id", "r.*").select(*PAPERS)
    return met.unionByName(rows.where("arxiv_id is null"))


def from_semantic_graph(answers: DataFrame) -> DataFrame:
    """Papers of {"data": [{title, authors, year, venue, abstract, externalIds}]} answers."""
    item = "struct<title:string,authors:array<struct<name:string>>,year:int,venue:string,abstract:string,externalIds:struct<ArXiv:string,DOI:string>>"
    r = answers.select("field", F.explode(F.from_json("body", f"struct<data:array<{item}>>")["data"]).alias("r")).select("field", "r.*")
    return _as_papers(
        r, authors=F.array_join("authors.name", "; "), venue=blank_to_null(F.col("venue")), abstract=blank_to_null(F.col("abstract")), arxiv_id=F.col("externalIds.ArXiv"), doi=F.col("externalIds.DOI"), source_api=F.lit("semantic_scholar"),
    )


def from_open_index(answers: DataFrame) -> DataFrame:
    """Papers of {"results": [{title, authorships, publication_year, primary_location, abstract_inverted_index, doi, ids}]} answers."""
    item = (
        "struct<title:string,authorships:array<struct<author:struct<display_name:string>>>,publication_year:int,primary_location:struct<source:struct<display_name:string>>,"
        "abstract_inverted_index:map<string,array<int>>,doi:string,ids:struct<arxiv:string>>"
    )
    r = answers.select("field", F.explode(F.from_json("body", f"struct<results:array<{item}>>")["results"]).alias("r")).select("field", "r.*")
    return _as_papers(
        r, authors=F.array_join("authorships.author.display_name", "; "), year=F.col("publication_year"), venue=F.col("primary_location.source.display_name"),
        abstract=blank_to_null(inverted_index_text(F.col("abstract_inverted_index"))), arxiv_id=_bare_arxiv_id(F.col("ids.arxiv")), doi=_bare_doi(F.col("doi")), source_api=F.lit("openalex"),
    )


def from_code_index(answers: DataFrame) -> DataFrame:
    """Papers of {"results": [{title, authors, published, abstract, arxiv_id, proceeding}]} answers."""
    item = "struct<title:string,authors:array<string>,published:string,abstract:string,arxiv_id:string,proceeding:string>"
    r = answers.select("field", F.explode(F.from_json("body", f"struct<results:array<{item}>>")["results"]).alias("r")).select("field", "r.*")
    return _as_papers(
        r, authors=F.array_join("authors", "; "), year=F.substring("published", 1, 4).try_cast("int"), venue=F.col("proceeding"), abstract=blank_to_null(F.col("abstract")), doi=F.lit(None).cast("string"), source_api=F.lit("paperswithcode"),
    )


def largest_text(files: DataFrame, key: str) -> DataFrame:
    """(key, path): of the files a converter left for a document (key, path, size) the largest; ties go to the first by path."""
    return files.groupBy(key).agg(F.min_by("path", F.struct((-F.col("size")).alias("s"), "path")).alias("path"))
