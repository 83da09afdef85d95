"""Queries of sources and sinks: what a writer leaves in the shared folder, a reader brings back. Whole tables go through files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators import extract as x
from citeloom.plans.p_core import delivered
from citeloom.session import scratch, table
from citeloom.sources import connectors, readers, sinks

#: Rows of one container file: what one task gathers, whatever the table's size.
BLOCK = 500


def _in_files(rows: DataFrame, path: str) -> None:
    """Writes (body) with one file for each row."""
    rows.select("body").write.option("maxRecordsPerFile", 1).text(path)


def _blocks(df: DataFrame, key: str) -> Column:
    """A block number for each row by hash, so that blocks hold BLOCK rows on average and no key fills one."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // BLOCK)))).alias("block")


def _containers(spark, d, name):
    i = table(spark, d, "instances", "instance_id", "original_paper", "claim_text", "citation_metadata", "true_outputs", "loaded_at")
    row = F.struct("instance_id", "original_paper", "claim_text", "citation_metadata", "true_outputs")
    # repeated deliveries share their id, so the block comes from the whole row
    grouped = i.groupBy(_blocks(i, "loaded_at")).agg(F.collect_list(row).alias(name or "rows"))
    at = scratch(spark, "containers")
    _in_files(grouped.select(F.to_json(F.struct(name) if name else F.col("rows")).alias("body")), at)
    r = readers.read_instances(spark, at)
    return r.select("instance_id", "original_paper", "claim_text", F.col("citation_metadata.title").alias("title"), F.size("citation_metadata.authors").alias("n_authors"), F.col("true_outputs.true_alignment").alias("label"))


def src01_instances(spark, d):
    """Instances through files that hold them under `instances`."""
    return _containers(spark, d, "instances")


def src02_samples(spark, d):
    """Instances through files that hold them under `samples`."""
    return _containers(spark, d, "samples")


def src03_adversarial(spark, d):
    """Instances through files that hold them under `adversarial_instances`."""
    return _containers(spark, d, "adversarial_instances")


def src01_plain_lists(spark, d):
    """Instances through files that are lists."""
    return _containers(spark, d, None)


def src04_references(spark, d):
    """Bibliography entries through files with a list of them below `references`; an entry alone in its block is a file of its own."""
    b = table(spark, d, "bib_references", "ref_id", "paper_id", "entry_pos", "id", "title", "year")
    entry = F.struct(F.col("ref_id").cast("string").alias("ref_id"), F.col("id").alias("ID"), "title", "year")
    g = b.groupBy("paper_id", F.floor(F.col("entry_pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("entry_pos", entry.alias("e")))).alias("es"))
    es = F.transform("es", lambda e: e["e"])
    at = scratch(spark, "references")
    files = g.select(F.when(F.size("es") == 1, F.to_json(es[0])).otherwise(F.to_json(F.struct(F.concat_ws("#", "paper_id", "block").alias("pdf_url"), es.alias("references")))).alias("body"))
    # files of a handful of rows are written by the block, not by the paper: one task writes many
    _in_files(files, at)
    r = readers.read_references(spark, at)
    return r.select(F.col("entry")["ref_id"].cast("bigint").alias("ref_id"), F.col("entry")["ID"].alias("id"), F.col("entry")["title"].alias("title"), F.col("entry")["year"].alias("year"))


def src05_id_list(spark, d):
    """The identifiers of a CSV list with quotes and line breaks in other columns: stripped, blanks left out."""
    at = scratch(spark, "list")
    sinks.write_csv(table(spark, d, "papers", "crawl_no", "title", "abstract", "arxiv_id"), at)
    return readers.read_id_list(spark, at, "arxiv_id")


def src06_csv_table(spark, d):
    """A CSV table through a file and back; text may hold quotes, commas and line breaks."""
    at = scratch(spark, "table")
    sinks.write_csv(table(spark, d, "papers", "crawl_no", "title", "authors", "venue", "abstract"), at)
    r = readers.read_csv(spark, at)
    return r.select(F.col("crawl_no").cast("bigint").alias("crawl_no"), "title", "authors", F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"))


_SQUEEZED = lambda: F.trim(F.regexp_replace("abstract", r"[^\x21-\x7e¡-ÿ]+", " "))


def src07_text(spark, d):
    """Texts of unknown encoding: half of the files are UTF-8, half Latin-1; every line comes back."""
    p = table(spark, d, "papers", "crawl_no", "abstract").select("crawl_no", _SQUEEZED().alias("body")).where("body <> ''").withColumn("body", F.concat(F.lit("é "), "body"))
    at = scratch(spark, "texts")
    for i, code in enumerate(("UTF-8", "ISO-8859-1")):
        p.where(F.col("crawl_no") % 2 == i).select("body").write.option("encoding", code).option("quote", "\u0000").option("sep", "\t").csv(f"{at}/{code}")
    lines = readers.read_text(spark, at, "*.csv").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.md5("line").alias("line_md5"))


def src08_discovered(spark, d):
    """Files of one kind below any depth of folders: the other kinds are not read."""
    p = table(spark, d, "papers", "crawl_no", "field", "source_api", "title").select("crawl_no", "field", "source_api", F.regexp_replace("title", r"\s+", " ").alias("title"))
    at = scratch(spark, "tree")
    p.select("field", "source_api", "title").write.partitionBy("field", "source_api").text(f"{at}/a")
    p.select("title").write.csv(f"{at}/a/b/c")
    lines = readers.read_text(spark, at, "*.txt").select(F.explode(F.split("text", "\n")).alias("title"))
    return lines.where("title <> ''")


def _tars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for block, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held = io.BytesIO()
            with tarfile.open(fileobj=held, mode="w:gz") as tar:
                for m in members:
                    data = (m["text"] or "").encode()
                    info = tarfile.TarInfo(m["name"])
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            out.append(held.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([f"block{x}.tar.gz" for x in b.column(0).to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])


def src09_members(spark, d):
    """Members of compressed archives; one archive of every second block is cut short as well, and says so."""
    b = table(spark, d, "bib_references", "ref_id", "title")
    g = b.groupBy(_blocks(b, "ref_id")).agg(F.collect_list(F.struct(F.concat(F.lit("bib/"), F.col("ref_id").cast("string"), F.lit(".bib")).alias("name"), F.col("title").alias("text"))).alias("ms"))
    whole = g.mapInArrow(_tars, "path string, content binary")
    broken = whole.where(F.col("path").rlike(r"[02468]\.tar")).select(F.concat(F.lit("cut-"), "path").alias("path"), F.expr("substring(content, 1, 9)").alias("content"))
    m = readers.archive_members(whole.unionAll(broken))
    return m.select("member", F.md5(F.coalesce(F.col("content").cast("string"), F.lit(""))).alias("text_md5")).where("member is not null")


_PLAIN = r"[^A-Za-z0-9 ,.:-]"


def src10_bibtex(spark, d):
    """Entries of BibTeX files."""
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _PLAIN, ""), " +", " "))
    b = table(spark, d, "bib_references", "ref_id", "title", "year").select("ref_id", tidy("title").alias("title"), tidy("year").alias("year"))
    entry = F.concat(F.lit("@article{r"), "ref_id", F.lit(",\n  title = {{"), "title", F.lit("}},\n  year = \""), "year", F.lit("\"\n}\n"))
    g = b.groupBy(_blocks(b, "ref_id").alias("path")).agg(F.array_join(F.collect_list(entry), "\n").alias("text")).select(F.col("path").cast("string").alias("path"), "text")
    e = readers.bibtex_entries(g, None)
    return e.select(F.col("entry")["ID"].alias("id"), F.regexp_replace(F.col("entry")["title"], "[{}]", "").alias("title"), F.col("entry")["year"].alias("year"))


def src11_main_tex(spark, d):
    """The main file of each paper among its LaTeX texts: by name, else by its document class, else the first."""
    docs = table(spark, d, "documents", "doc_id", "paper_id", "text", "source", "section").where("source = 'latex' and paper_id is not null")
    path = F.when(F.col("section") == "Method", F.lit("src/paper.tex")).when(F.col("section") == "Results", F.lit("out/main.tex")).otherwise(F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(".tex")))
    return readers.main_tex(docs.select("paper_id", path.alias("path"), "text"), "paper_id")


def src15_converted(spark, d):
    """Documents through a converter of bytes to text, here that of UTF-8; a failure gives null."""
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return readers.with_text(docs, lambda data: data.decode()).select("path", F.md5("text").alias("text_md5"))


def src16_pages(spark, d):
    """Documents as pages (parted at blank lines), joined as Markdown with a header for each page that is not blank."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")
    return readers.pages_to_markdown(pages, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def src17_largest(spark, d):
    """Of the texts a converter left for a paper the largest."""
    docs = table(spark, d, "documents", "doc_id", "paper_id", "n_chars").where("paper_id is not null")
    return connectors.largest_text(docs.select("paper_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size")), "paper_id")


_XML = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x20-\x7e]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def src19_tei_raw(spark, d):
    """The raw strings of TEI citations: the raw reference, else a bibliographic note; one without either is left out."""
    b = table(spark, d, "bib_references", "ref_id", "title", "year")
    note = F.when(F.col("ref_id") % 3 == 0, F.concat(F.lit("<note type='raw_reference'>"), _XML("title"), F.lit("</note>"))).when(F.col("ref_id") % 3 == 1, F.concat(F.lit("<note type='biblio'>"), _XML("title"), F.lit("</note>"))).otherwise(F.lit(""))
    tei = b.select("ref_id", F.concat(F.lit("<TEI><text><back><listBibl><biblStruct>"), note, F.lit("</biblStruct></listBibl></back></text></TEI>")).alias("xml"))
    return x.tei_raw(tei, "ref_id", "xml").select("ref_id", F.md5("raw").alias("raw_md5"))


def src20_tei_fields(spark, d):
    """The fields of TEI citations."""
    b = table(spark, d, "bib_references", "ref_id", "title", "year", "journal", "extra_fields")
    e = lambda k: _XML(F.col("extra_fields")[k])
    cat = lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cs])
    # an article is analytic within a journal; every second title stands in the monograph instead
    analytic = F.when(F.col("ref_id") % 2 == 0, cat("<analytic><title level='a'>", _XML("title"), "</title><author><persName><forename>Ada</forename><surname>Lin</surname></persName></author></analytic><monogr><title level='j'>", _XML("journal"), "</title>"))
    body = F.coalesce(analytic, cat("<monogr><title level='m'>", _XML("title"), "</title><author><persName><surname>Roe</surname></persName></author>"))
    imprint = cat("<imprint><date type='published' when='", _XML("year"), "'/><biblScope unit='volume'>", e("volume"), "</biblScope><biblScope unit='page' from='7' to='12'/><publisher>", e("publisher"), "</publisher></imprint></monogr><idno type='DOI'>", e("doi"), "</idno>")
    tei = b.select("ref_id", cat("<TEI><biblStruct>", body, imprint, "</biblStruct></TEI>").alias("xml"))
    f = x.tei_fields(tei, "ref_id", "xml")
    return f.select("ref_id", "title", "venue", "year", F.array_join("authors", "; ").alias("authors"), "volume", "pages", "publisher", "doi")


def _answers(spark, d, item: Column, name: str) -> DataFrame:
    """Stored answers of a service: pages of papers of one field."""
    p = table(spark, d, "papers").where("title is not null")
    block = F.floor(F.col("crawl_no") / BLOCK).alias("block")
    return p.groupBy("field", block).agg(F.collect_list(item).alias(name)).select("field", F.to_json(F.struct(name)).alias("body"))


_AUTHORS = lambda: F.filter(F.split("authors", "; "), lambda a: a != "")
_SAID = lambda p: p.select("title", "authors", "year", "venue", F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"), "arxiv_id", "doi", "field", "source_api")


def src21_atom(spark, d):
    """Papers of a category crawl, from stored Atom feeds; each id once."""
    p = table(spark, d, "papers").where("title is not null")
    cat = lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cs])
    names = F.array_join(F.transform(_AUTHORS(), lambda a: F.concat(F.lit("<author><name>"), _XML(a), F.lit("</name></author>"))), "")
    entry = cat("<entry><id>http://arxiv.org/abs/", _XML("arxiv_id"), "</id><title>", _XML("title"), "</title>", F.coalesce(names, F.lit("")), "<published>", F.coalesce(F.col("year").cast("string"), F.lit("")), "-01-01T00:00:00Z</published><summary>", _XML("abstract"), "</summary></entry>")
    a = p.groupBy("field", F.floor(F.col("crawl_no") / BLOCK).alias("block")).agg(F.array_join(F.collect_list(entry), "").alias("b")).select("field", cat("<feed>", F.col("b"), "</feed>").alias("body"))
    r = connectors.from_atom(a)
    return r.groupBy("arxiv_id").agg(F.count("*").alias("n"), F.min("field").alias("field")).where("arxiv_id is not null")


def src21_category_requests(spark, d):
    """The requests of a category crawl: the first three sources of each field stand for its categories."""
    c = table(spark, d, "papers", "field", "source_api").where("field is not null and source_api is not null").distinct()
    g = c.groupBy("field").agg(F.array_sort(F.collect_list("source_api")).alias("cs")).select("field", F.posexplode("cs").alias("pos", "category"))
    return connectors.category_requests(g, "20240101")


def src22_venue_requests(spark, d):
    """The requests of a venue crawl: listed venues in batches of five within a range of dates."""
    v = table(spark, d, "venues", "venue_id", "venue_name").select((F.col("venue_id") - 1).alias("pos"), F.col("venue_name").alias("venue"))
    return connectors.venue_requests(v, "20230101", "20240101")


def src23_semantic_graph(spark, d):
    """Papers of stored answers of a semantic graph."""
    item = F.struct("title", F.transform(_AUTHORS(), lambda a: F.struct(a.alias("name"))).alias("authors"), "year", F.nullif(F.trim("venue"), F.lit("")).alias("venue"), "abstract", F.struct(F.col("arxiv_id").alias("ArXiv"), F.col("doi").alias("DOI")).alias("externalIds"))
    return _SAID(connectors.from_semantic_graph(_answers(spark, d, item, "data")))


def src24_open_index(spark, d):
    """Papers of stored answers of an open index, whose abstracts come as inverted indexes of words."""
    words = F.filter(F.split("abstract", r"\s+"), lambda w: w != "")
    places = lambda w: F.filter(F.transform(words, lambda v, j: F.when(v == w, j)), lambda j: j.isNotNull())
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("k"), places(w).alias("v"))))
    item = F.struct(
        "title", F.transform(_AUTHORS(), lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.col("year").alias("publication_year"),
        F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), index.alias("abstract_inverted_index"),
        F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.struct(F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id").alias("arxiv")).alias("ids"),
    )
    return _SAID(connectors.from_open_index(_answers(spark, d, item, "results")))


def src25_code_index(spark, d):
    """Papers of stored answers of an index of papers with code."""
    item = F.struct("title", _AUTHORS().alias("authors"), F.concat(F.col("year").cast("string"), F.lit("-06-01")).alias("published"), "abstract", "arxiv_id", F.col("venue").alias("proceeding"))
    return _SAID(connectors.from_code_index(_answers(spark, d, item, "results")))


def src31_id_map(spark, d):
    """Identifiers of one kind for those of another, by a stored map: DOI for the arXiv id of a citation, null where there is none."""
    m = table(spark, d, "papers", "arxiv_id", "doi").where("arxiv_id is not null and arxiv_id <> ''").groupBy("arxiv_id").agg(F.min(F.nullif("doi", F.lit(""))).alias("mapped_doi"))
    i = delivered(spark, d, "citation_metadata").select("instance_id", F.col("citation_metadata.identifiers.arxiv_id").alias("asked"))
    return readers.lookup(i.where("asked is not null and asked <> ''"), F.col("asked"), m, "arxiv_id", "mapped_doi")


def snk01_report(spark, d):
    """A report with metadata, metrics and rows, written and read again."""
    at = scratch(spark, "report")
    rows = delivered(spark, d, "true_outputs").select("instance_id", F.col("true_outputs.true_alignment").alias("label"))
    sinks.write_report(rows, at, run="nightly", model="offline")
    r = spark.read.schema("meta struct<run:string,model:string>, row struct<instance_id:string,label:int>").json(at)
    return r.select("meta.run", "meta.model", "row.instance_id", "row.label")


def snk02_dataset(spark, d):
    """An enriched data set with its metadata row: the rows that come back, beside the number that the metadata names."""
    at = scratch(spark, "dataset")
    sinks.write_dataset(delivered(spark, d, "claim_text", "retrieved_evidences").withColumn("n_chunks", F.coalesce(F.size("retrieved_evidences.extractive_chunks"), F.lit(0))).drop("retrieved_evidences"), at, name="enriched", version="1")
    meta = spark.read.schema("name string, version string, n_rows bigint").json(f"{at}/dataset_metadata")
    return meta.join(spark.read.parquet(f"{at}/rows").agg(F.lit("enriched").alias("name"), F.count("*").alias("found"), F.sum("n_chunks").alias("n_chunks")), "name")


def snk03_master_and_part(spark, d):
    """The list of all papers and that of papers with an arXiv id, as two CSV tables."""
    at = scratch(spark, "master")
    p = table(spark, d, "papers", "crawl_no", "title", "field", "arxiv_id")
    sinks.write_csv(p, f"{at}/all")
    sinks.write_csv(p.where("trim(coalesce(arxiv_id, '')) <> ''"), f"{at}/arxiv")
    both = [readers.read_csv(spark, f"{at}/{k}").select(F.lit(k).alias("list"), F.col("crawl_no").cast("bigint").alias("crawl_no"), "title", "field") for k in ("all", "arxiv")]
    return both[0].unionByName(both[1])


def snk04_by_field(spark, d):
    """A folder of JSON files for each field, read as one table again."""
    at = scratch(spark, "fields")
    sinks.write_by_field(table(spark, d, "papers", "crawl_no", "title", "year", "field"), "field", at)
    return spark.read.schema("crawl_no bigint, title string, year int, field string").json(at)


def snk06_traces(spark, d):
    """The trace of a retrieval as a table: claim, stage, rank, chunk and score of each stage."""
    from citeloom.plans import retrieve_q

    at = scratch(spark, "traces")
    retrieve_q.traces(spark, d).write.partitionBy("stage").parquet(at)
    return spark.read.schema("qid string, rank int, chunk_id string, score double, stage string").parquet(at)


def snk07_extraction_report(spark, d):
    """The report on extracted fields, with numbers of four decimals, through JSON."""
    from citeloom.plans import metrics_q

    at = scratch(spark, "extraction")
    r = metrics_q.agg06_field_report(spark, d)
    r.select("method", "field", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "accuracy")]).write.json(at)
    return spark.read.schema("method string, field string, precision double, recall double, f1 double, accuracy double").json(at)


def snk08_failure_report(spark, d):
    """The report on failures as Markdown: one line for each model and kind of error."""
    from citeloom.plans import metrics_q

    return sinks.markdown_table(metrics_q.agg13_error_share(spark, d), "Failure modes", ["model", "error_type"])


def snk09_resumed(spark, d):
    """A run that is broken off and run again: the second appends only what the first has not."""
    at = scratch(spark, "resumed")
    i = delivered(spark, d, "claim_text")
    sinks.append_new(i.where(F.col("instance_id") < F.lit("m")), "instance_id", at)
    sinks.append_new(i, "instance_id", at)
    sinks.append_new(i, "instance_id", at)
    return spark.read.parquet(at).select("instance_id", "claim_text")


def snk10_sidecars(spark, d):
    """A JSON object beside each paper's document."""
    at = scratch(spark, "sidecars")
    p = table(spark, d, "papers", "crawl_no", "paper_id", "title", "doi").where("paper_id is not null")
    sinks.write_sidecars(p, F.col("paper_id"), at)
    return spark.read.schema("crawl_no bigint, paper_id string, title string, doi string").json(f"{at}/shelf=*")


def snk11_split(spark, d):
    """Both halves of a condition, each read on its own; null counts as failed."""
    at = scratch(spark, "split")
    p = table(spark, d, "papers", "crawl_no", "year")
    sinks.write_split(p, F.col("year") >= 2015, at)
    both = spark.read.schema("crawl_no bigint, year int, kept boolean").parquet(at)  # a half without rows has no folder
    return both.where("kept").select("crawl_no", F.lit(True).alias("passed")).unionAll(both.where("not kept").select("crawl_no", F.lit(False).alias("passed")))


QUERIES = {f.__name__: f for f in [
    src01_instances, src01_plain_lists, src02_samples, src03_adversarial, src04_references, src05_id_list, src06_csv_table, src07_text, src08_discovered, src09_members, src10_bibtex, src11_main_tex,
    src15_converted, src16_pages, src17_largest, src19_tei_raw, src20_tei_fields, src21_atom, src21_category_requests, src22_venue_requests, src23_semantic_graph, src24_open_index, src25_code_index, src31_id_map,
    snk01_report, snk02_dataset, snk03_master_and_part, snk04_by_field, snk06_traces, snk07_extraction_report, snk08_failure_report, snk09_resumed, snk10_sidecars, snk11_split,
]}

from citeloom.plans.metrics_q import SQL as _METRICS  # noqa: E402
from citeloom.plans.retrieve_q import TRACES_SQL as _TRACES  # noqa: E402

_D = "WITH d AS (SELECT * FROM instances WHERE instance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY loaded_at DESC) = 1) "
_INST = "SELECT instance_id, original_paper, nullif(trim(claim_text), '') AS claim_text, citation_metadata.title AS title, len(citation_metadata.authors) AS n_authors, true_outputs.true_alignment AS label FROM instances"
_ASCII = "regexp_replace(coalesce({}, ''), '[^\\x20-\\x7e]', '', 'g')"
_TIDY = "trim(regexp_replace(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9 ,.:-]', '', 'g'), ' +', ' ', 'g'))"
_ANSWER = "SELECT title, array_to_string(list_filter(string_split(coalesce(authors, ''), '; '), lambda a: a <> ''), '; ') AS authors, year, {venue} AS venue, md5({abstract}) AS abstract_md5, {arxiv} AS arxiv_id, {doi} AS doi, field, '{api}' AS source_api FROM papers WHERE title IS NOT NULL"
_FULL = "CASE WHEN trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g')) = '' THEN '' ELSE abstract END"
SQL = {
    "src01_instances": _INST, "src01_plain_lists": _INST, "src02_samples": _INST, "src03_adversarial": _INST,
    "src04_references": "SELECT ref_id, id, title, year FROM bib_references",
    "src05_id_list": "SELECT trim(arxiv_id) AS arxiv_id FROM papers WHERE trim(arxiv_id) <> ''",
    "src06_csv_table": "SELECT crawl_no, title, authors, md5(coalesce(abstract, '')) AS abstract_md5 FROM papers",
    "src07_text": "SELECT md5('é ' || b) AS line_md5 FROM (SELECT trim(regexp_replace(abstract, '[^\\x21-\\x7e\\x{00a1}-\\x{00ff}]+', ' ', 'g')) AS b FROM papers) WHERE b <> ''",
    "src08_discovered": "SELECT regexp_replace(title, '\\s+', ' ', 'g') AS title FROM papers WHERE title <> ''",
    "src09_members": "SELECT 'bib/' || ref_id || '.bib' AS member, md5(coalesce(title, '')) AS text_md5 FROM bib_references",
    "src10_bibtex": f"SELECT 'r' || ref_id AS id, {_TIDY.format('title')} AS title, {_TIDY.format('year')} AS year FROM bib_references",
    "src11_main_tex": """SELECT paper_id, arg_min(path, (r, path)) AS path FROM (SELECT paper_id, CASE section WHEN 'Method' THEN 'src/paper.tex' WHEN 'Results' THEN 'out/main.tex' ELSE 'x/' || doc_id || '.tex' END AS path,
  CASE WHEN section = 'Results' THEN 1 WHEN section = 'Method' THEN 2 WHEN contains(left(text, 5000), '\\documentclass') THEN 50 ELSE 100 END AS r FROM documents WHERE source = 'latex' AND paper_id IS NOT NULL) GROUP BY 1""",
    "src15_converted": "SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS text_md5 FROM documents",
    "src16_pages": "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(string_agg('## Page ' || n || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY n)) AS text_md5 FROM p WHERE trim(t) <> '' GROUP BY 1",
    "src17_largest": "SELECT paper_id, arg_min(CAST(doc_id AS VARCHAR), (-coalesce(n_chars, 0), CAST(doc_id AS VARCHAR))) AS path FROM documents WHERE paper_id IS NOT NULL GROUP BY 1",
    "src19_tei_raw": f"SELECT ref_id, md5({_ASCII.format('title')}) AS raw_md5 FROM bib_references WHERE ref_id % 3 < 2 AND {_ASCII.format('title')} <> ''",
    "src20_tei_fields": f"""SELECT ref_id, nullif(trim({_ASCII.format('title')}), '') AS title, CASE WHEN ref_id % 2 = 0 THEN nullif(trim({_ASCII.format('journal')}), '') ELSE nullif(trim({_ASCII.format('title')}), '') END AS venue,
  nullif(regexp_extract({_ASCII.format('year')}, '(1[89][0-9][0-9]|20[0-9][0-9])', 1), '') AS year, CASE WHEN ref_id % 2 = 0 THEN 'Ada Lin' ELSE 'Roe' END AS authors,
  nullif(trim({_ASCII.format("extra_fields['volume']")}), '') AS volume, '7-12' AS pages, nullif(trim({_ASCII.format("extra_fields['publisher']")}), '') AS publisher, nullif(trim({_ASCII.format("extra_fields['doi']")}), '') AS doi FROM bib_references""",
    "src21_atom": "SELECT a AS arxiv_id, CAST(1 AS BIGINT) AS n, min(field) AS field FROM (SELECT nullif(regexp_extract(arxiv_id, '([0-9]{4}\\.[0-9]{4,5}(v[0-9]+)?|[a-z-]+/[0-9]{7})', 1), '') AS a, field FROM papers WHERE title IS NOT NULL) WHERE a IS NOT NULL GROUP BY 1",
    "src21_category_requests": "SELECT field, source_api AS category, 'cat:' || source_api || ' AND submittedDate:[20240101 TO *]' AS query FROM (SELECT DISTINCT field, source_api FROM papers WHERE field IS NOT NULL AND source_api IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY field ORDER BY source_api) <= 3",
    "src22_venue_requests": "SELECT CAST(floor((venue_id - 1) / 5) AS INTEGER) AS batch, '(' || string_agg('jr:\"' || venue_name || '\"', ' OR ' ORDER BY venue_id) || ') AND submittedDate:[20230101 TO 20240101]' AS query FROM venues GROUP BY 1",
    "src23_semantic_graph": _ANSWER.format(venue="nullif(trim(venue), '')", abstract=_FULL, arxiv="arxiv_id", doi="doi", api="semantic_scholar"),
    "src24_open_index": _ANSWER.format(venue="venue", abstract="coalesce(array_to_string(list_filter(string_split_regex(abstract, '\\s+'), lambda w: w <> ''), ' '), '')", arxiv="nullif(regexp_extract(arxiv_id, '([0-9]{4}\\.[0-9]{4,5}(v[0-9]+)?|[a-z-]+/[0-9]{7})', 1), '')", doi="nullif(doi, '')", api="openalex"),
    "src25_code_index": _ANSWER.format(venue="venue", abstract=_FULL, arxiv="arxiv_id", doi="CAST(NULL AS VARCHAR)", api="paperswithcode"),
    "src31_id_map": _D + ", m AS (SELECT arxiv_id, min(nullif(doi, '')) AS mapped_doi FROM papers WHERE arxiv_id <> '' GROUP BY 1) SELECT instance_id, citation_metadata.identifiers.arxiv_id AS asked, mapped_doi FROM d LEFT JOIN m ON citation_metadata.identifiers.arxiv_id = m.arxiv_id WHERE citation_metadata.identifiers.arxiv_id <> ''",
    "snk01_report": _D + "SELECT 'nightly' AS run, 'offline' AS model, instance_id, true_outputs.true_alignment AS label FROM d",
    "snk02_dataset": _D + "SELECT 'enriched' AS name, '1' AS version, count(*) AS n_rows, count(*) AS found, CAST(sum(coalesce(len(retrieved_evidences.extractive_chunks), 0)) AS BIGINT) AS n_chunks FROM d",
    "snk03_master_and_part": "SELECT 'all' AS list, crawl_no, title, field FROM papers UNION ALL SELECT 'arxiv', crawl_no, title, field FROM papers WHERE trim(coalesce(arxiv_id, '')) <> ''",
    "snk04_by_field": "SELECT crawl_no, title, year, field FROM papers",
    "snk06_traces": _TRACES,
    "snk07_extraction_report": "SELECT method, field, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(accuracy, 4) AS accuracy FROM (" + _METRICS["agg06_field_report"] + ")",
    "snk08_failure_report": """WITH m AS (""" + _METRICS["agg13_error_share"] + """), h(line_no, line) AS (VALUES (1, '## Failure modes'), (2, ''), (3, '| model | error_type | n | share |'), (4, '|---|---|---|---|'))
SELECT line_no, line FROM h UNION ALL SELECT CAST(row_number() OVER (ORDER BY model, error_type) + 4 AS INTEGER), '| ' || model || ' | ' || error_type || ' | ' || n || ' | ' || share || ' |' FROM m""",
    "snk09_resumed": _D + "SELECT instance_id, claim_text FROM d",
    "snk10_sidecars": "SELECT crawl_no, paper_id, title, doi FROM papers WHERE paper_id IS NOT NULL",
    "snk11_split": "SELECT crawl_no, coalesce(year >= 2015, false) AS passed FROM papers",
}
