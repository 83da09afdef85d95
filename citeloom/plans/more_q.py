"""Queries: the remaining operators of the inventory, one each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.operators import curate, metrics, perturb, scoring
from citeloom.operators import extract as x
from citeloom.operators import retrieve as r
from citeloom.plans.curate_q import cited
from citeloom.plans.metrics_q import _FIELDS, _PRED, VERDICTS, misses, verdicts
from citeloom.plans.p_core import delivered
from citeloom.plans.retrieve_q import _BM, claims, passages, top03_bm25
from citeloom.operators.ranking import rank_within
from citeloom.session import table

D = "WITH d AS (SELECT * FROM instances WHERE instance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY loaded_at DESC) = 1)"


def flt10_existence_two_stage(spark, d):
    """Papers by arXiv id without version, else by title: which stage found each cited work."""
    c = cited(spark, d).select("instance_id", t.without_version(F.nullif(F.col("ids.arxiv_id"), F.lit(""))).alias("aid"), F.nullif(t.normalize_title(F.col("title")), F.lit("")).alias("nt"))
    p = table(spark, d, "papers", "crawl_no", "arxiv_id", "title")
    by = lambda k: p.select(k.alias("k"), "crawl_no").where("k <> ''").groupBy("k").agg(F.min("crawl_no").alias("value"))
    out = curate.cascade(c, "instance_id", [("id", F.col("aid"), by(t.without_version(F.col("arxiv_id"))), "k"), ("title", F.col("nt"), by(t.normalize_title(F.col("title"))), "k")])
    return out.groupBy(F.coalesce("hit_source", F.lit("none")).alias("stage")).agg(F.count("*").alias("n"))


def flt11_first_available(spark, d):
    """Instances whose paper has a document, with the first one by id."""
    docs = table(spark, d, "documents", "doc_id", "paper_id").where("paper_id is not null").groupBy(F.col("paper_id").alias("original_paper")).agg(F.min("doc_id").alias("doc_id"))
    return delivered(spark, d, "original_paper").join(docs, "original_paper").select("instance_id", "doc_id")


def flt14_misclassified(spark, d):
    """Predictions that differ from the truth; a missing one differs from any."""
    return misses(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("pred").isNull()).alias("no_prediction"))


def flt15_both_known(spark, d):
    return verdicts(spark, d).where("truth is not null and pred is not null").select("instance_id", "truth", "pred")


def prj01_drop_columns(spark, d):
    return delivered(spark, d, "claim_text", "original_paper", "surrounding_context").drop("surrounding_context").select("instance_id", "original_paper", F.length("claim_text").alias("chars"))


def prj03_positional_path(spark, d):
    """A file name by position within the paper, from 0."""
    i = delivered(spark, d, "original_paper", "created_at")
    i = rank_within(i, ["original_paper"], ["created_at", "instance_id"], "n")
    return i.select("instance_id", F.concat((F.col("n") - 1).cast("string"), F.lit(".pdf")).alias("path"))


def prj07_build_instances(spark, d):
    """Instances assembled from references with constant truth."""
    b = table(spark, d, "bib_references", "ref_id", "paper_id", "title").where("title is not null")
    s = b.select(F.col("ref_id"), F.struct(F.col("paper_id").alias("original_paper"), F.struct("title").alias("citation_metadata"), F.struct(F.lit(1).alias("true_existence"), F.lit(0).alias("true_alignment")).alias("true_outputs")).alias("i"))
    return s.select("ref_id", "i.original_paper", F.col("i.citation_metadata.title").alias("title"), F.col("i.true_outputs.true_existence").alias("existence"))


def prj09_drop_nulls(spark, d):
    """JSON without null fields."""
    b = table(spark, d, "bib_references", "ref_id", "year", "journal", "booktitle")
    return b.select("ref_id", F.size(F.coalesce(F.json_object_keys(F.to_json(F.struct("year", "journal", "booktitle"))), F.array().cast("array<string>"))).alias("fields"))


def prj11_verdict_rows(spark, d):
    v = verdicts(spark, d)
    return v.select("instance_id", t.label_name(F.col("truth")).alias("truth"), F.when(F.col("pred").isNull(), "ERROR").otherwise(t.label_name(F.col("pred"))).alias("predicted"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def j02_claim_keys(spark, d):
    """One row for each claim and each reference of its paper that shares the cited title."""
    i = delivered(spark, d, "original_paper", "citation_metadata").select("instance_id", F.col("original_paper").alias("paper_id"), t.normalize_title(F.col("citation_metadata.title")).alias("nt")).where("trim(nt) <> ''")
    b = table(spark, d, "bib_references", "ref_id", "paper_id", "title").select("ref_id", "paper_id", t.normalize_title(F.col("title")).alias("nt"))
    return i.join(b, ["paper_id", "nt"]).select("instance_id", "ref_id")


def j09_aligned(spark, d):
    """J09: the true authors of each instance and those extracted in its latest state, by position; every true one stays, extra ones are ignored."""
    true = delivered(spark, d, "citation_metadata").select("instance_id", F.posexplode("citation_metadata.authors").alias("pos", "truth"))
    v = table(spark, d, "verification_instances", "instance_id", "event_ts", "loaded_at", "extracted_citation")
    latest = v.groupBy("instance_id").agg(F.max(F.struct("event_ts", "loaded_at", "extracted_citation")).alias("b"))
    found = latest.select("instance_id", F.posexplode("b.extracted_citation.authors").alias("pos", "extracted"))
    return true.join(found, ["instance_id", "pos"], "left").select("instance_id", (F.col("pos") + 1).alias("position"), "truth", "extracted")


def j12_scoped_join(spark, d):
    """How many passages each claim can search: an equi join on its paper, counted before it is expanded."""
    n = passages(spark, d).groupBy("scope").agg(F.count("*").alias("passages"))
    i = delivered(spark, d, "claim_text", "original_paper").where("claim_text is not null").select(F.col("instance_id").alias("qid"), F.col("original_paper").alias("scope"))
    return i.join(n, "scope", "left").select("qid", F.coalesce("passages", F.lit(0)).alias("passages"))


def j13_left_if_exists(spark, d):
    m = table(spark, d, "sample_targets", "true_alignment").where("true_alignment is not null").groupBy("true_alignment").agg(F.count("*").alias("targets"))
    c = delivered(spark, d, "true_outputs").groupBy(F.col("true_outputs.true_alignment").alias("label")).agg(F.count("*").alias("n"))
    return c.join(F.broadcast(m), c["label"].eqNullSafe(m["true_alignment"]), "left").select("label", "n", "targets")


def win04_retrieval_ranks(spark, d):
    i = delivered(spark, d, "retrieved_evidences").select("instance_id", F.posexplode("retrieved_evidences.extractive_chunks").alias("pos", "c"))
    return i.select("instance_id", "pos", F.row_number().over(Window.partitionBy("instance_id").orderBy(F.col("c.relevance_score").desc_nulls_last(), "pos")).alias("rank"))


def top05_best_evidence(spark, d):
    return win04_retrieval_ranks(spark, d).where("rank <= 3").select("instance_id", "pos")


def top09_first_instances(spark, d):
    """The first 200 instances by creation: the limit is the operator."""
    return delivered(spark, d, "created_at").orderBy("created_at", "instance_id").limit(200).select("instance_id")


def top11_order_restored(spark, d):
    i = delivered(spark, d, "created_at")
    return i.select("instance_id", F.row_number().over(Window.partitionBy(F.to_date("created_at")).orderBy("created_at", "instance_id")).alias("place"))


def set02_concat_sources(spark, d):
    p = table(spark, d, "papers", "crawl_no", "source_api")
    a, b = p.where("source_api = 'arxiv'"), p.where("coalesce(source_api, '') <> 'arxiv'")
    return a.unionByName(b).groupBy("source_api").agg(F.count("*").alias("n"))


def set07_common_ids(spark, d):
    v = table(spark, d, "verification_instances", "instance_id").distinct()
    return table(spark, d, "instances", "instance_id").distinct().join(v, "instance_id", "left_semi").agg(F.count("*").alias("n"))


def smp05_combined(spark, d):
    """SMP05: all rows of every label, interleaved in proportion; slot is the place of each."""
    i = delivered(spark, d, "true_outputs").select("instance_id", F.col("true_outputs.true_alignment").alias("label"))
    return curate.interleave(i, "label", ["instance_id"]).select("instance_id", "label", "slot")


def str03_match_methods(spark, d):
    """Strict, soft, author, year and identifier matches of each verdict (STR03, 04, 07 to 10)."""
    v = verdicts(spark, d)
    return v.select(
        "instance_id", t.strict_match(F.col("m.title"), F.col("x.title")).alias("strict"), t.soft_match(F.col("m.title"), F.col("x.title")).alias("soft"),
        t.author_match(F.col("m.authors"), F.col("x.authors")).alias("authors"), F.coalesce(F.col("m.year") == F.col("x.year"), F.lit(False)).alias("year"),
        t.identifier_match(F.col("m.identifiers.doi"), F.col("x.identifiers.doi")).alias("doi"),
    )


def str15_year_number(spark, d):
    b = table(spark, d, "bib_references", "ref_id", "year")
    return b.select("ref_id", F.nullif(F.regexp_extract("year", r"(1[89]\d{2}|20\d{2})", 1), F.lit("")).try_cast("int").alias("year"))


def str22_latex_text(spark, d):
    doc = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'latex' and text is not null")
    return doc.select("doc_id", F.length(x.clean_latex(F.col("text"))).alias("chars"))


def mth02_jaccard(spark, d):
    v = delivered(spark, d, "claim_text", "surrounding_context")
    j = t.jaccard(r.terms(F.col("claim_text")), r.terms(F.col("surrounding_context")))
    return v.select("instance_id", F.round(F.coalesce(j, F.lit(0.0)), 6).alias("jaccard"))


def arr03_evidence_text(spark, d):
    i = delivered(spark, d, "retrieved_evidences")
    return i.select("instance_id", F.md5(F.coalesce(F.array_join(F.transform("retrieved_evidences.extractive_chunks", lambda c: c["extractive_text"]), "\n"), F.lit(""))).alias("evidence_md5"))


def jsn02_strict_parse(spark, d):
    """Traces that are valid JSON, and those that are not: a reject column, no exception."""
    v = table(spark, d, "verification_instances", "retrieval_traces").where("retrieval_traces is not null")
    return v.groupBy(F.try_parse_json("retrieval_traces").isNotNull().alias("valid")).agg(F.count("*").alias("n"))


def ret05_searched(spark, d):
    """RET05: claim and context of the stated query set each search the passages; of a text met by both the claim's place counts."""
    context = delivered(spark, d, "surrounding_context").select(F.col("instance_id").alias("qid"), F.col("surrounding_context").alias("context"))
    both = claims(spark, d).join(context, "qid", "left").select("scope", "qid", F.posexplode(F.array("query", "context")).alias("o", "query"))
    # a context that says the same as the claim is no second query
    both = both.where("query is not null").groupBy("scope", "qid", "query").agg(F.min("o").alias("o")).withColumn("q", F.struct("qid", "o"))
    p = passages(spark, d)
    found = r.bm25_top(both, p, "scope", "q", "query", "cid", "text", 15).join(p.select("cid", "text"), "cid")
    best = found.groupBy("q.qid", "text").agg(F.min(F.struct("q.o", "rank", "cid")).alias("b")).select("qid", "b.cid", F.col("b.o").alias("query_no"), "b.rank")
    return r.top_k(best, "qid", [F.col("query_no"), F.col("rank")], 30, "place")


def ret08_rerank(spark, d):
    s = top03_bm25(spark, d).join(passages(spark, d).select("cid", "text"), "cid").join(claims(spark, d).select("qid", "query"), "qid")
    return r.rerank(s, None, "query", "text").select("qid", "cid", F.round("rerank_score", 6).alias("rerank_score"))


def neg07_compound(spark, d):
    """Two errors at once: the year moved and the DOI corrupted."""
    c = delivered(spark, d, "citation_metadata").select("instance_id", F.col("citation_metadata").alias("m")).where("m.year is not null and m.identifiers.doi <> ''")
    return c.select("instance_id", perturb.shift_year(F.col("m.year"), F.col("instance_id")).alias("year"), (perturb.corrupt_doi(F.col("m.identifiers.doi"), F.col("instance_id")) != F.col("m.identifiers.doi")).alias("changed"))


def neg09_rewrite_rules(spark, d):
    """Rewrites and why they are refused: unchanged, too short, too long, marker lost, or accepted."""
    i = delivered(spark, d, "claim_text", "surrounding_context").where("claim_text is not null and surrounding_context is not null")
    new = F.split_part("surrounding_context", F.lit(". "), F.lit(1))
    why = (
        F.when(new == F.col("claim_text"), "unchanged").when(F.length(new) < 20, "too_short").when(F.length(new) > 3 * F.length("claim_text"), "too_long")
        .when(F.col("claim_text").contains("[CITATION]") & ~new.contains("[CITATION]"), "marker_lost").otherwise("accepted")
    )
    return i.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def spc03_year_score(spark, d):
    v = verdicts(spark, d).where("m.year is not null and x.year is not null")
    return v.groupBy(scoring.year_score(F.col("m.year"), F.col("x.year")).alias("score")).agg(F.count("*").alias("n"))


def spc08_confidence(spark, d):
    v = verdicts(spark, d).where("confidence is not null")
    return v.select("instance_id", F.round(scoring.confidence(F.col("confidence")), 6).alias("certainty"))


def spc19_ranking(spark, d):
    """P@5, MAP and NDCG of evidence lists: a chunk of the upper half by relevance counts as relevant, ranked by its place."""
    i = delivered(spark, d, "retrieved_evidences").select("instance_id", F.posexplode("retrieved_evidences.extractive_chunks").alias("pos", "c"))
    e = i.select("instance_id", (F.col("pos") + 1).alias("rk"), F.when(F.col("c.relevance_score") >= 0.5, 1).otherwise(0).alias("rel"))
    w = Window.partitionBy("instance_id").orderBy("rk")
    e = e.withColumn("hits", F.sum("rel").over(w))
    g = e.groupBy("instance_id").agg(
        (F.sum(F.when(F.col("rk") <= 5, F.col("rel")).otherwise(0)) / 5.0).alias("p5"), F.coalesce(F.try_divide(F.sum(F.col("rel") * F.col("hits") / F.col("rk")), F.sum("rel")), F.lit(0.0)).alias("ap"),
        F.sum(F.col("rel") / F.log2(F.col("rk") + 1)).alias("dcg"), F.sum("rel").alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1))
    return g.agg(F.round(F.avg("p5"), 5).alias("p_at_5"), F.round(F.avg("ap"), 5).alias("map"), F.round(F.avg(F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0)), 5).alias("ndcg"), F.count("*").alias("lists"))


def tpch_q1(spark, d):
    """Pricing summary of line items: grouped sums and averages over a pushed-down date filter."""
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), F.count("*").alias("n"))


def join_revenue_by_region(spark, d):
    """Line items through orders, customers and nations to regions: the optimizer broadcasts what is small."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    o, c = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer", "c_custkey", "c_nationkey")
    n, g = table(spark, d, "nation", "n_nationkey", "n_regionkey"), table(spark, d, "region", "r_regionkey", "r_name")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), F.count("*").alias("n"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_"}
_NT = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_T2 = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
_TM = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_LAST = "list_distinct(list_transform(list_filter({0}, lambda a: trim(a) <> ''), lambda a: lower(list_extract(string_split(trim(regexp_replace(a, '\\s+', ' ', 'g')), ' '), -1))))"
_JAC = "CASE WHEN len({0}) + len({1}) > 0 THEN len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) ELSE 0 END"
_BARE = "regexp_replace(regexp_replace(lower(trim({0})), '^(https?://)?(dx\\.)?(doi\\.org/|arxiv\\.org/(abs|pdf)/)|^(doi|arxiv):\\s*', ''), 'v\\d+$', '')"
_MATCH = VERDICTS + f", ab AS (SELECT *, {_LAST.format('m.authors')} AS la, {_LAST.format('x.authors')} AS lb FROM v)"
_SOFT = lambda f: f"coalesce(m.{f} <> '' AND x.{f} <> '' AND {_NT.format('m.' + f)} = {_NT.format('x.' + f)}, false)"
_AUTH = f"coalesce({_JAC.format('la', 'lb')} >= 0.75, false)"
_LN = "CASE truth WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' WHEN 2 THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END"
from citeloom.plans.retrieve_q import _Q as _QP, _W as _WORDS  # noqa: E402

_RET05 = D + ", " + _QP + f""", q2 AS (SELECT scope, qid, min(o) AS o, query FROM (SELECT scope, qid, 0 AS o, query FROM q UNION ALL SELECT q.scope, q.qid, 1, d.surrounding_context FROM q JOIN d ON d.instance_id = q.qid) WHERE query IS NOT NULL GROUP BY scope, qid, query),
pw AS (SELECT scope, cid, text, {_WORDS.format('text')} AS w FROM p), sz AS (SELECT scope, count(*) AS n, avg(len(w)) AS al FROM pw GROUP BY 1),
po AS (SELECT scope, cid, len, term, count(*) AS tf FROM (SELECT scope, cid, len(w) AS len, unnest(w) AS term FROM pw) GROUP BY ALL), df AS (SELECT scope, term, count(*) AS df FROM po GROUP BY 1, 2),
qt AS (SELECT scope, qid, o, unnest(list_distinct({_WORDS.format('query')})) AS term FROM q2),
sc AS (SELECT qid, o, cid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score FROM qt JOIN po USING (scope, term) JOIN df USING (scope, term) JOIN sz USING (scope) GROUP BY 1, 2, 3),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid, o ORDER BY score DESC, cid) AS rank FROM sc QUALIFY rank <= 15),
be AS (SELECT qid, text, o, rank, cid FROM bm JOIN (SELECT cid, text FROM pw) USING (cid) QUALIFY row_number() OVER (PARTITION BY qid, text ORDER BY o, rank, cid) = 1)
SELECT qid, cid, o AS query_no, rank, row_number() OVER (PARTITION BY qid ORDER BY o, rank) AS place FROM be QUALIFY place <= 30"""
from citeloom.plans.curate_q import _INTERLEAVED  # noqa: E402

SQL = {
    "j09_aligned": D + ", l AS (SELECT instance_id, extracted_citation AS x FROM verification_instances QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY event_ts DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1), a AS (SELECT d.instance_id, x.authors AS e, unnest(citation_metadata.authors) AS truth, generate_subscripts(citation_metadata.authors, 1) AS position FROM d LEFT JOIN l ON d.instance_id = l.instance_id) SELECT instance_id, position::INTEGER AS position, truth, e[position] AS extracted FROM a",
    "ret05_searched": _RET05,
    "smp05_combined": _INTERLEAVED.format(label="true_outputs.true_alignment"),
    "flt10_existence_two_stage": D + f", q AS (SELECT regexp_replace(nullif(citation_metadata.identifiers.arxiv_id, ''), 'v\\d+$', '') AS aid, nullif({_T2.format('citation_metadata.title')}, '') AS nt FROM d), a AS (SELECT DISTINCT regexp_replace(arxiv_id, 'v\\d+$', '') AS k FROM papers WHERE arxiv_id <> ''), b AS (SELECT DISTINCT {_T2.format('title')} AS k FROM papers) SELECT CASE WHEN a.k IS NOT NULL THEN 'id' WHEN b.k <> '' THEN 'title' ELSE 'none' END AS stage, count(*) AS n FROM q LEFT JOIN a ON a.k = aid LEFT JOIN b ON b.k = nt GROUP BY 1",
    "flt11_first_available": D + ", k AS (SELECT paper_id, min(doc_id) AS doc_id FROM documents WHERE paper_id IS NOT NULL GROUP BY 1) SELECT instance_id, doc_id FROM d JOIN k ON paper_id = original_paper",
    "flt14_misclassified": _PRED + "SELECT model, count(*) AS n, count(*) FILTER (pred IS NULL) AS no_prediction FROM miss GROUP BY 1",
    "flt15_both_known": VERDICTS + "SELECT instance_id, truth, pred FROM v WHERE truth IS NOT NULL AND pred IS NOT NULL",
    "prj01_drop_columns": D + " SELECT instance_id, original_paper, length(claim_text) AS chars FROM d",
    "prj03_positional_path": D + " SELECT instance_id, (row_number() OVER (PARTITION BY original_paper ORDER BY created_at, instance_id) - 1) || '.pdf' AS path FROM d",
    "prj07_build_instances": "SELECT ref_id, paper_id AS original_paper, title, 1 AS existence FROM bib_references WHERE title IS NOT NULL",
    "prj09_drop_nulls": "SELECT ref_id, (year IS NOT NULL)::INTEGER + (journal IS NOT NULL)::INTEGER + (booktitle IS NOT NULL)::INTEGER AS fields FROM bib_references",
    "prj11_verdict_rows": VERDICTS + f"SELECT instance_id, {_LN} AS truth, CASE WHEN pred IS NULL THEN 'ERROR' ELSE {_LN.replace('truth', 'pred')} END AS predicted, coalesce(confidence, 0) AS confidence FROM v",
    "j02_claim_keys": D + f", i AS (SELECT instance_id, original_paper AS p, {_T2.format('citation_metadata.title')} AS nt FROM d), b AS (SELECT ref_id, paper_id AS p, {_T2.format('title')} AS nt FROM bib_references) SELECT instance_id, ref_id FROM i JOIN b USING (p, nt) WHERE trim(nt) <> ''",
    "j12_scoped_join": D + ", k AS (SELECT paper_id, count(*) AS passages FROM bib_references WHERE title IS NOT NULL GROUP BY 1) SELECT instance_id AS qid, coalesce(passages, 0) AS passages FROM d LEFT JOIN k ON paper_id = original_paper WHERE claim_text IS NOT NULL",
    "j13_left_if_exists": D + ", c AS (SELECT true_outputs.true_alignment AS label, count(*) AS n FROM d GROUP BY 1), m AS (SELECT true_alignment AS a, count(*) AS targets FROM sample_targets WHERE true_alignment IS NOT NULL GROUP BY 1) SELECT label, n, targets FROM c LEFT JOIN m ON a = label",
    "win04_retrieval_ranks": D + ", e AS (SELECT instance_id, unnest(retrieved_evidences.extractive_chunks) AS c, generate_subscripts(retrieved_evidences.extractive_chunks, 1) - 1 AS pos FROM d) SELECT instance_id, pos, row_number() OVER (PARTITION BY instance_id ORDER BY c.relevance_score DESC NULLS LAST, pos) AS rank FROM e",
    "top05_best_evidence": D + ", e AS (SELECT instance_id, unnest(retrieved_evidences.extractive_chunks) AS c, generate_subscripts(retrieved_evidences.extractive_chunks, 1) - 1 AS pos FROM d) SELECT instance_id, pos FROM e QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY c.relevance_score DESC NULLS LAST, pos) <= 3",
    "top09_first_instances": D + " SELECT instance_id FROM d ORDER BY created_at, instance_id LIMIT 200",
    "top11_order_restored": D + " SELECT instance_id, row_number() OVER (PARTITION BY created_at::DATE ORDER BY created_at, instance_id) AS place FROM d",
    "set02_concat_sources": "SELECT source_api, count(*) AS n FROM papers GROUP BY 1",
    "set07_common_ids": "SELECT count(DISTINCT instance_id) AS n FROM instances WHERE instance_id IN (SELECT instance_id FROM verification_instances)",
    "str03_match_methods": _MATCH + f" SELECT instance_id, coalesce(m.title = x.title AND m.title <> '', false) AS strict, {_SOFT('title')} AS soft, {_AUTH} AS authors, coalesce(m.year = x.year, false) AS year, coalesce({_BARE.format('m.identifiers.doi')} = {_BARE.format('x.identifiers.doi')} AND {_BARE.format('m.identifiers.doi')} <> '', false) AS doi FROM ab",
    "str15_year_number": "SELECT ref_id, TRY_CAST(nullif(regexp_extract(year, '(1[89]\\d{2}|20\\d{2})', 1), '') AS INTEGER) AS year FROM bib_references",
    "mth02_jaccard": D + f", w AS (SELECT instance_id, list_distinct({_TM.format('claim_text')}) AS a, list_distinct({_TM.format('surrounding_context')}) AS b FROM d) SELECT instance_id, round(coalesce({_JAC.format('a', 'b')}, 0), 6) AS jaccard FROM w",
    "arr03_evidence_text": D + " SELECT instance_id, md5(coalesce(array_to_string(list_filter(list_transform(retrieved_evidences.extractive_chunks, lambda c: c.extractive_text), lambda s: s IS NOT NULL), chr(10)), '')) AS evidence_md5 FROM d",
    "jsn02_strict_parse": "SELECT json_valid(retrieval_traces) AS valid, count(*) AS n FROM verification_instances WHERE retrieval_traces IS NOT NULL GROUP BY 1",
    "ret08_rerank": _BM + f", j AS (SELECT bm.qid, bm.cid, list_distinct({_TM.format('q.query')}) AS a, list_distinct({_TM.format('p.text')}) AS b FROM bm JOIN q USING (qid) JOIN p USING (cid)) SELECT qid, cid, round(coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0), 6) AS rerank_score FROM j",
    "neg09_rewrite_rules": D + ", w AS (SELECT claim_text AS c, split_part(surrounding_context, '. ', 1) AS n FROM d WHERE claim_text IS NOT NULL AND surrounding_context IS NOT NULL) SELECT CASE WHEN n = c THEN 'unchanged' WHEN length(n) < 20 THEN 'too_short' WHEN length(n) > 3 * length(c) THEN 'too_long' WHEN contains(c, '[CITATION]') AND NOT contains(n, '[CITATION]') THEN 'marker_lost' ELSE 'accepted' END AS reason, count(*) AS n FROM w GROUP BY 1",
    "spc03_year_score": VERDICTS + "SELECT CASE abs(m.year - x.year) WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.0 END::DOUBLE AS score, count(*) AS n FROM v WHERE m.year IS NOT NULL AND x.year IS NOT NULL GROUP BY 1",
    "spc08_confidence": VERDICTS + "SELECT instance_id, round(1 - exp(-5 * abs(confidence - 0.8)), 6) AS certainty FROM v WHERE confidence IS NOT NULL",
    "spc19_ranking": D + ", e0 AS (SELECT instance_id, unnest(retrieved_evidences.extractive_chunks) AS c, generate_subscripts(retrieved_evidences.extractive_chunks, 1) AS rk FROM d), e AS (SELECT instance_id, rk, (coalesce(c.relevance_score, 0) >= 0.5)::INTEGER AS rel FROM e0), h AS (SELECT *, sum(rel) OVER (PARTITION BY instance_id ORDER BY rk) AS hits FROM e), g AS (SELECT instance_id, sum(CASE WHEN rk <= 5 THEN rel ELSE 0 END) / 5.0::DOUBLE AS p5, coalesce(sum(rel * hits / rk) / nullif(sum(rel), 0), 0) AS ap, sum(rel / log2(rk + 1)) AS dcg, sum(rel) AS n FROM h GROUP BY 1), i AS (SELECT *, CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n::BIGINT + 1), lambda k: 1 / log2(k + 1))) ELSE 0 END AS nd FROM g) SELECT round(avg(p5), 5) AS p_at_5, round(avg(ap), 5) AS map, round(avg(nd), 5) AS ndcg, count(*) AS lists FROM i",
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "join_revenue_by_region": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
}
