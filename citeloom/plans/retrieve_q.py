"""Queries: chunking, lexical and dense retrieval, fusion and evidence assembly. Claims search the texts of their own paper."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions import hooks
from citeloom.functions import text as t
from citeloom.operators import retrieve as r
from citeloom.plans.p_core import delivered
from citeloom.session import checkpointed, scratch, table

D = "WITH d AS (SELECT * FROM instances WHERE instance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY loaded_at DESC) = 1)"


def claims(spark, d):
    """Claims of every twentieth instance (by hash of its id), the stated query set, against all references of their paper."""
    i = delivered(spark, d, "claim_text", "original_paper").where("claim_text is not null")
    return i.where(F.pmod(F.conv(F.substring(F.md5("instance_id"), 1, 6), 16, 10).cast("bigint"), F.lit(20)) == 0).select(F.col("original_paper").alias("scope"), F.col("instance_id").alias("qid"), F.col("claim_text").alias("query"))


def passages(spark, d):
    b = table(spark, d, "bib_references", "ref_id", "paper_id", "title").where("title is not null")
    return b.select(F.col("paper_id").alias("scope"), F.col("ref_id").alias("cid"), F.col("title").alias("text"))


_Q = "q AS (SELECT original_paper AS scope, instance_id AS qid, claim_text AS query FROM d WHERE claim_text IS NOT NULL AND ('0x' || substr(md5(instance_id), 1, 6))::BIGINT % 20 = 0), p AS (SELECT paper_id AS scope, ref_id AS cid, title AS text FROM bib_references WHERE title IS NOT NULL)"
_W = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_BM = D + ", " + _Q + f""", pw AS (SELECT scope, cid, {_W.format('text')} AS w FROM p), sz AS (SELECT scope, count(*) AS n, avg(len(w)) AS al FROM pw GROUP BY 1),
po AS (SELECT scope, cid, len, term, count(*) AS tf FROM (SELECT scope, cid, len(w) AS len, unnest(w) AS term FROM pw) GROUP BY ALL), df AS (SELECT scope, term, count(*) AS df FROM po GROUP BY 1, 2),
qt AS (SELECT scope, qid, unnest(list_distinct({_W.format('query')})) AS term FROM q),
sc AS (SELECT qid, cid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score FROM qt JOIN po USING (scope, term) JOIN df USING (scope, term) JOIN sz USING (scope) GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM sc QUALIFY rank <= 15),
ov AS (SELECT qid, cid, count(*) AS score FROM qt JOIN po USING (scope, term) GROUP BY 1, 2),
lx AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM ov QUALIFY rank <= 15)
"""


def top03_bm25(spark, d):
    return r.bm25_top(claims(spark, d), passages(spark, d), "scope", "qid", "query", "cid", "text", 15)


def overlap(spark, d):
    """A second lexical ranker: how many distinct terms of the claim a passage holds."""
    q = claims(spark, d).select("scope", "qid", F.explode(F.array_distinct(r.terms(F.col("query")))).alias("term"))
    p = passages(spark, d).select("scope", "cid", F.explode(F.array_distinct(r.terms(F.col("text")))).alias("term"))
    s = q.join(p, ["scope", "term"]).groupBy("qid", "cid").agg(F.count("*").alias("score"))
    return r.top_k(s, "qid", [F.desc("score"), F.col("cid")], 15)


def ret06_rrf(spark, d):
    return _fused(top03_bm25(spark, d), overlap(spark, d))


def _fused(a, b):
    f = r.rrf(a, b, "qid", "cid")
    return r.top_k(f, "qid", [F.desc("score"), F.asc_nulls_last("ra"), F.asc_nulls_last("rb")], 15).select("qid", "cid", F.round("score", 9).alias("score"), "rank")


def traces(spark, d):
    """(qid, stage, rank, chunk_id, score): what each stage of a retrieval found, the sparse ranking, the overlap and their fusion."""
    row = lambda df, stage: df.select("qid", F.lit(stage).alias("stage"), F.col("rank").cast("int").alias("rank"), F.col("cid").cast("string").alias("chunk_id"), F.col("score").cast("double").alias("score"))
    sparse, other = checkpointed(top03_bm25(spark, d)), checkpointed(overlap(spark, d))
    return row(sparse, "sparse").unionAll(row(other, "overlap")).unionAll(row(_fused(sparse, other), "fused"))


def ret07_quota_fusion(spark, d):
    p = passages(spark, d).select("cid", "text")
    a, b = top03_bm25(spark, d).join(p, "cid"), overlap(spark, d).join(p, "cid")
    n = F.size(r.terms(F.col("query")))
    ws = F.when(n <= 8, 0.75).when(n <= 14, 0.60).when(n <= 24, 0.45).otherwise(0.35)
    w = claims(spark, d).select("qid", ws.alias("wa"), F.round(1 - ws, 2).alias("wb"))
    return r.quota_fusion(a, b, "qid", "text", w, 6)


def str25_retrieval_weights(spark, d):
    """Sparse and dense weights of each claim, by its length, its marks and its words."""
    i = delivered(spark, d, "claim_text").where("claim_text is not null")
    n = F.size(F.regexp_extract_all("claim_text", F.lit(r"\b([a-zA-Z0-9-]+)\b"), F.lit(1)))
    w = F.when(n <= 8, 0.75).when(n <= 14, 0.60).when(n <= 24, 0.45).otherwise(0.35)
    low = F.lower("claim_text")
    w = F.when(low.rlike(r"\[citation\]|<cit\.|<cit>"), F.least(F.lit(0.80), w + 0.05)).otherwise(w)
    w = F.when(low.rlike("include|common strategies|approach|methods"), F.least(F.lit(0.85), w + 0.10)).otherwise(w)
    return i.select("instance_id", F.round(w, 2).alias("sparse"), F.round(1 - F.round(w, 2), 2).alias("dense"))


def ret09_hybrid(spark, d):
    """The whole retrieval: two rankers, fusion, rerank, threshold, the three best; claims without evidence stay with none."""
    f = ret06_rrf(spark, d).join(passages(spark, d).select("cid", "text"), "cid").join(claims(spark, d).select("qid", "query"), "qid")
    s = r.rerank(f, None, "query", "text").withColumn("rerank_score", F.round("rerank_score", 6))
    best = r.top_k(s, "qid", [F.desc("rerank_score"), F.col("rank")], 3, "place").where("rerank_score >= 0.3")
    e = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "cid"))).alias("e"))
    return claims(spark, d).join(e, "qid", "left").select("qid", F.coalesce(F.array_join(F.transform("e", lambda x: x["cid"].cast("string")), ","), F.lit("")).alias("evidence"))


def document_chunks(spark, d, scopes):
    """(scope, cid, text): the chunks of the documents of these papers, split at headers and recursively, within their papers; written once, compressed."""
    docs = table(spark, d, "documents", "doc_id", "paper_id", "text").where("paper_id is not null and text is not null").withColumnRenamed("paper_id", "scope").join(scopes, "scope", "left_semi")
    c = r.header_chunks(docs.select(F.struct("scope", "doc_id").alias("at"), "text"), "at", "text")
    path = scratch(spark, "chunks")
    c.select("at.scope", F.concat_ws("_chunk_", "at.doc_id", "chunk_no").alias("cid"), F.col("chunk").alias("text")).write.parquet(path)
    return spark.read.parquet(path)


def ret02_header_chunks(spark, d):
    """Documents split at headers, which stay with their text, then recursively: 750 characters with 150 of overlap."""
    c = r.header_chunks(table(spark, d, "documents", "doc_id", "text").where("text is not null"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.countDistinct("header").alias("headers"), F.max(F.length("chunk")).alias("longest"))


def ret09_chunks(spark, d):
    """The whole retrieval over chunks of documents: BM25 and embeddings (the offline hasher), fusion, rerank from 0.2 on, the three best; the stated query set of claims."""
    q = checkpointed(claims(spark, d))
    c = document_chunks(spark, d, q.select("scope"))
    return r.hybrid(q, c, "scope", "qid", "query", "cid", "text", hooks.embed, least=0.2, model=hooks.hashing_embedder)


def top01_dense(spark, d):
    """Query set: every vector whose id is divisible by 20, against all vectors of its label."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("label").alias("scope"), F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return r.dense(q, e.select(F.col("label").alias("scope"), F.col("vec_id").alias("cid"), F.col("embedding").alias("v")), "scope", "qid", "cid", "v", 15).select("qid", "cid", F.round("score", 5).alias("score"), "rank")


def mth01_cosine(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    mean = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(mean, "label").select("vec_id", F.round(t.cosine(F.col("embedding"), F.col("first")), 5).alias("cosine"))


def ret01_header_sections(spark, d):
    m = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'markdown' and text is not null")
    s = r.header_sections(m, "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count_if(F.col("header") != "").alias("sections"), F.sum(F.length("header")).alias("header_chars"))


def ret02_chunks(spark, d):
    """Recursive splitter, 750 characters with 150 of overlap: chunks and their lengths for each document."""
    c = r.chunk(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 750, 150)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"))


def ret03_chunks_small(spark, d):
    c = r.chunk(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 512, 50)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"))


def ret11_missing_documents(spark, d):
    """Claims whose paper has no document keep an empty evidence row."""
    docs = table(spark, d, "documents", "paper_id").where("paper_id is not null").groupBy(F.col("paper_id").alias("original_paper")).agg(F.count("*").alias("docs"))
    return delivered(spark, d, "original_paper").join(docs, "original_paper", "left").groupBy(F.coalesce("docs", F.lit(0)).alias("docs")).agg(F.count("*").alias("claims"))


def ret12_synthesis(spark, d):
    i = delivered(spark, d, "retrieved_evidences")
    s = F.nullif(F.trim("retrieved_evidences.abstractive_synthesis"), F.lit("NO_EVIDENCE"))
    return i.select("instance_id", F.nullif(s, F.lit("")).alias("synthesis"))


def str36_evidence_block(spark, d):
    """The first five chunks of 500 characters, each with its score to four places or N/A."""
    i = delivered(spark, d, "retrieved_evidences").where("size(retrieved_evidences.extractive_chunks) > 0")
    line = lambda c, j: F.concat(F.lit("["), (j + 1).cast("string"), F.lit("] ("), F.coalesce(F.format_string("%.4f", c["relevance_score"]), F.lit("N/A")), F.lit(") "), F.substring(F.coalesce(c["extractive_text"], F.lit("")), 1, 500))
    return i.select("instance_id", F.array_join(F.transform(F.slice("retrieved_evidences.extractive_chunks", 1, 5), line), "\n").alias("block"))


QUERIES = {f.__name__: f for f in [top03_bm25, ret06_rrf, ret07_quota_fusion, str25_retrieval_weights, ret09_hybrid, top01_dense, mth01_cosine, ret01_header_sections, ret02_header_chunks, ret09_chunks, ret02_chunks, ret03_chunks_small, ret11_missing_documents, ret12_synthesis, str36_evidence_block]}
_RRF = _BM + ", f AS (SELECT qid, cid, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS s, a.rank AS ra, b.rank AS rb FROM bm a FULL JOIN lx b USING (qid, cid)), rf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM f QUALIFY rank <= 15)"
TRACES_SQL = _RRF + " SELECT qid, 'sparse' AS stage, rank, cid::VARCHAR AS chunk_id, score FROM bm UNION ALL SELECT qid, 'overlap', rank, cid::VARCHAR, score FROM lx UNION ALL SELECT qid, 'fused', rank, cid::VARCHAR, round(s, 9) FROM rf"
SQL = {
    "top03_bm25": _BM + " SELECT * FROM bm",
    "ret06_rrf": _RRF + " SELECT qid, cid, round(s, 9) AS score, rank FROM rf",
    "str25_retrieval_weights": D + r", n AS (SELECT instance_id, lower(claim_text) AS c, len(regexp_extract_all(claim_text, '\b([a-zA-Z0-9-]+)\b')) AS n FROM d WHERE claim_text IS NOT NULL), w AS (SELECT *, CASE WHEN n <= 8 THEN 0.75 WHEN n <= 14 THEN 0.60 WHEN n <= 24 THEN 0.45 ELSE 0.35 END AS w FROM n), x AS (SELECT *, CASE WHEN regexp_matches(c, '\[citation\]|<cit\.|<cit>') THEN least(0.80, w + 0.05) ELSE w END AS w1 FROM w), y AS (SELECT *, CASE WHEN regexp_matches(c, 'include|common strategies|approach|methods') THEN least(0.85, w1 + 0.10) ELSE w1 END AS w2 FROM x) SELECT instance_id, round(w2, 2)::DOUBLE AS sparse, round(1 - w2, 2)::DOUBLE AS dense FROM y",
    "ret09_hybrid": _RRF + f", j AS (SELECT rf.qid, rf.cid, rf.rank, {_W.format('q.query')} AS a, {_W.format('p.text')} AS b FROM rf JOIN q USING (qid) JOIN p USING (cid)), s AS (SELECT qid, cid, rank, round(coalesce(len(list_intersect(list_distinct(a), list_distinct(b))) / nullif(len(list_distinct(a)), 0), 0), 6) AS rs FROM j), b3 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rs DESC, rank) AS place FROM s QUALIFY place <= 3), e AS (SELECT qid, string_agg(cid::VARCHAR, ',' ORDER BY place) AS e FROM b3 WHERE rs >= 0.3 GROUP BY 1) SELECT q.qid, coalesce(e, '') AS evidence FROM q LEFT JOIN e USING (qid)",
    "top01_dense": "WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS cid, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 20 = 0) SELECT qid, cid, round(s, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS rank FROM s QUALIFY rank <= 15",
    "mth01_cosine": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS f FROM embeddings GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], f::DOUBLE[]), 5) AS cosine FROM embeddings JOIN f USING (label)",
    "ret01_header_sections": r"WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents WHERE source = 'markdown' AND text IS NOT NULL), h AS (SELECT doc_id, regexp_extract(line, '^#{1,3}\s+(.*)', 1) AS h FROM l WHERE regexp_matches(line, '^#{1,3}\s')) SELECT d.doc_id, count(*) FILTER (h <> '') AS sections, coalesce(sum(length(h)), 0)::BIGINT AS header_chars FROM (SELECT DISTINCT doc_id FROM documents WHERE source = 'markdown' AND text IS NOT NULL AND regexp_replace(text, '\s', '', 'g') <> '') d LEFT JOIN h USING (doc_id) GROUP BY 1",
    "ret11_missing_documents": D + ", k AS (SELECT paper_id, count(*) AS docs FROM documents WHERE paper_id IS NOT NULL GROUP BY 1) SELECT coalesce(docs, 0) AS docs, count(*) AS claims FROM d LEFT JOIN k ON paper_id = original_paper GROUP BY 1",
    "ret12_synthesis": D + " SELECT instance_id, nullif(nullif(trim(retrieved_evidences.abstractive_synthesis), 'NO_EVIDENCE'), '') AS synthesis FROM d",
    "str36_evidence_block": D + r", e AS (SELECT instance_id, unnest(retrieved_evidences.extractive_chunks) AS c, generate_subscripts(retrieved_evidences.extractive_chunks, 1) AS j FROM d) SELECT instance_id, string_agg('[' || j || '] (' || coalesce(printf('%.4f', c.relevance_score), 'N/A') || ') ' || substr(coalesce(c.extractive_text, ''), 1, 500), chr(10) ORDER BY j) AS block FROM e WHERE j <= 5 GROUP BY 1",
}
