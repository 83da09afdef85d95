"""Retrieval: chunks, postings, BM25, dense top-k, rank fusion, quota fusion and a hook for rerankers.

Our BM25: lower-case word tokens, k1 = 1.5, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)) over the chunks searched; the score
of a chunk is the sum over the distinct terms of the query. Scores come from a join of query terms with postings; chunks that
share no term with a query are never met.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.session import checkpointed, salted_lookup

#: Separators of the recursive splitter, coarse to fine; '' splits anywhere.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")


#: Blocks over which chunks are spread, so that no scope and no word is met in one task.
BLOCKS = 16


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, parted at the coarsest separator that does; consecutive pieces share up to `overlap`."""

    def parts(s: str, seps: tuple[str, ...]) -> Iterator[str]:
        if len(s) <= size:
            yield s
            return
        sep = next((x for x in seps if x == "" or x in s), "")
        rest = seps[seps.index(sep) + 1 :] if sep in seps else ()
        if sep == "":
            yield from (s[i : i + size] for i in range(0, len(s), size))
            return
        bits = s.split(sep)
        for i, b in enumerate(bits):
            b = b + sep if i < len(bits) - 1 else b
            yield from parts(b, rest) if len(b) > size else (b,)

    out: list[str] = []
    window: list[str] = []
    length = 0
    for p in parts(text, separators):
        if window and length + len(p) > size:
            out.append("".join(window).strip())
            while window and (length > overlap or length + len(p) > size):
                length -= len(window.pop(0))
        window.append(p)
        length += len(p)
    if window:
        out.append("".join(window).strip())
    return [x for x in out if x]


def chunk(df: DataFrame, key: str, text: str, size: int = 750, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(key, chunk_no, chunk): the pieces of every text, numbered from 0; null and blank texts have none."""
    d = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = d.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, no, out = [], [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                for j, c in enumerate(split_text(s, size, overlap, separators) if s else ()):
                    rows.append(i)
                    no.append(j)
                    out.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(out, pa.string())], ["k", "chunk_no", "chunk"])

    return d.mapInArrow(run, f"k {kind}, chunk_no int, chunk string").withColumnRenamed("k", key)


def _sections(text: Column) -> Column:
    """The sections of a Markdown text as (section_no, header, body)."""
    blocks = F.split(F.concat(F.lit("\n"), F.array_join(F.split(text, r"\r?\n"), "\n")), r"\n(?=#{1,3}\s)")
    header = lambda s: F.regexp_extract(s, r"^#{1,3}\s+([^\n]*)", 1)
    body = lambda s: F.regexp_replace(F.regexp_replace(s, r"^#{1,3}\s+[^\n]*\n?", ""), r"^\s+|\s+$", "")
    return F.filter(F.transform(blocks, lambda s, i: F.struct(i.alias("section_no"), header(s).alias("header"), body(s).alias("body"))), lambda x: (x["header"] != "") | (x["body"] != ""))


def header_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, header, body): Markdown split at headers of levels 1 to 3; text before the first header has header ''.

    Higher-order functions keep it in the row: no shuffle, whatever the length of the text.
    """
    return df.select(key, F.explode(_sections(F.col(text))).alias("x")).select(key, "x.section_no", "x.header", "x.body")


def header_chunks(df: DataFrame, key: str, text: str, size: int = 750, overlap: int = 150) -> DataFrame:
    """(key, chunk_no, header, chunk): Markdown split at its headers, which stay with their text, then recursively; numbered through the row's text, without a shuffle."""
    whole = lambda s: F.when(s["header"] != "", F.concat_ws("\n", s["header"], F.nullif(s["body"], F.lit("")))).otherwise(s["body"])
    d = df.select(F.col(key).alias("k"), F.transform(_sections(F.col(text)), lambda s: F.struct(s["header"].alias("header"), whole(s).alias("w"))).alias("s"))
    kind = d.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, no, heads, out = [], [], [], []
            for i, sections in enumerate(b.column(1).to_pylist()):
                pieces = [(x["header"], c) for x in sections or () if x["w"] for c in split_text(x["w"], size, overlap)]
                rows += [i] * len(pieces)
                no += range(len(pieces))
                heads += [h for h, _ in pieces]
                out += [c for _, c in pieces]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(heads, pa.string()), pa.array(out, pa.string())], ["k", "chunk_no", "header", "chunk"])

    return d.mapInArrow(run, f"k {kind}, chunk_no int, header string, chunk string").withColumnRenamed("k", key)


def hybrid(queries: DataFrame, chunks: DataFrame, scope: str, qid: str, query: str, cid: str, text: str, embedder, k: int = 15, least: float = 0.0, most: int = 3, score=None, model=None, block: int = 10_000) -> DataFrame:
    """(qid, cid, place, fused, rerank_score): sparse and dense rankings of k, fused by reciprocal ranks, reranked, kept from `least` on, at most `most`.

    embedder turns texts into vectors (hooks.embed); with model (texts -> vectors) those of the chunks are made where they are compared and never moved.
    score reranks (query, text), without one the share of the query's terms. Queries meet the chunks of their scope in blocks of about `block`, which give
    their best k of either ranking; pairs are scored in the block and not moved.
    """
    vectors = lambda df, key, c: df.join(embedder(df, key, c).withColumnRenamed("embedding", "__v"), key)
    stats = checkpointed(corpus_stats(chunks, scope, text).withColumn("__blocks", F.ceil(F.col("n") / block).cast("int")))
    big = F.broadcast(checkpointed(stats.where("__blocks > 1").select(scope, "__blocks")))  # one scope for `block` chunks at most
    # how often a term occurs is known inside a block only if that is the whole scope
    df = chunks.join(big, scope).select(scope, F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy(scope, "term").agg(F.count("*").alias("df"))
    asked = checkpointed(queries.select(scope, qid, query))
    of = asked.select(scope, qid, F.explode(F.array_distinct(terms(F.col(query)))).alias("term")).join(df, [scope, "term"], "left")
    of = of.groupBy(qid).agg(F.collect_list(F.struct("term", F.coalesce("df", F.lit(0)).alias("df"))).alias("__terms"))
    q = vectors(asked.join(stats, scope), qid, query).join(of, qid, "left")
    q = q.select(scope, qid, "__terms", "__v", "n", "avg_len", F.col("__blocks").alias("__of"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"))
    c = chunks.select(scope, cid, text) if model else vectors(chunks.select(scope, cid, text), cid, text)
    c = c.join(big, scope, "left").withColumn("__block", F.coalesce(F.pmod(F.xxhash64(cid), F.col("__blocks")), F.lit(0)).cast("int")).drop("__blocks")
    kinds = {x: d.schema[x].dataType.simpleString() for d, x in ((queries, qid), (chunks, cid))}
    found = q.groupBy(scope, "__block").cogroup(c.groupBy(scope, "__block")).applyInArrow(_in_block(qid, cid, text, k, model), f"`{qid}` {kinds[qid]}, `{cid}` {kinds[cid]}, dense int, score double, share double")
    w = Window.partitionBy(qid, "dense").orderBy(F.desc("score"), F.col(cid))
    found = found.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) & ((F.col("dense") == 0) | (F.col("score") > 0)))
    f = found.groupBy(qid, cid).agg(F.max(F.when(F.col("dense") == 0, F.col("r"))).alias("ra"), F.max(F.when(F.col("dense") == 1, F.col("r"))).alias("rb"), F.max("share").alias("share"))
    f = top_k(f.withColumn("fused", F.round(_reciprocal("ra") + _reciprocal("rb"), 9)), qid, [F.desc("fused"), F.asc_nulls_last("ra"), F.asc_nulls_last("rb"), F.col(cid)], k)
    if score:
        f = rerank(f.join(chunks.select(cid, text), cid).join(asked.select(qid, query), qid), score, query, text)
    else:
        f = f.withColumn("rerank_score", F.col("share"))
    s = f.withColumn("rerank_score", F.round("rerank_score", 6)).where(F.col("rerank_score") >= least)
    return top_k(s, qid, [F.desc("rerank_score"), F.col("rank")], most, "place").select(qid, cid, "place", "fused", "rerank_score")


def _in_block(qid: str, cid: str, text: str, k: int, model, k1: float = 1.5, b: float = 0.75) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of the queries and the chunks of one block the k best pairs of each query by BM25 (dense = 0) and by cosine (dense = 1), ties by cid."""

    def best(scores: np.ndarray, among: np.ndarray) -> np.ndarray:
        if len(among) > k:
            least = -np.partition(-scores[among], k - 1)[k - 1]
            among = among[scores[among] >= least]
        return among[np.argsort(-scores[among], kind="stable")[:k]]

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        names, kinds = [qid, cid, "dense", "score", "share"], [q.schema.field(qid).type, c.schema.field(cid).type, pa.int32(), pa.float64(), pa.float64()]
        if not q.num_rows or not c.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        ids = c[cid].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))  # so that ties go by place
        texts = c[text].to_pylist()
        texts = [texts[i] or "" for i in order]
        asked = [[(x["term"], x["df"]) for x in ts or ()] for ts in q["__terms"].to_pylist()]
        posts: dict[str, tuple[list[int], list[int]]] = {t: ([], []) for ts in asked for t, _ in ts}
        sizes = np.zeros(len(texts))
        for i, s in enumerate(texts):
            words = re.findall("[a-z0-9]+", s.lower())
            sizes[i] = len(words)
            for w, tf in Counter(words).items():
                if w in posts:
                    posts[w][0].append(i)
                    posts[w][1].append(tf)
        n, mean, whole = q["n"][0].as_py(), q["avg_len"][0].as_py(), q["__of"][0].as_py() == 1
        norm = k1 * (1 - b + b * sizes / mean) if mean else sizes
        dfs = {t: len(posts[t][0]) if whole else df for ts in asked for t, df in ts}
        weights = {}
        for t, (at, tf) in posts.items():
            at, tf = np.array(at, np.int64), np.array(tf, np.float64)
            weights[t] = at, np.log(1 + (n - dfs[t] + 0.5) / (dfs[t] + 0.5)) * tf * (k1 + 1) / (tf + norm[at])
        if model:
            each = dict.fromkeys(texts)
            made = np.array(model(list(each)), np.float32).astype(np.float64)
            number = {s: i for i, s in enumerate(each)}
            cv = made[[number[s] for s in texts]]
        else:
            cv = np.array(c["__v"].to_pylist(), np.float64)[order]
        qv = np.array(q["__v"].to_pylist(), np.float64)
        lengths = np.sqrt((qv * qv).sum(1)), np.sqrt((cv * cv).sum(1))
        every, rows = np.arange(len(texts)), []
        for j, ts in enumerate(asked):
            total, hits = np.zeros(len(texts)), np.zeros(len(texts), np.int32)
            for t, _ in ts:
                at, w = weights[t]
                total[at] += w
                hits[at] += 1
            length = lengths[0][j] * lengths[1]
            near = np.where(length > 0, cv @ qv[j] / np.where(length > 0, length, 1), 0.0)
            for dense, scores, among in ((0, total.round(6), hits.nonzero()[0]), (1, near.round(9), every)):
                rows += [(j, order[i], dense, scores[i], hits[i] / max(len(ts), 1)) for i in best(scores, among)]
        j, i, *rest = zip(*rows, strict=True)
        return pa.table([q[qid].take(pa.array(j)), c[cid].take(pa.array(i)), *(pa.array(list(v), t) for v, t in zip(rest, kinds[2:], strict=True))], names)

    return run


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")


def postings(chunks: DataFrame, scope: str, cid: str, text: str) -> DataFrame:
    """(scope, cid, term, tf, len): term counts of every chunk and its length."""
    d = chunks.select(scope, cid, terms(F.col(text)).alias("w")).withColumn("len", F.size("w"))
    return d.select(scope, cid, "len", F.explode("w").alias("term")).groupBy(scope, cid, "len", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, chunks: DataFrame, scope: str, qid: str, query: str, cid: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, cid, score): chunks of the query's scope that share a term with it."""
    post = checkpointed(postings(chunks, scope, cid, text))
    return bm25_search(queries, post, corpus_stats(chunks, scope, text), scope, qid, query, cid, k1, b)


def bm25_top(queries: DataFrame, chunks: DataFrame, scope: str, qid: str, query: str, cid: str, text: str, k: int) -> DataFrame:
    """(qid, cid, score, rank): the k best chunks of each query by bm25 rounded to six places, ties by cid.

    Queries go by number while their scores are added up, which is where most rows are moved; ids come back with the best.
    """
    # a query's number is that of its row in the written table, so it is the same wherever it is read
    numbered = checkpointed(queries.select(scope, F.col(qid).alias("__id"), query).withColumn("__q", F.monotonically_increasing_id()))
    s = bm25(numbered.select(scope, "__q", query), chunks, scope, "__q", query, cid, text).withColumn("score", F.round("score", 6))
    best = top_k(s, "__q", [F.desc("score"), F.col(cid)], k)
    return best.join(numbered.select("__q", "__id"), "__q").select(F.col("__id").alias(qid), cid, "score", "rank")


def corpus_stats(chunks: DataFrame, scope: str, text: str) -> DataFrame:
    """(scope, n, avg_len): the number of chunks of each scope and their mean length."""
    return chunks.select(scope, F.size(terms(F.col(text))).alias("len")).groupBy(scope).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def bm25_search(queries: DataFrame, post: DataFrame, stats: DataFrame, scope: str, qid: str, query: str, cid: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """bm25 on postings made once for many searches.

    What a term weighs is put beside the query's terms, which are few, before they meet the postings. Postings are spread over BLOCKS by a
    hash of the chunk and query terms copied to each, so that a common word of a large scope is met in many tasks.
    """
    df = post.groupBy(scope, "term").agg(F.count("*").alias("df"))
    q = queries.select(scope, qid, F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    q = salted_lookup(q, stats.withColumn("__n", F.col("n")), scope, "term", "__n").join(df, [scope, "term"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = q.select(scope, qid, "term", "avg_len", idf.alias("idf"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("__block"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return q.join(blocked(post, cid), [scope, "term", "__block"]).groupBy(qid, cid).agg(F.sum(part).alias("score"))


def blocked(chunks: DataFrame, cid: str) -> DataFrame:
    """chunks with `__block`, by a hash of their id."""
    return chunks.withColumn("__block", F.pmod(F.xxhash64(cid), F.lit(BLOCKS)).cast("int"))


def top_k(scored: DataFrame, qid: str, order: list, k: int, name: str = "rank") -> DataFrame:
    """Ranks from 1 to k within each query, by a total order."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(qid).orderBy(*order))).where(F.col(name) <= k)


def dense(queries: DataFrame, chunks: DataFrame, scope: str, qid: str, cid: str, vec: str, k: int) -> DataFrame:
    """(qid, cid, score, rank): the k most similar vectors within the query's scope, exactly.

    The queries are a stated set; they meet the vectors block by block, and each block keeps its best k before the blocks are merged.
    """
    c = blocked(chunks.select(scope, cid, F.col(vec).alias("__c")), cid)
    q = queries.select(scope, qid, F.col(vec).alias("__q"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("__block"))
    s = q.join(c, [scope, "__block"]).select(qid, cid, "__block", F.round(t.cosine(F.col("__q"), F.col("__c")), 9).alias("score"))
    best = s.withColumn("__r", F.row_number().over(Window.partitionBy(qid, "__block").orderBy(F.desc("score"), F.col(cid)))).where(F.col("__r") <= k)
    return top_k(best.select(qid, cid, "score"), qid, [F.desc("score"), F.col(cid)], k)


def rrf(a: DataFrame, b: DataFrame, qid: str, cid: str, k: int = 60) -> DataFrame:
    """(qid, cid, score, ra, rb): reciprocal rank fusion of two ranked lists (qid, cid, rank from 1); both terms in one expression."""
    x = a.select(qid, cid, F.col("rank").alias("ra"))
    y = b.select(qid, cid, F.col("rank").alias("rb"))
    return x.join(y, [qid, cid], "full_outer").withColumn("score", _reciprocal("ra", k) + _reciprocal("rb", k))


def _reciprocal(rank: str, k: int = 60) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))


def quota_fusion(a: DataFrame, b: DataFrame, qid: str, text: str, weights: DataFrame, most: int) -> DataFrame:
    """(qid, text, source, place): quotas by weight, slack to the dominant list first, repeated texts skipped, topped up to `most`.

    a and b: (qid, text, rank from 1); weights: (qid, wa, wb). Equal weights favour a.
    """
    n = lambda d, name: d.groupBy(qid).agg(F.count("*").alias(name))
    w = weights.join(n(a, "na"), qid, "left").join(n(b, "nb"), qid, "left").na.fill(0, ["na", "nb"])
    share = F.col("wa") / (F.col("wa") + F.col("wb"))
    qa = F.bround(F.lit(most) * share, 0).cast("int")
    w = w.withColumn("qa0", F.least(qa, F.col("na"))).withColumn("qb0", F.least(F.lit(most) - qa, F.col("nb")))
    lead = F.col("wa") >= F.col("wb")
    slack = F.lit(most) - F.col("qa0") - F.col("qb0")
    ra, rb = F.col("na") - F.col("qa0"), F.col("nb") - F.col("qb0")
    to_a = F.when(lead, F.least(slack, ra)).otherwise(F.least(slack - F.least(slack, rb), ra))
    to_b = F.when(lead, F.least(slack - F.least(slack, ra), rb)).otherwise(F.least(slack, rb))
    w = w.select(qid, (F.col("qa0") + to_a).alias("qa"), (F.col("qb0") + to_b).alias("qb"), lead.alias("lead_a"))
    both = a.select(qid, F.col(text).alias("text"), "rank", F.lit("a").alias("source")).unionAll(b.select(qid, F.col(text).alias("text"), "rank", F.lit("b").alias("source"))).join(w, qid)
    leads = (F.col("source") == "a") == F.col("lead_a")
    inside = F.col("rank") <= F.when(F.col("source") == "a", F.col("qa")).otherwise(F.col("qb"))
    tier = F.when(inside & leads, 0).when(inside, 1).when(leads, 2).otherwise(3)
    first = both.groupBy(qid, "text").agg(F.min(F.struct(tier.alias("tier"), "rank", "source")).alias("f"))
    return top_k(first, qid, [F.col("f.tier"), F.col("f.rank"), F.col("f.source")], most, "place").select(qid, "text", "f.source", "place")


def rerank(pairs: DataFrame, score: Callable[[Column, Column], Column] | None, query: str, text: str) -> DataFrame:
    """pairs with `rerank_score`; without a scorer the share of the query's terms that the text holds."""
    lexical = lambda q, c: F.coalesce(F.size(F.array_intersect(terms(q), terms(c))) / F.nullif(F.size(F.array_distinct(terms(q))), F.lit(0)), F.lit(0.0))
    return pairs.withColumn("rerank_score", (score or lexical)(F.col(query), F.col(text)))
