"""Queries: predicates, projections, joins, ranking, set operations and sampling on the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.operators import curate, ranking
from citeloom.operators.ranking import rank_within
from citeloom.plans.p_core import delivered
from citeloom.session import checkpointed, table

D = "WITH d AS (SELECT * FROM instances WHERE instance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY loaded_at DESC) = 1)"


def cited(spark, d, *more):
    i = delivered(spark, d, "citation_metadata", *more)
    return i.select("instance_id", "citation_metadata.title", "citation_metadata.authors", "citation_metadata.venue", "citation_metadata.year", F.col("citation_metadata.identifiers").alias("ids"), *more)


def _required():
    return curate.has_required(F.col("title"), F.col("venue"), F.col("year"), F.col("authors"))


def flt01_required(spark, d):
    """Rows with title, venue, year and an author; snk11: the complement is the other half."""
    c = cited(spark, d)
    kept, rejected = curate.split(c, _required())
    return kept.select("instance_id", F.lit(True).alias("kept")).unionAll(rejected.select("instance_id", F.lit(False)))


def flt02_not_preprint(spark, d):
    return cited(spark, d).where(curate.not_preprint(F.col("venue"), F.col("authors"))).select("instance_id")


def flt03_claim_in_context(spark, d):
    i = delivered(spark, d, "claim_text", "surrounding_context")
    return i.where(curate.claim_in_context(F.col("claim_text"), F.col("surrounding_context"))).select("instance_id")


def flt04_combined_cleaner(spark, d):
    """The four cleaning steps in one pass: how many rows each rejects."""
    c = cited(spark, d, "claim_text", "surrounding_context")
    steps = [
        ("required", _required()), ("preprint", ~F.coalesce(F.lower("venue").contains("arxiv"), F.lit(False))),
        ("authors", F.size("authors") < 10), ("context", curate.claim_in_context(F.col("claim_text"), F.col("surrounding_context"))),
    ]
    return curate.clean_steps(c, steps).groupBy(F.coalesce("rejected_by", F.lit("kept")).alias("step")).agg(F.count("*").alias("n"))


LATEX_MARKS = ["\\begin", "\\end", "\\section", "\\label", "\\ref", "\\includegraphics", "\\caption", "\\item", "\\footnote"]


def valid_claim(c):
    bad = F.lit(False)
    for m in LATEX_MARKS:
        bad = bad | c.contains(m)
    return (F.length(F.trim(c)) >= 20) & c.contains("[CITATION]") & ~bad & (F.size(F.regexp_extract_all(c, F.lit("([a-zA-Z]{3,})"), F.lit(1))) >= 5)


def flt05_valid_claims(spark, d):
    return delivered(spark, d, "claim_text").where(valid_claim(F.col("claim_text"))).select("instance_id")


VERBS = "is|are|was|were|has|have|had|shows?|showed|proposes?|proposed|uses?|used|improves?|improved|outperforms?|reports?|demonstrates?|fails?|trained|benefits?"


def flt06_substantive(spark, d):
    """Claims whose text before the marker is more than a mark: at most 8 words need a verb."""
    i = delivered(spark, d, "claim_text").withColumn("c", t.claim_text(F.col("claim_text")))
    words = F.size(t.tokens(F.col("c")))
    return i.where((words > 8) | ((words > 0) & F.lower("c").rlike(rf"\b({VERBS})\b"))).select("instance_id")


def flt07_has_marker(spark, d):
    return delivered(spark, d, "claim_text").groupBy(F.coalesce(F.col("claim_text").contains("[CITATION]"), F.lit(False)).alias("marked")).agg(F.count("*").alias("n"))


def flt08_first_with_arxiv_id(spark, d):
    """The first 50 instances with an arXiv id, by id: the limit is the operator."""
    return cited(spark, d).where(~t.is_missing(F.col("ids.arxiv_id"))).orderBy("instance_id").limit(50).select("instance_id", F.col("ids.arxiv_id").alias("arxiv_id"))


def flt09_arxiv_full_match(spark, d):
    p = table(spark, d, "papers", "crawl_no", "arxiv_id", "arxiv_url").where(F.col("arxiv_id").rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"))
    return p.select("crawl_no", F.coalesce(F.nullif(F.col("arxiv_url"), F.lit("")), F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id")).alias("url"))


def flt12_without_evidence(spark, d):
    i = delivered(spark, d, "retrieved_evidences")
    return i.agg(F.count_if(F.coalesce(F.size("retrieved_evidences.extractive_chunks"), F.lit(0)) == 0).alias("without"), F.count("*").alias("n"))


def flt13_label_and_category(spark, d):
    """Rows of one alignment and two categories, however these are spelled."""
    i = delivered(spark, d, "true_outputs")
    c = F.regexp_replace(F.upper(F.trim("true_outputs.true_hallucination_category")), r"[\s_-]+", "_")
    return i.where((F.col("true_outputs.true_alignment") == 2) & c.isin("META_ERROR_DATE", "META_ERROR_VENUE")).select("instance_id", c.alias("category"))


def flt16_threshold_orders(spark, d):
    """Evidence by threshold after the top 3, and by threshold before a maximum of 3: both orders side by side."""
    i = delivered(spark, d, "retrieved_evidences")
    e = i.select("instance_id", F.posexplode("retrieved_evidences.extractive_chunks").alias("pos", "c")).select("instance_id", "pos", "c.relevance_score")
    w = Window.partitionBy("instance_id").orderBy(F.desc("relevance_score"), "pos")
    r = e.withColumn("rk", F.row_number().over(w)).where("rk <= 3")
    # ranks are by score, so a threshold first and the top 3 after keep the same rows at one threshold
    return r.groupBy("instance_id").agg(F.count_if(F.col("relevance_score") >= 0.85).alias("top3_then_85"), F.count_if(F.col("relevance_score") >= 0.95).alias("from_95_max3"))


def flt17_conditional_update(spark, d):
    i = delivered(spark, d, "claim_text", "true_outputs").withColumn("a", F.col("true_outputs.true_alignment"))
    new = F.when((F.col("a") == 3) & ~t.is_missing(F.col("claim_text")), t.enforce_marker(F.col("claim_text"))).otherwise(F.col("claim_text"))
    return i.select("instance_id", new.alias("claim_text"))


def prj02_correction_counts(spark, d):
    i = delivered(spark, d, "claim_text", "true_outputs")
    needs = F.col("true_outputs.true_alignment") == 1
    has = ~t.is_missing(F.col("true_outputs.expert_rationale"))
    return i.agg(F.count_if(needs).alias("needed"), F.count_if(needs & has).alias("corrected"), F.count_if(needs & ~has).alias("failed"))


def prj04_label_rewrite(spark, d):
    i = delivered(spark, d, "true_outputs")
    return i.select("instance_id", t.label_name(F.col("true_outputs.true_alignment")).alias("label"))


def prj05_citation_struct(spark, d):
    c = cited(spark, d)
    s = F.struct("title", F.array_join("authors", "; ").alias("authors"), "venue", "year", F.col("ids.doi").alias("doi"))
    return c.select("instance_id", s.alias("c")).select("instance_id", "c.title", "c.authors", "c.venue", "c.year", "c.doi")


def prj06_bibtex_to_citation(spark, d):
    """BibTeX entries as citations: year as a number, venue from the first field that has one, arXiv id by precedence."""
    r = table(spark, d, "bib_references", "ref_id", "title", "author", "year", "journal", "booktitle", "extra_fields")
    e = F.col("extra_fields")
    venue = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (F.col("booktitle"), F.col("journal"), e["publisher"])])
    aid = t.arxiv_id(e["eprint"], e["url"], F.col("journal"))
    return r.select("ref_id", "title", F.nullif(F.regexp_extract("year", r"(?U)^\s*(\d+)\s*$", 1), F.lit("")).try_cast("int").alias("year"), venue.alias("venue"), aid.alias("arxiv_id"), F.nullif(e["doi"], F.lit("")).alias("doi"))


def prj10_first_location(spark, d):
    """A value from the first of several places that holds it."""
    i = delivered(spark, d, "claim_text", "surrounding_context", "retrieved_evidences")
    c = F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (F.col("retrieved_evidences.abstractive_synthesis"), F.col("claim_text"))])
    return i.select("instance_id", c.alias("text"))


def prj12_safe_filename(spark, d):
    return table(spark, d, "papers", "crawl_no", "title").select("crawl_no", t.safe_filename(F.col("title")).alias("file_name"))


def j01_cite_key_join(spark, d):
    """Entries by (paper, cite key), the last entry of a key wins, joined to how often the paper is cited from instances."""
    r = table(spark, d, "bib_references", "paper_id", "id", "entry_pos", "title").where("id is not null")
    last = r.groupBy("paper_id", "id").agg(F.max_by("title", "entry_pos").alias("title"), F.max("entry_pos").alias("entry_pos"))
    n = table(spark, d, "instances", "original_paper").groupBy("original_paper").agg(F.count("*").alias("claims"))
    return last.join(n, F.col("paper_id") == F.col("original_paper")).select("paper_id", "id", "entry_pos", "title", "claims")


def j03_semi_then_enrich(spark, d):
    v = table(spark, d, "verification_instances", "instance_id").distinct()
    return delivered(spark, d, "original_paper").join(v, "instance_id", "left_semi").select("instance_id", "original_paper")


def j04_unprocessed(spark, d):
    """Instances without a final verdict: resume by anti join, not by counting a prefix."""
    done = table(spark, d, "verification_instances", "instance_id", "status").where("status = 'COMPLETED'").select("instance_id").distinct()
    return table(spark, d, "instances", "instance_id").distinct().join(done, "instance_id", "left_anti")


def j05_left_with_default(spark, d):
    v = table(spark, d, "verification_instances", "instance_id", "status", "event_ts", "loaded_at")
    last = v.groupBy("instance_id").agg(F.max_by("status", F.struct("event_ts", "loaded_at", "status")).alias("status"))
    return table(spark, d, "instances", "instance_id").distinct().join(last, "instance_id", "left").select("instance_id", F.coalesce("status", F.lit("UNKNOWN")).alias("status"))


def j06_cascade(spark, d):
    """Cited works found among the crawled papers by DOI, then arXiv id, then title: the first hit wins."""
    c = cited(spark, d).select("instance_id", F.nullif(F.col("ids.doi"), F.lit("")).alias("doi"), t.without_version(F.nullif(F.col("ids.arxiv_id"), F.lit(""))).alias("aid"), F.nullif(t.normalize_text(F.col("title")), F.lit("")).alias("nt"))
    p = table(spark, d, "papers", "crawl_no", "doi", "arxiv_id", "title")
    by = lambda k: p.select(k.alias("k"), "crawl_no").where("k <> ''").groupBy("k").agg(F.min("crawl_no").alias("value"))
    lookups = [("doi", F.col("doi"), by(F.col("doi")), "k"), ("arxiv", F.col("aid"), by(t.without_version(F.col("arxiv_id"))), "k"), ("title", F.col("nt"), by(t.normalize_text(F.col("title"))), "k")]
    return curate.cascade(c, "instance_id", lookups).select("instance_id", F.col("hit").alias("crawl_no"), F.coalesce("hit_source", F.lit("none")).alias("source"))


def j07_two_key_attach(spark, d):
    """Evidence attached by (paper, title); of repeated keys the last wins."""
    i = delivered(spark, d, "original_paper", "citation_metadata").select("instance_id", "original_paper", F.col("citation_metadata.title").alias("title"))
    r = table(spark, d, "bib_references", "paper_id", "title", "ref_id").where("title is not null").groupBy(F.col("paper_id").alias("original_paper"), "title").agg(F.max("ref_id").alias("ref_id"))
    return i.join(r, ["original_paper", "title"], "left").select("instance_id", "ref_id")


def j14_upsert(spark, d):
    """States merged by instance: the latest event wins."""
    v = table(spark, d, "verification_instances", "instance_id", "event_ts", "loaded_at", "status")
    old, new = v.where("status <> 'COMPLETED' or status is null"), v.where("status = 'COMPLETED'")
    return curate.upsert_latest(old, new, "instance_id", ["event_ts", "loaded_at", "status"]).select("instance_id", "status", "event_ts")


def j15_author_pool_minus(spark, d):
    """Authors of the same venue that are not authors of the paper itself, counted."""
    c = cited(spark, d).where("venue is not null").select("instance_id", "venue", "authors")
    pool = c.select("venue", F.explode("authors").alias("a")).where("a is not null").distinct().groupBy("venue").agg(F.count("*").alias("n"))
    # a row's authors are in its venue's pool, so the others are counted, not listed
    own = F.size(F.array_distinct(F.array_compact(F.coalesce("authors", F.array().cast("array<string>")))))
    return c.join(pool, "venue").select("instance_id", (F.col("n") - own).cast("int").alias("others"))


def win01_head_per_field(spark, d):
    p = table(spark, d, "papers", "crawl_no", "field")
    return curate.head_per_group(p, "field", ["crawl_no"], 40)


def win02_two_valid_per_reference(spark, d):
    i = delivered(spark, d, "claim_text", "citation_metadata").select("instance_id", "claim_text", F.col("citation_metadata.title").alias("title"))
    return curate.head_per_group(i, "title", ["instance_id"], 2, valid_claim(F.col("claim_text"))).select("instance_id")


def win03_claims_per_paper(spark, d):
    i = delivered(spark, d, "original_paper", "created_at")
    return curate.head_per_group(i, "original_paper", ["created_at", "instance_id"], 75).select("instance_id")


def win05_interleave(spark, d):
    i = delivered(spark, d, "true_outputs").select("instance_id", F.coalesce("true_outputs.true_alignment", F.lit(9)).alias("label"))
    return curate.interleave(i, "label", ["instance_id"]).select("instance_id", "label", "slot")


def win06_rolling_minute(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "user_id", "value")
    r = curate.rolling(e, "ts", "user_id", 60, F.col("value"))
    return r.select("event_id", "n_window", F.round("sum_window", 4).alias("sum_window"))


def win08_paragraphs(spark, d):
    """Lines of each text numbered by paragraph: blank lines and section commands end one."""
    doc = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'latex'")
    lines = doc.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    cut = F.trim("line").rlike(r"^$|^\\(par|section|subsection)\b")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    p = lines.withColumn("par", F.sum(cut.cast("int")).over(w)).where(~cut)
    return p.groupBy("doc_id", "par").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def top02_best_title(spark, d):
    """For each cited title the crawled paper with the best word overlap: 1000 x Jaccard, 1000 more if equal; the first of the best wins.

    Equal titles have the highest score there is, so they are settled by an equi join; only titles without an equal one are compared with all.
    """
    p = table(spark, d, "papers", "crawl_no", "title").withColumn("nt", t.normalize_title(F.col("title"))).where("trim(nt) <> ''").select("crawl_no", "nt")
    p = p.groupBy("nt").agg(F.min("crawl_no").alias("crawl_no"))
    i = table(spark, d, "instances", "instance_id", "loaded_at", "citation_metadata.title").where("instance_id is not null")
    i = i.groupBy("instance_id").agg(F.max_by("title", "loaded_at").alias("title"))  # as latest loaded; of citation_metadata only the title is moved
    c = i.select(t.normalize_title(F.col("title")).alias("q")).where("trim(q) <> ''").distinct()
    c = checkpointed(c.join(p, F.col("q") == F.col("nt"), "left"))
    equal = c.where("nt is not null").select("q", F.lit(2000).cast("bigint").alias("score"), "crawl_no")
    words = lambda title: F.array_distinct(t.tokens(F.col(title)))
    rest = c.where("nt is null").select("q", words("q").alias("qt"))
    best = curate.best_overlap(rest, p.select(F.col("crawl_no").alias("id"), words("nt").alias("pt")))
    return equal.unionAll(best.select("q", "score", F.col("id").alias("crawl_no")))


STOP = ["with", "that", "this", "from", "have", "been", "were", "their", "which", "than"]


def top04_keywords(spark, d):
    """The six most frequent words of at least four letters of each claim, by frequency, then word."""
    i = delivered(spark, d, "claim_text").select("instance_id", F.explode(F.regexp_extract_all(F.lower("claim_text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("w")).where(~F.col("w").isin(STOP + ["citation"]))
    n = i.groupBy("instance_id", "w").agg(F.count("*").alias("n"))
    k = n.groupBy("instance_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "w"))), 1, 6).alias("k"))
    return k.select("instance_id", F.array_join(F.transform("k", lambda x: x["w"]), ",").alias("keywords"))


def top06_best_clause(spark, d):
    """The clause of a claim with most content words; ties go to the shorter, then the earlier."""
    i = delivered(spark, d, "claim_text").where("claim_text is not null")
    cl = F.filter(F.transform(F.split("claim_text", r"[,;]"), lambda c, j: F.struct((-F.size(F.regexp_extract_all(c, F.lit("([A-Za-z]{4,})"), F.lit(1)))).alias("a"), F.length(F.trim(c)).alias("l"), j.alias("j"), F.trim(c).alias("c"))), lambda s: s["c"] != "")
    return i.select("instance_id", F.array_min(cl).alias("m")).select("instance_id", F.col("m.c").alias("clause"))


def set01_union_all(spark, d):
    a = table(spark, d, "instances", "instance_id", "claim_text").select("instance_id", F.lit("instances").alias("src"))
    b = table(spark, d, "verification_instances", "instance_id").withColumn("src", F.lit("verification_instances"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("instance_id").alias("ids"))


def set03_dedup_two_pass(spark, d):
    """Papers crawled twice: first by arXiv id without version, then by title; the first crawled stays."""
    p = table(spark, d, "papers", "crawl_no", "arxiv_id", "title")
    return curate.dedup_two_pass(p, t.without_version(F.nullif(F.col("arxiv_id"), F.lit(""))), F.nullif(t.normalize_text(F.col("title")), F.lit("")), ["crawl_no"]).select("crawl_no")


def set04_dedup_keep_idless(spark, d):
    r = table(spark, d, "bib_references", "ref_id", "id")
    return curate.first_by_key(r, F.nullif(F.trim("id"), F.lit("")), ["ref_id"]).select("ref_id")


def set05_dedup_chunks(spark, d):
    i = delivered(spark, d, "retrieved_evidences").select("instance_id", F.posexplode("retrieved_evidences.extractive_chunks").alias("pos", "c"))
    return i.groupBy("instance_id", F.col("c.extractive_text").alias("text")).agg(F.min("pos").alias("pos")).select("instance_id", "pos")


def set06_array_sets(spark, d):
    v = delivered(spark, d, "citation_metadata", "claim_text").select("instance_id", t.tokens(t.normalize_text(F.col("citation_metadata.title"))).alias("a"), t.tokens(t.normalize_text(F.col("claim_text"))).alias("b"))
    return v.select("instance_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("only_title"))


def smp01_seeded_sample(spark, d):
    i = delivered(spark, d, "original_paper")
    return curate.seeded_sample(i, "instance_id", 100, 7).select("instance_id")


def smp02_placed(spark, d):
    """SMP02: the place of every paper in the order of a seeded hash: a range sort, not one task."""
    i = table(spark, d, "papers", "crawl_no").withColumn("h", F.md5(F.concat(F.lit("11|"), F.col("crawl_no").cast("string"))))
    return ranking.global_rank(i, ["h", "crawl_no"], "place").select("crawl_no", "place")


SHARES = [("TITLE_ERROR_SUBSTITUTE", "0.12"), ("TITLE_ERROR_PARAPHRASE", "0.10"), ("TITLE_ERROR_FULLY_FABRICATED", "0.08"), ("AUTHOR_ERROR_ADD_DEL", "0.12"), ("AUTHOR_ERROR_PERTURBATION", "0.12"), ("AUTHOR_ERROR_FULLY_FABRICATED", "0.08"), ("META_ERROR_DOI", "0.12"), ("META_ERROR_DATE", "0.12"), ("META_ERROR_VENUE", "0.10"), ("COMPOUND_ERROR", "0.04")]


def smp03_target_allocation(spark, d):
    n = table(spark, d, "instances", "instance_id").agg(F.countDistinct("instance_id").alias("n"))
    return n.select(F.explode(curate.allocate(SHARES, F.col("n"))).alias("x")).select("x.name", "x.n")


def smp04_cycled(spark, d):
    """SMP04: the papers with instances, in seeded order, repeated in turn until there are 3 rows for each instance."""
    i = table(spark, d, "instances", "original_paper").where("original_paper is not null")
    pool = i.distinct().withColumn("h", F.md5(F.concat(F.lit("4|"), "original_paper")))
    target = i.agg((F.count("*") * 3).alias("n"))
    return curate.cycle(pool, ["h", "original_paper"], target).select("original_paper", "round", "position")


_NT = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_REQ = "(coalesce(m.title, '') <> '' AND coalesce(m.venue, '') <> '' AND coalesce(m.year, 0) <> 0 AND coalesce(len(m.authors), 0) > 0)"
_DM = D + ", c AS (SELECT instance_id, citation_metadata AS m, * FROM d)"
_VALID = "length(trim(claim_text)) >= 20 AND contains(claim_text, '[CITATION]') AND len(regexp_extract_all(claim_text, '[a-zA-Z]{3,}')) >= 5" + "".join(f" AND NOT contains(claim_text, '{m}')" for m in LATEX_MARKS)
_CLAIM = r"regexp_replace(trim(regexp_replace(regexp_replace(claim_text, '(?i)\[CITATION\]|<cit[^>]*>|\(cit[^)]*\)', ' ', 'g'), '\s+', ' ', 'g')), '^[\s,;:.\-]+|[\s,;:.\-]+$', '', 'g')"
_ENF = "regexp_replace(trim(claim_text), '^[\"'']+|[\"'']+$', '', 'g')"
_TK = "list_filter(string_split(" + _NT + ", ' '), lambda w: w <> '')"
_ST = ", ".join(f"'{w}'" for w in [*STOP, "citation"])

QUERIES = {k: f for k, f in globals().items() if k.split("_")[0].rstrip("0123456789") in {"flt", "prj", "j", "win", "top", "set", "smp"} and callable(f) and k[-1] != "_" and k.split("_")[0][-1].isdigit()}
# the virtual time of a row is added up step by step, as doubles are
_INTERLEAVED = "WITH RECURSIVE " + D.removeprefix("WITH ") + """, r AS (SELECT instance_id, {label} AS label, row_number() OVER (PARTITION BY {label} ORDER BY instance_id) AS j FROM d),
k AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY min(instance_id)) AS g FROM r GROUP BY 1),
t(label, g, n, j, v) AS (SELECT label, g, n, 1::BIGINT, 1.0::DOUBLE / n FROM k UNION ALL SELECT label, g, n, j + 1, v + 1.0::DOUBLE / n FROM t WHERE j < n)
SELECT instance_id, r.label, row_number() OVER (ORDER BY v, g) AS slot FROM r JOIN t ON r.label IS NOT DISTINCT FROM t.label AND r.j = t.j"""
SQL = {
    "smp02_placed": "SELECT crawl_no, row_number() OVER (ORDER BY md5('11|' || crawl_no), crawl_no) AS place FROM papers",
    "smp04_cycled": "WITH p AS (SELECT original_paper, row_number() OVER (ORDER BY md5('4|' || original_paper), original_paper) AS r FROM (SELECT DISTINCT original_paper FROM instances WHERE original_paper IS NOT NULL)), z AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT 3 * count(*) FROM instances WHERE original_paper IS NOT NULL) AS t), g AS (SELECT unnest(generate_series(1, (SELECT t FROM z)))::BIGINT AS position) SELECT original_paper, (position - 1) // (SELECT n FROM z) + 1 AS round, position FROM g JOIN p ON p.r = (position - 1) % (SELECT n FROM z) + 1",
    "win05_interleave": _INTERLEAVED.format(label="coalesce(true_outputs.true_alignment, 9)"),
    "flt01_required": _DM + f" SELECT instance_id, {_REQ} AS kept FROM c",
    "flt02_not_preprint": _DM + " SELECT instance_id FROM c WHERE NOT coalesce(contains(lower(m.venue), 'arxiv'), false) AND coalesce(len(m.authors), 0) < 10",
    "flt03_claim_in_context": D + " SELECT instance_id FROM d WHERE contains(surrounding_context, claim_text)",
    "flt04_combined_cleaner": _DM + f" SELECT CASE WHEN NOT {_REQ} THEN 'required' WHEN contains(lower(m.venue), 'arxiv') THEN 'preprint' WHEN NOT len(m.authors) < 10 THEN 'authors' WHEN NOT coalesce(contains(surrounding_context, claim_text), false) THEN 'context' ELSE 'kept' END AS step, count(*) AS n FROM c GROUP BY 1",
    "flt05_valid_claims": D + f" SELECT instance_id FROM d WHERE {_VALID}",
    "flt06_substantive": D + f", c AS (SELECT instance_id, {_CLAIM} AS c FROM d), w AS (SELECT *, len(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> '')) AS n FROM c) SELECT instance_id FROM w WHERE n > 8 OR (n > 0 AND regexp_matches(lower(c), '\\b({VERBS})\\b'))",
    "flt07_has_marker": D + " SELECT coalesce(contains(claim_text, '[CITATION]'), false) AS marked, count(*) AS n FROM d GROUP BY 1",
    "flt08_first_with_arxiv_id": _DM + " SELECT instance_id, m.identifiers.arxiv_id AS arxiv_id FROM c WHERE m.identifiers.arxiv_id <> '' ORDER BY instance_id LIMIT 50",
    "flt09_arxiv_full_match": "SELECT crawl_no, coalesce(nullif(arxiv_url, ''), 'https://arxiv.org/abs/' || arxiv_id) AS url FROM papers WHERE regexp_full_match(arxiv_id, '\\d{4}\\.\\d{4,5}(v\\d+)?')",
    "flt12_without_evidence": D + " SELECT count(*) FILTER (coalesce(len(retrieved_evidences.extractive_chunks), 0) = 0) AS without, count(*) AS n FROM d",
    "flt13_label_and_category": D + ", c AS (SELECT instance_id, true_outputs.true_alignment AS a, regexp_replace(upper(trim(true_outputs.true_hallucination_category)), '[\\s_-]+', '_', 'g') AS category FROM d) SELECT instance_id, category FROM c WHERE a = 2 AND category IN ('META_ERROR_DATE', 'META_ERROR_VENUE')",
    "flt16_threshold_orders": D + ", e AS (SELECT instance_id, unnest(retrieved_evidences.extractive_chunks) AS c, generate_subscripts(retrieved_evidences.extractive_chunks, 1) AS pos FROM d), r AS (SELECT instance_id, c.relevance_score AS s FROM e QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY c.relevance_score DESC NULLS LAST, pos) <= 3) SELECT instance_id, count(*) FILTER (s >= 0.85) AS top3_then_85, count(*) FILTER (s >= 0.95) AS from_95_max3 FROM r GROUP BY 1",
    "flt17_conditional_update": D + f" SELECT instance_id, CASE WHEN true_outputs.true_alignment = 3 AND claim_text <> '' THEN CASE WHEN contains({_ENF}, '[CITATION]') THEN {_ENF} ELSE regexp_replace({_ENF}, '[.\\s]+$', '') || ' [CITATION].' END ELSE claim_text END AS claim_text FROM d",
    "prj02_correction_counts": D + " SELECT count(*) FILTER (true_outputs.true_alignment = 1) AS needed, count(*) FILTER (true_outputs.true_alignment = 1 AND coalesce(true_outputs.expert_rationale, '') <> '') AS corrected, count(*) FILTER (true_outputs.true_alignment = 1 AND coalesce(true_outputs.expert_rationale, '') = '') AS failed FROM d",
    "prj04_label_rewrite": D + " SELECT instance_id, CASE true_outputs.true_alignment WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' WHEN 2 THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END AS label FROM d",
    "prj05_citation_struct": _DM + " SELECT instance_id, m.title, array_to_string(list_filter(m.authors, lambda a: a IS NOT NULL), '; ') AS authors, m.venue, m.year, m.identifiers.doi FROM c",
    "prj06_bibtex_to_citation": "SELECT ref_id, title, TRY_CAST(nullif(regexp_extract(year, '^[\\s\\p{Z}]*(\\d+)[\\s\\p{Z}]*$', 1), '') AS INTEGER) AS year, coalesce(nullif(trim(booktitle), ''), nullif(trim(journal), ''), nullif(trim(extra_fields['publisher']), '')) AS venue, coalesce(nullif(regexp_extract(extra_fields['eprint'], '([0-9]{4}\\.[0-9]{4,5}(?:v[0-9]+)?)', 1), ''), nullif(regexp_extract(extra_fields['url'], '([0-9]{4}\\.[0-9]{4,5}(?:v[0-9]+)?)', 1), ''), nullif(regexp_extract(journal, '([0-9]{4}\\.[0-9]{4,5}(?:v[0-9]+)?)', 1), '')) AS arxiv_id, nullif(extra_fields['doi'], '') AS doi FROM bib_references",
    "prj10_first_location": D + " SELECT instance_id, coalesce(nullif(trim(retrieved_evidences.abstractive_synthesis), ''), nullif(trim(claim_text), '')) AS text FROM d",
    "prj12_safe_filename": "SELECT crawl_no, substr(regexp_replace(regexp_replace(title, '[^A-Za-z0-9._\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS file_name FROM papers",
    "j01_cite_key_join": "WITH l AS (SELECT paper_id, id, arg_max(title, entry_pos) AS t0, max(entry_pos) AS entry_pos FROM bib_references WHERE id IS NOT NULL GROUP BY 1, 2), r AS (SELECT l.paper_id, l.id, l.entry_pos, b.title FROM l JOIN bib_references b ON b.paper_id = l.paper_id AND b.entry_pos = l.entry_pos), n AS (SELECT original_paper, count(*) AS claims FROM instances GROUP BY 1) SELECT paper_id, id, entry_pos, title, claims FROM r JOIN n ON paper_id = original_paper",
    "j03_semi_then_enrich": D + " SELECT instance_id, original_paper FROM d WHERE instance_id IN (SELECT instance_id FROM verification_instances)",
    "j04_unprocessed": "SELECT DISTINCT instance_id FROM instances WHERE instance_id NOT IN (SELECT instance_id FROM verification_instances WHERE status = 'COMPLETED' AND instance_id IS NOT NULL)",
    "j05_left_with_default": "WITH l AS (SELECT instance_id, status FROM verification_instances QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY event_ts DESC NULLS LAST, loaded_at DESC NULLS LAST, status DESC NULLS LAST) = 1) SELECT i.instance_id, coalesce(l.status, 'UNKNOWN') AS status FROM (SELECT DISTINCT instance_id FROM instances) i LEFT JOIN l USING (instance_id)",
    "j06_cascade": _DM + f", q AS (SELECT instance_id, nullif(m.identifiers.doi, '') AS doi, regexp_replace(nullif(m.identifiers.arxiv_id, ''), 'v\\d+$', '') AS aid, nullif({_NT.format('m.title')}, '') AS nt FROM c), a AS (SELECT doi AS k, min(crawl_no) AS v FROM papers WHERE doi <> '' GROUP BY 1), b AS (SELECT regexp_replace(arxiv_id, 'v\\d+$', '') AS k, min(crawl_no) AS v FROM papers WHERE arxiv_id <> '' GROUP BY 1), e AS (SELECT {_NT.format('title')} AS k, min(crawl_no) AS v FROM papers GROUP BY 1) SELECT instance_id, coalesce(a.v, b.v, e.v) AS crawl_no, CASE WHEN a.v IS NOT NULL THEN 'doi' WHEN b.v IS NOT NULL THEN 'arxiv' WHEN e.v IS NOT NULL THEN 'title' ELSE 'none' END AS source FROM q LEFT JOIN a ON a.k = doi LEFT JOIN b ON b.k = aid LEFT JOIN e ON e.k = nt AND e.k <> ''",
    "j07_two_key_attach": _DM + ", r AS (SELECT paper_id, title, max(ref_id) AS ref_id FROM bib_references WHERE title IS NOT NULL GROUP BY 1, 2) SELECT c.instance_id, r.ref_id FROM c LEFT JOIN r ON r.paper_id = c.original_paper AND r.title = m.title",
    "j14_upsert": "SELECT instance_id, status, event_ts FROM verification_instances QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY event_ts DESC NULLS LAST, loaded_at DESC NULLS LAST, status DESC NULLS LAST) = 1",
    "j15_author_pool_minus": _DM + ", p AS (SELECT m.venue AS venue, unnest(m.authors) AS a FROM c WHERE m.venue IS NOT NULL), g AS (SELECT venue, list(DISTINCT a) AS pool FROM p WHERE a IS NOT NULL GROUP BY 1) SELECT instance_id, len(list_filter(pool, lambda x: NOT coalesce(list_contains(m.authors, x), false))) AS others FROM c JOIN g ON g.venue = m.venue",
    "win01_head_per_field": "SELECT crawl_no, field FROM papers QUALIFY row_number() OVER (PARTITION BY field ORDER BY crawl_no) <= 40",
    "win02_two_valid_per_reference": D + f" SELECT instance_id FROM d WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY citation_metadata.title ORDER BY instance_id) <= 2",
    "win03_claims_per_paper": D + " SELECT instance_id FROM d QUALIFY row_number() OVER (PARTITION BY original_paper ORDER BY created_at, instance_id) <= 75",
    "win06_rolling_minute": "SELECT event_id, count(*) OVER w AS n_window, round(sum(value) OVER w, 4) AS sum_window FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)",
    "win08_paragraphs": r"WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS no FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS x FROM documents WHERE source = 'latex' AND text IS NOT NULL)), c AS (SELECT *, regexp_matches(trim(line), '^$|^\\(par|section|subsection)\b') AS cut FROM l), p AS (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY doc_id ORDER BY no) AS par FROM c) SELECT doc_id, par::BIGINT AS par, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM p WHERE NOT cut GROUP BY 1, 2",
    "top02_best_title": _DM + ", q AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(m.title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g') AS q FROM c), qq AS (SELECT q, list_distinct(list_filter(string_split(q, ' '), lambda w: w <> '')) AS qt FROM q WHERE trim(q) <> ''), p AS (SELECT crawl_no, regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g') AS nt FROM papers), pp AS (SELECT *, list_distinct(list_filter(string_split(nt, ' '), lambda w: w <> '')) AS pt FROM p WHERE trim(nt) <> ''), qw AS (SELECT q, len(qt) AS nq, unnest(qt) AS w FROM qq), pw AS (SELECT crawl_no, nt, len(pt) AS np, unnest(pt) AS w FROM pp), m AS (SELECT q, nq, crawl_no, np, nt, count(*) AS b FROM qw JOIN pw USING (w) GROUP BY ALL), s AS (SELECT q, crawl_no, floor(1000 * b / (nq + np - b))::BIGINT + CASE WHEN q = nt THEN 1000 ELSE 0 END AS score FROM m) SELECT q, score, crawl_no FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, crawl_no) = 1",
    "top04_keywords": D + f", w AS (SELECT instance_id, unnest(regexp_extract_all(lower(claim_text), '[a-z]{{4,}}')) AS w FROM d), n AS (SELECT instance_id, w, count(*) AS n FROM w WHERE w NOT IN ({_ST}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY n DESC, w) AS k FROM n) SELECT instance_id, string_agg(w, ',' ORDER BY k) AS keywords FROM r WHERE k <= 6 GROUP BY 1",
    "top06_best_clause": D + ", c AS (SELECT instance_id, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM (SELECT instance_id, regexp_split_to_array(claim_text, '[,;]') AS x FROM d WHERE claim_text IS NOT NULL)) SELECT instance_id, trim(c) AS clause FROM c WHERE trim(c) <> '' QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY -len(regexp_extract_all(c, '[A-Za-z]{4,}')), length(trim(c)), j) = 1",
    "set01_union_all": "SELECT src, count(*) AS n, count(DISTINCT instance_id) AS ids FROM (SELECT 'instances' AS src, instance_id FROM instances UNION ALL SELECT 'verification_instances', instance_id FROM verification_instances) GROUP BY 1",
    "set03_dedup_two_pass": f"WITH a AS (SELECT crawl_no, title, regexp_replace(nullif(arxiv_id, ''), 'v\\d+$', '') AS k FROM papers), b AS (SELECT * FROM a QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY crawl_no) = 1), c AS (SELECT crawl_no, nullif({_NT.format('title')}, '') AS k FROM b) SELECT crawl_no FROM c QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY crawl_no) = 1",
    "set04_dedup_keep_idless": "SELECT ref_id FROM bib_references QUALIFY nullif(trim(id), '') IS NULL OR row_number() OVER (PARTITION BY nullif(trim(id), '') ORDER BY ref_id) = 1",
    "set05_dedup_chunks": D + ", e AS (SELECT instance_id, unnest(retrieved_evidences.extractive_chunks) AS c, generate_subscripts(retrieved_evidences.extractive_chunks, 1) - 1 AS pos FROM d) SELECT instance_id, min(pos) AS pos FROM e GROUP BY instance_id, c.extractive_text",
    "set06_array_sets": D + f", s AS (SELECT instance_id, list_distinct({_TK.format('citation_metadata.title')}) AS a, list_distinct({_TK.format('claim_text')}) AS b FROM d) SELECT instance_id, len(list_intersect(a, b)) AS \"both\", len(a) + len(b) - len(list_intersect(a, b)) AS either, len(a) - len(list_intersect(a, b)) AS only_title FROM s",
    "smp01_seeded_sample": D + " SELECT instance_id FROM d ORDER BY md5('7|' || instance_id), instance_id LIMIT 100",
    "smp03_target_allocation": "WITH n AS (SELECT count(DISTINCT instance_id) AS n FROM instances), s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {v}::DECIMAL(10,6))" for i, (k, v) in enumerate(SHARES)) + ") t(i, name, s)), p AS (SELECT i, name, round_even((n * s)::DOUBLE, 0)::BIGINT AS n0, n FROM s, n) SELECT name, CASE WHEN i = 9 THEN n - (SELECT sum(n0) FROM p WHERE i < 9) ELSE n0 END::BIGINT AS n FROM p",
}
