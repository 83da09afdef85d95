"""Queries: extraction, cleaning and model steps in full. Where a rule takes text apart, the text is put together from known parts, which the SQL gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import hooks, prompts
from citeloom.functions import text as t
from citeloom.operators import extract as x
from citeloom.operators import perturb
from citeloom.operators.ranking import global_rank
from citeloom.plans.metrics_q import VERDICTS, verdicts
from citeloom.plans.p_core import SQL as _P
from citeloom.plans.p_core import delivered, p6_traces
from citeloom.session import table

_TIDY = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9 ]", ""), " +", " "))
_cat = lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cs])


def src12_bbl(spark, d):
    """Entries of bibliographies with optional labels, from their files: key and text of each."""
    b = table(spark, d, "bib_references", "ref_id", "paper_id", "entry_pos", "title").select("ref_id", "paper_id", "entry_pos", _TIDY(F.col("title")).alias("title")).where("title <> ''")
    item = F.when(F.col("ref_id") % 2 == 0, _cat("\\bibitem[Lin, ", F.col("ref_id").cast("string"), "]")).otherwise(F.lit("\\bibitem"))
    one = _cat(item, "{key", F.col("ref_id").cast("string"), "}\n", F.col("title"), ".\n")
    text = _cat("\\begin{thebibliography}{9}\n", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_pos", one.alias("e")))), lambda s: s["e"]), "\n"), "\n\\end{thebibliography}")
    files = b.groupBy("paper_id", F.floor(F.col("entry_pos") / 500).alias("block")).agg(text.alias("bbl"))
    got = x.bibitems(files.select(F.struct("paper_id", "block").alias("file"), "bbl"), "file", "bbl")
    return got.select("cite_key", F.regexp_replace("body", r"\s*\\end\{thebibliography\}$", "").alias("body"))


def j10_bbl_order(spark, d):
    """References in the order of a bibliography file (here: by title), those it lacks last, in their own order."""
    r = table(spark, d, "bib_references", "ref_id", "paper_id", "entry_pos", "title").where("paper_id is not null")
    bbl = r.where("ref_id % 3 > 0 and title is not null").select("ref_id", "paper_id", F.md5("title").alias("at"), "entry_pos")
    placed = _ranked(bbl, "paper_id", ["at", "entry_pos"], "bbl_pos").select("ref_id", "bbl_pos")
    both = r.select("ref_id", "paper_id", "entry_pos").join(placed, "ref_id", "left")
    return _ranked(both, "paper_id", [F.asc_nulls_last("bbl_pos"), F.col("entry_pos")], "place").select("ref_id", "place")


def _ranked(df, group, order, name):
    from citeloom.operators.ranking import rank_within

    return rank_within(df, [group], order, name)


def j08_truth_and_prediction(spark, d):
    """Two data sets side by side by position, to the end of the shorter: true labels and predicted states, each in the order of its ids."""
    a = global_rank(delivered(spark, d, "true_outputs").select("instance_id", F.col("true_outputs.true_alignment").alias("truth")), ["instance_id"], "n")
    v = table(spark, d, "verification_instances", "instance_id", "event_ts", "loaded_at", "system_prediction")
    latest = v.groupBy("instance_id").agg(F.max(F.struct("event_ts", "loaded_at", "system_prediction")).alias("b")).select(F.col("instance_id").alias("pred_id"), F.col("b.system_prediction.alignment.label").alias("pred"))
    b = global_rank(latest.where("pred_id is not null"), ["pred_id"], "n")
    return a.join(b, "n").select("n", "instance_id", "truth", "pred_id", "pred")


def str13_parted(spark, d):
    """References run together three by three come apart again, at names that lead to a quoted title."""
    b = table(spark, d, "bib_references", "ref_id", "title").select("ref_id", _TIDY(F.col("title")).alias("title")).where("title <> ''")
    one = _cat(F.when(F.col("ref_id") % 2 == 0, "A. B. Lin and C. Roe").otherwise("J. O'Hara"), ', "', F.col("title"), '," J. Tests, vol. 3, 2010.')
    g = b.groupBy(F.floor(F.col("ref_id") / 3).alias("g")).agg(F.array_join(F.array_sort(F.collect_list(_cat(one))), " ").alias("raw"))
    return g.select("g", F.explode(x.split_quoted(F.col("raw"))).alias("part")).select("g", F.md5("part").alias("part_md5"))


def str14_filled(spark, d):
    """The fields of reference strings put together from known parts: a thesis, an article, a preprint, a web page, each with its own."""
    b = table(spark, d, "bib_references", "ref_id", "title").select("ref_id", F.col("ref_id").cast("string").alias("n"), _TIDY(F.col("title")).alias("title")).where("length(title) > 8 and title rlike '^[A-Z].*[a-z]$' and not lower(title) rlike '^(arxiv|corr|in |available|accessed|retrieved|http|pp|vol|[0-9])|report|thesis|github|press'")
    raw = (
        F.when(F.col("ref_id") % 4 == 0, _cat('A. Lin, "', F.col("title"), '", Oslo, 1999. University of Lund. PhD thesis. ISBN: 978-0-', F.lpad(F.col("n"), 8, "0")))
        .when(F.col("ref_id") % 4 == 1, _cat("A. Lin. ", F.col("title"), ". J. Tests 12(3), pp. 7-19, 2011. doi 10.1234/x", F.col("n"), "."))
        .when(F.col("ref_id") % 4 == 2, _cat('B. Roe, "', F.col("title"), '," arXiv:2101.', F.lpad(F.pmod(F.col("ref_id"), F.lit(100000)).cast("string"), 5, "0"), "v2, Report No: R-", F.col("n")))
        .otherwise(_cat('C. Ek, "', F.col("title"), '," 3rd ed. GitHub. https://example.org/', F.col("n"), ". Accessed 2020-01-02."))
    )
    f = x.filled_fields(F.col("raw"))
    kept = ("title", "title_source", "year", "doi", "isbn", "url", "arxiv_id", "version", "volume", "issue", "pages", "report_number", "edition", "institution", "platform", "location")
    return b.select("ref_id", raw.alias("raw")).select("ref_id", *[f[k].alias(k) for k in kept])


def str16_people(spark, d):
    """Authors that are people: those that share a word with the title, the publisher or the place are left out."""
    i = delivered(spark, d, "citation_metadata").select("instance_id", F.col("citation_metadata.title").alias("title"), F.col("citation_metadata.authors").alias("authors")).where("authors is not null")
    planted = F.concat("authors", F.array(F.lit("Quiver Press"), F.lit("Tromso")), F.when(F.col("title").isNotNull(), F.array(F.element_at(F.split("title", " "), 1))).otherwise(F.array().cast("array<string>")))
    kept = x.real_people(planted, F.col("title"), F.array(F.lit("Quiver Press"), F.lit("Tromso")))
    return i.select("instance_id", F.array_join(kept, "|").alias("people"))


def str21_claims(spark, d):
    """Claims of LaTeX texts: the sentence of each citation, kept if it makes a claim (length, marker, words, no markup); at most 75 of a text, in its order."""
    doc = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'latex' and text is not null")
    s = x.citing_sentences(doc, "doc_id", "text").where("sentence is not null")
    ok = (F.length(F.trim("sentence")) >= 20) & F.col("sentence").contains("[CITATION]") & ~F.col("sentence").rlike(r"\\[a-zA-Z]+|[$&_^]") & (F.size(F.regexp_extract_all("sentence", F.lit(r"([a-zA-Z]{3,})"), F.lit(1))) >= 5)
    ranked = _ranked(s.where(ok).select("doc_id", "paragraph", "cite_key", "sentence").distinct(), "doc_id", ["paragraph", "sentence", "cite_key"], "n")
    return ranked.where("n <= 75").select("doc_id", "n", "cite_key", "sentence")


def str22_clean_fields(spark, d):
    """Five fields freed from LaTeX; a row with a field whose braces do not pair up is left out."""
    cols = ["title", "author", "journal", "booktitle", "year"]
    b = table(spark, d, "bib_references", "ref_id", *cols).select("ref_id", *[_TIDY(F.col(c)).alias(c) for c in cols])
    typed = [_cat("\\emph{", F.col(c), "}~\\textbf{", F.col(c), "}\\label{x", "}", F.when(F.col("ref_id") % 7 == i, F.lit("{")).otherwise(F.lit("")), " % aside").alias(c) for i, c in enumerate(cols)]
    raw = b.select("ref_id", *typed)
    for c in cols:
        raw = raw.where(x.balanced(F.regexp_replace(c, r"(?<!\\)%.*$", "")))
    return raw.select("ref_id", *[x.clean_latex(F.col(c)).alias(c) for c in cols])


def str24_page_links(spark, d):
    """Links to PDF files of pages with anchors, data attributes and scripts: made absolute, other schemes and repeats left out."""
    p = table(spark, d, "papers", "crawl_no").select("crawl_no", F.col("crawl_no").cast("string").alias("n"))
    html = _cat('<a href="/files/', F.col("n"), '.pdf">x</a><a href="sub/b.pdf?x=1">y</a><a href=\'//cdn.example.org/c.pdf\'>', '<button data-pdf-url="https://other.example.org/pdf/', F.col("n"), '"></button>', "<script>window.open('/files/", F.col("n"), ".pdf'); location.href = \"d.pdf\";</script>", '<a href="ftp://example.org/e.pdf"><a href="mailto:a@example.org"><a href="/about">')
    return p.select("crawl_no", F.array_join(x.page_links(html, _cat("https://example.org/papers/", F.col("n"), "/view.html")), " ").alias("links"))


def str28_secrets(spark, d):
    """Messages with secrets of every known form, redacted; what is no secret stays."""
    p = table(spark, d, "papers", "crawl_no", "title").select("crawl_no", F.md5(F.coalesce("title", F.lit(""))).alias("h"))
    h = F.col("h")
    m = _cat("api_key=", h, " ok; MY_API_KEY: '", h, "' Authorization: Bearer ", h, " sk-", h, " AIza", h, "abc ghp_", h, " access_token=", h, " secret: ", h, " password='", h, "' https://me:", h, "@example.org/ plain ", h)
    return p.select("crawl_no", t.redact(m).alias("message"))


def str29_messages(spark, d):
    """Categories of errors, and whether to try again, on messages of all kinds."""
    kinds = ["Rate limit reached", "HTTP 429", "401 for this api key", "Request timed out", "connection refused", "404", "cannot parse json", "odd", "502 from upstream", ""]
    p = table(spark, d, "papers", "crawl_no").withColumn("message", F.array(*[F.lit(k) for k in kinds])[F.pmod(F.col("crawl_no"), F.lit(len(kinds))).cast("int")])
    return p.select("crawl_no", t.error_category(F.col("message")).alias("category"), t.is_retryable(F.col("message")).alias("retryable"))


def _answers(spark, d):
    """(instance_id, raw): answers of a model in many shapes, by instance."""
    i = delivered(spark, d, "true_outputs").select("instance_id", F.coalesce(F.col("true_outputs.true_alignment"), F.lit(9)).cast("string").alias("n"))
    n = F.col("n")
    shapes = F.array(
        _cat('{"label": ', n, "}"), _cat('```json\n{"label": ', n, "}\n```"), F.lit("null"), F.lit("```\nNone\n```"), _cat('Here it is: {"label": ', n, ', "why": "a {b"} as asked.'), _cat("The list [", n, ", 2] is all."), F.lit("no answer"), _cat('{"label": ', n),
    )
    return i.select("instance_id", shapes[F.pmod(F.ascii("instance_id") + F.ascii(F.substring("instance_id", 3, 1)), F.lit(8))].alias("raw"))


def jsn04_answers(spark, d):
    """Answers parsed without their fence: null for null and none, else the whole, an object or a list in it."""
    return _answers(spark, d).select("instance_id", F.get_json_object(x.answered_json(F.col("raw")), "$.label").alias("label"), F.get_json_object(x.answered_json(F.col("raw")), "$[0]").alias("first"))


def jsn05_objects(spark, d):
    """Answers parsed as the widest object, else the whole, else an empty object."""
    return _answers(spark, d).select("instance_id", F.get_json_object(x.object_or_empty(F.col("raw")), "$.label").alias("label"), (x.object_or_empty(F.col("raw")) == "{}").alias("empty"))


def prj08_all_types(spark, d):
    """The fields that a reference of each of eight types keeps, as a map in their order."""
    b = table(spark, d, "bib_references", "ref_id", "title", "author", "year", "journal", "booktitle", "extra_fields")
    kind = F.array(*[F.lit(k) for k in KEPT])[F.pmod(F.col("ref_id"), F.lit(len(KEPT))).cast("int")]
    value = {c: F.col(c) for c in ("title", "author", "year", "journal", "booktitle")}
    get = lambda c: value.get(c, F.col("extra_fields")[c])
    fields = F.lit("")
    for k, names in reversed(KEPT.items()):
        made = F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.nullif(F.trim(get(c)), F.lit(""))) for c in names])
        fields = F.when(F.col("kind") == k, made).otherwise(fields)
    return b.withColumn("kind", kind).select("ref_id", "kind", fields.alias("fields"))


#: The fields of each type of reference, in the order of the output.
KEPT = {
    "journal_article": ["title", "author", "year", "journal", "volume", "number", "pages", "doi"], "conference_paper": ["title", "author", "year", "booktitle", "pages", "publisher", "doi"],
    "book": ["title", "author", "year", "publisher"], "thesis": ["title", "author", "year", "publisher", "url"], "technical_report": ["title", "author", "year", "number", "url"],
    "preprint": ["title", "author", "year", "eprint", "archiveprefix", "primaryclass"], "web_resource": ["title", "author", "year", "url", "note"], "other": ["title", "author", "year", "note"],
}


def agg10_runs(spark, d):
    """Calls of a model by step: how many, failed, estimated tokens of prompts (words x 1.3), whether any is known."""
    i = delivered(spark, d, "claim_text", "surrounding_context").where("claim_text is not null")
    each = F.array(*[F.struct(F.lit(k).alias("step"), prompts.fill(k, claim=F.col("claim_text"), context=F.col("surrounding_context")).alias("p")) for k in ("citation_claim", "hypothetical", "drift")])
    c = i.select("instance_id", F.explode(each).alias("e")).select(F.concat_ws("|", "instance_id", "e.step").alias("call"), "e.step", "e.p")
    g = hooks.generate(c, "call", "p", lambda ps: ["" for _ in ps])
    return c.join(g, "call").groupBy("step").agg(
        F.count("*").alias("calls"), F.count("error").alias("failed"), F.sum(F.floor(F.size(F.filter(F.split("p", r"\s+"), lambda w: w != "")) * 1.3).cast("bigint")).alias("tokens_in"), (F.count("answer") > 0).alias("available"),
    )


def mth05_waits(spark, d):
    """Waiting times before each repeated attempt of an instance, whose attempts are its traces: 1.5 s doubled each time, and 30 s doubled up to 120."""
    n = p6_traces(spark, d).groupBy("instance_id").agg(F.count("*").cast("int").alias("attempts"))
    a = n.select("instance_id", F.explode(F.sequence(F.lit(1), F.col("attempts"))).alias("attempt"))
    return a.select("instance_id", "attempt", (1.5 * F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("wait"), F.least(F.lit(120.0), 30.0 * F.pow(F.lit(2.0), F.col("attempt"))).alias("capped"))


def dat03_stamped(spark, d):
    """Names of result files with a stamp, and the stamp in ISO form."""
    v = table(spark, d, "verification_instances", "instance_id", "event_ts").where("event_ts is not null")
    ts = F.col("event_ts").cast("timestamp_ntz")
    return v.select("instance_id", _cat("run_", F.date_format(ts, "yyyyMMdd_HHmmss"), ".json").alias("name"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def prm01_prompts(spark, d):
    """All sixteen prompts of each instance."""
    i = delivered(spark, d, "claim_text", "surrounding_context", "citation_metadata", "true_outputs", "retrieved_evidences")
    m = F.col("citation_metadata")
    parts = {"claim": F.col("claim_text"), "context": F.col("surrounding_context"), "title": m["title"], "year": m["year"], "venue": m["venue"], "label": F.col("true_outputs.true_alignment"), "evidence": F.col("retrieved_evidences.abstractive_synthesis"), "rewrite": F.upper("claim_text")}
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.md5(prompts.fill(k, **parts)).alias("prompt_md5")) for k in prompts.TEMPLATES])
    return i.select("instance_id", F.explode(each).alias("e")).select("instance_id", "e.name", "e.prompt_md5")


def udf04_closed_book(spark, d):
    """Claims judged by what a model knows of the cited work (offline: overlap with its title); an answer that fails is UNCERTAIN."""
    i = delivered(spark, d, "claim_text", "citation_metadata")
    p = i.select("instance_id", F.when(F.col("claim_text").isNotNull(), F.concat("claim_text", F.lit("\nEvidence: "), F.coalesce("citation_metadata.title", F.lit("")))).alias("prompt"))
    g = hooks.generate(p, "instance_id", "prompt", hooks.rule_classifier)
    return g.select("instance_id", x.classification(F.col("answer")).alias("label"), F.col("error").isNotNull().alias("failed"))


def _failing(ps):
    """A model that fails on batches with a forbidden word: a failed batch must not lose its rows."""
    if any("[CITATION]" not in p for p in ps):
        raise RuntimeError("refused")
    return hooks.rule_classifier(ps)


def udf06_batch(spark, d):
    """One citation, a batch or a file alike: each row comes back with its verdict, or with ERROR and the reason."""
    i = delivered(spark, d, "claim_text", "surrounding_context")
    p = i.select("instance_id", F.concat("claim_text", F.lit("\nEvidence: "), F.coalesce("surrounding_context", F.lit(""))).alias("prompt"))
    g = hooks.generate(p, "instance_id", "prompt", _failing)
    return g.select("instance_id", F.when(F.col("error").isNotNull(), "ERROR").otherwise(x.classification(F.col("answer"))).alias("classification"), "error")


def udf07_support(spark, d):
    """What of a claim its evidence holds and what it lacks: words on either side (offline), and the share held."""
    from citeloom.operators.retrieve import terms

    i = delivered(spark, d, "claim_text", "retrieved_evidences").where("claim_text is not null")
    e = F.array_join(F.transform("retrieved_evidences.extractive_chunks", lambda c: F.coalesce(c["extractive_text"], F.lit(""))), " ")
    claim, held = F.array_distinct(terms(F.col("claim_text"))), F.array_distinct(terms(F.coalesce(e, F.lit(""))))
    for_, against = F.array_intersect(claim, held), F.array_except(claim, held)
    return i.select("instance_id", F.size(for_).alias("held"), F.size(against).alias("lacking"), F.round(F.coalesce(F.try_divide(F.size(for_), F.size(claim)), F.lit(0.0)), 6).alias("share"))


def udf08_claims(spark, d):
    """The claim of a citing passage: its sentence with the marker, without leads and marks (offline for a model's answer)."""
    i = delivered(spark, d, "surrounding_context").where("surrounding_context like '%[CITATION]%'")
    s = F.filter(F.split("surrounding_context", r"\.\s+"), lambda p: p.contains("[CITATION]"))[0]
    bare = F.regexp_replace(t.claim_text(s), r"(?i)^(?:however|moreover|furthermore|in addition|for example|recently|in contrast|specifically),?\s+", "")
    return i.select("instance_id", bare.alias("claim"))


def neg06_titles(spark, d):
    """Three ways to a wrong title: that of the next crawled paper, the same words with halves exchanged, and one invented for the venue."""
    p = table(spark, d, "papers", "crawl_no", "title", "venue").where("title is not null")
    ranked = global_rank(p, ["crawl_no"], "n")
    following = ranked.select((F.col("n") - 1).alias("n"), F.col("title").alias("substituted"))
    w = F.split("title", " ")
    half = F.floor(F.size(w) / 2).cast("int")
    turned = F.array_join(F.concat(F.slice(w, half + 1, F.size(w) - half), F.slice(w, F.lit(1), half)), " ")
    made = _cat("Towards a theory of ", F.lower(F.coalesce("venue", F.lit("everything"))))
    return ranked.join(following, "n", "left").select("crawl_no", "substituted", turned.alias("paraphrased"), made.alias("fabricated"))


def neg13_uncertain(spark, d):
    """Claims of uncertain verdicts rewritten by a hedge, all others as they are; the rows changed are marked."""
    i = delivered(spark, d, "claim_text", "true_outputs").where("claim_text is not null")
    hit = F.coalesce(F.col("true_outputs.true_alignment") == 3, F.lit(False))
    return i.select("instance_id", F.when(hit, _cat("It remains open whether ", F.lower(F.substring("claim_text", 1, 1)), F.substring("claim_text", 2, 1 << 30))).otherwise(F.col("claim_text")).alias("claim"), hit.alias("rewritten"))


def neg12_audit(spark, d):
    """Labels looked at anew: a claim said to be supported is always a mismatch, else one whose prediction differs; each with its new label."""
    v = verdicts(spark, d)
    bad = F.coalesce(F.col("truth") == 0, F.lit(False)) | ~F.col("truth").eqNullSafe(F.col("pred"))
    return v.select("instance_id", "truth", bad.alias("mismatch"), F.when(bad, F.coalesce("pred", F.lit(3))).otherwise(F.col("truth")).alias("relabelled"))


def neg01_pool_author(spark, d):
    """An author more at a seeded place, the first author of the next instance, unless it is one already; and one author less."""
    i = global_rank(delivered(spark, d, "citation_metadata").select("instance_id", F.col("citation_metadata.authors").alias("a")), ["instance_id"], "n")
    other = i.select((F.col("n") - 1).alias("n"), F.get("a", F.lit(0)).alias("other"))
    both = i.join(other, "n", "left").where("size(a) > 0")
    return both.select("instance_id", F.array_join(perturb.add_author(F.col("a"), F.col("other"), F.col("instance_id")), "|").alias("added"), F.array_join(perturb.drop_author(F.col("a"), F.col("instance_id")), "|").alias("dropped"))


def neg11_accepted(spark, d):
    """Distorted claims, three attempts each: the first that a judge finds distorted and whose embedding stays within .80 of the claim's; without one the row stays empty."""
    i = delivered(spark, d, "claim_text").where("claim_text is not null")
    w = F.split("claim_text", " ")
    c = i.select("instance_id", "claim_text", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    made = F.array_join(F.filter(w, lambda x_, j: j % (2 * F.col("attempt") + 1) != 2), " ")  # every third, fifth, seventh word is lost
    c = c.select("instance_id", "attempt", "claim_text", made.alias("candidate"), F.concat_ws("|", "instance_id", "attempt").alias("key"))
    near = hooks.embed(c, "key", "claim_text").withColumnRenamed("embedding", "a").join(hooks.embed(c, "key", "candidate").withColumnRenamed("embedding", "b"), "key")
    judged = hooks.generate(c.select("key", F.concat("claim_text", F.lit("\nEvidence: "), "candidate").alias("p")), "key", "p", hooks.rule_classifier)
    ok = (
        c.join(near.select("key", F.round(t.cosine(F.col("a"), F.col("b")), 6).alias("sim")), "key").join(judged.select("key", x.classification(F.col("answer")).alias("verdict")), "key")
        .where("sim >= 0.8 and candidate <> claim_text and verdict = 'SUPPORTED'").groupBy("instance_id").agg(F.min(F.struct("attempt", "candidate", "sim")).alias("b"))
    )
    return i.select("instance_id").join(ok, "instance_id", "left").select("instance_id", "b.attempt", "b.candidate", "b.sim")


QUERIES = {f.__name__: f for f in [
    src12_bbl, j08_truth_and_prediction, j10_bbl_order, str13_parted, str14_filled, str16_people, str21_claims, str22_clean_fields, str24_page_links, str28_secrets, str29_messages, jsn04_answers, jsn05_objects, prj08_all_types,
    agg10_runs, mth05_waits, dat03_stamped, prm01_prompts, udf04_closed_book, udf06_batch, udf07_support, udf08_claims, neg01_pool_author, neg06_titles, neg11_accepted, neg12_audit, neg13_uncertain,
]}

_D = "WITH d AS (SELECT * FROM instances WHERE instance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY loaded_at DESC) = 1)"
_T = "trim(regexp_replace(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
_R = "'[REDACTED]'"
_RAW = _D + """, n AS (SELECT instance_id, coalesce(true_outputs.true_alignment, 9)::VARCHAR AS n, (ascii(instance_id) + ascii(substr(instance_id, 3, 1))) % 8 AS k FROM d)"""
_KEPT_SQL = "CASE kind " + " ".join(
    f"WHEN '{k}' THEN concat_ws(';', " + ", ".join(f"'{c}=' || nullif(trim({c if c in ('title', 'author', 'year', 'journal', 'booktitle') else f'''extra_fields['{c}']'''}), '')" for c in names) + ")" for k, names in KEPT.items()
) + " END"
_W = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"


def _prompt_sql():
    parts = {"claim": "claim_text", "context": "surrounding_context", "title": "citation_metadata.title", "year": "citation_metadata.year::VARCHAR", "venue": "citation_metadata.venue", "label": "true_outputs.true_alignment::VARCHAR", "evidence": "retrieved_evidences.abstractive_synthesis", "rewrite": "upper(claim_text)"}
    out = []
    for k, text in prompts.TEMPLATES.items():
        e = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        e = f"({e})"
        for name in sorted(parts):
            e = f"replace({e}, '{{{name}}}', coalesce({parts[name]}, ''))"
        out.append(f"SELECT instance_id, '{k}' AS name, md5({e}) AS prompt_md5 FROM d")
    return _D + " " + " UNION ALL ".join(out)


def _tokens_sql():
    out = []
    for k in ("citation_claim", "hypothetical", "drift"):
        e = "('" + prompts.TEMPLATES[k].replace("\n", "' || chr(10) || '") + "')"
        for name, c in (("claim", "claim_text"), ("context", "surrounding_context")):
            e = f"replace({e}, '{{{name}}}', coalesce({c}, ''))"
        out.append(f"SELECT '{k}' AS step, count(*) AS calls, CAST(0 AS BIGINT) AS failed, CAST(sum(floor(len(list_filter(string_split_regex({e}, '\\s+'), lambda w: w <> '')) * 1.3)) AS BIGINT) AS tokens_in, true AS available FROM d WHERE claim_text IS NOT NULL")
    return _D + " " + " UNION ALL ".join(out)


_SEED = lambda n, word: f"(('0x' || substr(md5('{word}|' || instance_id), 1, 8))::BIGINT % ({n}))"
SQL = {
    "neg01_pool_author": _D + f""", i AS (SELECT instance_id, citation_metadata.authors AS a, lead(citation_metadata.authors[1]) OVER (ORDER BY instance_id) AS o FROM d), k AS (SELECT *, {_SEED('len(a) + 1', 'add')} AS p, {_SEED('greatest(len(a), 1)', 'drop')} AS q FROM i WHERE len(a) > 0)
SELECT instance_id, coalesce(array_to_string(CASE WHEN o IS NULL OR list_contains(a, o) THEN a ELSE list_concat(list_concat(list_slice(a, 1, p), [o]), list_slice(a, p + 1, len(a))) END, '|'), '') AS added,
  coalesce(array_to_string(CASE WHEN len(a) >= 2 THEN list_concat(list_slice(a, 1, q), list_slice(a, q + 2, len(a))) ELSE a END, '|'), '') AS dropped FROM k""",
    "src12_bbl": f"SELECT 'key' || ref_id AS cite_key, t || '.' AS body FROM (SELECT ref_id, {_T.format('title')} AS t FROM bib_references) WHERE t <> ''",
    "j08_truth_and_prediction": _D + """, a AS (SELECT instance_id, true_outputs.true_alignment AS truth, row_number() OVER (ORDER BY instance_id) AS n FROM d),
b AS (SELECT instance_id AS pred_id, system_prediction.alignment.label AS pred, row_number() OVER (ORDER BY instance_id) AS n FROM (SELECT * FROM verification_instances WHERE instance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY event_ts DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1))
SELECT n, a.instance_id, truth, pred_id, pred FROM a JOIN b USING (n)""",
    "j10_bbl_order": """WITH p AS (SELECT ref_id, row_number() OVER (PARTITION BY paper_id ORDER BY md5(title), entry_pos) AS bp FROM bib_references WHERE ref_id % 3 > 0 AND title IS NOT NULL AND paper_id IS NOT NULL)
SELECT ref_id, row_number() OVER (PARTITION BY paper_id ORDER BY bp NULLS LAST, entry_pos) AS place FROM bib_references LEFT JOIN p USING (ref_id) WHERE paper_id IS NOT NULL""",
    "str13_parted": f"""SELECT CAST(floor(ref_id / 3) AS BIGINT) AS g, md5(CASE WHEN ref_id % 2 = 0 THEN 'A. B. Lin and C. Roe' ELSE 'J. O''Hara' END || ', "' || t || '," J. Tests, vol. 3, 2010.') AS part_md5 FROM (SELECT ref_id, {_T.format('title')} AS t FROM bib_references) WHERE t <> ''""",
    "str14_filled": f"""WITH b AS (SELECT ref_id, ref_id::VARCHAR AS n, t, ref_id % 4 AS k FROM (SELECT ref_id, {_T.format('title')} AS t FROM bib_references) WHERE length(t) > 8 AND regexp_matches(t, '^[A-Z].*[a-z]$') AND NOT regexp_matches(lower(t), '^(arxiv|corr|in |available|accessed|retrieved|http|pp|vol|[0-9])|report|thesis|github|press'))
SELECT ref_id, t AS title, CASE WHEN k = 1 THEN 'sentence' ELSE 'quotes' END AS title_source, coalesce(nullif(regexp_extract(t, '\\b(1[89][0-9][0-9]|20[0-9][0-9])\\b', 1), ''), CASE k WHEN 0 THEN '1999' WHEN 1 THEN '2011' WHEN 2 THEN nullif(regexp_extract(n, '^(1[89][0-9][0-9]|20[0-9][0-9])$', 1), '') ELSE coalesce(nullif(regexp_extract(n, '^(1[89][0-9][0-9]|20[0-9][0-9])$', 1), ''), '2020') END) AS year,
  CASE WHEN k = 1 THEN '10.1234/x' || n END AS doi, CASE WHEN k = 0 THEN '978-0-' || lpad(n, 8, '0') END AS isbn, CASE WHEN k = 3 THEN 'https://example.org/' || n END AS url, CASE WHEN k = 2 THEN '2101.' || lpad((ref_id % 100000)::VARCHAR, 5, '0') END AS arxiv_id, CASE WHEN k = 2 THEN 'v2' END AS version,
  CASE WHEN k = 1 THEN '12' END AS volume, CASE WHEN k = 1 THEN '3' END AS issue, CASE WHEN k = 1 THEN '7-19' END AS pages, CASE WHEN k = 2 THEN 'R-' || n END AS report_number, CASE WHEN k = 3 THEN '3' END AS edition,
  CASE WHEN k = 0 THEN 'University of Lund' END AS institution, CASE WHEN k = 3 THEN 'GitHub' END AS platform, CASE WHEN k = 0 THEN 'Oslo' END AS location FROM b""",
    "str22_clean_fields": "SELECT ref_id, " + ", ".join(f"trim({_T.format(c)} || ' ' || {_T.format(c)}) AS {c}" for c in ("title", "author", "journal", "booktitle", "year")) + " FROM bib_references WHERE ref_id % 7 > 4",
    "str24_page_links": "SELECT crawl_no, 'https://example.org/files/' || crawl_no || '.pdf https://example.org/papers/' || crawl_no || '/sub/b.pdf?x=1 https://cdn.example.org/c.pdf https://other.example.org/pdf/' || crawl_no || ' https://example.org/papers/' || crawl_no || '/d.pdf' AS links FROM papers",
    "str28_secrets": f"SELECT crawl_no, 'api_key=' || {_R} || ' ok; MY_API_KEY: ''' || {_R} || ''' Authorization: Bearer ' || {_R} || ' ' || {_R} || ' ' || {_R} || ' ' || {_R} || ' access_token=' || {_R} || ' secret: ' || {_R} || ' password=''' || {_R} || ''' https://me:' || {_R} || '@example.org/ plain ' || md5(coalesce(title, '')) AS message FROM papers",
    "str29_messages": """SELECT crawl_no, ['rate limit', 'rate limit', 'authentication', 'timeout', 'network', 'not found', 'parsing', 'other', 'other', 'none'][crawl_no % 10 + 1] AS category, crawl_no % 10 IN (0, 1, 3, 8) AS retryable FROM papers""",
    "jsn04_answers": _RAW + " SELECT instance_id, CASE WHEN k IN (0, 1, 4) THEN n END AS label, CASE WHEN k = 5 THEN n END AS first FROM n",
    "jsn05_objects": _RAW + " SELECT instance_id, CASE WHEN k IN (0, 1, 4) THEN n END AS label, k IN (3, 5, 6, 7) AS empty FROM n",
    "prj08_all_types": "SELECT ref_id, kind, " + _KEPT_SQL + " AS fields FROM (SELECT *, [" + ", ".join(f"'{k}'" for k in KEPT) + f"][ref_id % {len(KEPT)} + 1] AS kind FROM bib_references)",
    "agg10_runs": _tokens_sql(),
    "mth05_waits": "WITH n AS (SELECT instance_id, count(*) AS c FROM (" + _P["p6_traces"] + ") GROUP BY 1), a AS (SELECT instance_id, unnest(generate_series(1, c))::INTEGER AS attempt FROM n) SELECT instance_id, attempt, 1.5 * pow(2.0, attempt - 1) AS wait, least(120.0, 30.0 * pow(2.0, attempt)) AS capped FROM a",
    "dat03_stamped": "SELECT instance_id, 'run_' || strftime(event_ts, '%Y%m%d_%H%M%S') || '.json' AS name, strftime(event_ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM verification_instances WHERE event_ts IS NOT NULL",
    "prm01_prompts": _prompt_sql(),
    "udf07_support": _D + f", q AS (SELECT instance_id, list_distinct({_W.format('claim_text')}) AS c, list_distinct({_W.format(chr(99) + 'oalesce(array_to_string(list_transform(retrieved_evidences.extractive_chunks, lambda k: coalesce(k.extractive_text, ' + chr(39) * 2 + ')), ' + chr(39) + ' ' + chr(39) + '), ' + chr(39) * 2 + ')')}) AS h FROM d WHERE claim_text IS NOT NULL) SELECT instance_id, len(list_intersect(c, h))::INTEGER AS held, (len(c) - len(list_intersect(c, h)))::INTEGER AS lacking, round(coalesce(len(list_intersect(c, h)) / nullif(len(c), 0), 0), 6) AS share FROM q",
    "neg06_titles": "SELECT crawl_no, lead(title) OVER (ORDER BY crawl_no) AS substituted, array_to_string(list_concat(list_slice(w, len(w) // 2 + 1, len(w)), list_slice(w, 1, len(w) // 2)), ' ') AS paraphrased, 'Towards a theory of ' || lower(coalesce(venue, 'everything')) AS fabricated FROM (SELECT *, string_split(title, ' ') AS w FROM papers WHERE title IS NOT NULL)",
    "neg12_audit": VERDICTS + "SELECT instance_id, truth, coalesce(truth = 0, false) OR truth IS DISTINCT FROM pred AS mismatch, CASE WHEN coalesce(truth = 0, false) OR truth IS DISTINCT FROM pred THEN coalesce(pred, 3) ELSE truth END AS relabelled FROM v",
    "neg13_uncertain": _D + " SELECT instance_id, CASE WHEN coalesce(true_outputs.true_alignment = 3, false) THEN 'It remains open whether ' || lower(substr(claim_text, 1, 1)) || substr(claim_text, 2) ELSE claim_text END AS claim, coalesce(true_outputs.true_alignment = 3, false) AS rewritten FROM d WHERE claim_text IS NOT NULL",
}
