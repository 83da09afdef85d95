"""Queries: the documented scores of a verification in full, on truth and extraction of each verdict, and the quality of references."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import hooks
from citeloom.functions import text as t
from citeloom.operators import scoring
from citeloom.operators.retrieve import top_k
from citeloom.plans.metrics_q import VERDICTS, verdicts
from citeloom.session import checkpointed, table


def _pairs(spark, d):
    return verdicts(spark, d).select("instance_id", "confidence", "m", "x")


def spc01_title_parts(spark, d):
    """The parts of the title ensemble that need no model: edits, Jaro and Winkler, words, weighted words."""
    v = checkpointed(_pairs(spark, d).select("instance_id", F.col("x.title").alias("a"), F.col("m.title").alias("b")))
    p = scoring.title_parts(F.col("a"), F.col("b"))
    norm = v.select("instance_id", F.trim(t.normalize_title(F.col("a"))).alias("na"), F.trim(t.normalize_title(F.col("b"))).alias("nb"))
    w = scoring.tfidf_cosine(norm, "instance_id", "na", "nb")
    return v.select("instance_id", *[F.round(p[k], 6).alias(k) for k in ("lev", "jaro", "jaccard")]).join(w, "instance_id").withColumn("tfidf", F.round("tfidf", 6))


def spc01_title_ensemble(spark, d):
    """The whole title ensemble, with matching blocks and embeddings (the offline hasher)."""
    v = checkpointed(_pairs(spark, d).select("instance_id", F.col("x.title").alias("a"), F.col("m.title").alias("b")))
    norm = v.select("instance_id", F.trim(t.normalize_title(F.col("a"))).alias("na"), F.trim(t.normalize_title(F.col("b"))).alias("nb"))
    e = [hooks.embed(norm, "instance_id", c).withColumnRenamed("embedding", f"e{c}") for c in ("na", "nb")]
    near = e[0].join(e[1], "instance_id").select("instance_id", F.coalesce(t.cosine(F.col("ena"), F.col("enb")), F.lit(0.0)).alias("semantic"))
    both = v.join(scoring.tfidf_cosine(norm, "instance_id", "na", "nb"), "instance_id").join(near, "instance_id")
    parts = {**scoring.title_parts(F.col("a"), F.col("b")), "tfidf": F.col("tfidf"), "semantic": F.col("semantic")}
    s = scoring.title_ensemble(parts, F.col("a"), F.col("b"))
    return both.select("instance_id", F.round(s, 6).alias("score")).withColumn("verdict", F.when(F.col("score") > 0.95, "exact").when(F.col("score") >= 0.8, "fuzzy").otherwise("mismatch"))


def spc02_author_ensemble(spark, d):
    s = scoring.author_ensemble(F.col("x.authors"), F.col("m.authors"))
    return _pairs(spark, d).select("instance_id", F.round(s, 6).alias("score"))


def _venues(spark, d):
    """(form, venue_id): the names and short forms of listed venues, as forms that are compared."""
    v = table(spark, d, "venues", "venue_id", "venue_name", "acronym")
    form = F.trim(t.normalize_title(F.col("name")))
    forms = v.select("venue_id", F.explode(F.array("venue_name", "acronym")).alias("name")).select("venue_id", form.alias("form")).where("form <> ''")
    return forms.groupBy("form").agg(F.min("venue_id").alias("venue_id"))


def _with_venue_score(spark, d, pairs):
    forms = _venues(spark, d)
    p = pairs.withColumns({"fa": F.trim(t.normalize_title(F.col("x.venue"))), "fb": F.trim(t.normalize_title(F.col("m.venue")))})
    for side in "ab":
        p = p.join(forms.select(F.col("form").alias(f"f{side}"), F.col("venue_id").alias(f"v{side}")), f"f{side}", "left")
    s = scoring.venue_ensemble(F.col("x.venue"), F.col("m.venue"), F.col("va") == F.col("vb"))
    return p.withColumn("venue_score", s).drop("fa", "fb", "va", "vb")


def spc04_venue_ensemble(spark, d):
    """Venues: equal, listed short form, alike in letters, less for another kind."""
    return _with_venue_score(spark, d, _pairs(spark, d)).select("instance_id", F.round("venue_score", 6).alias("score"))


def _ids(side):
    return {k: F.col(f"{side}.identifiers.{k}") for k in ("doi", "arxiv_id")}


def spc05_identifiers(spark, d):
    """Identifiers of an extraction against those of its truth, and against their older forms (a version, a resolver)."""
    v = _pairs(spark, d)
    older = {"doi": F.concat(F.lit("https://doi.org/"), F.upper(F.col("m.identifiers.doi")), F.lit(".v2")), "arxiv_id": F.concat(F.lit("arXiv:"), F.col("m.identifiers.arxiv_id"), F.lit("v3"))}
    return v.select("instance_id", F.round(scoring.identifier_ensemble(_ids("x"), _ids("m")), 6).alias("score"), F.round(scoring.identifier_ensemble(older, _ids("m")), 6).alias("older_score"))


def spc05_isbn(spark, d):
    """ISBN forms of one number: ten digits, thirteen, with hyphens; made from the reference's number."""
    core = F.lpad((F.col("ref_id") % 1000000000).cast("string"), 9, "0")
    total = sum((F.substring(core, i + 1, 1).cast("int") * (10 - i) for i in range(9)), F.lit(0))
    check = (11 - total % 11) % 11
    ten = F.concat(core, F.when(check == 10, "X").otherwise(check.cast("string")))
    r = table(spark, d, "bib_references", "ref_id").select("ref_id", ten.alias("ten"))
    hyphens = F.concat_ws("-", F.substring("ten", 1, 1), F.substring("ten", 2, 4), F.substring("ten", 6, 4), F.substring("ten", 10, 1))
    s = scoring.identifier_ensemble({"isbn": hyphens}, {"isbn": t.isbn13(F.col("ten"))})
    return r.select("ref_id", "ten", t.isbn13(F.col("ten")).alias("thirteen"), s.alias("score"))


def spc06_whole_score(spark, d):
    """The score of a whole reference by the documented weights, from the parts that need no model."""
    v = _with_venue_score(spark, d, _pairs(spark, d))
    both = lambda k: ~t.is_missing(F.col(f"x.{k}")) & ~t.is_missing(F.col(f"m.{k}"))
    some = lambda s: F.coalesce(F.size(F.filter(s, lambda a: F.trim(a) != "")), F.lit(0)) > 0
    scores = {
        "title": F.when(both("title"), scoring.edit_similarity(F.trim(t.normalize_title(F.col("x.title"))), F.trim(t.normalize_title(F.col("m.title"))))),
        "authors": F.when(some(F.col("x.authors")) & some(F.col("m.authors")), scoring.author_ensemble(F.col("x.authors"), F.col("m.authors"))),
        "year": F.when(F.col("x.year").isNotNull() & F.col("m.year").isNotNull(), scoring.year_score(F.col("x.year"), F.col("m.year"))),
        "venue": F.col("venue_score"), "identifiers": scoring.identifier_ensemble(_ids("x"), _ids("m")),
    }
    return v.select("instance_id", F.round(F.round(scoring.whole_score(scores, F.coalesce("confidence", F.lit(0.0))), 9), 4).alias("score"))


def spc11_ranked_candidates(spark, d):
    """Crawled papers as candidates for each extracted citation: those that share its title's first three words; the best three with their scores."""
    head = lambda c: F.array_join(F.slice(t.tokens(t.normalize_title(c)), 1, 3), " ")
    q = verdicts(spark, d).select("instance_id", F.col("x.title").alias("title"), F.col("x.authors").alias("authors"), F.col("x.year").alias("year"), F.col("x.venue").alias("venue"), head(F.col("x.title")).alias("h")).where("h <> ''")
    c = table(spark, d, "papers", "crawl_no", "title", "authors", "year", "venue").select("crawl_no", F.col("title").alias("ct"), F.split("authors", "; ").alias("ca"), F.col("year").alias("cy"), F.col("venue").alias("cv"), head(F.col("title")).alias("h")).where("h <> ''")
    norm = lambda c: F.trim(t.normalize_title(c))
    title = scoring.edit_similarity(norm(F.col("title")), norm(F.col("ct")))
    venue = F.when(~t.is_missing(F.col("venue")) & ~t.is_missing(F.col("cv")), scoring.edit_similarity(norm(F.col("venue")), norm(F.col("cv"))))
    lasts = lambda c: F.array_distinct(F.transform(F.filter(c, lambda a: F.trim(a) != ""), lambda a: scoring.person(a)["last"]))
    authors = F.coalesce(t.jaccard(lasts(F.col("authors")), lasts(F.col("ca"))), F.lit(0.0))
    s = q.join(c, "h").select("instance_id", "crawl_no", F.round(scoring.candidate_score(title, authors, F.abs(F.col("year") - F.col("cy")), venue), 6).alias("score"))
    return top_k(s, "instance_id", [F.desc("score"), F.col("crawl_no")], 3).withColumn("status", scoring.candidate_status(F.col("score")))


def spc12_extraction_quality(spark, d):
    """Completeness, validity, confidence, issues and warnings of each extracted citation."""
    v = _pairs(spark, d)
    c = {k: F.col(f"x.{k}") for k in ("title", "authors", "year", "venue")}
    q = scoring.extraction_quality(c["title"], c["authors"], c["year"], c["venue"], F.col("x.identifiers.doi"), F.col("x.identifiers.arxiv_id"), F.coalesce("confidence", F.lit(0.0)))
    return v.select("instance_id", *[col.alias(k) for k, col in q.items()])


def spc13_near_titles(spark, d):
    """References whose title is more than .95 similar by edits to an earlier one of the same paper, with the first such place."""
    b = table(spark, d, "bib_references", "ref_id", "paper_id", "entry_pos", "title").where("paper_id is not null")
    # a filter of its own would make each title's normal form twice
    r = b.select("ref_id", "paper_id", "entry_pos", F.explode(F.filter(F.array(F.trim(t.normalize_title(F.col("title")))), lambda x: x != "")).alias("nt"))
    n = scoring.near_titles(r, "paper_id", "nt", "entry_pos")
    return r.join(n, ["paper_id", "nt"]).where("first_pos < entry_pos").select("ref_id", "first_pos")


def _right(spark, d):
    v = _pairs(spark, d)
    lasts = lambda c: F.array_distinct(F.transform(F.filter(c, lambda a: F.trim(a) != ""), lambda a: scoring.person(a)["last"]))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return v.select(
        "instance_id", "m", "x", is_((t.normalize_text(F.col("x.title")) == t.normalize_text(F.col("m.title"))) & (t.normalize_text(F.col("m.title")) != "")).alias("title"),
        is_((F.size(lasts(F.col("m.authors"))) > 0) & (t.jaccard(lasts(F.col("x.authors")), lasts(F.col("m.authors"))) >= 0.75)).alias("authors"), is_(F.col("x.year") == F.col("m.year")).alias("year"),
        is_(F.size(F.array_intersect(lasts(F.col("x.authors")), lasts(F.col("m.authors")))) > 0).alias("one_surname"),
    )


def spc14_reference_report(spark, d):
    """References fully, partially or not correct, extraction success, and F1 as mean, over all fields, and by weight."""
    r = _right(spark, d)
    n = sum((F.col(k).cast("int") for k in ("title", "authors", "year")), F.lit(0))
    has_t, has_a, has_y = ~t.is_missing(F.col("x.title")), F.coalesce(F.size("x.authors"), F.lit(0)) > 0, F.col("x.year").isNotNull()
    state = F.when((has_t | (has_a & has_y)) & (n > 0), "success").when((has_t | has_a | has_y) & (n > 0), "partial").otherwise("failure")
    f1 = {}
    for k in ("title", "authors", "year"):
        given = {"title": has_t, "authors": has_a, "year": has_y}[k]
        true = ~t.is_missing(F.col("m.title")) if k == "title" else F.coalesce(F.size("m.authors"), F.lit(0)) > 0 if k == "authors" else F.col("m.year").isNotNull()
        f1[k] = [F.count_if(F.col(k)), F.count_if(given & ~F.col(k)), F.count_if(true & ~F.col(k))]
    score = lambda tp, fp, fn: F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    each = {k: score(*c) for k, c in f1.items()}
    sums = [sum((c[i] for c in f1.values()), F.lit(0)) for i in range(3)]
    w = {"title": 0.35, "authors": 0.30, "year": 0.15}
    return r.agg(
        F.count("*").alias("n"), F.count_if(n == 3).alias("fully"), F.count_if(n == 2).alias("partially"), F.count_if(n < 2).alias("wrong"),
        F.round(F.avg(state.isin("success", "partial").cast("int")), 6).alias("success_rate"), F.round(sum(each.values(), F.lit(0.0)) / 3, 6).alias("macro_f1"), F.round(score(*sums), 6).alias("micro_f1"),
        F.round(sum((each[k] * x for k, x in w.items()), F.lit(0.0)) / sum(w.values()), 6).alias("weighted_f1"),
    )


def spc20_existence(spark, d):
    """Whether a citation exists: title equal but for formatting, same year, one surname, and the DOI right if there is one."""
    r = _right(spark, d)
    doi = t.is_missing(F.col("x.identifiers.doi")) | t.identifier_match(F.col("x.identifiers.doi"), F.col("m.identifiers.doi"))
    return r.select("instance_id", (F.col("title") & F.col("year") & F.col("one_surname") & F.coalesce(doi, F.lit(False))).alias("exists"))


def spc23_normalized(spark, d):
    """Typed references in normal form: names, whether the list was cut short, year, venue's kind, DOI."""
    b = table(spark, d, "bib_references", "ref_id", "author", "year", "journal", "booktitle", "extra_fields")
    doi = F.regexp_replace(F.lower(F.col("extra_fields")["doi"]), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")
    return b.select(
        "ref_id", F.coalesce(F.array_join(scoring.split_people(F.col("author")), "|"), F.lit("")).alias("people"), F.coalesce(F.col("author").rlike(r"(?i)\bet al\b|\bothers\s*$"), F.lit(False)).alias("truncated"),
        scoring.first_of_range(F.col("year"), 2026).alias("year"), scoring.venue_kind(F.coalesce("journal", "booktitle")).alias("kind"), F.when(doi.rlike(r"^10\.\d{4,9}/\S+$"), doi).alias("doi"),
    )


def agg09_four_methods(spark, d):
    """F1 of titles by four methods of matching, the best of them, the first of the list for ties."""
    v = _pairs(spark, d)
    a, b = F.col("x.title"), F.col("m.title")
    methods = {"strict": t.strict_match(a, b), "soft": t.soft_match(a, b), "levenshtein": t.ratio_match(a, b, 0.80), "ratcliff": t.ratio_match(a, b, 0.95)}
    given, true = ~t.is_missing(a), ~t.is_missing(b)
    f1 = lambda m: F.coalesce(F.try_divide(2.0 * F.count_if(m), 2 * F.count_if(m) + F.count_if(given & ~m) + F.count_if(true & ~m)), F.lit(0.0))
    r = v.agg(*[F.round(f1(m), 6).alias(k) for k, m in methods.items()])
    best = F.coalesce(*[F.when(F.col(k) == F.greatest(*methods), F.lit(k)) for k in methods])
    return r.withColumn("best", best)


QUERIES = {f.__name__: f for f in [
    spc01_title_parts, spc01_title_ensemble, spc02_author_ensemble, spc04_venue_ensemble, spc05_identifiers, spc05_isbn, spc06_whole_score, spc11_ranked_candidates, spc12_extraction_quality, spc13_near_titles,
    spc14_reference_report, spc20_existence, spc23_normalized, agg09_four_methods,
]}

_NT = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NX = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TOK = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_STOP = "(" + ", ".join(f"'{w}'" for w in scoring.STOP_WORDS) + ")"
_CONTENT = "list_distinct(list_filter(" + _TOK + f", lambda w: w NOT IN {_STOP}))"
_JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0.0 END"
_LEV = "CASE WHEN greatest(length({0}), length({1})) > 0 AND {0} IS NOT NULL AND {1} IS NOT NULL THEN 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) ELSE 0.0 END"
_NAMED = "list_filter({0}, lambda a: trim(a) <> '' AND lower(trim(a)) NOT IN ('others', 'et al', 'et al.'))"
_SQ = "lower(trim(regexp_replace(a, '\\s+', ' ', 'g')))"
_LASTS = "list_transform({0}, lambda a: CASE WHEN contains(" + _SQ + ", ',') THEN trim(split_part(" + _SQ + ", ',', 1)) ELSE list_extract(string_split(" + _SQ + ", ' '), -1) END)"
_FIRSTS = "list_transform({0}, lambda a: CASE WHEN contains(" + _SQ + ", ',') THEN trim(split_part(" + _SQ + ", ',', 2)) ELSE array_to_string(list_slice(string_split(" + _SQ + ", ' '), 1, len(string_split(" + _SQ + ", ' ')) - 1), ' ') END)"
_ZIP = "list_transform(list_zip({0}, {1}), lambda z: z[1] || '{2}' || {3})"
_AUTH = VERDICTS + f""", n AS (SELECT instance_id, confidence, m, x, {_NAMED.format('x.authors')} AS e, {_NAMED.format('m.authors')} AS f, coalesce(len(list_filter(x.authors, lambda a: lower(trim(a)) IN ('others', 'et al', 'et al.'))) > 0, false) AS cut FROM v),
p AS (SELECT *, {_LASTS.format('e')} AS el, {_LASTS.format('f')} AS fl, {_FIRSTS.format('e')} AS ef, {_FIRSTS.format('f')} AS ff FROM n),
s AS (SELECT *, list_distinct(el) AS eld, list_distinct(fl) AS fld, list_distinct({_ZIP.format('el', 'ef', '|', 'left(z[2], 1)')}) AS es, list_distinct({_ZIP.format('fl', 'ff', '|', 'left(z[2], 1)')}) AS fs,
  list_distinct({_ZIP.format('ef', 'el', ' ', 'z[2]')}) AS eu, list_distinct({_ZIP.format('ff', 'fl', ' ', 'z[2]')}) AS fu FROM p),
a1 AS (SELECT *, list_distinct(list_transform(list_intersect(es, fs), lambda q: split_part(q, '|', 1))) AS wi, list_intersect(eld, fld) AS co FROM s),
au AS (SELECT instance_id, confidence, m, x, coalesce(len(e), 0) AS ne, coalesce(len(f), 0) AS nf, (CASE WHEN coalesce(len(e), 0) = 0 OR coalesce(len(f), 0) = 0 THEN 0.0 WHEN el = fl AND ef = ff THEN 1.0 WHEN len(e) = 1 AND len(f) = 1 THEN (CASE WHEN len(wi) > 0 THEN 0.5 ELSE 0.0 END)
  ELSE 0.4 * ({_JAC.format('eld', 'fld')}) + 0.2 * coalesce(len(wi) / nullif(len(co), 0), 0) + 0.2 * (coalesce((el[1] = fl[1])::INT, 0) + coalesce((el[2] = fl[2])::INT, 0) + coalesce((el[3] = fl[3])::INT, 0)) / 3.0 + 0.2 * ({_JAC.format('eu', 'fu')}) END)
  * (CASE WHEN cut THEN 0.9 ELSE 1.0 END) AS authors FROM a1)
"""
_KIND = "CASE WHEN regexp_matches(lower({0}), 'arxiv|preprint') THEN 'preprint' WHEN regexp_matches(lower({0}), 'workshop') THEN 'workshop' WHEN regexp_matches(lower({0}), 'conference|conf\\.|proceedings|proc\\.|symposium|meeting') THEN 'conference' WHEN regexp_matches(lower({0}), 'journal|transactions|annals|letters|review') THEN 'journal' END"
_VEN = f""", fm AS (SELECT form, min(venue_id) AS venue_id FROM (SELECT venue_id, {_NT.format('n')} AS form FROM (SELECT venue_id, unnest([venue_name, acronym]) AS n FROM venues)) WHERE form <> '' GROUP BY 1),
ve AS (SELECT instance_id, CASE WHEN coalesce(x.venue, '') = '' OR coalesce(m.venue, '') = '' THEN NULL ELSE greatest(0.0, (CASE WHEN na = nb THEN 1.0 WHEN na = 'arxiv' OR nb = 'arxiv' THEN 0.0 WHEN coalesce(a.venue_id = b.venue_id, false) THEN 0.95
  WHEN greatest({_LEV.format('na', 'nb')}, jaro_winkler_similarity(na, nb)) > 0.85 THEN 0.9 ELSE 0.0 END) - CASE WHEN coalesce(({_KIND.format('x.venue')}) <> ({_KIND.format('m.venue')}), false) THEN 0.2 ELSE 0.0 END) END AS venue
  FROM (SELECT instance_id, x, m, {_NT.format('x.venue')} AS na, {_NT.format('m.venue')} AS nb FROM v) z LEFT JOIN fm a ON na = a.form LEFT JOIN fm b ON nb = b.form)
"""
_LOW = "regexp_replace(lower(trim({0})), '^(https?://)?(dx\\.)?(doi\\.org/|arxiv\\.org/(abs|pdf)/)|^(doi|arxiv):\\s*', '')"
_BASE = "regexp_replace(" + _LOW + ", '\\.?v\\d+$', '')"
_ONE = "CASE WHEN coalesce({0}, '') <> '' AND coalesce({1}, '') <> '' THEN CASE WHEN " + _LOW.format("{0}") + " = " + _LOW.format("{1}") + " THEN 1.0 WHEN " + _BASE.format("{0}") + " = " + _BASE.format("{1}") + " THEN {2} ELSE 0.0 END END"
_IDS = "CASE WHEN {d} IS NOT NULL OR {a} IS NOT NULL THEN (coalesce({d}, 0) + coalesce({a}, 0)) / (({d} IS NOT NULL)::INT + ({a} IS NOT NULL)::INT) WHEN coalesce({0}, '') <> '' OR coalesce({1}, '') <> '' OR coalesce({2}, '') <> '' OR coalesce({3}, '') <> '' THEN 0.5 END"


def _id_sql(xd, xa, md, ma):
    one = lambda a, b, w: "(" + _ONE.replace("{0}", a).replace("{1}", b).replace("{2}", w) + ")"
    s = _IDS.replace("{d}", one(xd, md, "0.8")).replace("{a}", one(xa, ma, "0.95"))
    for i, c in enumerate((xd, xa, md, ma)):
        s = s.replace("{" + str(i) + "}", c)
    return s


_XM = ("x.identifiers.doi", "x.identifiers.arxiv_id", "m.identifiers.doi", "m.identifiers.arxiv_id")
_OM = ("('https://doi.org/' || upper(m.identifiers.doi) || '.v2')", "('arXiv:' || m.identifiers.arxiv_id || 'v3')", *_XM[2:])
_RIGHT = VERDICTS + f""", q AS (SELECT instance_id, m, x, {_LASTS.format("list_filter(x.authors, lambda a: trim(a) <> '')")} AS xl, {_LASTS.format("list_filter(m.authors, lambda a: trim(a) <> '')")} AS ml FROM v),
r AS (SELECT *, coalesce({_NX.format('x.title')} = {_NX.format('m.title')} AND {_NX.format('m.title')} <> '', false) AS title, coalesce(len(ml) > 0 AND ({_JAC.format('list_distinct(xl)', 'list_distinct(ml)')}) >= 0.75, false) AS authors,
  coalesce(x.year = m.year, false) AS year, coalesce(len(list_intersect(xl, ml)) > 0, false) AS one_surname FROM q)
"""
_PEOPLE = "list_filter(list_transform(string_split_regex(regexp_replace(author, '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '\\s*;\\s*|\\s+and\\s+|\\s*&\\s*'), lambda a: trim(regexp_replace(regexp_replace(a, '\\s+', ' ', 'g'), ',?\\s*\\bet al\\.?$', '', 'i'))), lambda a: a <> '' AND lower(a) <> 'others')"
_DOI = "regexp_replace(lower(extra_fields['doi']), '^(https?://)?(dx\\.)?doi\\.org/|^doi:\\s*', '')"
SQL = {
    "spc01_title_parts": VERDICTS + f""", n AS (SELECT instance_id, {_NT.format('x.title')} AS a, {_NT.format('m.title')} AS b FROM v),
dc AS (SELECT instance_id, 0 AS side, a AS s FROM n WHERE a IS NOT NULL UNION ALL SELECT instance_id, 1, b FROM n WHERE b IS NOT NULL), wd AS (SELECT instance_id, side, w, count(*) AS tf FROM (SELECT instance_id, side, unnest({_TOK.format('s')}) AS w FROM dc) GROUP BY ALL),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM dc)) / (1 + count(*))) + 1 AS idf FROM wd GROUP BY 1),
tv AS (SELECT instance_id, w, idf, coalesce(sum(tf) FILTER (side = 0), 0) * idf AS x, coalesce(sum(tf) FILTER (side = 1), 0) * idf AS y FROM wd JOIN idf USING (w) GROUP BY instance_id, w, idf),
tc AS (SELECT instance_id, sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0) AS tfidf FROM tv GROUP BY 1)
SELECT instance_id, round({_LEV.format('a', 'b')}, 6) AS lev, round(coalesce(jaro_winkler_similarity(a, b), 0), 6) AS jaro, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE {_JAC.format(_CONTENT.format('a'), _CONTENT.format('b'))} END, 6) AS jaccard, round(coalesce(tfidf, 0), 6) AS tfidf FROM n LEFT JOIN tc USING (instance_id)""",
    "spc02_author_ensemble": _AUTH + "SELECT instance_id, round(authors, 6) AS score FROM au",
    "spc04_venue_ensemble": VERDICTS + _VEN + "SELECT instance_id, round(venue, 6) AS score FROM ve",
    "spc05_identifiers": VERDICTS + f"SELECT instance_id, round({_id_sql(*_XM)}, 6) AS score, round({_id_sql(*_OM)}, 6) AS older_score FROM v",
    "spc05_isbn": """WITH c AS (SELECT ref_id, lpad(CAST(ref_id % 1000000000 AS VARCHAR), 9, '0') AS core FROM bib_references),
t AS (SELECT ref_id, core, (11 - list_sum(list_transform(range(9), lambda i: CAST(substr(core, CAST(i AS INT) + 1, 1) AS INT) * (10 - i)))::INT % 11) % 11 AS k, list_sum(list_transform(range(12), lambda i: CAST(substr('978' || core, CAST(i AS INT) + 1, 1) AS INT) * (CASE WHEN i % 2 = 0 THEN 1 ELSE 3 END)))::INT AS s13 FROM c)
SELECT ref_id, core || CASE WHEN k = 10 THEN 'X' ELSE CAST(k AS VARCHAR) END AS ten, '978' || core || CAST((10 - s13 % 10) % 10 AS VARCHAR) AS thirteen, 1.0::DOUBLE AS score FROM t""",
    "spc06_whole_score": _AUTH + _VEN + f""", w AS (SELECT au.instance_id, coalesce(confidence, 0) AS c, CASE WHEN coalesce(x.title, '') <> '' AND coalesce(m.title, '') <> '' THEN {_LEV.format(_NT.format('x.title'), _NT.format('m.title'))} END AS t,
  CASE WHEN len(list_filter(x.authors, lambda a: trim(a) <> '')) > 0 AND len(list_filter(m.authors, lambda a: trim(a) <> '')) > 0 THEN authors END AS a, CASE abs(x.year - m.year) WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE CASE WHEN x.year IS NOT NULL AND m.year IS NOT NULL THEN 0.0 END END AS y, venue AS ve, {_id_sql(*_XM)} AS i FROM au JOIN ve USING (instance_id)),
sc AS (SELECT *, (coalesce(t, 0) * 0.35 + coalesce(a, 0) * 0.30 + coalesce(y, 0) * 0.15 + coalesce(ve, 0) * 0.10 + coalesce(i, 0) * 0.10) / nullif((t IS NOT NULL)::INT * 0.35 + (a IS NOT NULL)::INT * 0.30 + (y IS NOT NULL)::INT * 0.15 + (ve IS NOT NULL)::INT * 0.10 + (i IS NOT NULL)::INT * 0.10, 0) AS o FROM w)
SELECT instance_id, round(round(least(1.0, coalesce(o, 0)::DOUBLE * (0.9::DOUBLE + 0.1::DOUBLE * c) * CASE WHEN coalesce(i = 1.0, false) THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END), 9), 4) AS score FROM sc""",
    "spc12_extraction_quality": VERDICTS + """, q AS (SELECT instance_id, coalesce(confidence, 0) AS g, x.title AS t, x.authors AS a, coalesce(len(x.authors), 0) AS n, x.year AS y, x.venue AS ve, coalesce(x.identifiers.doi, '') AS doi, coalesce(x.identifiers.arxiv_id, '') AS ax FROM v),
w AS (SELECT *, round((CASE WHEN coalesce(t, '') <> '' THEN 0.3 ELSE 0 END) + (CASE WHEN n > 0 THEN 0.3 ELSE 0 END) + (CASE WHEN y IS NOT NULL THEN 0.2 ELSE 0 END) + (CASE WHEN coalesce(ve, '') <> '' THEN 0.1 ELSE 0 END) + (CASE WHEN doi <> '' OR ax <> '' THEN 0.1 ELSE 0 END), 6) AS completeness,
  (coalesce(y BETWEEN 1900 AND 2028, false)::INT + (n > 0)::INT + coalesce(length(t) > 5, false)::INT + (doi = '' OR regexp_full_match(doi, '10\\.\\d{4,9}/\\S+'))::INT + (ax = '' OR regexp_full_match(ax, '(\\d{4}\\.\\d{4,5}(v\\d+)?|[a-z-]+/\\d{7})'))::INT) / 5.0 AS validity FROM q),
z AS (SELECT *, round(0.5 * g + 0.3 * completeness + 0.2 * validity, 6) AS sure FROM w)
SELECT instance_id, completeness, round(validity, 6) AS validity, sure AS confidence,
  array_to_string(list_filter([CASE WHEN coalesce(t, '') = '' OR length(t) < 5 THEN 'missing_title' END, CASE WHEN n = 0 THEN 'missing_authors' END, CASE WHEN y IS NULL THEN 'missing_year' END, CASE WHEN NOT y BETWEEN 1900 AND 2028 THEN 'invalid_year' END, CASE WHEN sure < 0.6 THEN 'low_confidence' END, CASE WHEN (coalesce(t, '') = '')::INT + (n = 0)::INT + (y IS NULL)::INT > 1 THEN 'partial_parsing' END], lambda k: k IS NOT NULL), ',') AS issues,
  array_to_string(list_filter([CASE WHEN doi = '' AND ax = '' THEN 'no_identifiers' END, CASE WHEN coalesce(ve, '') = '' THEN 'no_venue' END, CASE WHEN len(list_filter(a, lambda k: regexp_matches(k, '\\b[A-Z]\\.'))) > 0 THEN 'abbreviated_authors' END, CASE WHEN len(list_filter(a, lambda k: lower(trim(k)) IN ('others', 'et al', 'et al.'))) > 0 THEN 'et_al_present' END], lambda k: k IS NOT NULL), ',') AS warnings FROM z""",
    "spc13_near_titles": f"""WITH r AS (SELECT ref_id, paper_id, entry_pos, {_NT.format('title')} AS nt FROM bib_references WHERE title IS NOT NULL AND paper_id IS NOT NULL)
SELECT b.ref_id, min(a.entry_pos) AS first_pos FROM r a JOIN r b ON a.paper_id = b.paper_id AND a.entry_pos < b.entry_pos AND a.nt <> '' AND b.nt <> '' AND abs(length(a.nt) - length(b.nt)) <= 0.05 * greatest(length(a.nt), length(b.nt)) AND (a.nt = b.nt OR levenshtein(a.nt, b.nt) < 0.05 * greatest(length(a.nt), length(b.nt)) - 1e-9) GROUP BY 1""",
    "spc14_reference_report": _RIGHT + """, k AS (SELECT *, title::INT + authors::INT + year::INT AS n, coalesce(x.title, '') <> '' AS ht, coalesce(len(x.authors), 0) > 0 AS ha, x.year IS NOT NULL AS hy, coalesce(m.title, '') <> '' AS tt, coalesce(len(m.authors), 0) > 0 AS ta, m.year IS NOT NULL AS ty FROM r),
c AS (SELECT count(*) AS n, count(*) FILTER (n = 3) AS fully, count(*) FILTER (n = 2) AS partially, count(*) FILTER (n < 2) AS wrong, avg(((ht OR ha OR hy) AND n > 0)::INT) AS sr, count(*) FILTER (title) AS t1, count(*) FILTER (ht AND NOT title) AS t2, count(*) FILTER (tt AND NOT title) AS t3,
  count(*) FILTER (authors) AS a1, count(*) FILTER (ha AND NOT authors) AS a2, count(*) FILTER (ta AND NOT authors) AS a3, count(*) FILTER (year) AS y1, count(*) FILTER (hy AND NOT year) AS y2, count(*) FILTER (ty AND NOT year) AS y3 FROM k),
f AS (SELECT *, coalesce(2.0 * t1 / nullif(2 * t1 + t2 + t3, 0), 0) AS ft, coalesce(2.0 * a1 / nullif(2 * a1 + a2 + a3, 0), 0) AS fa, coalesce(2.0 * y1 / nullif(2 * y1 + y2 + y3, 0), 0) AS fy FROM c)
SELECT n, fully, partially, wrong, round(sr, 6) AS success_rate, round((ft + fa + fy) / 3, 6) AS macro_f1, round(coalesce(2.0 * (t1 + a1 + y1) / nullif(2 * (t1 + a1 + y1) + t2 + a2 + y2 + t3 + a3 + y3, 0), 0), 6) AS micro_f1, round((0.35 * ft + 0.30 * fa + 0.15 * fy) / 0.8, 6) AS weighted_f1 FROM f""",
    "spc20_existence": _RIGHT + f"SELECT instance_id, title AND year AND one_surname AND (coalesce(x.identifiers.doi, '') = '' OR coalesce({_BASE.format('x.identifiers.doi')} = {_BASE.format('m.identifiers.doi')}, false)) AS exists FROM r",
    "spc23_normalized": f"""SELECT ref_id, coalesce(array_to_string({_PEOPLE}, '|'), '') AS people, coalesce(regexp_matches(author, '(?i)\\bet al\\b|\\bothers\\s*$'), false) AS truncated,
  (SELECT CASE WHEN y BETWEEN 1900 AND 2028 THEN y END FROM (SELECT coalesce(TRY_CAST(nullif(regexp_extract(year, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS INT), CASE WHEN TRY_CAST(nullif(regexp_extract(year, '[''’](\\d{{2}})\\b', 1), '') AS INT) + 2000 > 2027 THEN TRY_CAST(nullif(regexp_extract(year, '[''’](\\d{{2}})\\b', 1), '') AS INT) + 1900 ELSE TRY_CAST(nullif(regexp_extract(year, '[''’](\\d{{2}})\\b', 1), '') AS INT) + 2000 END) AS y)) AS year,
  {_KIND.format('coalesce(journal, booktitle)')} AS kind, CASE WHEN regexp_full_match({_DOI}, '10\\.\\d{{4,9}}/\\S+') THEN {_DOI} END AS doi FROM bib_references""",
    "spc11_ranked_candidates": VERDICTS + f""", q AS (SELECT instance_id, x, array_to_string(list_slice({_TOK.format(_NT.format('x.title'))}, 1, 3), ' ') AS h FROM v), c AS (SELECT crawl_no, title, string_split(authors, '; ') AS ca, year AS cy, venue AS cv, array_to_string(list_slice({_TOK.format(_NT.format('title'))}, 1, 3), ' ') AS h FROM papers),
j AS (SELECT instance_id, crawl_no, {_LEV.format(_NT.format('x.title'), _NT.format('c.title'))} AS t, CASE WHEN coalesce(x.venue, '') <> '' AND coalesce(cv, '') <> '' THEN {_LEV.format(_NT.format('x.venue'), _NT.format('cv'))} END AS ve, abs(x.year - cy) AS g,
  list_distinct({_LASTS.format("list_filter(x.authors, lambda a: trim(a) <> '')")}) AS xl, list_distinct({_LASTS.format("list_filter(ca, lambda a: trim(a) <> '')")}) AS cl FROM q JOIN c USING (h) WHERE h <> ''),
s AS (SELECT instance_id, crawl_no, round(0.5 * t + 0.3 * coalesce({_JAC.format('xl', 'cl')}, 0) + 0.2 * (CASE g WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END) + 0.1 * coalesce(ve, 0), 6) AS score FROM j)
SELECT instance_id, crawl_no, score, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, crawl_no) AS rank, CASE WHEN score > 0.8 THEN 'match' WHEN score >= 0.6 THEN 'ambiguous_match' ELSE 'no_confident_match' END AS status FROM s QUALIFY rank <= 3""",
}
