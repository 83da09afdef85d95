"""Queries: string functions, extraction, JSON recovery, perturbation and verification scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.operators import extract as x
from citeloom.operators import perturb, scoring
from citeloom.operators.ranking import rank_within
from citeloom.plans.metrics_q import VERDICTS, verdicts
from citeloom.plans.p_core import delivered
from citeloom.session import table

D = "WITH d AS (SELECT * FROM instances WHERE instance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY loaded_at DESC) = 1)"


def _refs(spark, d, *cols):
    return table(spark, d, "bib_references", "ref_id", *cols)


def str01_normalize_text(spark, d):
    return _refs(spark, d, "title").select("ref_id", t.normalize_text(F.col("title")).alias("norm"))


def str02_normalize_title(spark, d):
    return _refs(spark, d, "title").select("ref_id", t.normalize_title(F.col("title")).alias("norm"))


def str05_ratio_match(spark, d):
    """Sequence ratio of cited and extracted titles, once for each distinct pair (a Python function: no SQL)."""
    p = verdicts(spark, d).select(F.col("m.title").alias("a"), F.col("x.title").alias("b")).where("a <> '' and b <> ''").distinct()
    s = p.withColumn("ratio", t.sequence_ratio("a", "b"))
    return s.select("a", "b", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= 0.80).alias("lenient"), (F.col("ratio") >= 0.95).alias("close"))


def str08_first_year(spark, d):
    return _refs(spark, d, "year").select("ref_id", t.first_year(F.col("year")).alias("year4"))


def str09_bare_identifier(spark, d):
    i = delivered(spark, d, "citation_metadata").select("instance_id", F.col("citation_metadata.identifiers").alias("i"))
    return i.select("instance_id", t.bare_identifier(F.col("i.doi")).alias("doi"), t.bare_identifier(F.col("i.arxiv_id")).alias("arxiv_id"))


def str11_arxiv_id(spark, d):
    return _refs(spark, d, "journal", "extra_fields").select("ref_id", t.arxiv_id(F.col("extra_fields")["eprint"], F.col("extra_fields")["url"], F.col("journal")).alias("arxiv_id"))


def str12_arxiv_url(spark, d):
    p = table(spark, d, "papers", "crawl_no", "arxiv_id").where("arxiv_id <> ''")
    return p.select("crawl_no", F.concat(F.lit("https://arxiv.org/abs/"), t.without_version(F.col("arxiv_id"))).alias("url"))


def str17_reference_type(spark, d):
    b = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'bibliography' and text is not null")
    e = b.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")
    return e.groupBy(x.reference_type(F.col("line")).alias("type")).agg(F.count("*").alias("n"))


def str14_reference_fields(spark, d):
    b = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'bibliography' and text is not null")
    e = b.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")
    f = x.reference_fields(F.col("line"))
    return e.select("doc_id", "line_no", *[f[k].alias(k) for k in ("year", "doi", "url", "arxiv_id", "volume", "issue", "pages", "edition", "platform")])


def str18_conference_name(spark, d):
    return _refs(spark, d, "booktitle").where("booktitle is not null").select("ref_id", x.conference_name(F.col("booktitle")).alias("short_name"))


def str19_cite_scan(spark, d):
    doc = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'latex' and text is not null")
    return x.citations(doc, "doc_id", "text").groupBy("doc_id", "cite_key").agg(F.count("*").alias("n"))


def str20_citing_sentences(spark, d):
    doc = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'latex' and text is not null")
    return x.citing_sentences(doc, "doc_id", "text")


def src14_numbered_entries(spark, d):
    doc = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'bibliography' and text is not null")
    return x.numbered_entries(doc, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("entries"))


def str23_claim_text(spark, d):
    return delivered(spark, d, "claim_text").select("instance_id", t.claim_text(F.col("claim_text")).alias("claim"))


def str26_label_code(spark, d):
    i = delivered(spark, d, "true_outputs")
    return i.groupBy(t.label_code(F.col("true_outputs.true_alignment")).alias("code"), t.label_name(F.col("true_outputs.true_alignment")).alias("label")).agg(F.count("*").alias("n"))


def str28_redact(spark, d):
    """Texts with secrets removed: how many changed, by source."""
    c = table(spark, d, "documents", "text", "source").where("text is not null")
    return c.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(t.redact(F.col("text")) != F.col("text")).alias("changed"))


def str29_error_category(spark, d):
    v = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'web_scrape'")
    return v.groupBy(t.error_category(F.col("text")).alias("category"), t.is_retryable(F.col("text")).alias("retryable")).agg(F.count("*").alias("n"))


def str31_venue_topic(spark, d):
    """The topic of the first venue that contains, or is contained in, the typed venue; met by words, not by a cross join."""
    v = table(spark, d, "venues", "venue_id", "venue_name", "topic").where("topic is not null").withColumn("w", F.explode(t.tokens(F.lower("venue_name"))))
    c = table(spark, d, "papers", "venue").where("venue <> ''").distinct().withColumn("w", F.explode(t.tokens(F.lower("venue"))))
    m = c.join(v, "w").where(F.lower("venue").contains(F.lower("venue_name")) | F.lower("venue_name").contains(F.lower("venue")))
    return m.groupBy("venue").agg(F.min_by("topic", "venue_id").alias("topic"))


def str32_doi_encode(spark, d):
    p = table(spark, d, "papers", "crawl_no", "doi").where("doi <> ''")
    e = F.replace(F.replace(F.replace(F.url_encode("doi"), F.lit("."), F.lit("%2E")), F.lit("-"), F.lit("%2D")), F.lit("+"), F.lit("%20"))
    return p.select("crawl_no", e.alias("encoded"), (F.url_decode(e) == F.col("doi")).alias("round_trip"))


def str33_strategy_tag(spark, d):
    i = delivered(spark, d, "true_outputs").select("instance_id", F.regexp_extract("true_outputs.expert_rationale", r"^\[([^\]]*)", 1).alias("tag"))
    return i.groupBy("tag").agg(F.count("*").alias("n"))


def str34_enforce_marker(spark, d):
    return delivered(spark, d, "claim_text").select("instance_id", t.enforce_marker(F.col("claim_text")).alias("claim"))


def str35_replace_first(spark, d):
    i = delivered(spark, d, "claim_text", "surrounding_context").where("claim_text <> ''")
    return i.select("instance_id", t.replace_first(F.col("surrounding_context"), F.col("claim_text"), F.lit("<claim>")).alias("context"))


def spc21_clean_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(t.ligatures(F.col("text"))).alias("clean_md5"))


def spc22_reference_sections(spark, d):
    """Lines that open a reference section, by document: headers, or where numbered lines begin."""
    doc = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    n = F.size(F.regexp_extract_all("text", F.lit(r"(?im)(^(?:#+\s*)?(?:references|bibliography)\s*$)"), F.lit(1)))
    m = F.size(F.regexp_extract_all("text", F.lit(r"(?m)(^\[\d+\]\s)"), F.lit(1)))
    return doc.select("doc_id", n.alias("headers"), m.alias("numbered")).where("headers > 0 or numbered >= 5")


def dat01_crawl_year(spark, d):
    return table(spark, d, "papers", "crawled_at").groupBy(F.year("crawled_at").alias("year"), F.date_format("crawled_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def dat02_since(spark, d, today: str = "2026-06-30"):
    """Papers of the year before a given day."""
    p = table(spark, d, "papers", "crawl_no", "crawled_at")
    return p.where(F.to_date("crawled_at") >= F.date_sub(F.lit(today).cast("date"), 365)).select("crawl_no")


def mth06_token_estimate(spark, d):
    return delivered(spark, d, "claim_text").select("instance_id", F.round(F.size(t.tokens(F.coalesce("claim_text", F.lit("")))) * 1.3, 1).alias("tokens"))


def arr01_authors_joined(spark, d):
    return delivered(spark, d, "citation_metadata").select("instance_id", F.array_join("citation_metadata.authors", "; ").alias("authors"))


def arr04_batches(spark, d):
    """Papers in batches of 100 within their field, by order of crawl."""
    p = rank_within(table(spark, d, "papers", "crawl_no", "field"), ["field"], ["crawl_no"], "n").withColumn("b", F.floor((F.col("n") - 1) / 100))
    return p.groupBy("field", "b").agg(F.count("*").alias("n"))


def map01_inverted_index(spark, d):
    """Titles as inverted indexes and back again."""
    p = table(spark, d, "papers", "crawl_no", "title").where("title is not null").withColumn("w", F.split("title", " "))
    i = F.map_from_arrays(F.array_distinct("w"), F.transform(F.array_distinct("w"), lambda v: F.filter(F.transform("w", lambda y, j: F.when(y == v, j)), lambda j: j.isNotNull())))
    return p.select("crawl_no", x.inverted_index_text(i).alias("title"))


def jsn01_recover(spark, d):
    """Labels from JSON answers cut short: the last characters of each answer are missing."""
    i = delivered(spark, d, "true_outputs").select("instance_id", F.to_json(F.struct(t.label_name(F.col("true_outputs.true_alignment")).alias("classification"), F.lit("x").alias("reasoning"))).alias("j"))
    cut = F.substring("j", 1, F.length("j") - F.pmod(F.length("instance_id") + F.ascii("instance_id"), F.lit(3)))
    return i.groupBy(x.classification(cut).alias("label"), F.try_parse_json(cut).isNotNull().alias("was_valid")).agg(F.count("*").alias("n"))


def jsn06_metadata_blob(spark, d):
    p = table(spark, d, "papers", "crawl_no", "title", "year")
    return p.select("crawl_no", F.get_json_object(F.to_json(F.struct("title", "year")), "$.title").alias("title"))


def prm01_prompt(spark, d):
    i = delivered(spark, d, "claim_text", "citation_metadata").where("claim_text is not null")
    return i.select("instance_id", F.md5(F.concat(F.lit("Claim: "), "claim_text", F.lit("\nReference: "), F.coalesce("citation_metadata.title", F.lit("unknown")))).alias("prompt_md5"))


def _cited(spark, d):
    return delivered(spark, d, "citation_metadata").select("instance_id", F.col("citation_metadata").alias("m"))


def neg01_author_drop_add(spark, d):
    c = _cited(spark, d).where("size(m.authors) > 0")
    k = F.col("instance_id")
    return c.select("instance_id", F.array_join(perturb.drop_author(F.col("m.authors"), k), ";").alias("dropped"), F.size(perturb.add_author(F.col("m.authors"), F.lit("A. N. Other"), k)).alias("n_added"))


def neg02_name_mutation(spark, d):
    c = _cited(spark, d).where("size(m.authors) > 0").withColumn("a", F.col("m.authors")[0]).where("a is not null")
    return c.select("instance_id", perturb.mutate_name(F.col("a"), F.col("instance_id")).alias("name"))


def neg03_doi_corruption(spark, d):
    return _cited(spark, d).where("m.identifiers.doi <> ''").select("instance_id", perturb.corrupt_doi(F.col("m.identifiers.doi"), F.col("instance_id")).alias("doi"))


def neg04_year_shift(spark, d):
    return _cited(spark, d).where("m.year is not null").select("instance_id", perturb.shift_year(F.col("m.year"), F.col("instance_id")).alias("year"))


def neg05_venue_swap(spark, d):
    """The venue list is fixed and short; it is one array in one broadcast row."""
    v = table(spark, d, "venues", "venue_name").agg(F.array_sort(F.collect_list("venue_name")).alias("vs"))
    return _cited(spark, d).join(F.broadcast(v)).select("instance_id", perturb.swap_venue(F.col("m.venue"), F.col("vs"), F.col("instance_id")).alias("venue"))


def neg08_targets(spark, d):
    """Generation with targets: each category takes its share of candidates, by seeded order; a window limit, not a loop."""
    c = delivered(spark, d, "true_outputs").select("instance_id", F.regexp_replace(F.upper(F.trim("true_outputs.true_hallucination_category")), r"[\s_-]+", "_").alias("category")).where("category is not null")
    w = Window.partitionBy("category").orderBy(F.md5(F.concat(F.lit("3|"), "instance_id")))
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("category", "instance_id")


def neg10_drift_fanout(spark, d):
    i = delivered(spark, d, "claim_text").where("claim_text is not null")
    return i.select("instance_id", F.explode(perturb.drifts(F.col("claim_text"))).alias("drift"))


def _scored(spark, d):
    v = verdicts(spark, d)
    s = {
        "title": F.round(scoring.title_score(F.col("m.title"), F.col("x.title")), 6), "authors": F.round(scoring.author_score(F.col("m.authors"), F.col("x.authors")), 6),
        "year": scoring.year_score(F.col("m.year"), F.col("x.year")), "venue": F.round(scoring.venue_score(F.col("m.venue"), F.col("x.venue")), 6),
        "identifier": scoring.identifier_score(F.col("m.identifiers.doi"), F.col("x.identifiers.doi")),
    }
    return v.select("instance_id", "confidence", *[c.alias(k) for k, c in s.items()])


def spc01_field_scores(spark, d):
    return _scored(spark, d).drop("confidence")


def spc06_overall(spark, d):
    s = _scored(spark, d)
    o = scoring.overall({k: F.col(k) for k in scoring.WEIGHTS}, F.coalesce("confidence", F.lit(0.0)))
    return s.select("instance_id", F.round(o, 4).alias("overall"))


def spc09_verdicts(spark, d):
    s = _scored(spark, d)
    o = F.round(scoring.overall({k: F.col(k) for k in scoring.WEIGHTS}, F.coalesce("confidence", F.lit(0.0))), 4)
    hard = sum((F.when(F.coalesce(F.col(k), F.lit(1.0)) < 0.5, 1).otherwise(0) for k in ("title", "authors", "year")), F.lit(0))
    v = scoring.verdict(o, hard, F.coalesce("confidence", F.lit(0.0)), F.lit(True))
    return s.groupBy(v.alias("verdict"), scoring.field_verdict(F.col("title")).alias("title_verdict")).agg(F.count("*").alias("n"))


def spc10_quality_flags(spark, d):
    c = _cited(spark, d)
    m = [F.col(f"m.{k}") for k in ("title", "authors", "year", "venue")]
    return c.select("instance_id", F.array_join(scoring.quality_flags(*m), ",").alias("flags"), scoring.completeness(*m).alias("completeness"))


def spc24_verdict_export(spark, d):
    """The flattened export: one row for each verdict, nested fields as columns."""
    return verdicts(spark, d).select("instance_id", "truth", "pred", F.col("m.title").alias("title"), F.col("m.year").alias("year"), F.array_join("m.authors", "; ").alias("authors"))


_N = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_S = lambda n, *p: f"(('0x' || substr(md5(concat_ws('|', {', '.join(p)})), 1, 8))::BIGINT % ({n}))"
_DM = D + ", c AS (SELECT instance_id, citation_metadata AS m FROM d)"
_BARE = "regexp_replace(regexp_replace(lower(trim({0})), '^(https?://)?(dx\\.)?(doi\\.org/|arxiv\\.org/(abs|pdf)/)|^(doi|arxiv):\\s*', ''), 'v\\d+$', '')"
_AX = "nullif(regexp_extract({0}, '([0-9]{{4}}\\.[0-9]{{4,5}}(?:v[0-9]+)?)', 1), '')"
_LINES = "l0 AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents WHERE source = '{0}' AND text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l0)"
_BIB = "WITH " + _LINES.format("bibliography") + ", e AS (SELECT * FROM l WHERE trim(line) <> '')"
_TYPE = "CASE WHEN regexp_matches(lower(line), 'https?://') AND regexp_matches(lower(line), 'accessed|retrieved') THEN 'web_resource' WHEN regexp_matches(lower(line), 'arxiv|preprint') THEN 'preprint' WHEN regexp_matches(lower(line), 'thesis|dissertation') THEN 'thesis' WHEN regexp_matches(lower(line), 'technical report|tech\\. rep|report no') THEN 'technical_report' WHEN regexp_matches(lower(line), 'isbn') THEN 'book' WHEN regexp_matches(lower(line), 'journal|transactions|annals|letters') THEN 'journal_article' WHEN regexp_matches(lower(line), 'proceedings|\\bproc\\.|conference|symposium|\\bin: ') THEN 'conference_paper' WHEN regexp_matches(lower(line), 'press|publisher|springer|wiley|elsevier') THEN 'book' ELSE 'other' END"
_F = lambda p: f"nullif(trim(regexp_extract(line, '{p}', 1)), '')"
_CLAIM = r"regexp_replace(trim(regexp_replace(regexp_replace(claim_text, '(?i)\[CITATION\]|<cit[^>]*>|\(cit[^)]*\)', ' ', 'g'), '\s+', ' ', 'g')), '^[\s,;:.\-]+|[\s,;:.\-]+$', '', 'g')"
_ENF = "regexp_replace(trim(claim_text), '^[\"'']+|[\"'']+$', '', 'g')"
_LAST = "list_distinct(list_transform(list_filter({0}, lambda a: trim(a) <> ''), lambda a: lower(list_extract(string_split(trim(regexp_replace(a, '\\s+', ' ', 'g')), ' '), -1))))"
_LASTS = _LAST.removeprefix("list_distinct(").removesuffix(")")
_TOK = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
_JAC = "CASE WHEN len({0}) + len({1}) > 0 THEN len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) ELSE 0 END"
_ED = "CASE WHEN greatest(length({0}), length({1})) > 0 AND {0} IS NOT NULL AND {1} IS NOT NULL THEN 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) ELSE 0 END"
_SC = VERDICTS + f""", n AS (SELECT instance_id, confidence, m, x, {_N.format('m.title')} AS ta, {_N.format('x.title')} AS tb, {_N.format('m.venue')} AS va, {_N.format('x.venue')} AS vb, {_LAST.format('m.authors')} AS la, {_LAST.format('x.authors')} AS lb, ({_LASTS.format('m.authors')})[1] AS fa, ({_LASTS.format('x.authors')})[1] AS fb FROM v),
k AS (SELECT *, {_TOK.format('ta')} AS ka, {_TOK.format('tb')} AS kb FROM n),
s AS (SELECT instance_id, confidence,
  coalesce(round(0.5 * ({_ED.format('ta', 'tb')}) + 0.5 * ({_JAC.format('ka', 'kb')}), 6), 0) AS title,
  coalesce(round(0.6 * ({_JAC.format('la', 'lb')}) + 0.2 * CASE WHEN len(la) > 0 AND len(lb) > 0 AND fa = fb THEN 1 ELSE 0 END + 0.2 * CASE WHEN m.authors IS NULL OR x.authors IS NULL THEN NULL ELSE least(len(m.authors), len(x.authors)) / nullif(greatest(len(m.authors), len(x.authors)), 0) END, 6), 0) AS authors,
  CASE abs(m.year - x.year) WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.0 END::DOUBLE AS year,
  coalesce(round(CASE WHEN va = vb THEN 1.0::DOUBLE WHEN contains(va, vb) OR contains(vb, va) THEN 0.95 ELSE 0.9 * ({_ED.format('va', 'vb')}) END, 6), 0) AS venue,
  CASE WHEN coalesce(m.identifiers.doi, '') = '' OR coalesce(x.identifiers.doi, '') = '' THEN NULL WHEN coalesce({_BARE.format('m.identifiers.doi')} = {_BARE.format('x.identifiers.doi')} AND {_BARE.format('m.identifiers.doi')} <> '', false) THEN 1.0 ELSE 0.0 END::DOUBLE AS identifier FROM k),
o AS (SELECT *, round(least(1.0, (title * 0.35 + authors * 0.25 + year * 0.15 + venue * 0.15 + coalesce(identifier * 0.10, 0)) / (0.9 + CASE WHEN identifier IS NULL THEN 0 ELSE 0.1 END) * (0.9 + 0.1 * coalesce(confidence, 0))), 4) AS overall FROM s)
"""

QUERIES = {k: f for k, f in globals().items() if k.split("_")[0] and k.split("_")[0][:3] in {"str", "src", "spc", "dat", "mth", "arr", "map", "jsn", "prm", "neg"} and callable(f) and k.split("_")[0][-1].isdigit()}

def _categories(c):
    rules = [("rate limit", ["rate limit", "429", "too many requests"]), ("authentication", ["401", "403", "unauthorized", "api key", "forbidden"]), ("timeout", ["timeout", "timed out"]), ("network", ["connection", "network", "unreachable"]), ("not found", ["404", "not found"]), ("parsing", ["json", "parse", "decode"])]
    return f"CASE WHEN {c} IS NULL OR trim({c}, ' ') = '' THEN 'none' " + " ".join(f"WHEN {' OR '.join(f'contains(lower({c}), {chr(39)}{m}{chr(39)})' for m in ms)} THEN '{k}'" for k, ms in rules) + " ELSE 'other' END"


SQL = {
    "neg02_name_mutation": _DM + f", a AS (SELECT instance_id, m.authors[1] AS a FROM c WHERE len(m.authors) > 0 AND m.authors[1] IS NOT NULL), k AS (SELECT instance_id, a, length(a) AS n, {_S('3', chr(39) + 'kind' + chr(39), 'instance_id')} AS kind, 2 + {_S('greatest(length(a) - 3, 1)', chr(39) + 'at' + chr(39), 'instance_id')} AS pp FROM a) SELECT instance_id, CASE WHEN n < 4 THEN a WHEN kind = 0 THEN substr(a, 1, pp - 1) || substr(a, pp + 1, 1) || substr(a, pp, 1) || substr(a, pp + 2) WHEN kind = 1 THEN substr(a, 1, pp) || substr(a, pp) ELSE regexp_replace(a, '^(\\w)\\w+', '\\1.') END AS name FROM k",
    "str29_error_category": f"SELECT {_categories('text')} AS category, coalesce(regexp_matches(lower(text), '429|rate limit|timeout|timed out|temporarily|unavailable|502|503|504|connection reset|overloaded|try again'), false) AS retryable, count(*) AS n FROM documents WHERE source = 'web_scrape' GROUP BY ALL",
    "spc21_clean_text": "SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '([a-z])-\\r?\\n([a-z])', '\\1\\2', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) AS clean_md5 FROM documents",

    "str01_normalize_text": f"SELECT ref_id, {_N.format('title')} AS norm FROM bib_references",
    "str02_normalize_title": "SELECT ref_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g') AS norm FROM bib_references",
    "str08_first_year": "SELECT ref_id, nullif(regexp_extract(year, '\\b(19|20)\\d{2}\\b', 0), '') AS year4 FROM bib_references",
    "str09_bare_identifier": _DM + f" SELECT instance_id, {_BARE.format('m.identifiers.doi')} AS doi, {_BARE.format('m.identifiers.arxiv_id')} AS arxiv_id FROM c",
    "str11_arxiv_id": f"SELECT ref_id, coalesce({_AX.format(chr(101) + chr(120) + 'tra_fields[' + chr(39) + 'eprint' + chr(39) + ']')}, {_AX.format('extra_fields[' + chr(39) + 'url' + chr(39) + ']')}, {_AX.format('journal')}) AS arxiv_id FROM bib_references",
    "str12_arxiv_url": "SELECT crawl_no, 'https://arxiv.org/abs/' || regexp_replace(arxiv_id, 'v\\d+$', '') AS url FROM papers WHERE arxiv_id <> ''",
    "str17_reference_type": _BIB + f" SELECT {_TYPE} AS type, count(*) AS n FROM e GROUP BY 1",
    "str14_reference_fields": _BIB + f" SELECT doc_id, line_no, {_F(chr(92) + 'b(1[89]' + chr(92) + 'd{2}|20' + chr(92) + 'd{2})' + chr(92) + 'b')} AS year, regexp_replace({_F(r'(10\.\d{4,}/[^\s,;]+)')}, '\\.+$', '') AS doi, regexp_replace({_F(r'(https?://[^\s)]+)')}, '\\.+$', '') AS url, {_F(r'(?i)arxiv[:\s./a-z]*(\d{4}\.\d{4,5})')} AS arxiv_id, {_F(r'\b(\d+)\s*\(\d+\)')} AS volume, {_F(r'\b\d+\s*\((\d+)\)')} AS issue, {_F(r'(?:pp\.?|pages)\s*(\d+\s*[-–]+\s*\d+)')} AS pages, {_F(r'(\d+)(?:st|nd|rd|th)\s+ed')} AS edition, {_F(r'\b(GitHub|Zenodo|Figshare|OSF|Kaggle)\b')} AS platform FROM e",
    "str18_conference_name": "SELECT ref_id, nullif(trim(regexp_extract(booktitle, '\\(([^()]{2,25})\\)', 1)), '') AS short_name FROM bib_references WHERE booktitle IS NOT NULL",
    "str19_cite_scan": "WITH " + _LINES.format("latex") + r", m AS (SELECT doc_id, unnest(regexp_extract_all(line, '\\cite[a-z]*(?:\[[^\]]*\])?(?:\[[^\]]*\])?\{([^}]+)\}', 1)) AS ks FROM l WHERE NOT starts_with(ltrim(line), '%')), k AS (SELECT doc_id, trim(unnest(string_split(ks, ','))) AS cite_key FROM m) SELECT doc_id, cite_key, count(*) AS n FROM k WHERE cite_key <> '' GROUP BY 1, 2",
    "src14_numbered_entries": "WITH " + _LINES.format("bibliography") + r" SELECT doc_id, count(*) AS entries FROM l WHERE regexp_matches(line, '^\s*\[\d+\]') GROUP BY 1",
    "str23_claim_text": D + f" SELECT instance_id, {_CLAIM} AS claim FROM d",
    "str26_label_code": D + " SELECT true_outputs.true_alignment AS code, CASE true_outputs.true_alignment WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' WHEN 2 THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END AS label, count(*) AS n FROM d GROUP BY 1, 2",
    "str31_venue_topic": "WITH c AS (SELECT DISTINCT venue FROM papers WHERE venue <> '') SELECT venue, arg_min(topic, venue_id) AS topic FROM c JOIN venues v ON v.topic IS NOT NULL AND (contains(lower(venue), lower(venue_name)) OR contains(lower(venue_name), lower(venue))) AND len(list_intersect(string_split(lower(venue), ' '), string_split(lower(venue_name), ' '))) > 0 GROUP BY 1",
    "str32_doi_encode": "SELECT crawl_no, replace(replace(url_encode(doi), '.', '%2E'), '-', '%2D') AS encoded, true AS round_trip FROM papers WHERE doi <> ''",
    "str33_strategy_tag": D + r" SELECT regexp_extract(true_outputs.expert_rationale, '^\[([^\]]*)', 1) AS tag, count(*) AS n FROM d GROUP BY 1",
    "str34_enforce_marker": D + f" SELECT instance_id, CASE WHEN contains({_ENF}, '[CITATION]') THEN {_ENF} ELSE regexp_replace({_ENF}, '[.\\s]+$', '') || ' [CITATION].' END AS claim FROM d",
    "str35_replace_first": D + " SELECT instance_id, CASE WHEN strpos(surrounding_context, claim_text) > 0 THEN substr(surrounding_context, 1, strpos(surrounding_context, claim_text) - 1) || '<claim>' || substr(surrounding_context, strpos(surrounding_context, claim_text) + length(claim_text)) END AS context FROM d WHERE claim_text <> ''",
    "dat01_crawl_year": "SELECT year(crawled_at) AS year, strftime(crawled_at, '%Y-%m') AS month, count(*) AS n FROM papers GROUP BY 1, 2",
    "dat02_since": "SELECT crawl_no FROM papers WHERE crawled_at::DATE >= DATE '2026-06-30' - 365",
    "mth06_token_estimate": D + " SELECT instance_id, round(len(list_filter(regexp_split_to_array(coalesce(claim_text, ''), '\\s+'), lambda w: w <> '')) * 1.3, 1)::DOUBLE AS tokens FROM d",
    "arr01_authors_joined": _DM + " SELECT instance_id, array_to_string(list_filter(m.authors, lambda a: a IS NOT NULL), '; ') AS authors FROM c",
    "arr04_batches": "WITH b AS (SELECT field, (row_number() OVER (PARTITION BY field ORDER BY crawl_no) - 1) // 100 AS b FROM papers) SELECT field, b, count(*) AS n FROM b GROUP BY 1, 2",
    "map01_inverted_index": "SELECT crawl_no, title FROM papers WHERE title IS NOT NULL",
    "jsn06_metadata_blob": "SELECT crawl_no, title FROM papers",
    "prm01_prompt": _DM.replace("citation_metadata AS m", "citation_metadata AS m, claim_text") + " SELECT instance_id, md5('Claim: ' || claim_text || chr(10) || 'Reference: ' || coalesce(m.title, 'unknown')) AS prompt_md5 FROM c WHERE claim_text IS NOT NULL",
    "neg01_author_drop_add": _DM + f", w AS (SELECT instance_id, m.authors AS a, {_S('len(m.authors)', chr(39) + 'drop' + chr(39), 'instance_id')} + 1 AS gone FROM c WHERE len(m.authors) > 0) SELECT instance_id, array_to_string(list_filter(CASE WHEN len(a) >= 2 THEN list_filter(a, lambda x, i: i <> gone) ELSE a END, lambda x: x IS NOT NULL), ';') AS dropped, CASE WHEN list_contains(a, 'A. N. Other') THEN len(a) ELSE len(a) + 1 END::INTEGER AS n_added FROM w",
    "neg03_doi_corruption": _DM + f", w AS (SELECT instance_id, m.identifiers.doi AS doi, {_S(3, chr(39) + 'doi' + chr(39), 'instance_id')} AS k, 1 + {_S(8, chr(39) + 'shift' + chr(39), 'instance_id')} AS s, regexp_extract(m.identifiers.doi, '(\\d)(\\D*)$', 1) AS l FROM c WHERE m.identifiers.doi <> '') SELECT instance_id, CASE WHEN k = 0 AND l <> '' THEN regexp_extract(doi, '^(.*)\\d\\D*$', 1) || ((TRY_CAST(l AS INTEGER) + s) % 10) || regexp_extract(doi, '\\d(\\D*)$', 1) WHEN k = 1 THEN doi || 'x' ELSE doi || '.invalid' END AS doi FROM w",
    "neg04_year_shift": _DM + f", w AS (SELECT instance_id, m.year AS y, (1 + {_S(4, chr(39) + 'by' + chr(39), 'instance_id')}) * CASE WHEN {_S(2, chr(39) + 'sign' + chr(39), 'instance_id')} = 0 THEN 1 ELSE -1 END AS b FROM c WHERE m.year IS NOT NULL), z AS (SELECT *, least(greatest(y + b, 1960), 2025) AS n FROM w) SELECT instance_id, (CASE WHEN n = y THEN CASE WHEN y >= 2025 THEN y - 1 ELSE y + 1 END ELSE n END)::INTEGER AS year FROM z",
    "neg05_venue_swap": _DM + f", v AS (SELECT list(venue_name ORDER BY venue_name) AS vs FROM venues), w AS (SELECT instance_id, list_filter(vs, lambda x: x <> coalesce(m.venue, '')) AS o FROM c, v) SELECT instance_id, o[{_S('len(o)', chr(39) + 'venue' + chr(39), 'instance_id')} + 1] AS venue FROM w",
    "neg08_targets": D + ", c AS (SELECT instance_id, regexp_replace(upper(trim(true_outputs.true_hallucination_category)), '[\\s_-]+', '_', 'g') AS category FROM d) SELECT category, instance_id FROM c WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('3|' || instance_id)) <= 20",
    "neg10_drift_fanout": D + ", c AS (SELECT instance_id, lower(claim_text) AS l, length(claim_text) AS n FROM d WHERE claim_text IS NOT NULL) SELECT instance_id, 'scope' AS drift FROM c WHERE regexp_matches(l, '\\d|all|most|many|some') UNION ALL SELECT instance_id, 'reversal' FROM c WHERE regexp_matches(l, 'improve|reduce|increase|outperform|fail|benefit') UNION ALL SELECT instance_id, 'strength' FROM c WHERE regexp_matches(l, 'suggest|show|may|can|might') UNION ALL SELECT instance_id, 'context_shift' FROM c WHERE n > 60",
    "spc01_field_scores": _SC + " SELECT instance_id, title, authors, year, venue, identifier FROM s",
    "spc06_overall": _SC + " SELECT instance_id, overall FROM o",
    "spc09_verdicts": _SC + ", h AS (SELECT *, (title < 0.5)::INTEGER + (authors < 0.5)::INTEGER + (year < 0.5)::INTEGER AS hard, coalesce(confidence, 0) AS cf FROM o) SELECT CASE WHEN overall < 0.5 OR hard >= 2 THEN 'unverified' WHEN overall < 0.7 OR hard = 1 OR cf < 0.6 THEN 'questionable' WHEN overall < 0.85 THEN 'partially_verified' WHEN overall <= 0.90 AND cf > 0.70 THEN 'likely_verified' WHEN overall > 0.90 AND cf > 0.80 THEN 'verified' ELSE 'partially_verified' END AS verdict, CASE WHEN title >= 0.95 THEN 'match' WHEN title >= 0.8 THEN 'minor' WHEN title >= 0.5 THEN 'major' ELSE 'mismatch' END AS title_verdict, count(*) AS n FROM h GROUP BY 1, 2",
    "spc10_quality_flags": _DM + " SELECT instance_id, array_to_string(list_filter([CASE WHEN coalesce(m.title, '') = '' THEN 'no_title' END, CASE WHEN coalesce(len(m.authors), 0) = 0 THEN 'no_authors' END, CASE WHEN m.year IS NULL OR NOT m.year BETWEEN 1900 AND 2030 THEN 'bad_year' END, CASE WHEN coalesce(m.venue, '') = '' THEN 'no_venue' END], lambda f: f IS NOT NULL), ',') AS flags, ((coalesce(m.title, '') <> '')::INTEGER + (coalesce(len(m.authors), 0) > 0)::INTEGER + (m.year IS NOT NULL)::INTEGER + (coalesce(m.venue, '') <> '')::INTEGER) / 4.0 AS completeness FROM c",
    "spc24_verdict_export": VERDICTS + " SELECT instance_id, truth, pred, m.title, m.year, array_to_string(list_filter(m.authors, lambda a: a IS NOT NULL), '; ') AS authors FROM v",
}
