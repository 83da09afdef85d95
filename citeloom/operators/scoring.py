"""Verification scores: similarity of titles, authors, years, venues and identifiers, verdicts by field and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import text as t
from citeloom.session import checkpointed


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 0 if one is missing."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((longer > 0) & a.isNotNull() & b.isNotNull(), 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))


def title_score(a: Column, b: Column) -> Column:
    """Half edit similarity, half word overlap, on normalised titles: the parts of the ensemble that need no model."""
    x, y = t.normalize_text(a), t.normalize_text(b)
    return F.coalesce(0.5 * edit_similarity(x, y) + 0.5 * t.jaccard(t.tokens(x), t.tokens(y)), F.lit(0.0))


def author_score(a: Column, b: Column) -> Column:
    """Overlap of surnames, first surname and number of authors, weighted .6, .2 and .2."""
    x, y = t.last_names(a), t.last_names(b)
    n = F.when(a.isNotNull() & b.isNotNull(), F.least(F.size(a), F.size(b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)))
    first = F.when((F.size(x) > 0) & (F.size(y) > 0) & (F.get(x, F.lit(0)) == F.get(y, F.lit(0))), 1.0).otherwise(0.0)
    return F.coalesce(0.6 * t.jaccard(x, y) + 0.2 * first + 0.2 * n, F.lit(0.0))


def year_score(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d == 0, 1.0).when(d == 1, 0.9).when(d == 2, 0.7).otherwise(0.0)


def venue_score(a: Column, b: Column) -> Column:
    x, y = t.normalize_text(a), t.normalize_text(b)
    return F.coalesce(F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.95).otherwise(0.9 * edit_similarity(x, y)), F.lit(0.0))


def identifier_score(a: Column, b: Column) -> Column:
    return F.when(t.is_missing(a) | t.is_missing(b), F.lit(None).cast("double")).when(t.identifier_match(a, b), 1.0).otherwise(0.0)


#: Weights of the fields in the overall score; they are renormalised over the fields that are there.
WEIGHTS = {"title": 0.35, "authors": 0.25, "year": 0.15, "venue": 0.15, "identifier": 0.10}


def overall(scores: dict[str, Column], confidence: Column) -> Column:
    """Weighted mean over the scores that are not null, damped by confidence, at most 1."""
    zero = F.lit(0.0)
    top = sum((F.when(s.isNotNull(), s * WEIGHTS[k]).otherwise(zero) for k, s in scores.items()), zero)
    room = sum((F.when(s.isNotNull(), F.lit(WEIGHTS[k])).otherwise(zero) for k, s in scores.items()), zero)
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(top, room), zero) * (0.9 + 0.1 * confidence))


def field_verdict(s: Column) -> Column:
    """Five levels of one field's score."""
    return F.when(s.isNull(), "missing").when(s >= 0.95, "match").when(s >= 0.8, "minor").when(s >= 0.5, "major").otherwise("mismatch")


def confidence(score: Column, threshold: float = 0.8) -> Column:
    return 1 - F.exp(-5 * F.abs(score - threshold))


def verdict(score: Column, hard: Column, conf: Column, fetched: Column) -> Column:
    """Six levels, in a fixed order because the bands overlap."""
    return (
        F.when(~fetched, "unfetchable")
        .when((score < 0.5) | (hard >= 2), "unverified")
        .when((score < 0.7) | (hard == 1) | (conf < 0.6), "questionable")
        .when(score < 0.85, "partially_verified")
        .when((score <= 0.90) & (conf > 0.70), "likely_verified")
        .when((score > 0.90) & (conf > 0.80), "verified")
        .otherwise("partially_verified")
    )


def quality_flags(title: Column, authors: Column, year: Column, venue: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(t.is_missing(title), "no_title"), F.when(F.coalesce(F.size(authors), F.lit(0)) == 0, "no_authors"),
            F.when(year.isNull() | ~year.between(1900, 2030), "bad_year"), F.when(t.is_missing(venue), "no_venue"),
        )
    )


def completeness(title: Column, authors: Column, year: Column, venue: Column) -> Column:
    """Share of the four core fields that are there."""
    there = lambda c: F.when(c, 1).otherwise(0)
    n = there(~t.is_missing(title)) + there(F.coalesce(F.size(authors), F.lit(0)) > 0) + there(year.isNotNull()) + there(~t.is_missing(venue))
    return n / 4.0


#: Words that the token overlap of titles leaves out.
STOP_WORDS = ["a", "an", "the", "of", "on", "in", "for", "and", "to", "with", "by", "from", "at"]
#: Weights of the title ensemble, of the author ensemble and of the fields in the whole score.
TITLE_PARTS = {"lev": 0.2, "jaro": 0.15, "ratcliff": 0.15, "jaccard": 0.15, "tfidf": 0.15, "semantic": 0.2}
AUTHOR_PARTS = {"jaccard": 0.4, "initials": 0.2, "sequence": 0.2, "full": 0.2}
FIELDS = {"title": 0.35, "authors": 0.30, "year": 0.15, "venue": 0.10, "identifiers": 0.10}


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    hits = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [ch for j, ch in enumerate(b) if taken[j]]
    moved = sum(x != y for x, y in zip(hits, other)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@F.udf(T.DoubleType(), useArrow=True)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common beginning of up to four letters where it is above 0.7; null if one is null."""
    if a is None or b is None:
        return None
    s = _jaro(a, b)
    k = 0
    while k < min(4, len(a), len(b)) and a[k] == b[k]:
        k += 1
    return s + k * 0.1 * (1 - s) if s > 0.7 else s


def content_tokens(c: Column) -> Column:
    return F.filter(t.tokens(c), lambda w: ~w.isin(STOP_WORDS))


def tfidf_cosine(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, tfidf): cosine of two texts of a row as vectors of word counts times smoothed inverse document frequency.

    Every text of either column is a document. The words of a row are matched in the row; only words and counts are shuffled.
    """
    docs = df.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).alias("s")), F.struct(F.lit(1).alias("side"), F.col(b).alias("s")))).alias("d"), key).select(key, "d.side", "d.s").where("s is not null")
    words = docs.select(key, "side", F.explode(t.tokens(F.col("s"))).alias("w")).groupBy(key, "side", "w").agg(F.count("*").alias("tf"))
    total = docs.count()
    idf = words.groupBy("w").agg((F.log((1 + F.lit(float(total))) / (1 + F.count("*"))) + 1).alias("idf"))
    both = words.join(idf, "w").groupBy(key, "w", "idf").agg(F.sum(F.when(F.col("side") == 0, F.col("tf")).otherwise(0)).alias("x"), F.sum(F.when(F.col("side") == 1, F.col("tf")).otherwise(0)).alias("y"))
    wx, wy = F.col("x") * F.col("idf"), F.col("y") * F.col("idf")
    sums = both.groupBy(key).agg(F.sum(wx * wy).alias("xy"), F.sum(wx * wx).alias("xx"), F.sum(wy * wy).alias("yy"))
    return df.select(key).join(sums, key, "left").select(key, F.coalesce(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0)).alias("tfidf"))


def title_parts(a: Column, b: Column) -> dict[str, Column]:
    """The parts of the title ensemble that two titles give by themselves (normalised); 0 where one is missing."""
    x, y = F.trim(t.normalize_title(a)), F.trim(t.normalize_title(b))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {"lev": zero(edit_similarity(x, y)), "jaro": zero(jaro_winkler(x, y)), "ratcliff": zero(t.sequence_ratio(x, y)), "jaccard": zero(t.jaccard(content_tokens(x), content_tokens(y)))}


def title_ensemble(parts: dict[str, Column], a: Column, b: Column) -> Column:
    """The weighted sum of all parts; 0 for a missing title, 0.9 for equal main titles with different subtitles."""
    main = lambda c: F.trim(t.normalize_title(F.split_part(c, F.lit(":"), F.lit(1))))
    whole = lambda c: F.trim(t.normalize_title(c))
    total = sum((parts[k] * w for k, w in TITLE_PARTS.items()), F.lit(0.0))
    subtitle = (a.contains(":") | b.contains(":")) & (main(a) == main(b)) & (main(a) != "") & (whole(a) != whole(b))
    return F.when(t.is_missing(a) | t.is_missing(b), 0.0).when(subtitle, 0.9).otherwise(total)


def person(a: Column) -> Column:
    """(first, last) of a name, `Last, First` or `First Last`, in lower case."""
    s = F.lower(F.trim(t.squeeze(a)))
    words = F.split(s, " ")
    comma = s.contains(",")
    last = F.when(comma, F.trim(F.split_part(s, F.lit(","), F.lit(1)))).otherwise(F.element_at(words, -1))
    first = F.when(comma, F.trim(F.split_part(s, F.lit(","), F.lit(2)))).otherwise(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
    return F.struct(first.alias("first"), last.alias("last"))


def author_ensemble(extracted: Column, found: Column) -> Column:
    """Surnames, initials of equal surnames, the first three in order, and full names; x 0.9 for a truncated list; 1 for equal lists.

    One author on each side: 1 if equal, 0.5 for the same surname and initial, else 0. A side without authors: 0.
    """
    named = lambda c: F.filter(c, lambda a: (F.trim(a) != "") & ~F.lower(F.trim(a)).isin("others", "et al", "et al."))
    e, f = F.transform(named(extracted), person), F.transform(named(found), person)
    lasts = lambda p: F.array_distinct(F.transform(p, lambda q: q["last"]))
    short = lambda p: F.array_distinct(F.transform(p, lambda q: F.concat(q["last"], F.lit("|"), F.substring(q["first"], 1, 1))))
    full = lambda p: F.array_distinct(F.transform(p, lambda q: F.concat(q["first"], F.lit(" "), q["last"])))
    common = F.array_intersect(lasts(e), lasts(f))
    with_initial = F.array_distinct(F.transform(F.array_intersect(short(e), short(f)), lambda s: F.split_part(s, F.lit("|"), F.lit(1))))
    place = lambda i: F.when(F.get(e, F.lit(i))["last"] == F.get(f, F.lit(i))["last"], 1).otherwise(0)
    parts = {
        "jaccard": t.jaccard(lasts(e), lasts(f)), "initials": F.coalesce(F.try_divide(F.size(with_initial), F.size(common)), F.lit(0.0)),
        "sequence": (place(0) + place(1) + place(2)) / 3.0, "full": t.jaccard(full(e), full(f)),
    }
    total = sum((parts[k] * w for k, w in AUTHOR_PARTS.items()), F.lit(0.0))
    truncated = F.exists(extracted, lambda a: F.lower(F.trim(a)).isin("others", "et al", "et al."))
    one = (F.size(e) == 1) & (F.size(f) == 1)
    single = F.when(F.size(with_initial) > 0, 0.5).otherwise(0.0)
    score = F.when((F.coalesce(F.size(e), F.lit(0)) <= 0) | (F.coalesce(F.size(f), F.lit(0)) <= 0), 0.0).when(e == f, 1.0).when(one, single).otherwise(total)
    return F.when(F.coalesce(truncated, F.lit(False)), score * 0.9).otherwise(score)


def venue_kind(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("arxiv|preprint"), "preprint").when(low.rlike("workshop"), "workshop").when(low.rlike("conference|conf\\.|proceedings|proc\\.|symposium|meeting"), "conference").when(low.rlike("journal|transactions|annals|letters|review"), "journal")


def venue_ensemble(a: Column, b: Column, same_entry: Column, semantic: Column | None = None) -> Column:
    """The best of equal (1), a listed short form (0.95), alike in letters (0.9) and in meaning (0.85), less 0.2 for another kind; null if one is missing.

    same_entry: whether both are names or short forms of one listed venue; semantic: a similarity by a model, 0 to 1.
    """
    x, y = F.trim(t.normalize_title(a)), F.trim(t.normalize_title(b))
    alike = F.greatest(edit_similarity(x, y), F.coalesce(jaro_winkler(x, y), F.lit(0.0))) > 0.85
    meant = (semantic > 0.9) if semantic is not None else F.lit(False)
    generic = x.isin("arxiv") | y.isin("arxiv")
    best = F.when(x == y, 1.0).when(generic, 0.0).when(F.coalesce(same_entry, F.lit(False)), 0.95).when(alike, 0.9).when(meant, 0.85).otherwise(0.0)
    other = F.coalesce(venue_kind(a) != venue_kind(b), F.lit(False))
    return F.when(t.is_missing(a) | t.is_missing(b), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), best - F.when(other, 0.2).otherwise(0.0)))


def identifier_ensemble(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The mean over the identifiers that both have (doi, arxiv_id, isbn); 0.5 if only one side has any, null if neither has.

    DOI: 1 if equal, 0.8 if equal but for a version; arXiv: 1, and 0.95 for another version; ISBN: 1 as thirteen digits.
    """
    has = lambda c: ~t.is_missing(c)
    low = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^(https?://)?(dx\.)?(doi\.org/|arxiv\.org/(abs|pdf)/)|^(doi|arxiv):\s*", "")
    base = lambda c: F.regexp_replace(low(c), r"\.?v\d+$", "")
    digits = lambda c: F.regexp_replace(F.upper(c), "[^0-9X]", "")
    thirteen = lambda c: F.when(F.length(digits(c)) == 10, t.isbn13(digits(c))).otherwise(digits(c))
    rules = {
        "doi": lambda x, y: F.when(low(x) == low(y), 1.0).when(base(x) == base(y), 0.8).otherwise(0.0),
        "arxiv_id": lambda x, y: F.when(low(x) == low(y), 1.0).when(base(x) == base(y), 0.95).otherwise(0.0),
        "isbn": lambda x, y: F.when(thirteen(x) == thirteen(y), 1.0).otherwise(0.0),
    }
    kinds = [k for k in rules if k in a and k in b]
    scores = F.array_compact(F.array(*[F.when(has(a[k]) & has(b[k]), rules[k](a[k], b[k])) for k in kinds]))
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda s, v: s + v), F.size(scores))
    some = lambda side: F.array_contains(F.array(*[has(side[k]) for k in kinds]), True)
    return F.when(F.size(scores) > 0, mean).when(some(a) | some(b), 0.5)


def whole_score(scores: dict[str, Column], conf: Column) -> Column:
    """Weighted mean over the fields that are there, damped by confidence, raised by a twentieth where the identifiers agree, at most 1."""
    zero = F.lit(0.0)
    top = sum((F.when(s.isNotNull(), s * FIELDS[k]).otherwise(zero) for k, s in scores.items()), zero)
    room = sum((F.when(s.isNotNull(), F.lit(FIELDS[k])).otherwise(zero) for k, s in scores.items()), zero)
    agreed = F.when(F.coalesce(scores["identifiers"] == 1.0, F.lit(False)), 1.05).otherwise(1.0)
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(top, room), zero) * (0.9 + 0.1 * conf) * agreed)


def candidate_score(title: Column, authors: Column, year_gap: Column, venue: Column) -> Column:
    """Similarity of titles .5, surnames .3, years .2 (half for a year off), and venues .1 where both have one."""
    year = F.when(year_gap == 0, 1.0).when(year_gap == 1, 0.5).otherwise(0.0)
    return 0.5 * title + 0.3 * authors + 0.2 * year + 0.1 * F.coalesce(venue, F.lit(0.0))


def candidate_status(score: Column) -> Column:
    return F.when(score > 0.8, "match").when(score >= 0.6, "ambiguous_match").otherwise("no_confident_match")


def extraction_quality(title: Column, authors: Column, year: Column, venue: Column, doi: Column, arxiv: Column, parser: Column) -> dict[str, Column]:
    """completeness, validity, confidence, issues and warnings of one extracted reference; parser: the parser's own confidence."""
    has = lambda c: ~t.is_missing(c)
    n_authors = F.coalesce(F.size(authors), F.lit(0))
    w = lambda ok, x: F.when(ok, x).otherwise(0.0)
    ok = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    ids = has(doi) | has(arxiv)
    complete = F.round(w(has(title), 0.3) + w(n_authors > 0, 0.3) + w(year.isNotNull(), 0.2) + w(has(venue), 0.1) + w(ids, 0.1), 6)
    valid = (ok(year.between(1900, 2028)) + ok(n_authors > 0) + ok(F.length(title) > 5) + ok(~has(doi) | doi.rlike(r"^10\.\d{4,9}/\S+$")) + ok(~has(arxiv) | arxiv.rlike(r"^(\d{4}\.\d{4,5}(v\d+)?|[a-z-]+/\d{7})$"))) / 5.0
    sure = F.round(0.5 * parser + 0.3 * complete + 0.2 * valid, 6)
    missing = ok(~has(title)) + ok(n_authors == 0) + ok(year.isNull())
    issues = F.array_compact(F.array(
        F.when(~has(title) | (F.length(title) < 5), "missing_title"), F.when(n_authors == 0, "missing_authors"), F.when(year.isNull(), "missing_year"),
        F.when(~year.between(1900, 2028), "invalid_year"), F.when(sure < 0.6, "low_confidence"), F.when(missing > 1, "partial_parsing"),
    ))
    warnings = F.array_compact(F.array(
        F.when(~ids, "no_identifiers"), F.when(~has(venue), "no_venue"), F.when(F.exists(authors, lambda a: a.rlike(r"\b[A-Z]\.")), "abbreviated_authors"),
        F.when(F.exists(authors, lambda a: F.lower(F.trim(a)).isin("others", "et al", "et al.")), "et_al_present"),
    ))
    return {"completeness": complete, "validity": F.round(valid, 6), "confidence": sure, "issues": F.array_join(issues, ","), "warnings": F.array_join(warnings, ",")}


def _meetings(d: DataFrame, group: str, title: str, least: float, widest: int = 9) -> DataFrame:
    """(x, y): ids of titles of one group that share a part where a pair more similar than `least` must share one; d has `__id` and `__k`, the edits a title as the longer of a pair may bear.

    A title is cut into one part more than the edits of its longest partner, so one part stays whole, and it lies near its place: in the longer
    title that part begins as far off as the edits before and after it allow. Titles of more than `widest` parts are looked up at all places, which are fewer there.
    """
    share, size, long = 1 - least, F.col("__size"), F.length(title)
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.lit(share) * F.floor(n / F.lit(least) + 1e-9) - 1e-9)).cast("int")
    cut = lambda df: df.withColumn("__m", parts(F.col("__l"))).where("__m > 1").withColumn("__size", F.floor(F.col("__l") / F.col("__m")).cast("int")).withColumn("__plain", F.col("__m") - F.col("__l") % F.col("__m"))
    begin = lambda df: df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__m") - 1))).withColumn("__at", 1 + F.col("__i") * size + F.greatest(F.lit(0), F.col("__i") - F.col("__plain"))).withColumn("__len", size + (F.col("__i") >= F.col("__plain")).cast("int"))
    near = F.col("__m") <= widest
    keyed = lambda df, at, length, *place: df.select(F.xxhash64(group, F.substring(F.col(title), at, length), *place).alias("key"), "__id", at.alias("at"), "__k")
    place = (F.when(near, F.col("__l")).otherwise(0), F.when(near, F.col("__i")).otherwise(0))
    shorter = keyed(begin(cut(d.withColumn("__l", long))), F.col("__at"), F.col("__len"), *place)
    asked = cut(d.where("__k > 0").withColumn("__l", F.explode(F.sequence(long - F.col("__k"), long))))
    off, i, m = long - F.col("__l"), F.col("__i"), F.col("__m")
    first = F.greatest(F.lit(1), F.col("__at") - i, F.col("__at") + off - (m - 1 - i))
    last = F.least(long - F.col("__len") + 1, F.col("__at") + i, F.col("__at") + off + (m - 1 - i))
    longer = keyed(begin(asked.where(near)).withColumns({"__first": first, "__last": last}).where("__first <= __last").withColumn("__p", F.explode(F.sequence("__first", "__last"))), F.col("__p"), F.col("__len"), "__l", "__i")
    sizes = asked.where(~near).select(group, title, "__id", "__k", F.explode(F.array("__size", size + 1)).alias("__len")).distinct()
    anywhere = keyed(sizes.withColumn("__p", F.explode(F.sequence(F.lit(1), long - F.col("__len") + 1))), F.col("__p"), F.col("__len"), F.lit(0), F.lit(0))
    b = shorter.select("key", F.col("__id").alias("b"), F.col("at").alias("sb"))
    met = longer.unionAll(anywhere).join(b, "key").where((F.abs(F.col("at") - F.col("sb")) <= F.col("__k")) & (F.col("__id") != F.col("b")))
    return met.select(F.least("__id", "b").alias("x"), F.greatest("__id", "b").alias("y")).distinct()


def near_titles(titles: DataFrame, group: str, title: str, pos: str, least: float = 0.95, few: int = 400) -> DataFrame:
    """(group, title, first_pos): of each title the least position of a title of its group that is equal to it or more similar than `least`.

    Similarity is 1 less the edit distance by the longer length. In groups of at most `few` titles each meets each; in larger ones they meet by
    the parts that so few edits leave whole. Pairs are filtered by length and verified exactly, so both ways find the same.
    """
    share = 1 - least
    d = titles.groupBy(group, title).agg(F.min(pos).alias("__pos")).withColumn("__id", F.monotonically_increasing_id())
    d = checkpointed(d.withColumn("__k", F.greatest(F.lit(0), F.ceil(F.lit(share) * F.length(title) - 1e-9) - 1).cast("int")))
    hot = F.broadcast(checkpointed(d.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") > few).select(group)))  # one group for `few` titles at most
    side = lambda df, s: df.select(group, F.col("__id").alias(f"i{s}"), F.col(title).alias(f"t{s}"), F.col("__pos").alias(f"p{s}"), F.col("__k").alias(f"k{s}"))
    small, large = d.join(hot, group, "left_anti"), checkpointed(d.join(hot, group, "left_semi"))
    each = side(small, "a").join(side(small, "b"), group).where("pb < pa and ia <> ib")
    met = _meetings(large, group, title, least).join(side(large, "a").withColumnRenamed("ia", "x"), "x").join(side(large, "b").withColumnsRenamed({"ib": "y", group: "__g"}), "y")
    later = F.col("pa") > F.col("pb")
    met = met.where((F.col(group) == F.col("__g")) & (F.col("pa") != F.col("pb"))).select(group, F.when(later, F.col("ta")).otherwise(F.col("tb")).alias("ta"), F.when(later, F.col("tb")).otherwise(F.col("ta")).alias("tb"), F.least("pa", "pb").alias("pb"), "ka", "kb")
    most = F.greatest("ka", "kb")
    alike = (most > 0) & (F.abs(F.length("ta") - F.length("tb")) <= most) & (F.call_function("levenshtein", "ta", "tb", most) >= 0)
    near = [df.where(alike).select(group, F.col("ta").alias(title), "pb") for df in (each, met)]
    near = near[0].unionAll(near[1]).groupBy(group, title).agg(F.min("pb").alias("__near"))
    return d.join(near, [group, title], "left").select(group, title, F.least("__pos", "__near").alias("first_pos"))


def first_of_range(c: Column, now: int) -> Column:
    """The year of a text: the first of a range, '17 as 2017 (19xx beyond next year), null outside 1900 to now + 2."""
    four = F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")
    two = F.nullif(F.regexp_extract(c, r"['’](\d{2})\b", 1), F.lit("")).cast("int")
    y = F.coalesce(four, F.when(two + 2000 > now + 1, two + 1900).otherwise(two + 2000))
    return F.when(y.between(1900, now + 2), y)


def split_people(c: Column) -> Column:
    """The names of an author string, parted at semicolons, `and` and `&`; affiliations in brackets are dropped, and so are `et al.` and `others`."""
    bare = F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", "")
    names = F.transform(F.split(bare, r"\s*;\s*|\s+and\s+|\s*&\s*"), lambda a: F.trim(F.regexp_replace(t.squeeze(a), r"(?i),?\s*\bet al\.?$", "")))
    return F.filter(names, lambda a: (a != "") & (F.lower(a) != "others"))
