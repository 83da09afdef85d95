"""Extraction from reference strings, LaTeX, BibTeX, bibliographies and TEI, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as t

#: Fixed value: the form of a citation command with its keys.
CITE = r"\\cite[a-z]*(?:\[[^\]]*\])?(?:\[[^\]]*\])?\{([^}]+)\}"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, cite_key): every key of every citation command; lines that are comments are no sites."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).where(~F.ltrim("line").startswith("%"))
    keys = F.explode(F.flatten(F.transform(F.regexp_extract_all("line", F.lit(CITE), F.lit(1)), lambda s: F.split(s, ","))))
    return lines.select(key, "line_no", keys.alias("k")).select(key, "line_no", F.trim("k").alias("cite_key")).where("cite_key <> ''")


def clean_latex(c: Column) -> Column:
    """Text of LaTeX: comments and commands dropped, arguments of font commands kept, braces and ties removed."""
    s = F.regexp_replace(c, r"(?m)(?<!\\)%.*$", "")
    s = F.regexp_replace(s, r"\\(?:begin|end)\{[^}]*\}", " ")
    s = F.regexp_replace(s, r"\\(?:label|ref|eqref|includegraphics)(?:\[[^\]]*\])?\{[^}]*\}", " ")
    s = F.regexp_replace(s, r"\\(?:emph|textbf|textit|texttt|section|subsection|paragraph)\*?\{([^}]*)\}", "$1")
    s = F.regexp_replace(s, r"\\([%&_#$])", "$1")
    s = F.regexp_replace(s, r"\\[a-zA-Z]+\*?", " ")
    return F.trim(t.squeeze(F.regexp_replace(s, r"[{}~]", " ")))


def citing_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, cite_key, sentence): the sentence around each citation, with the marker in place of the command.

    A paragraph ends at a blank line, at a paragraph or a section command. Everything stays within the row's arrays.
    """
    paragraphs = F.split(F.col(text), r"\r?\n\s*\r?\n|\\par\b|(?m)^\\(?:sub)?section\*?\{[^}]*\}")
    p = df.select(key, F.posexplode(paragraphs).alias("paragraph", "p")).where(F.col("p").rlike(r"\\cite"))
    # optional arguments may hold full stops, so they go before the text is parted into sentences
    bare = F.regexp_replace("p", r"(\\cite[a-z]*)(?:\[[^\]]*\])+\{", "$1{")
    s = p.select(key, "paragraph", F.posexplode(F.split(bare, r"(?<=[.!?])\s+")).alias("i", "s"))
    keys = F.flatten(F.transform(F.regexp_extract_all("s", F.lit(CITE), F.lit(1)), lambda x: F.split(x, ",")))
    marked = F.regexp_replace("s", CITE, "[CITATION]")
    return s.select(key, "paragraph", "i", F.explode(keys).alias("k"), clean_latex(marked).alias("sentence")).select(key, "paragraph", F.trim("k").alias("cite_key"), "sentence")


def bibitems(df: DataFrame, key: str, text: str) -> DataFrame:
    r"""(key, pos, cite_key, body): the \bibitem entries of a bibliography."""
    parts = F.split(F.col(text), r"\\bibitem")
    d = df.select(key, F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "b"))
    return d.select(key, "pos", found(F.col("b"), r"^\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}").alias("cite_key"), F.trim(t.squeeze(F.regexp_replace("b", r"^\s*(?:\[[^\]]*\])?\s*\{[^}]*\}", ""))).alias("body")).where("cite_key is not null")


def numbered_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, entry): lines regrouped into numbered entries; a line without a number continues the one before."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    start = F.col("line").rlike(r"^\s*\[\d+\]")
    w = Window.partitionBy(key).orderBy("line_no")
    g = lines.withColumn("no", F.sum(start.cast("int")).over(w)).where("no > 0")
    return g.groupBy(key, "no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls")).select(key, "no", F.trim(t.squeeze(F.array_join(F.transform("ls", lambda x: x["line"]), " "))).alias("entry"))


#: Platforms that host code and data.
PLATFORMS = "GitHub|Zenodo|Figshare|OSF|Kaggle"


def reference_fields(c: Column) -> dict[str, Column]:
    """The fields that rules find in a reference string; null where a rule finds nothing."""
    tidy = lambda x: F.regexp_replace(x, r"\.+$", "")
    first = F.regexp_extract(c, r"[\"“]([^\"”]{5,})[\"”]", 1)
    return {
        "year": found(c, r"\b(1[89]\d{2}|20\d{2})\b"),
        "quoted_title": F.nullif(F.trim(F.regexp_replace(first, r"[,.]$", "")), F.lit("")),
        "doi": tidy(found(c, r"(10\.\d{4,}/[^\s,;]+)")),
        "isbn": found(c, r"ISBN:?\s*([\d\-Xx]{10,17})"),
        "url": tidy(found(c, r"(https?://[^\s)]+)")),
        "access_date": found(c, r"(?:Accessed|Retrieved)[:\s]+([^.,;]+)"),
        "arxiv_id": found(c, r"(?i)arxiv[:\s./a-z]*(\d{4}\.\d{4,5})"),
        "volume": found(c, r"\b(\d+)\s*\(\d+\)"),
        "issue": found(c, r"\b\d+\s*\((\d+)\)"),
        "pages": found(c, r"(?:pp\.?|pages)\s*(\d+\s*[-–]+\s*\d+)"),
        "edition": found(c, r"(\d+)(?:st|nd|rd|th)\s+ed"),
        "report_number": found(c, r"Report No[.:]?\s*([\w\-/]+)"),
        "degree": found(c, r"(?i)\b(Ph\.?D\.?|Master(?:'s)?|M\.?Sc\.?)\b[^,.]{0,12}thesis"),
        "platform": found(c, rf"\b({PLATFORMS})\b"),
    }


def reference_type(c: Column) -> Column:
    """One of eight types, by the first rule that holds."""
    low = F.lower(c)
    return (
        F.when(low.rlike(r"https?://") & low.rlike("accessed|retrieved"), "web_resource")
        .when(low.rlike("arxiv|preprint"), "preprint")
        .when(low.rlike("thesis|dissertation"), "thesis")
        .when(low.rlike("technical report|tech\\. rep|report no"), "technical_report")
        .when(low.rlike("isbn"), "book")
        .when(low.rlike("journal|transactions|annals|letters"), "journal_article")
        .when(low.rlike(r"proceedings|\bproc\.|conference|symposium|\bin: "), "conference_paper")
        .when(low.rlike("press|publisher|springer|wiley|elsevier"), "book")
        .otherwise("other")
    )


def conference_name(c: Column) -> Column:
    """The first bracket of 2 to 25 characters."""
    return found(c, r"\(([^()]{2,25})\)")


def split_merged(c: Column) -> Column:
    """Reference strings that were run together, parted before the next bracketed number."""
    return F.filter(F.split(c, r"(?<=[.\d])\s+(?=\[\d+\]\s)"), lambda s: F.trim(s) != "")


def split_quoted(c: Column) -> Column:
    """Reference strings that were run together, parted after a full stop before names with initials that lead to a quoted title."""
    names = r"(?:[A-Z]\.\s*)+[A-Z][\p{L}'-]+(?:(?:,|\s+and|\s*&)\s+(?:[A-Z]\.\s*)+[A-Z][\p{L}'-]+)*"
    return F.filter(F.split(c, rf'(?<=[^A-Z]\.)\s+(?={names},?\s+["“])'), lambda s: F.trim(s) != "")


#: What a title is not, when it is sought among the sentences of a reference, and words of publishers, who are no places.
NO_TITLE = r"(?i)^(?:arxiv|corr|in |pp\.|vol\.|http|doi:|available|accessed|retrieved|\d{4})"
PUBLISHERS = r"(?i)\b(?:press|publish\w*|books?|group|wiley|elsevier|springer|arnold|wilkins|medical|science|physics)\b"


def filled_fields(c: Column) -> dict[str, Column]:
    """Every field that rules find in a reference string, beside those of reference_fields: title by its cascade, version, article number, institution, place."""
    base = reference_fields(c)
    sentences = F.transform(F.split(c, r"(?<![A-Z])\.\s+"), lambda s: F.trim(s))
    later = F.filter(F.slice(sentences, F.lit(2), F.greatest(F.size(sentences) - 1, F.lit(0))), lambda s: (F.length(s) > 5) & ~s.rlike(NO_TITLE))
    title = F.coalesce(base["quoted_title"], F.get(later, F.lit(0)))
    after = F.substr(c, F.position(title, c) + F.length(title))
    place = found(after, r"^[\"”]?\s*(?:\([^)]*\))?\s*,\s*([A-Z][A-Za-z ]{2,25}?)\s*(?:,|$)")
    return {
        **{k: v for k, v in base.items() if k != "quoted_title"}, "title": title, "title_source": F.when(base["quoted_title"].isNotNull(), "quotes").when(title.isNotNull(), "sentence"),
        "version": found(c, r"(?i)arxiv[:\s./a-z]*\d{4}\.\d{4,5}(v\d+)"), "article_number": F.when(base["pages"].isNull(), found(c, r":\s*([eE]?\d{3,})\b")),
        "institution": found(c, r"\.\s*([^.]*(?:University|Institute|College|Hospital)[^.]*)\.\s*(?i:phd|dissertation|thesis)"),
        "location": F.when((F.size(F.split(place, " ")) <= 3) & ~place.rlike(PUBLISHERS), place),
    }


def real_people(authors: Column, title: Column, places: Column) -> Column:
    """The authors of which no word is a word of the title or of a place or publisher."""
    words = lambda c: t.tokens(t.normalize_text(c))
    other = F.concat(words(F.coalesce(title, F.lit(""))), F.flatten(F.transform(F.array_compact(places), words)))
    return F.filter(authors, lambda a: a.isNotNull() & (F.trim(a) != "") & ~F.arrays_overlap(words(a), other))


def balanced(c: Column) -> Column:
    """Whether braces pair up."""
    plain = F.regexp_replace(c, r"\\[{}]", "")
    depth = F.aggregate(F.regexp_extract_all(plain, F.lit(r"([{}])"), F.lit(1)), F.lit(0), lambda d, b: F.when(d < 0, d).when(b == "{", d + 1).otherwise(d - 1))
    return depth == 0


def tei_raw(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, raw): the raw strings of TEI citations: the notes marked as raw references, else the bibliographic notes; blank ones are none."""
    x = F.col(xml)
    marked = F.xpath(x, F.lit("//biblStruct/note[@type='raw_reference']/text()"))
    notes = F.xpath(x, F.lit("//biblStruct/note[@type='biblio']/text()"))
    return df.select(key, F.explode(F.when(F.size(marked) > 0, marked).otherwise(notes)).alias("raw")).where(F.trim("raw") != "")


def tei_fields(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, title, venue, year, authors, volume, issue, pages, publisher, doi, arxiv_id, url): the fields of one TEI citation each.

    The title is that of the analytic part, else of the monograph; the venue is the monograph's. Authors are forename and surname of
    each person in either part, pages a range of from and to or the text of the scope. Absent fields are null.
    """
    x = F.col(xml)
    one = lambda path: F.nullif(F.trim(F.xpath_string(x, F.lit(path))), F.lit(""))
    # persons as forename|surname, in the order of the document
    persons = F.regexp_extract_all(x, F.lit(r"(?s)<persName\b[^>]*>(.*?)</persName>"), F.lit(1))
    part = lambda p, tag: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), F.trim), " ")
    authors = F.filter(F.transform(persons, lambda p: F.trim(F.concat_ws(" ", part(p, "forename"), part(p, "surname")))), lambda a: a != "")
    ends = F.concat_ws("-", one("//biblScope[@unit='page']/@from"), one("//biblScope[@unit='page']/@to"))
    return df.select(
        key, F.coalesce(one("//analytic/title"), one("//monogr/title")).alias("title"), one("//monogr/title").alias("venue"),
        F.nullif(F.regexp_extract(F.coalesce(one("//imprint/date/@when"), one("//imprint/date")), r"(1[89]\d{2}|20\d{2})", 1), F.lit("")).alias("year"), authors.alias("authors"),
        one("//biblScope[@unit='volume']").alias("volume"), one("//biblScope[@unit='issue']").alias("issue"), F.coalesce(F.nullif(ends, F.lit("")), one("//biblScope[@unit='page']")).alias("pages"),
        one("//publisher").alias("publisher"), one("//idno[@type='DOI']").alias("doi"), one("//idno[@type='arXiv']").alias("arxiv_id"), one("//ptr/@target").alias("url"),
    )


def tei_references(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, title, year, authors, raw): title, year, surnames and raw string of one TEI citation each."""
    x = F.col(xml)
    raw = F.coalesce(*[F.when(F.size(p) > 0, p[0]) for p in (F.xpath(x, F.lit(f"//biblStruct/note[@type='{k}']/text()")) for k in ("raw_reference", "biblio"))])
    surnames = F.xpath(x, F.lit("//author/persName/surname/text()"))
    return tei_fields(df.select(key, xml), key, xml).join(df.select(key, surnames.alias("surnames"), raw.alias("raw")), key).select(key, "title", "year", F.col("surnames").alias("authors"), "raw")


def html_links(html: Column) -> Column:
    """The absolute links of a page that lead to PDF files, each once."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|data-pdf-url)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.filter(hrefs, lambda u: u.rlike(r"(?i)^https?://.*(\.pdf|/pdf/)")))


def page_links(html: Column, base: Column) -> Column:
    """The links of a page to PDF files as absolute URLs of http or https, each once: anchors, data attributes, addresses set by scripts."""
    found_ = F.concat(
        F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|data-pdf-url)\s*=\s*["']([^"']+)["']"""), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"""(?i)(?:window\.open\(|location(?:\.href)?\s*=)\s*["']([^"']+)["']"""), F.lit(1)),
    )
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    whole = lambda u: F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(scheme, u)).when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(folder, u))
    return F.array_distinct(F.filter(F.transform(found_, whole), lambda u: u.rlike(r"(?i)^https?://") & u.rlike(r"(?i)\.pdf\b|/pdf/")))


def inverted_index_text(index: Column) -> Column:
    """The text of a map word -> positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def unfenced(raw: Column) -> Column:
    """Model output without the code fence around it."""
    return F.trim(F.regexp_replace(raw, r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", ""))


def closing(c: Column) -> Column:
    """What a text of JSON that breaks off lacks: the quotation mark of an open string, then the open brackets from the inside out."""
    bare = F.regexp_replace(c, r"\\.", "")  # escaped characters are neither marks nor brackets
    outside = F.regexp_replace(bare, r'"[^"]*"', "")  # whole strings are gone; a mark that is left opens one
    in_string = outside.contains('"')
    marks = F.regexp_extract_all(F.regexp_replace(outside, r'"(?s).*$', ""), F.lit(r"([\[\]{}])"), F.lit(1))
    step = lambda open_, m: F.when(m.isin("[", "{"), F.concat(m, open_)).otherwise(F.substr(open_, F.lit(2)))
    left = F.aggregate(marks, F.lit(""), step)
    return F.concat(F.when(in_string, '"').otherwise(""), F.translate(left, "[{", "]}"))


def recover_json(raw: Column) -> Column:
    """Valid JSON text from model output: as it is, with what breaks off closed, the widest object in it, or null."""
    s = unfenced(raw)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    cut = F.regexp_replace(s, r"[,:\s]+$", "")
    return F.coalesce(ok(s), F.when(s.startswith("{"), ok(F.concat(cut, closing(cut)))), ok(F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))))


def answered_json(raw: Column) -> Column:
    """The JSON of an answer without its fence: null for null or none, else the whole, the widest object, or the widest list."""
    s = unfenced(raw)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    wide = lambda p: ok(F.nullif(F.regexp_extract(s, p, 1), F.lit("")))
    return F.when(F.lower(s).isin("null", "none", ""), F.lit(None).cast("string")).otherwise(F.coalesce(ok(s), wide(r"(?s)(\{.*\})"), wide(r"(?s)(\[.*\])")))


def object_or_empty(raw: Column) -> Column:
    """The widest object of an answer, else the whole answer if it is JSON, else {}."""
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(ok(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))), ok(F.trim(raw)), F.lit("{}"))


def classification(raw: Column) -> Column:
    """The canonical label of a model's answer; UNCERTAIN for blank or hopeless answers."""
    j = recover_json(raw)
    direct = F.get_json_object(j, "$.classification")
    loose = F.nullif(F.regexp_extract(raw, r'"classification"\s*:\s*"([^"]+)"', 1), F.lit(""))
    return t.label_name(F.coalesce(direct, loose, F.lit("UNCERTAIN")))
