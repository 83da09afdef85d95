"""Mapping free-entered values to a canonical list: prefix-filter set-similarity join, then an exact check.

Every distinct value is cleaned once (letters folded, braces, quotes, numbers, ordinals and bibliographic
filler removed) and turned into a set of elements: the beginnings of two, three and four letters of each
content word, so that an abbreviation shares the elements of the word it shortens, and its last two letters, so that
a typing error at the start does not cost all elements of a word. A value of several passages is compared whole and by each
passage of several words, so that words of place, series and publisher do not hide the name.

The join: elements are ordered by rarity, counted over all distinct values and the list; each set is cut to
the prefix that must hold a shared element if the Jaccard similarity reaches the threshold; prefixes are
joined; pairs are dropped by length and by position; the Jaccard similarity of the rest is computed exactly.
The pairs left go through an alignment of words: every content word of the entry must be met by another word
of the value (the same word, a beginning of it, a known short form, or a typing error), and the value may
have nothing left over in the passages that hold those words. The best pair is kept: fewest errors, then
highest similarity, then the smallest key. A value without such a pair is reported with key 0.

Defined cases: null and blank values are no values; a value that consists only of filler gets 0; ties go to
the smallest key; an empty list gives 0 everywhere. Values are cleaned whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import checkpointed, salted_lookup

#: Least Jaccard similarity of element sets. A typing error at the start of a word costs three of its four elements: a name of
#: three words, of which two begin wrongly, still reaches 6 / 18.
THRESHOLD = 0.25
#: Least Jaccard similarity of the pairs of letters of a value in one word and a listed name run together. Two swaps in a word of eight letters leave 3 / 15.
RUN_THRESHOLD = 0.2
#: Words that carry no meaning in the name of a venue.
FILLER = frozenset(
    "a an the of on in at for and und et proc proceedings vol volume no number issue ed edn edition eds pp pages series "
    "preprint preprints eprint eprints e prints abs".split()
)
#: Short forms that are not a beginning of the word they stand for.
SHORT_FORMS = {
    "j": "journal", "jnl": "journal", "jrnl": "journal", "mtg": "meeting", "intl": "international", "intnl": "international",
    "natl": "national", "assn": "association", "assoc": "association", "dept": "department", "wkshp": "workshop",
    "bull": "bulletin", "rev": "review", "lett": "letters", "ltrs": "letters", "trns": "transactions", "cnf": "conference",
}

#: Filler that may also be a shortened last word of a name ("Robotic For"): kept at the end of a passage, and free to be left over.
ENDINGS = frozenset("for in an at no ed a".split())
#: Stands before the words of a value that begins as proceedings do: there a place may follow without a comma.
PROCEEDINGS = "^"

_IN_ACRONYM = re.compile(r"\bIn(?=[A-Z]{3,}\b)")
_PROC = re.compile(r"^\W*(?:in\b\W*)?(?:proceedings|proc)\b")
_BRACKET = re.compile(r"[(\[]([^()\[\]]*)[)\]]")
_EDITION = re.compile(r"\bed(?:n|ition)?\b[.\s]*\d+")
_NUMBER = re.compile(r"\d+(?:st|nd|rd|th)\b|\d+")
_WORD = re.compile(r"[^\W\d_]+")
#: Filler run on to the word before it.
_RUN_ON = re.compile(r"(?<=\w{4})(?:preprints?|eprints?)$")
#: Filler that a name run together may hold between its words.
_BETWEEN = "(?:a|an|the|of|on|in|at|for|and|und|et)*"


def clean(value: str) -> list[list[str]]:
    """The content words of a value, by passage (parted by commas, brackets, semicolons, colons and dashes)."""
    s = _IN_ACRONYM.sub("In ", value).replace("\\&", " and ").replace("&", " and ")
    s = re.sub(r"\\[\"'`^~=.uvHcdbtkr]\s*\{?\\?([a-zA-Z])\}?", r"\1", s)
    s = "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)).lower()
    s = re.sub(r"[{}]", "", s)
    proceedings = bool(_PROC.match(s))
    s = _BRACKET.sub(r" , \1 , ", s)
    s = _EDITION.sub(" , ", s)
    s = _NUMBER.sub(" ", s)
    s = re.sub(r"\blnx\b|\blncs\b|\blnai\b", " ", s)
    out = []
    for passage in re.split(r"[,;:()\[\]|/]|\s[-\u2013\u2014]+\s", s):
        found = [_RUN_ON.sub("", w) for w in _WORD.findall(passage)]
        last = found[-1] if len(found) > 2 and found[-1] in ENDINGS else None
        words = [SHORT_FORMS.get(w, w) for w in found if w not in FILLER or w == last]
        words = [w for i, w in enumerate(words) if w not in words[:i]]
        if words and words not in out:
            out.append(words)
    if proceedings and out and len(out[0]) > 2:
        out[0].insert(0, PROCEEDINGS)
    return out


def elements(passages: list[list[str]]) -> list[str]:
    words = [w for p in passages for w in p if w != PROCEEDINGS]
    if len(words) == 1:
        return ["=" + words[0]]
    return sorted({w[:k] for w in words for k in (2, 3, 4) if len(w) >= k} | {"$" + w[-2:] for w in words})


def pairs_of_letters(word: Column) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(2))))


def parts(passages: list[list[str]]) -> dict[str, list[str]]:
    """The elements of a value's core and of each of its passages of several words, by their text."""
    texts = {" ".join(p): elements([p]) for p in passages if len(p) > 1 and len(passages) > 1}
    return {"|".join(" ".join(p) for p in passages): elements(passages), **texts}


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j - 1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@lru_cache(maxsize=1 << 17)
def word_cost(typed: str, listed: str) -> float | None:
    """Errors by which `typed` stands for `listed`; None if it does not."""
    if typed == listed:
        return 0.0
    if len(typed) >= 2 and listed.startswith(typed):
        return 0.1
    most = 1 if len(listed) <= 4 else 2 if len(listed) <= 8 else 3
    d = distance(typed, listed, most)
    if d <= most:
        return float(d)
    if 3 <= len(typed) < len(listed):  # a short form with one typing error
        if min(distance(typed, listed[:k], 1) for k in (len(typed) - 1, len(typed), len(typed) + 1)) <= 1 and typed[0] == listed[0]:
            return 1.5
    return None


def align(passages: list[list[str]], entry: list[str]) -> float | None:
    """Errors by which the value names the entry; None if a word of either is left over."""
    if len(entry) == 1 and [len(p) for p in passages] == [1]:  # a beginning of the one word would be any word
        typed, most = passages[0][0], 0 if len(entry[0]) < 5 else 1 if len(entry[0]) < 8 else 2
        d = distance(typed, entry[0], most)
        return float(d) if d <= most else None
    proceedings = bool(passages) and passages[0][:1] == [PROCEEDINGS]
    words = [(p, w) for p, ws in enumerate(passages) for w in ws if w != PROCEEDINGS]
    free = set(range(len(words)))
    used: set[int] = set()
    at = -1
    total = 0.0
    for want in sorted(entry, key=len, reverse=True):
        best = None
        for i in free:
            c = word_cost(words[i][1], want)
            if c is not None and (best is None or (c, i) < best):
                best = (c, i)
        if best is None:
            return _joined(passages, entry)
        total += best[0]
        free.discard(best[1])
        used.add(words[best[1]][0])
        at = max(at, best[1])
    over = [i for i in free if words[i][0] in used and words[i][1] not in ENDINGS]
    if over and proceedings and len(over) <= 2 and min(over) > at:
        return total + 0.5
    if over:
        return _joined(passages, entry)
    return total


def _joined(passages: list[list[str]], entry: list[str]) -> float | None:
    """The same for a value whose words are wrongly joined or parted: compares the letters of a whole passage."""
    target = "".join(entry)
    if len(passages) == 1 and len(passages[0]) == 1 and len(entry) > 1 and re.fullmatch(_BETWEEN.join(map(re.escape, entry)), passages[0][0]):
        return 1.0
    found = [d for p in passages if (d := distance("".join(w for w in p if w != PROCEEDINGS), target, 2)) <= 2]
    return min(found) + 1.0 if found else None


def _cleaned(values: DataFrame) -> DataFrame:
    """(value, core, parts): core is the cleaned value as text, by which equal cleanings are joined only once; parts are its element sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cores, sets = [], []
            for v in b.column(0).to_pylist():
                passages = clean(v)
                cores.append("|".join(" ".join(p) for p in passages))
                sets.append(list(parts(passages).items()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cores, pa.string()), pa.array(sets, pa.map_(pa.string(), pa.list_(pa.string())))], ["value", "core", "parts"]
            )

    return values.mapInArrow(run, "value string, core string, parts map<string,array<string>>")


def _ranked(sets: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """(key, els array of (rarity rank, element), ascending): each set in the global order of rarity."""
    return (
        sets.select(key, F.explode("els").alias("el"))
        .join(order, "el")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("n", "el"))).alias("els"))
    )


def _prefixes(sets: DataFrame, key: str, t: float) -> DataFrame:
    """(key, size, pos, el): the elements of each set's prefix, pos counting from 0."""
    size = F.size("els")
    keep = size - F.ceil(size * F.lit(t)).cast("int") + 1
    return sets.select(
        key, size.alias(f"{key}_size"), F.posexplode(F.slice(F.transform("els", lambda e: e["el"]), F.lit(1), keep)).alias(f"{key}_pos", "el")
    )


def similar(left: DataFrame, right: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(l, r, jaccard): pairs of sets with a Jaccard similarity of at least t.

    left (l, els array<string>) and right (r, els array<string>), keys unique, els distinct. Prefix filter over
    the global order of rarity, length filter, positional filter, exact verification.
    """
    order = left.select(F.explode("els").alias("el")).unionAll(right.select(F.explode("els").alias("el"))).groupBy("el").agg(F.count("*").alias("n"))
    lr, rr = checkpointed(_ranked(left, order, "l")), checkpointed(_ranked(right, order, "r"))
    lp, rp = _prefixes(lr, "l", t), _prefixes(rr, "r", t)
    small, large = F.least("l_size", "r_size"), F.greatest("l_size", "r_size")
    # of the elements from the shared one on, at most the shorter rest can be common
    rest = 1 + F.least(F.col("l_size") - F.col("l_pos"), F.col("r_size") - F.col("r_pos")) - 1 + F.least("l_pos", "r_pos")
    need = F.lit(t) / (1 + F.lit(t)) * (F.col("l_size") + F.col("r_size"))
    pairs = lp.join(rp, "el").where((small >= F.lit(t) * large) & (rest >= need - 1e-9)).select("l", "r").distinct()
    both = pairs.join(lr.withColumnRenamed("els", "le"), "l").join(rr.withColumnRenamed("els", "re"), "r")
    common = F.size(F.array_intersect("le", "re"))
    return (
        both.withColumn("jaccard", common / (F.size("le") + F.size("re") - common))
        .where(F.col("jaccard") >= t)
        .select("l", "r", "jaccard")
    )


def map_values(values: DataFrame, entries: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(value, key, errors, jaccard) for each distinct value: the key of the entry meant, or 0.

    values: one string column `value`, distinct, neither null nor blank. entries: (key, name, alias): the
    canonical list; alias may be null. Entries without content words are met by nothing.
    """
    cleaned = checkpointed(_cleaned(values))
    cores = checkpointed(cleaned.where("core <> ''").groupBy("core").agg(F.first("parts").alias("parts")).select(F.col("core").alias("l"), F.explode("parts").alias("part", "els")))
    names = entries.select("key", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("name").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("alias").alias("value")))).alias("e")).select("key", "e.kind", "e.value").where("trim(coalesce(value, '')) <> ''").distinct()
    listed = checkpointed(names.select("key", "value").distinct().join(_cleaned(names.select("value").distinct()), "value").groupBy("core", "key").agg(F.first(F.col("parts")[F.col("core")]).alias("els")))
    sets = listed.groupBy("core").agg(F.first("els").alias("els")).withColumnRenamed("core", "r").where("r <> ''")
    sets_met = similar(cores.groupBy(F.col("part").alias("l")).agg(F.first("els").alias("els")), sets, t).withColumnRenamed("l", "part")
    # values in one word: typing errors in names of one word (acronyms are met by equality alone) and names run together
    alone = cores.where(~F.col("l").rlike("[ |]")).select("l", pairs_of_letters(F.col("l")).alias("els"))
    run = names.where("kind = 0").select("value").distinct()
    run = _cleaned(run).where("core <> ''").select(F.col("core").alias("r")).distinct().withColumn("els", pairs_of_letters(F.regexp_replace("r", "[ |^]", "")))
    run_met = similar(alone, run, RUN_THRESHOLD)
    pairs = cores.select("l", "part").join(sets_met, "part").select("l", "r", "jaccard").unionByName(run_met).groupBy("l", "r").agg(F.max("jaccard").alias("jaccard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = []
            for v, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                errors.append(align([p.split(" ") for p in v.split("|")], [w for p in e.split("|") for w in p.split(" ")]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(errors, pa.float64())], ["l", "r", "jaccard", "errors"])

    aligned = pairs.mapInArrow(run, "l string, r string, jaccard double, errors double").where("errors is not null")
    best = (
        aligned.join(listed.select(F.col("core").alias("r"), "key"), "r")
        .groupBy("l")
        .agg(F.min(F.struct("errors", (-F.col("jaccard")).alias("less"), "key")).alias("b"))
        .select(F.col("l").alias("core"), "b.key", "b.errors", (-F.col("b.less")).alias("jaccard"))
    )
    return cleaned.join(best, "core", "left").select("value", F.coalesce("key", F.lit(0)).alias("key"), "errors", "jaccard")


def resolve(occurrences: DataFrame, value_col: str, id_col: str, entries: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """occurrences with the column `key` added: the entry that each row's value means, 0 for none.

    Rows with a null or blank value are no occurrences and do not come out. Distinct values are mapped once; rows
    find their value's key by a salted join, so one value may fill a third of the table.
    """
    rows = occurrences.where(F.trim(F.regexp_replace(F.coalesce(F.col(value_col), F.lit("")), r"(?U)\s+", " ")) != "")
    counted = checkpointed(rows.groupBy(F.col(value_col).alias("value")).agg(F.count("*").alias("n")))
    mapped = map_values(counted.select("value"), entries, t).join(counted, "value").select(F.col("value").alias(value_col), "key", "n")
    return salted_lookup(rows, checkpointed(mapped), value_col, id_col, "n")
