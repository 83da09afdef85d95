"""Variant spellings of names: q-gram prefix-filtered similarity join and soft weighted token similarity.

1. Every distinct spelling is parsed into folded tokens (names_parse). Spellings whose tokens agree apart from
   case, accents, order, titles and punctuation are one form; a full name's token set is its key.
2. Typing errors: the q-gram sets of all tokens are joined by their prefixes. Grams are ordered by rarity over all
   tokens; one edit or one swap of neighbours spoils at most q + 1 of a token's padded q-grams, so two tokens within one
   error share one of the q + 2 rarest of each; pairs are filtered by length and position. A token may be a typing error of
   a commoner one unless both are established (more names have it than errors explain) or both are known given names, as Ben and Jen.
3. Names meet by their tokens: each key is read as every name that replaced tokens make of it, in any number of
   tokens, while the soft weighted token similarity holds: equal tokens count fully, similar ones by one less their share of
   wrong letters, all weighted by rarity (log of the number of keys over those with the token). Keys that can stand for one
   name are linked if their dissimilarities to it add up to no more than the bound.
4. Linked keys form entities (connected components). A key whose forms have several middle initials stands
   for several people: it is split by them, and a form without one stays alone.
5. Short forms (initials, nicknames) are given to the entity they can mean if there is exactly one.

Defined cases: null and blank names and `others` are no names; a single word without initials is linked only with
spellings of the same form; ambiguous short forms stay alone; repeated spellings count once; without names
there are no rows. No step pairs the members of a group other than the result itself, which has the pairs of an entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.names_parse import GIVEN_NAMES, links
from citeloom.session import checkpointed, salted_lookup

Q = 3
#: Least soft weighted token similarity of two keys.
SIMILARITY = 0.8
#: At most this share of the keys of a token has it with one and the same typing error; a token that is in more, by so many
#: standard deviations, is a name of its own.
ERROR_RATE, DEVIATIONS = 0.03, 3.3
#: Names with more readings than this are compared by the classes of their tokens, not by their readings.
MOST_WAYS = 4096


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_authors(author: Column) -> Column:
    """The names of an author field: parted by the word `and` between white space, except within braces."""
    parts = F.split(author, r"(?<=\s)and(?=\s)")
    depth = lambda s: F.length(F.regexp_replace(s, r"[^{]", "")) - F.length(F.regexp_replace(s, r"[^}]", ""))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("d"))

    def step(acc: Column, part: Column) -> Column:
        text = F.concat(acc["open"], part)
        d = depth(text)
        return F.when(d > 0, F.struct(acc["done"].alias("done"), F.concat(text, F.lit("and")).alias("open"), d.alias("d"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(text)).alias("done"), F.lit("").alias("open"), F.lit(0).alias("d"))
        )

    rest = lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(F.regexp_replace(acc["open"], "and$", "")))).otherwise(acc["done"])
    return F.when(author.contains("{"), F.aggregate(parts, empty, step, rest)).otherwise(parts)


def spellings(*columns: DataFrame) -> DataFrame:
    """(name): the distinct trimmed names that are neither empty nor `others`; each input has one string column."""
    every = None
    for df in columns:
        one = df.select(trimmed(F.col(df.columns[0])).alias("name"))
        every = one if every is None else every.unionAll(one)
    return every.where("name <> '' and name <> 'others'").distinct()


def _parsed(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*[links(n) for n in b.column(0).to_pylist()])) or [[]] * 5
            s, a = pa.string(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(cols, (s, a, s, a, a))]],
                ["name", "form", "keys", "middle", "holds", "asks"],
            )

    return names.mapInArrow(run, "name string, form string, keys array<string>, middle string, holds array<string>, asks array<string>")


def _swaps(s: Column) -> Column:
    """The text with each pair of neighbours swapped."""
    return F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.lit(1)), F.substr(s, i, F.lit(1)), F.substr(s, i + 2)))


def one_error(a: Column, b: Column) -> Column:
    """Whether a and b differ by one letter left out, added or replaced, or by one swap of neighbours."""
    return (F.levenshtein(a, b, 1) == 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & F.array_contains(_swaps(a), b))


def established(rarer: Column, commoner: Column) -> Column:
    """Whether a token in `rarer` keys is more than the typing errors of one in `commoner` keys, at ERROR_RATE, explain.

    A test of counts with stabilised variance: evidence accumulates with the keys, and there is no size at which the rule changes.
    """
    return 2 * (F.sqrt(rarer) - F.sqrt(ERROR_RATE * commoner)) >= DEVIATIONS


def _gram_prefix(tokens: DataFrame, q: int, n: int) -> DataFrame:
    """(tok, g, p): the n rarest padded q-grams of each token with their positions, by their number of tokens."""
    padded = F.concat(F.lit("#"), "tok", F.lit("#"))
    grams = tokens.select("tok", F.explode(F.transform(F.sequence(F.lit(1), F.length("tok") + 3 - q), lambda p: F.struct(p.alias("p"), F.substr(padded, p, F.lit(q)).alias("g")))).alias("e")).select("tok", "e.p", "e.g")
    rarity = grams.groupBy("g").agg(F.count("*").alias("df"))
    ordered = grams.join(rarity, "g").groupBy("tok").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "g", "p"))), 1, n).alias("es"))
    return ordered.select("tok", F.explode("es").alias("e")).select("tok", F.concat(F.lit(f"{q}"), "e.g").alias("g"), "e.p")


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """(tok, n, alt, n_alt): each token with the commoner tokens of which it may be a typing error. tokens: (tok, n) distinct.

    The q-gram sets of the tokens are joined by prefixes: one error spoils at most q + 1 grams of a set, so the q + 2 rarest of
    either hold a common one. Of two tokens that are equally common the smaller is the one meant.
    """
    long = tokens.where(F.length("tok") >= Q)
    # four letters and fewer have too few trigrams: a swap may spoil all, but not all pairs of letters
    short = tokens.where((F.length("tok") > 1) & (F.length("tok") <= Q + 1))
    prefix = checkpointed(_gram_prefix(long, Q, Q + 2).unionAll(_gram_prefix(short, Q - 1, Q + 1)).join(tokens, "tok"))
    x = prefix.select("tok", "n", "g", "p")
    y = prefix.select(F.col("tok").alias("alt"), F.col("n").alias("n_alt"), "g", F.col("p").alias("p_alt"))
    known = sorted(GIVEN_NAMES)
    return (
        x.join(y, "g")
        .where("tok <> alt and abs(p - p_alt) <= 1 and abs(length(tok) - length(alt)) <= 1 and (n_alt > n or (n_alt = n and alt < tok))")
        .where(~established(F.col("n"), F.col("n_alt")) & ~(F.col("tok").isin(known) & F.col("alt").isin(known)))
        .select("tok", "n", "alt", "n_alt").distinct()
        .where(one_error(F.col("tok"), F.col("alt")))
    )


def typing_errors(keys: DataFrame) -> DataFrame:
    """(a, b): pairs of keys that differ by typing errors, in any number of tokens. keys: (key) distinct, tokens after the first colon.

    Each key is read as every name it may stand for: any of its tokens may be replaced by one that it is a typing error of, as
    long as the soft weighted similarity to the name so made stays at SIMILARITY. Keys that can stand for one name meet
    there, whether it occurs or not, and are linked with the key nearest to it if the dissimilarities of both add up to no
    more than 1 - SIMILARITY. Two keys whose tokens are equal or similar one by one always meet, at the better of each two tokens.
    """
    each = keys.select("key", F.posexplode(F.split(F.substring_index("key", ":", -1), " ")).alias("i", "tok")).where("tok <> ''")
    counts = checkpointed(each.select("key", "tok").distinct().groupBy("tok").agg(F.count("*").alias("n")))
    total = keys.count()
    weight = lambda n: F.log(1 + F.lit(float(total)) / n)
    pairs = checkpointed(similar_tokens(counts))
    pair_weight = (weight(F.col("n")) + weight(F.col("n_alt"))) / 2
    likeness = 1 - 1 / F.greatest(F.length("tok"), F.length("alt"))
    alts = pairs.groupBy("tok").agg(F.collect_list(F.struct(F.col("alt").alias("t"), (pair_weight * likeness).alias("gain"), pair_weight.alias("w"))).alias("alts"))
    itself = F.struct(F.col("tok").alias("t"), weight(F.col("n")).alias("gain"), weight(F.col("n")).alias("w"))
    readings = counts.join(alts, "tok", "left").select("tok", "n", F.concat(F.array(itself), F.coalesce("alts", F.array().cast("array<struct<t:string,gain:double,w:double>>"))).alias("options"))
    spelled = (
        salted_lookup(each, readings, "tok", "key", "n").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "options"))).alias("es"))
        .select("key", F.transform("es", lambda e: e["options"]).alias("es"))
    )
    spelled = checkpointed(spelled.withColumn("ways", F.aggregate("es", F.lit(1.0), lambda n, o: n * F.size(o))))
    most = (1 - SIMILARITY) * F.aggregate("es", F.lit(0.0), lambda w, os: w + F.array_max(F.transform(os, lambda o: o["w"])))
    first = F.array(F.struct(F.array().cast("array<string>").alias("ts"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("w")))

    def extend(ways: Column, options: Column) -> Column:
        grown = F.flatten(F.transform(ways, lambda a: F.transform(options, lambda o: F.struct(F.concat(a["ts"], F.array(o["t"])).alias("ts"), (a["gain"] + o["gain"]).alias("gain"), (a["w"] + o["w"]).alias("w")))))
        return F.filter(grown, lambda a: a["w"] - a["gain"] <= most + 1e-9)  # no name so begun is lost that could still reach the similarity

    meant = (
        spelled.where(F.col("ways") <= MOST_WAYS).select("key", F.explode(F.aggregate("es", first, extend)).alias("m"))
        .select("key", F.concat(F.substring("key", 1, 2), F.array_join(F.array_sort("m.ts"), " ")).alias("name"), (1 - F.col("m.gain") / F.col("m.w")).alias("d"))
        .where(F.col("d") <= 1 - SIMILARITY + 1e-9)
    )
    links = linked_by_name(meant)
    if spelled.where(F.col("ways") > MOST_WAYS).limit(1).count():
        links = links.unionAll(_long_names(spelled, pairs)).distinct()
    return links


def linked_by_name(meant: DataFrame) -> DataFrame:
    """(a, b): keys linked with the one nearest to a name that both can stand for. meant: (key, name, d)."""
    meant = checkpointed(meant)
    centre = meant.groupBy("name").agg(F.min(F.struct("d", "key")).alias("c"), F.count("*").alias("n")).where("n > 1").select("name", "c.d", "c.key")
    centre = centre.withColumnsRenamed({"d": "d_near", "key": "near"})
    return (
        meant.join(centre, "name").where((F.col("key") != F.col("near")) & (F.col("d") + F.col("d_near") <= 1 - SIMILARITY + 1e-9))
        .select(F.least("key", "near").alias("a"), F.greatest("key", "near").alias("b")).distinct()
    )


def _long_names(spelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the same for keys with more than MOST_WAYS readings, which are not spelled out: they meet by the classes of their tokens.

    Similar tokens have one class (connected component), so two keys whose tokens are similar one by one have the same
    classes. Such keys have a dozen ambiguous tokens or more, so few share all classes; their tokens are compared pair by pair, those of one class in their order.
    """
    classes = components(pairs.select(F.col("tok").alias("a"), F.col("alt").alias("b"))).select(F.col("node").alias("tok"), "label")
    tokens = spelled.select("key", F.explode("es").alias("o")).select("key", F.col("o")[0]["t"].alias("tok"), F.col("o")[0]["w"].alias("w"))
    named = tokens.join(classes, "tok", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("label", "tok").alias("c"), "tok", "w"))).alias("ts"))
    long = spelled.where(F.col("ways") > MOST_WAYS).select("key")
    named = checkpointed(named.withColumn("sign", F.concat(F.substring("key", 1, 2), F.array_join(F.transform("ts", lambda t: t["c"]), " "))))
    mine = named.join(long, "key", "left_semi").select(F.col("key").alias("a"), "sign", F.col("ts").alias("ta"))
    same = mine.join(named.select(F.col("key").alias("b"), "sign", F.col("ts").alias("tb")), "sign").where("a <> b")
    zipped = F.arrays_zip("ta", "tb")
    likeness = lambda z: F.when(z["ta"]["tok"] == z["tb"]["tok"], 1.0).when(one_error(z["ta"]["tok"], z["tb"]["tok"]), 1 - 1 / F.greatest(F.length(z["ta"]["tok"]), F.length(z["tb"]["tok"]))).otherwise(0.0)
    w = lambda z: (z["ta"]["w"] + z["tb"]["w"]) / 2
    gain = F.aggregate(zipped, F.lit(0.0), lambda acc, z: acc + w(z) * likeness(z))
    return same.where(gain >= SIMILARITY * F.aggregate(zipped, F.lit(0.0), lambda acc, z: acc + w(z)) - 1e-9).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component; edges (a, b) as text.

    Labels spread along edges and are shortened through the label's own label in every round, so the number of
    rounds grows with the logarithm of the longest path. Each round is written to the shared folder.
    """
    both = checkpointed(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("other"))
        spread = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "other").alias("new"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("jl"))
        after = checkpointed(spread.join(jump, F.col("new") == F.col("j"), "left").select("node", "label", F.least("new", "jl").alias("new")))
        moved = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not moved:
            return labels


def entities(names: DataFrame) -> DataFrame:
    """(name, entity): the entity of every spelling. names: (name) distinct."""
    parsed = checkpointed(_parsed(names))
    forms = checkpointed(
        parsed.groupBy("form").agg(*[F.first(c).alias(c) for c in ("keys", "middle", "holds", "asks")])
    )
    full = forms.where(F.size("keys") > 0)
    # split the keys that stand for several people
    by_key = full.select("form", "middle", F.explode("keys").alias("key"))
    split = by_key.where("middle <> ''").groupBy("key").agg(F.countDistinct("middle").alias("m"), F.max("middle").alias("only"))
    nodes = checkpointed(
        by_key.join(split, "key", "left").select(
            "form", "key", "middle",
            (F.coalesce("m", F.lit(0)) > 1).alias("split"),
            F.when(F.coalesce("m", F.lit(0)) > 1, F.concat("key", F.lit("#"), "middle")).otherwise(F.col("key")).alias("node"),
            F.when(F.coalesce("m", F.lit(0)) > 1, F.col("middle")).otherwise(F.coalesce("only", F.lit(""))).alias("m"),
        )
    )
    # the halves of double surnames
    own = nodes.groupBy("form").agg(F.min("node").alias("home"), F.collect_set("node").alias("all"))
    halves = own.select(F.col("home").alias("a"), F.explode("all").alias("b")).where("a <> b")
    # typing errors
    distinct = checkpointed(nodes.select("key", "node", "m", "split").distinct())
    n1 = distinct.select(F.col("key").alias("a"), F.col("node").alias("na"), F.col("m").alias("ma"), F.col("split").alias("sa"))
    n2 = distinct.select(F.col("key").alias("b"), F.col("node").alias("nb"), F.col("m").alias("mb"), F.col("split").alias("sb"))
    wrong = (
        typing_errors(distinct.select("key").distinct())
        .join(n1, "a").join(n2, "b")
        .where("ma = mb or (ma = '' and not sb and not sa) or (mb = '' and not sa and not sb)")
        .select(F.col("na").alias("a"), F.col("nb").alias("b"))
    )
    labels = components(halves.unionAll(wrong))
    homes = checkpointed(
        own.join(labels, F.col("home") == F.col("node"), "left")
        .select("form", F.coalesce("label", "home").alias("entity"))
        .join(nodes.groupBy("form").agg(F.max("m").alias("m")), "form")
    )
    # nicknames: a form with keys of its own that may mean another entity's full name
    keyed = distinct.join(nodes.select("node", "form").distinct(), "node").join(homes.drop("m"), "form")
    named = forms.where(F.size("keys") > 0).select("form", "middle", F.explode("asks").alias("ask"))
    meant = meant_by(named, keyed.select("entity", "m", F.col("key").alias("ask")))
    moved = (
        meant.join(homes.select("form", F.col("entity").alias("from")), "form")
        .groupBy("from")
        .agg(F.min("meant").alias("to"), F.max("meant").alias("to2"))
        .where("to = to2 and from <> to")
        .select("from", "to")
    )
    homes = checkpointed(
        homes.join(moved, F.col("entity") == F.col("from"), "left").select("form", F.coalesce("to", "entity").alias("entity"), "m")
    )
    # initials: a form without keys that may mean one entity
    short = forms.where(F.size("keys") == 0).select("form", "middle", F.explode("asks").alias("ask"))
    holds = homes.join(forms.select("form", "holds"), "form").select("entity", "m", F.explode("holds").alias("ask"))
    settled = (
        forms.select("form")
        .join(homes.select("form", "entity"), "form", "left")
        .join(meant_by(short, holds), "form", "left")
        .select("form", F.coalesce("entity", "meant", "form").alias("entity"))
    )
    return parsed.select("name", "form").join(checkpointed(settled), "form").select("name", "entity")


def meant_by(asking: DataFrame, holding: DataFrame) -> DataFrame:
    """(form, meant): the one entity that each short form can mean; ambiguous forms do not come out.

    asking (form, middle, ask), holding (entity, m, ask). Middle initials must not contradict; a single entity with
    the same middle initials wins over others without any.
    """
    # whether one entity or several hold a token is told by the least and the greatest: one row for each token and middle initials
    held = holding.groupBy("ask", "entity").agg(F.max("m").alias("m")).groupBy("ask", "m").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
    asked = (
        asking.join(held, "ask")
        .where("middle = '' or m = '' or startswith(m, middle) or startswith(middle, m)")
        .withColumn("exact", (F.col("middle") != "") & (F.col("m") == F.col("middle")))
    )
    exactly = lambda c: F.when(F.col("exact"), F.col(c))
    found = asked.groupBy("form").agg(F.min(exactly("lo")).alias("e1"), F.max(exactly("hi")).alias("e2"), F.min("lo").alias("a1"), F.max("hi").alias("a2"))
    return found.select(
        "form", F.when(F.col("e1") == F.col("e2"), F.col("e1")).when(F.col("e1").isNull() & (F.col("a1") == F.col("a2")), F.col("a1")).alias("meant")
    ).where("meant is not null")


def linked_pairs(named: DataFrame) -> DataFrame:
    """(name_a, name_b): the pairs of different spellings of one entity, the smaller first."""
    a = named.select(F.col("name").alias("name_a"), "entity")
    b = named.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
