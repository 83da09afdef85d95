"""Selection, deduplication, joins and sampling of datasets; every function is DataFrame -> DataFrame without an action."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.operators import ranking
from citeloom.session import checkpointed


def split(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): complements of each other, also where the condition is null."""
    ok = F.coalesce(keep, F.lit(False))
    return df.where(ok), df.where(~ok)


def has_required(title: Column, venue: Column, year: Column, authors: Column) -> Column:
    return ~t.is_missing(title) & ~t.is_missing(venue) & ~t.is_missing(year, "number") & (F.coalesce(F.size(authors), F.lit(0)) > 0)


def not_preprint(venue: Column, authors: Column, max_authors: int = 10) -> Column:
    return ~F.coalesce(F.lower(venue).contains("arxiv"), F.lit(False)) & (F.coalesce(F.size(authors), F.lit(0)) < max_authors)


def claim_in_context(claim: Column, context: Column) -> Column:
    return F.coalesce(context.contains(claim), F.lit(False))


def clean_steps(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """df with the name of the first step that rejects the row in `rejected_by`, null for kept rows; one pass."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(steps):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("rejected_by", reason)


def head_per_group(df: DataFrame, group: str | list[str], order: list, k: int, where: Column | None = None) -> DataFrame:
    """The first k rows of each group; becomes a WindowGroupLimit, so no group is sorted beyond its first k rows."""
    w = Window.partitionBy(group).orderBy(*order)
    d = df.where(where) if where is not None else df
    return d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def first_by_key(df: DataFrame, key: Column, order: list[str], keep_null: bool = True) -> DataFrame:
    """The first row of each key; rows without a key stay if keep_null."""
    w = Window.partitionBy("__k").orderBy(*order)
    d = df.withColumn("__k", key)
    # rows without a key need no window: they do not meet in one partition
    firsts = d.where("__k is not null").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return (firsts.unionByName(d.where("__k is null")) if keep_null else firsts).drop("__k")


def dedup_two_pass(df: DataFrame, id_key: Column, title_key: Column, order: list[str]) -> DataFrame:
    """First wins by id, then first wins by title among what is left; both keys may be null."""
    return first_by_key(first_by_key(df, id_key, order), title_key, order)


def cascade(df: DataFrame, key: str, lookups: list[tuple[str, Column, DataFrame, str]]) -> DataFrame:
    """df with `hit` and `hit_source`: the first lookup that answers.

    lookups: (source name, column of df, table, its key column); each table has the columns (key, value) with unique keys.
    """
    out = df.withColumn("hit", F.lit(None).cast("string")).withColumn("hit_source", F.lit(None).cast("string"))
    for name, c, table, k in lookups:
        side = table.select(F.col(k).cast("string").alias("__k"), F.col("value").alias("__v"))
        # rows without a key, and rows answered already, meet nothing: each gets a key of its own, so they do not gather in one task
        open_ = F.when(F.col("hit_source").isNull(), c.cast("string"))
        alone = F.concat(F.lit("\u0000"), F.xxhash64(key).cast("string"))
        found = out.withColumn("__c", F.coalesce(open_, alone)).join(side, F.col("__c") == F.col("__k"), "left")
        out = found.withColumn("hit_source", F.coalesce("hit_source", F.when(F.col("__v").isNotNull(), F.lit(name)))).withColumn("hit", F.coalesce("hit", F.col("__v"))).drop("__k", "__v", "__c")
    return out


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The union of both with the latest version of each key, by aggregation: no window, no group in one task."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("r")).select(key, "r.*")


def interleave(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with `slot`: rows of all groups in proportion, by virtual time; ties go to the group that appears first.

    The virtual time of a group's j-th row is the sum of j times 1/n, added up from the left, because j/n rounds
    differently and would change ties. order must be total. Groups may be hot: ranks come from range sorts.
    """
    first = F.min(F.struct(*order))
    groups = df.groupBy(group).agg(F.count("*").alias("__n"), first.alias("__f"))
    groups = ranking.global_rank(groups, ["__f"], "__g").drop("__f")
    groups = groups.withColumnRenamed(group, "__group")
    d = ranking.rank_within(df, [group], order, "__rn").join(groups, F.col(group).eqNullSafe(F.col("__group")))
    d = ranking.virtual_times(d.drop("__group"), "__rn", "__n", "__v")
    return ranking.global_rank(d, ["__v", "__g"], "slot").drop("__rn", "__n", "__g", "__v")


def cycle(df: DataFrame, order: list[str], target: DataFrame) -> DataFrame:
    """The rows of df repeated in turn, in a total order, until `target` (one row, one column) rows are reached: `round` and `position` from 1."""
    size = df.agg(F.count("*").alias("__size"))
    d = ranking.global_rank(df, order, "__rank").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(target.toDF("__target")))
    d = d.where("__rank <= __target").withColumn("round", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("(__target - __rank) div __size + 1"))))
    return d.withColumn("position", F.col("__rank") + (F.col("round") - 1) * F.col("__size")).drop("__rank", "__size", "__target")


def allocate(shares: list[tuple[str, str]], total: Column) -> Column:
    """array<struct<name, n>>: shares (decimal text) of a total, half to even, the last takes the rest."""
    parts = [F.bround(total.cast("decimal(20,0)") * F.lit(s).cast("decimal(10,6)"), 0).cast("bigint") for _, s in shares[:-1]]
    rest = total.cast("bigint") - sum(parts[1:], parts[0]) if parts else total.cast("bigint")
    return F.array(*[F.struct(F.lit(n).alias("name"), p.alias("n")) for (n, _), p in zip(shares, [*parts, rest])])


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the order of a seeded hash: without replacement, the same in every run; a top-k, not a sort."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def rolling(df: DataFrame, at: str, key: str, seconds: int, value: Column) -> DataFrame:
    """df with the number of rows and the sum of value in the last `seconds` (lower bound exclusive) of each key."""
    span = seconds * 1_000_000
    d = df.withColumn("__us", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("__value", value).withColumn("__b", F.floor(F.col("__us") / span))
    # a window reaches into the block before at most: each row is counted in its own block and lent to the next, so a key is spread over its blocks
    w = Window.partitionBy(key, "__block").orderBy("__us").rangeBetween(-(span - 1), 0)
    each = d.withColumn("__lent", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__block", F.col("__b") + F.col("__lent"))
    out = each.withColumn("n_window", F.count("*").over(w)).withColumn("sum_window", F.sum("__value").over(w))
    return out.where("__lent = 0").drop("__us", "__value", "__b", "__lent", "__block")


def best_overlap(asked: DataFrame, listed: DataFrame, block: int = 262_144) -> DataFrame:
    """(q, score, id): for each set of words the listed set with the highest floor(1000 x Jaccard), the smallest id of the best; sets without a common word do not come out.

    asked (q, qt array) and listed (id, pt array), words distinct. Words that many sets share leave no pair out, so all sets meet: in blocks of about `block`
    listed sets and, of the asked, a 16th of all (4096 at least, `block` at most), where their common words are counted in numpy; only a block's best leave it.
    """
    asked, listed = checkpointed(asked.select("q", "qt").where("size(qt) > 0")), checkpointed(listed.select("id", "pt").where("size(pt) > 0"))
    n = asked.count()
    rows, columns = (max(1, math.ceil(k / most)) for k, most in ((n, min(block, max(4096, n // 16))), (listed.count(), block)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = asked.select("q", "qt", one("q", rows).alias("__row"), every(columns).alias("__column")).groupBy("__row", "__column")
    right = listed.select("id", "pt", every(rows).alias("__row"), one("id", columns).alias("__column")).groupBy("__row", "__column")
    kinds = asked.schema["q"].dataType.simpleString(), listed.schema["id"].dataType.simpleString()
    best = left.cogroup(right).applyInArrow(_best_in_block, f"q {kinds[0]}, score bigint, id {kinds[1]}")
    best = best.groupBy("q").agg(F.max(F.struct("score", (-F.col("id")).alias("less"))).alias("b"))
    return best.select("q", "b.score", (-F.col("b.less")).alias("id"))


def _best_in_block(asked: pa.Table, listed: pa.Table, *, step: int = 65_536) -> pa.Table:
    """The best listed set for each asked set of one block.

    Listed sets are ordered by size, then id, so that among sets of one size the first with the most common words is the best of them; they are taken
    `step` at a time, so that counts stay in the processor's cache. A word adds its row of 0 and 1 to the counts if it is one of the commonest (1024 at
    most, in a 64th of the sets at least), else 1 at its places.
    """
    names = ["q", "score", "id"]
    if not asked.num_rows or not listed.num_rows:
        return pa.table([asked["q"].slice(0, 0), pa.array([], pa.int64()), listed["id"].slice(0, 0)], names)
    words, sizes = _flat(listed["pt"])
    n = len(sizes)
    rank, place = np.empty(n, np.int32), np.empty(n, np.int32)
    rank[pc.sort_indices(listed["id"], null_placement="at_end").to_numpy()] = np.arange(n)
    order = np.lexsort((rank, sizes))
    place[order] = np.arange(n)
    ranks = rank[order].tolist()
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)[np.argsort(np.repeat(place, sizes), kind="stable")]
    sizes = sizes[order]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    asked_words, asked_sizes = _flat(asked["qt"])
    asked_codes = pc.fill_null(pc.index_in(asked_words, coded.dictionary), -1).to_numpy(zero_copy_only=False)
    asked_ends = np.cumsum(asked_sizes).tolist()
    asked_sizes = asked_sizes.tolist()
    bests, firsts = [-1] * len(asked_sizes), [-1] * len(asked_sizes)
    for start in range(0, n, step):
        stop = min(n, start + step)
        own = codes[ends[start] : ends[stop]]
        by = np.argsort(own, kind="stable")
        held, at, df = np.unique(own[by], return_index=True, return_counts=True)
        posts = dict(zip(held.tolist(), np.split(np.repeat(np.arange(stop - start, dtype=np.int32), sizes[start:stop])[by], at[1:]), strict=True))
        common = {}
        for i in np.argsort(-df, kind="stable")[:1024].tolist():
            if df[i] * 64 >= stop - start:
                w = int(held[i])
                common[w] = np.zeros(stop - start, np.uint8)
                common[w][posts[w]] = 1
        size, lo = np.unique(sizes[start:stop], return_index=True)
        groups = list(zip(size.tolist(), lo.tolist(), [*lo[1:].tolist(), stop - start], strict=True))
        near: dict[int, list[tuple[int, int, int, int]]] = {}  # by the size of the asked set: the highest score that a size can have, and where it is
        small, large = np.empty(stop - start, np.uint8), np.empty(stop - start, np.int32)
        for j, (k, end) in enumerate(zip(asked_sizes, asked_ends, strict=True)):
            if k not in near:
                near[k] = sorted(((1000 * min(k, s) // max(k, s), s, a, b) for s, a, b in groups), key=lambda x: -x[0])
            best, first = bests[j], firsts[j]
            if near[k][0][0] < best:
                continue
            both = small if k < 256 else large
            both.fill(0)
            for w in asked_codes[end - k : end].tolist():
                if w in common:
                    np.add(both, common[w], out=both)
                elif w in posts:
                    both[posts[w]] += 1
            for most, s, a, b in near[k]:
                if most < best:
                    break
                part = both[a:b]
                i = int(part.argmax())
                c = int(part[i])
                if not c:
                    continue
                score, less = 1000 * c // (k + s - c), c
                while less > 1 and 1000 * (less - 1) // (k + s - less + 1) == score:  # in large sets, fewer common words may give the same
                    less -= 1
                if less < c:
                    i = int((part >= less).argmax())
                i += start + a
                if score > best or score == best and ranks[i] < ranks[first]:
                    best, first = score, i
            bests[j], firsts[j] = best, first
    bests, firsts = np.array(bests, np.int64), np.array(firsts, np.int64)
    met = np.flatnonzero(bests >= 0)
    return pa.table([asked["q"].take(pa.array(met)), pa.array(bests[met]), listed["id"].take(pa.array(order[firsts[met]]))], names)


def _flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words in one array, and how many each row has."""
    one = lists.combine_chunks()
    return pc.list_flatten(one), pc.list_value_length(one).to_numpy(zero_copy_only=False)
