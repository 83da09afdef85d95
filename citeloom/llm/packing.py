"""Filling containers of fixed capacity with whole texts: bulk-synchronous best fit, largest items first.

Documents are range-sorted by size (descending, then id), which gives every document one global position.
Documents of one size are interchangeable, and so are containers with one gap, so a round matches them in
bulk: the sweep takes the sizes in descending order, finds the successor gap (the smallest gap that is large
enough), and matches the k-th document of that size with the k-th container of that gap; the rank settles
which of several documents gets which container. The matched containers move to their new gap, and the
sweep repeats until the size is used up; a size for which no gap is left opens containers. The outcome is the
same as best-fit decreasing run item by item.

The sweeps need only how many pieces have each size below the capacity, at most as many numbers as the capacity, whatever the
number and the length of the documents: the counts of one kind of container go to one task, which gives back the
matches of each size. Nothing of this passes through the driver. Documents meet the matches of their size by a join
spread for hot sizes, and find their container by their rank, in the JVM.

Defined cases: a text above the capacity is cut into full pieces and a remainder; only such texts are split.
A text without tokens (null, empty) takes no room and is put into an existing container, by position.
Repeated ids are separate items. Without documents there are no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.ranking import global_rank
from citeloom.session import checkpointed, salted_lookup


def sweep(counts: dict[int, int], capacity: int, first_id: int = 0) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing on size classes.

    counts: number of items of each size, 0 < size <= capacity. Returns the matches (size, first rank within
    the size, first container, items in each container), ordered by size descending and rank, and the number
    of the next unused container. Items of consecutive ranks fill consecutive containers.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    matches: list[tuple[int, int, int, int]] = []
    free = first_id

    def give_back(gap: int, start: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in runs:
            runs[gap] = []
            insort(gaps, gap)
        runs[gap].append((start, n))

    for size in sorted((s for s in counts if counts[s] > 0), reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                start, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    del gaps[at]
            else:
                gap = capacity
                start, n = free, -(-left // (capacity // size))
                free += n
            each = gap // size
            full = min(n, left // each)
            if full:
                matches.append((size, rank, start, each))
                rank += full * each
                left -= full * each
                give_back(gap - each * size, start, full)
            if full < n:
                if left:  # the last items of this size: fewer than one container takes
                    matches.append((size, rank, start + full, left))
                    give_back(gap - left * size, start + full, 1)
                    full += 1
                    left = 0
                give_back(gap, start + full, n - full)
    return matches, free


def _swept(frame: pd.DataFrame) -> pd.DataFrame:
    """The matches of one kind of container, a row for each size: (pack, rest, ranks, starts, eaches, containers)."""
    pack, capacity, first = frame["pack"].iloc[0], int(frame["cap"].iloc[0]), int(frame["n_whole"].iloc[0])
    matches, containers = sweep(dict(zip(frame["rest"].tolist(), frame["c"].tolist())), capacity, first)
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for size, rank, start, each in matches:
        by_size.setdefault(size, []).append((rank, start, each))
    rows = [(pack, size, *[list(x) for x in zip(*sorted(ms))], containers) for size, ms in by_size.items()]
    return pd.DataFrame(rows, columns=["pack", "rest", "ranks", "starts", "eaches", "containers"])


def pack_documents(sized: DataFrame, packs: list[tuple[str, int]], id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(pack_name, id_col, piece_no int, n_tokens bigint, container_no bigint): a row for each piece and pack.

    packs: (name, capacity) of the container kinds, a short configuration list. Containers are numbered from
    0 within a pack. A null size counts as 0; capacities below 1 are refused.
    """
    if any(c is None or c < 1 for _, c in packs):
        raise ValueError("a capacity must be at least 1")
    kind = sized.schema[id_col].dataType.simpleString()
    s = sized.select(F.col(id_col).alias("k"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    s = checkpointed(s)  # the range sort reads its input twice: once for the bounds
    ranged = global_rank(s, [F.desc("n"), F.col("k")], "pos").withColumn("pos", F.col("pos") - 1)
    sizes = checkpointed(ranged.groupBy("n").agg(F.count("*").alias("c"), F.min("pos").alias("start")))
    each_pack = F.explode(F.array(*[F.struct(F.lit(name).alias("pack"), F.lit(int(c)).cast("bigint").alias("cap")) for name, c in packs]))
    per = sizes.withColumn("p", each_pack).select("n", "c", "start", "p.pack", "p.cap")
    above = F.col("n") > F.col("cap")
    per = per.withColumn("whole", F.when(above, F.expr("n div cap")).otherwise(0)).withColumn("rest", F.when(above, F.col("n") % F.col("cap")).otherwise(F.col("n")))
    before = lambda *by: Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    # of each size: how many items of the same rest come before, and how many full containers (only sizes above the capacity have any)
    ranked = per.withColumn("rank_base", F.coalesce(F.sum("c").over(before("pack", "rest")), F.lit(0)))
    full = per.where("whole > 0").select("pack", "n", F.coalesce(F.sum(F.col("whole") * F.col("c")).over(before("pack")), F.lit(0)).alias("whole_base"))
    n_whole = per.groupBy("pack").agg(F.sum(F.col("whole") * F.col("c")).alias("n_whole"))  # one row for each pack, as in all broadcasts here
    classes = per.where("rest > 0").groupBy("pack", "cap", "rest").agg(F.sum("c").alias("c")).join(F.broadcast(n_whole), "pack")
    lists = "ranks array<bigint>, starts array<bigint>, eaches array<bigint>"
    matches = checkpointed(classes.groupBy("pack").applyInPandas(_swept, f"pack string, rest bigint, {lists}, containers bigint"))
    boxes = n_whole.join(matches.groupBy("pack").agg(F.max("containers").alias("with_rests")), "pack", "left").select("pack", F.coalesce("with_rests", "n_whole").alias("containers"))
    plan = ranked.join(full, ["pack", "n"], "left").join(matches.drop("containers"), ["pack", "rest"], "left").join(F.broadcast(boxes), "pack")
    plan = plan.groupBy("n").agg(F.first("c").alias("c"), F.first("start").alias("start"), F.collect_list(F.struct("pack", "cap", "whole", "rest", "rank_base", "whole_base", "ranks", "starts", "eaches", "containers")).alias("plans"))
    d = salted_lookup(ranged, plan, "n", "k", "c").select("k", "n", (F.col("pos") - F.col("start")).alias("nth"), F.explode("plans").alias("p")).select("k", "n", "nth", "p.*")
    # the match of a rank is the last that begins at or before it
    rank = F.col("rank_base") + F.col("nth")
    at = F.size(F.filter("ranks", lambda r: r <= F.col("rank"))) - 1
    box = F.get("starts", F.col("at")) + F.expr("(rank - ranks[at]) div eaches[at]")
    d = d.withColumn("rank", rank).withColumn("at", F.when(F.col("rest") > 0, at))
    piece = lambda no, tokens, where: F.struct(no.cast("int").alias("piece_no"), tokens.cast("bigint").alias("n_tokens"), where.cast("bigint").alias("container_no"))
    fulls = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("whole") - 1, F.lit(0))), lambda i: piece(i, F.col("cap"), F.col("whole_base") + F.col("nth") * F.col("whole") + i)))
    last = F.when(F.col("rest") > 0, F.array(piece(F.col("whole"), F.col("rest"), box)))
    none = F.when(F.col("n") == 0, F.array(piece(F.lit(0), F.lit(0), F.col("nth") % F.greatest(F.col("containers"), F.lit(1)))))
    empty = F.array().cast("array<struct<piece_no:int,n_tokens:bigint,container_no:bigint>>")
    pieces = F.concat(*[F.coalesce(x, empty) for x in (fulls, last, none)])
    out = d.select(F.col("pack").alias("pack_name"), F.col("k").cast(kind).alias(id_col), F.explode(pieces).alias("x"))
    return out.select("pack_name", id_col, "x.piece_no", "x.n_tokens", "x.container_no")


def fill_report(packed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """For each pack: containers used, the least possible number by volume, tokens, share of room filled, split texts."""
    caps = packed.sparkSession.createDataFrame(packs, "pack_name string, capacity_tokens bigint")
    boxes = packed.groupBy("pack_name", "container_no").agg(
        F.sum("n_tokens").alias("held"), F.count_if(F.col("piece_no") > 0).alias("later_pieces")
    )
    return (
        boxes.join(F.broadcast(caps), "pack_name")
        .groupBy("pack_name", "capacity_tokens")
        .agg(
            F.count("*").alias("containers"),
            F.sum("held").alias("tokens"),
            F.max("held").alias("fullest"),
            F.sum("later_pieces").alias("later_pieces"),
        )
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("bigint"))
        .withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )
