"""Samples with target category proportions: min-cost flow on cross-classified cell counts.

Rows are counted by cell (the combination of labels; a label that no target names is `other`, so the number
of cells is bounded by the targets). For a set of targets a network is solved:

source -> cell (capacity: distinct rows) -> target (each target takes from the cells that match its labels)
-> sink (demand: share x sample size, or the floor if that is more), and a slack arc source -> target of high
cost, whose flow is the shortfall. Within a target, a cell's quota costs nothing and rows beyond it cost more, so the
optimum follows the proportions of the data and departs from them only where cells are exhausted or shared. The integer quotas are
drawn by systematic sampling on the fractions, in a random order of the cells: a share of whole rows stays as it is,
any other is rounded up with a probability equal to its fraction, and the quotas of a target add up to its need. Rows
are then drawn per cell by the order of a seeded hash; the cut is found on counts of hash buckets, so no cell is
sorted as a whole.

Defined cases: null labels match only targets that leave the label open; labels agree regardless of case, outer
white space and the separator of words; repeated deliveries of an id count once, as the latest delivered; rows without
an id are not drawn; without rows every target with a need falls short; a target without need never does.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import checkpointed

OTHER = "#other"
SLACK_COST, BEYOND_COST = 1_000_000, 1_000
#: Hash buckets by which a cell's cut is found.
BUCKETS = 4096


def label(c: Column) -> Column:
    """A label in comparable form: upper case, words joined by _, null for blank."""
    s = F.upper(F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)^[\s_\-]+|[\s_\-]+$", ""), r"(?U)[\s_\-]+", "_"))
    return F.when(s != "", s)


def plain_label(v: object) -> str | None:
    s = "_".join(x for x in str(v).upper().replace("-", " ").replace("_", " ").split()) if v is not None else ""
    return s or None


class Flow:
    """Min-cost flow by successive shortest paths with potentials; arcs (from, to, capacity, cost)."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[object, list[int]] = defaultdict(list)
        self.node: list[object] = []

    def arc(self, a: object, b: object, capacity: int, cost: int = 0) -> int:
        for x, y, room, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.node))
            self.node.append(y)
            self.room.append(room)
            self.cost.append(c)
        return len(self.node) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def solve(self, source: object, sink: object) -> None:
        height: dict[object, int] = defaultdict(int)
        while True:
            dist, via, queue, n = {source: 0}, {}, [(0, 0, source)], 0
            done = set()
            while queue:
                d, _, x = heappop(queue)
                if x in done:
                    continue
                done.add(x)
                for e in self.out[x]:
                    y = self.node[e]
                    nd = d + self.cost[e] + height[x] - height[y]
                    if self.room[e] > 0 and nd < dist.get(y, math.inf):
                        dist[y], via[y] = nd, e
                        n += 1
                        heappush(queue, (nd, n, y))
            if sink not in dist:
                return
            for x in list(self.out):
                height[x] += min(dist.get(x, dist[sink]), dist[sink])
            push, y = math.inf, sink
            while y != source:
                push = min(push, self.room[via[y]])
                y = self.node[via[y] ^ 1]
            y = sink
            while y != source:
                self.room[via[y]] -= push
                self.room[via[y] ^ 1] += push
                y = self.node[via[y] ^ 1]


def needs(targets: list[dict]) -> dict[object, int]:
    """The rows each target needs: share x sample size rounded up (excess below 1e-6 ignored), at least its floor."""
    out = {}
    for t in targets:
        wanted = math.ceil((t["share"] or 0.0) * (t["sample_size"] or 0) - 1e-6)
        out[t["id"]] = max(wanted, t["min_rows"] or 0, 0)
    return out


def matches(cell: tuple, target: tuple) -> bool:
    return all(want is None or want == have for have, want in zip(cell, target))


def rounded(shares: dict[tuple, Fraction], draw: random.Random) -> dict[tuple, int]:
    """Integers for shares whose sum is an integer: each rounded up with a probability equal to its fraction, the sum kept."""
    order = sorted(shares, key=str)
    draw.shuffle(order)
    at = Fraction(draw.getrandbits(53), 1 << 53)
    out = {}
    for c in order:
        out[c] = math.floor(at + shares[c]) - math.floor(at)
        at += shares[c]
    return out


def quotas(cells: dict[tuple, int], targets: list[dict], seed: int = 0) -> tuple[dict[tuple[object, tuple], int], dict[object, int]]:
    """({(target id, cell): rows}, {target id: shortfall}) of one network; targets (id, labels, share, sample_size, min_rows)."""
    net, draw = Flow(), random.Random(seed)
    arcs: dict[tuple[object, tuple], list[int]] = {}
    slack: dict[object, int] = {}
    need = needs(targets)
    for cell, n in sorted(cells.items(), key=str):
        net.arc("source", ("cell", cell), n)
    for t in targets:
        k = t["id"]
        mine = [c for c in sorted(cells, key=str) if matches(c, t["labels"]) and cells[c] > 0]
        total = sum(cells[c] for c in mine)
        wanted = min(need[k], total)
        quota = rounded({c: Fraction(wanted * cells[c], total) for c in mine}, draw)
        for c in mine:
            arcs[k, c] = [
                net.arc(("cell", c), ("target", k), quota[c], 0),
                net.arc(("cell", c), ("target", k), cells[c] - quota[c], BEYOND_COST),
            ]
        slack[k] = net.arc("source", ("target", k), need[k], SLACK_COST)
        net.arc(("target", k), "sink", need[k])
    net.solve("source", "sink")
    return {x: q for x, es in arcs.items() if (q := sum(map(net.flow, es)))}, {k: net.flow(e) for k, e in slack.items()}


def cell_rows(rows: DataFrame, id_col: str, labels: list[str], targets: list[dict], order_col: str | None = None) -> DataFrame:
    """(id, l0, l1, ..): one row for each id, labels in comparable form, those no target names as OTHER."""
    named = [{t["labels"][i] for t in targets} - {None} for i in range(len(labels))]
    cols = []
    for i, c in enumerate(labels):
        v = label(F.col(c))
        cols.append(F.when(v.isin(*named[i]), v).when(v.isNotNull(), F.lit(OTHER)).alias(f"l{i}") if named[i] else F.when(v.isNotNull(), F.lit(OTHER)).alias(f"l{i}"))
    at = F.col(order_col) if order_col else F.lit(0)
    picked = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), at.alias("at"), *cols)
    best = F.max(F.struct("at", *[f"l{i}" for i in range(len(labels))])).alias("b")
    return picked.groupBy("id").agg(best).select("id", *[f"b.l{i}" for i in range(len(labels))])


def cell_counts(cells: DataFrame, n_labels: int) -> dict[tuple, int]:
    """Cell counts on the driver: at most the product of (labels named + 2) entries, whatever the rows."""
    names = [f"l{i}" for i in range(n_labels)]
    return {tuple(r[:-1]): r[-1] for r in cells.groupBy(*names).count().collect()}


def shortfalls(counts: dict[tuple, int], targets: list[dict]) -> dict[object, int]:
    """What each target lacks when it alone draws from all rows: the slack of its own network."""
    out = {}
    for t in targets:
        out |= quotas(counts, [t])[1]
    return out


def draw(cells: DataFrame, n_labels: int, quota: dict[tuple[object, object, tuple], int], seed: int = 0) -> DataFrame:
    """(target_set, target_id, id): the drawn rows. quota: {(target set, target id, cell): rows}.

    Within a set, the targets that share a cell take consecutive stretches of the cell's hash order.
    """
    spark = cells.sparkSession
    names = [f"l{i}" for i in range(n_labels)]
    stretch, at = [], defaultdict(int)
    for (s, t, cell), q in sorted(quota.items(), key=str):
        stretch.append((s, t, *cell, at[s, cell], at[s, cell] + q))
        at[s, cell] += q
    schema = "target_set string, target_id int, " + ", ".join(f"{n} string" for n in names) + ", lo bigint, hi bigint"
    wanted = spark.createDataFrame(stretch, schema)
    same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    h = F.xxhash64(F.col("id"), F.lit(seed))
    hashed = checkpointed(cells.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)).cast("int")))
    from pyspark.sql import Window

    w = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = hashed.groupBy(*names, "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    # only buckets that hold a drawn row go on; their rows are ranked within the bucket
    most = wanted.groupBy(*names).agg(F.max("hi").alias("most"))
    live = per.alias("p").join(F.broadcast(most.alias("m")), same("p", "m")).where("before < most").select(*[F.col(f"p.{n}").alias(n) for n in names], "p.bucket", "p.before")
    cond = [*same("r", "v"), F.col("r.bucket") == F.col("v.bucket")]
    rows = hashed.alias("r").join(F.broadcast(live.alias("v")), cond).select("r.id", "r.h", *[F.col(f"r.{n}").alias(n) for n in names], "r.bucket", "v.before")
    rank = Window.partitionBy(*names, "bucket").orderBy("h", "id")
    ranked = rows.withColumn("rank", F.col("before") + F.row_number().over(rank) - 1)
    return (
        ranked.alias("k").join(F.broadcast(wanted.alias("w")), [*same("k", "w"), F.col("rank") >= F.col("lo"), F.col("rank") < F.col("hi")])
        .select("w.target_set", "w.target_id", "k.id")
    )
