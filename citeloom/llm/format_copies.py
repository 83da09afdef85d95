"""Copies hidden by formatting: progressive partition refinement over records.

Records are copies if every field has the same letters and digits in the same order, ignoring case. Classes
of possible copies are refined step by step, and only members of a class with several members go on:

1. cheap invariants: the number of letters and digits of the whole record and of three fields, which needs
   no copying of text beyond one length;
2. a histogram of letters: how often each of HISTOGRAM occurs in the record, as one hash;
3. the full key: the SHA-256 of every field's letters and digits in the order of the fields.

Classes of step 1 and 2 are counted, not collected: each is a group-by with map-side combine on a 64-bit
class number. A record is attached to its class by `salted_lookup`, so a class may hold a third of all rows.

Defined cases: null, missing, empty and text without letters or digits are the same; the order of the entries
of a map does not matter, and an entry without letters or digits counts as missing; rows repeated with the
same id are one record: they add to the count, but none of them is listed as a copy of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import checkpointed, salted_lookup

#: Everything that is neither a letter nor a digit, in any script.
NOT_ALNUM = r"[^\p{L}\p{Nd}]+"
#: The letters and digits that the histogram counts; all others show in the length.
HISTOGRAM = "aeinorst0125"
SEP = "\u0001"


def bare(c: Column) -> Column:
    """The letters and digits of c, in lower case; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), NOT_ALNUM, "")


def bare_map(c: Column) -> Column:
    """A map as text: its entries with letters or digits in the value, each key=bare value, in order of the key."""
    entries = F.transform(F.map_entries(c), lambda e: F.struct(F.lower(e["key"]).alias("k"), bare(e["value"]).alias("v")))
    kept = F.array_sort(F.filter(entries, lambda e: e["v"] != ""))
    return F.coalesce(F.array_join(F.transform(kept, lambda e: F.concat(e["k"], F.lit("="), e["v"])), SEP), F.lit(""))


def several(classes: DataFrame, key: str) -> DataFrame:
    """(key, n): the classes with more than one member."""
    return classes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def copies(
    df: DataFrame, id_col: str, fields: list[str], maps: tuple[str, ...] = (), cheap: tuple[str, ...] = ()
) -> DataFrame:
    """(first_id, copy_id, n_copies): each row other than the one with the smallest id of its copies.

    fields: text columns to compare; maps: map<string,string> columns; cheap: the fields whose lengths enter
    the first class besides the length of the whole record. n_copies counts the rows of the class, the first
    included. Rows with a null id are not compared.
    """
    base = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("rid"),
        *[bare(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)],
        *[bare_map(F.col(m)).alias(f"m{i}") for i, m in enumerate(maps)],
    )
    parts = [c for c in base.columns if c != "rid"]
    # 1: lengths. Only the class numbers of all rows are shuffled; text moves for members of larger classes alone.
    lengths = [F.length(f"f{fields.index(f)}") for f in cheap or fields[:3]]
    one = base.withColumn("c1", F.xxhash64(F.length(F.concat(*parts)), *lengths))
    text = F.concat(*parts)
    histogram = [F.length(F.replace(text, F.lit(ch))) for ch in HISTOGRAM]
    inside = checkpointed(
        salted_lookup(one, several(one, "c1"), "c1", "rid", "n").withColumn("c2", F.xxhash64("c1", *histogram))
    )
    # 2 and 3: the histogram of letters within the class of step 1, then the full key within the classes left
    three = checkpointed(
        salted_lookup(inside, several(inside, "c2"), "c2", "rid", "n").select(
            "rid", F.sha2(F.concat_ws(SEP, *parts), 256).alias("key")
        )
    )
    reps = three.groupBy("key").agg(F.min("rid").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return (
        salted_lookup(three, reps.withColumn("n_copies", F.col("n")), "key", "rid", "n")
        .where("rid <> first_id")
        .select("first_id", F.col("rid").alias("copy_id"), "n_copies")
    )
