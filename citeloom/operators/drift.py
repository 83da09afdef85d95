"""Schemas that drift between numbered files: versioned fingerprints, change log, one consistent table.

A file's schema is the set of its top-level fields with a non-null value, each with the commonest JSON type of
its values. Its fingerprint is a hash of that. Consecutive files of an exporter with different fingerprints are compared: fields that are gone and
fields that are new are matched as renames by the values of the records that both files hold, all others are
removals, additions and changes of type; every change is one row of the log, which is the list of migration steps.
Records are then routed through the steps: the renames logged for the record's own exporter, chained from file to file, lead
each raw name to a column of the target schema; names without such steps follow the renames of all exporters. Absent fields
get null as default, and values are cast by the target's type. No value is lost: of several values for one column the others,
and values that the column's type cannot hold, go to `other_fields`.

Everything but the chaining of an exporter's log runs in the JVM on variant values. The joins are keyed by exporter, file and record ID, so an exporter with a
third of all rows spreads over its files and records; schemas are pre-aggregated before they are shuffled.

Defined cases: records that are no JSON object have no fields (and stay in the table with nulls); repeated records,
whatever the order of their keys, count once; a tie between types goes to the first of string, number, boolean, array,
object; rows without exporter or file number have no version and bring no changes; a first file brings no changes; an
empty table gives no rows. Field names differ if their case does.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import checkpointed

#: JSON types in the order that breaks ties.
TYPES = ["string", "number", "boolean", "array", "object"]


def json_type(v: Column) -> Column:
    """string, number, boolean, array or object for a variant value; null for JSON null."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "VOID", None)
        .when(s.startswith("STRING"), "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def fields(records: DataFrame, id_field: str = "ID") -> DataFrame:
    """(exporter, file_seq, rec, rid, name, type, value): the non-null fields of each distinct record of a file.

    rec numbers the distinct records by hash of their content; value is the JSON text of the value with sorted keys.
    """
    spark = records.sparkSession
    distinct = (
        records.where("exporter is not null and file_seq is not null")
        .select("exporter", "file_seq", F.to_json(F.try_parse_json("record")).alias("canon"))
        .where("canon is not null")
        .distinct()
        .select("exporter", "file_seq", F.xxhash64("canon").alias("rec"), F.parse_json("canon").alias("v"))
        .withColumn("rid", F.try_variant_get("v", f"$.{id_field}", "string"))
    )
    exploded = distinct.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return (
        exploded.where("key is not null")
        .select("exporter", "file_seq", "rec", "rid", F.col("key").alias("name"), json_type(F.col("value")).alias("type"), F.to_json("value").alias("value"))
        .where("type is not null")
    )


def schemas(fielded: DataFrame) -> DataFrame:
    """(exporter, file_seq, name, type): each file's fields with their commonest type."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    return (
        fielded.groupBy("exporter", "file_seq", "name", "type")
        .agg(F.count("*").alias("n"))
        .groupBy("exporter", "file_seq", "name")
        .agg(F.max_by("type", F.struct("n", (-rank).alias("r"))).alias("type"))
    )


def fingerprints(schema: DataFrame) -> DataFrame:
    """(exporter, file_seq, fingerprint, n_fields): the version of each file's schema."""
    field = F.concat_ws(":", "name", "type")
    return schema.groupBy("exporter", "file_seq").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(field)), "\n"), 256).alias("fingerprint"), F.count("*").alias("n_fields")
    )


def changes(records: DataFrame, id_field: str = "ID") -> DataFrame:
    """(exporter, file_seq, change_type, old_field, new_field): every change from the exporter's file before."""
    fielded = checkpointed(fields(records, id_field))
    schema = checkpointed(schemas(fielded))
    files = records.where("exporter is not null and file_seq is not null").select("exporter", "file_seq").distinct()
    at = ["exporter", "file_seq"]
    # consecutive pairs of files, named by the later one
    pairs = files.join(files.select("exporter", (F.col("file_seq") + 1).cast("int").alias("file_seq")), at)
    # files of the version before them bring no change: only pairs of different fingerprints go on
    versions = checkpointed(fingerprints(schema)).select(*at, "fingerprint")
    older = versions.select("exporter", (F.col("file_seq") + 1).cast("int").alias("file_seq"), F.col("fingerprint").alias("before"))
    pairs = checkpointed(pairs.join(versions, at, "left").join(older, at, "left").where(~F.col("fingerprint").eqNullSafe(F.col("before"))).select(*at))
    now = schema.join(pairs, at, "left_semi")
    before = schema.withColumn("file_seq", (F.col("file_seq") + 1).cast("int")).join(pairs, at, "left_semi")
    both = checkpointed(
        now.withColumnRenamed("type", "new_type").join(before.withColumnRenamed("type", "old_type"), [*at, "name"], "full_outer")
    )
    gone = both.where("new_type is null").select(*at, F.col("name").alias("old_field"))
    new = both.where("old_type is null").select(*at, F.col("name").alias("new_field"))
    # renames: what the records in both files hold in the fields gone and in the fields new
    held = fielded.where("rid is not null")
    had = (
        held.withColumn("file_seq", (F.col("file_seq") + 1).cast("int"))
        .withColumnRenamed("name", "old_field")
        .join(gone.join(new.select(*at).distinct(), at, "left_semi"), [*at, "old_field"], "left_semi")
        .select(*at, "rid", "old_field", F.col("value").alias("old_value"))
    )
    has = (
        held.withColumnRenamed("name", "new_field")
        .join(new.join(gone.select(*at).distinct(), at, "left_semi"), [*at, "new_field"], "left_semi")
        .groupBy(*at, "rid", "rec")
        .agg(F.collect_list(F.struct("new_field", "value")).alias("has"))
    )
    there = held.select(*at, "rid", "rec").distinct().join(gone.select(*at).distinct(), at, "left_semi")
    there = there.join(has, [*at, "rid", "rec"], "left")
    met = checkpointed(
        had.join(there, [*at, "rid"]).select(
            *at, "old_field", F.transform(F.filter("has", lambda f: f["value"] == F.col("old_value")), lambda f: f["new_field"]).alias("equal")
        )
    )
    asked = met.groupBy(*at, "old_field").agg(F.count("*").alias("n"))
    equal = met.select(*at, "old_field", F.explode("equal").alias("new_field")).groupBy(*at, "old_field", "new_field").agg(F.count("*").alias("k"))
    renamed = checkpointed(equal.join(asked, [*at, "old_field"]).where("k = n").select(*at, "old_field", "new_field"))
    removed = gone.join(renamed, [*at, "old_field"], "left_anti").withColumn("new_field", F.lit(""))
    added = new.join(renamed, [*at, "new_field"], "left_anti").withColumn("old_field", F.lit(""))
    retyped = both.where("old_type <> new_type").select(*at, F.col("name").alias("old_field"), F.col("name").alias("new_field"))
    log = None
    for kind, df in (("renamed", renamed), ("removed", removed), ("added", added), ("retyped", retyped)):
        one = df.select(*at, F.lit(kind).alias("change_type"), "old_field", "new_field")
        log = one if log is None else log.unionAll(one)
    return log


#: The columns of the consistent table and their types; every other field goes to `other_fields`.
TARGET = {
    "ID": "string", "ENTRYTYPE": "string", "title": "string", "author": "string", "year": "int", "journal": "string", "booktitle": "string",
    "volume": "string", "numpages": "int", "series": "string", "month": "string", "language": "string", "doi": "string", "url": "string",
    "eprint": "string", "eprinttype": "string", "archiveprefix": "string", "primaryclass": "string", "howpublished": "string",
    "abstractnote": "string", "keywords": "string", "note": "string", "open_access": "boolean",
}
#: Most distinct renames (old name, new name) that the driver takes to compose the chains: field names, not rows.
MAX_RENAMES = 100_000


def plain(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def compose(renames: list[tuple[str, str, int]], target: list[str]) -> dict[str, str]:
    """Raw name -> target column, by chained renames: names joined by renames mean one field, strongest evidence first.

    A rename that would merge two target columns is not followed; spelling variants of one name are one name.
    """
    return chained(renames, target)[0]


def chained(renames: list[tuple[str, str, int]], target: list[str]) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """What compose returns, and the pairs of target columns that renames join."""
    joined: list[tuple[str, str]] = []
    home = {plain(t): t for t in target}
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for old, new, _ in sorted(renames, key=lambda r: (-r[2], r[0], r[1])):
        a, b = root(plain(old)), root(plain(new))
        if a == b:
            continue
        if a in home and b in home:
            joined.append((home[a], home[b]))
            continue
        keep, drop = (a, b) if a in home or (b not in home and a < b) else (b, a)
        parent[drop] = keep
    return {x: home[root(x)] for x in [*parent, *home] if root(x) in home}, list(dict.fromkeys(joined))


def merged(pairs: list[tuple[str, str]], target: list[str]) -> dict[str, str]:
    """Target column -> the first column, in the order of the target, that the pairs join it with."""
    first = {t: t for t in target}
    for a, b in pairs:
        keep, drop = sorted((first[a], first[b]), key=target.index)
        first = {t: keep if f == drop else f for t, f in first.items()}
    return first


def own_routes(steps: list[tuple[int, str, str, str]], files: list[int], names: dict[str, str], target: list[str]) -> dict[int, dict[str, str]]:
    """File -> raw name -> target column, by the logged steps (file_seq, change_type, old_field, new_field) of one exporter.

    A name stands for one field from the file that brings it on until it comes anew; renames join fields. Joined fields go to the
    first target column that one of their names spells, else to the first to which `names` leads; names without either are left out.
    """
    home = {plain(t): t for t in target}
    renames = [(seq, old, new) for seq, kind, old, new in steps if kind == "renamed"]
    known = {n for _, old, new in renames for n in (old, new)}
    starts = {n: [] for n in known}
    for seq, kind, _, new in steps:
        if kind in ("added", "renamed") and new in known:
            starts[new].append(seq)
    starts = {n: sorted(set(s)) for n, s in starts.items()}
    at = lambda n, seq: (n, bisect_right(starts[n], seq))
    parent: dict[tuple[str, int], tuple[str, int]] = {}

    def root(x: tuple[str, int]) -> tuple[str, int]:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for seq, old, new in renames:
        parent[root(at(old, seq - 1))] = root(at(new, seq))
    spelt: dict[tuple[str, int], set[str]] = {}
    led: dict[tuple[str, int], set[str]] = {}
    for x in list(parent):
        n = plain(x[0])
        if n in home:
            spelt.setdefault(root(x), set()).add(home[n])
        if n in names:
            led.setdefault(root(x), set()).add(names[n])
    column = {x: min(found, key=target.index) for x in parent if (found := spelt.get(root(x)) or led.get(root(x)))}
    return {seq: {n: column[x] for n in sorted(known) if (x := at(n, seq)) in column} for seq in files}


def leftover(unified: DataFrame, by: list[str]) -> DataFrame:
    """(by, field, n): the values of a consistent table that no column could take, counted by raw field: fields without a column, second values of one, and values of no fitting type."""
    return unified.select(*by, F.explode("other_fields").alias("field", "v")).groupBy(*by, "field").agg(F.count("*").alias("n"))


def routes(records: DataFrame, log: DataFrame, names: dict[str, str], target: list[str]) -> DataFrame:
    """(exporter, file_seq, route map<string,string>): own_routes of every exporter with renames.

    The steps and file numbers of one exporter meet in one row: a few for each file, whatever the number of its records.
    """
    steps = log.groupBy("exporter").agg(
        F.collect_list(F.struct("file_seq", "change_type", "old_field", "new_field")).alias("steps"), F.count_if(F.col("change_type") == "renamed").alias("n")
    )
    files = records.where("file_seq is not null").groupBy("exporter").agg(F.collect_set("file_seq").alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for exporter, own, seqs in zip(*[c.to_pylist() for c in b.columns]):
                found = own_routes([tuple(s.values()) for s in own], seqs, names, target)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([exporter] * len(found), pa.string()), pa.array(list(found), pa.int32()), pa.array([list(m.items()) for m in found.values()], pa.map_(pa.string(), pa.string()))],
                    ["exporter", "file_seq", "route"],
                )

    both = steps.where("n > 0").join(files, "exporter").select("exporter", "steps", "files")
    return both.mapInArrow(run, "exporter string, file_seq int, route map<string,string>")


def as_text(raw: Column) -> Column:
    """A raw JSON value as text: lists are joined by '; ', of an object the text, name, label or URL is taken, else all values."""
    as_list = F.from_json(raw, "array<string>")
    as_map = F.from_json(raw, "map<string,string>")
    named = F.coalesce(*[as_map[k] for k in ("text", "name", "label", "url", "value")])
    return F.when(raw.startswith("["), F.coalesce(F.array_join(as_list, "; "), raw)).when(
        raw.startswith("{"), F.coalesce(named, F.array_join(F.map_values(as_map), "; "), raw)
    ).otherwise(raw)


def cast_to(text: Column, kind: str) -> Column:
    if kind == "int":
        return F.regexp_extract(text, r"-?\d+", 0).try_cast("int")
    if kind == "boolean":
        low = F.lower(F.trim(text))
        return F.when(low.isin("true", "yes", "y", "1", "open"), True).when(low.isin("false", "no", "n", "0", "closed"), False)
    return text


def unify(records: DataFrame, log: DataFrame, keep: list[str], target: dict[str, str] = TARGET, record_col: str = "record") -> DataFrame:
    """keep + the target columns + other_fields (map<string,string>): every record in one schema.

    log: the change log of `changes`. A record that is no JSON object gets nulls.
    """
    rows = (
        log.where("change_type = 'renamed'").groupBy("old_field", "new_field").agg(F.count("*").alias("n")).limit(MAX_RENAMES + 1).collect()
    )
    if len(rows) > MAX_RENAMES:
        raise ValueError(f"more than {MAX_RENAMES} distinct renames")
    names, joined = chained([tuple(r) for r in rows], list(target))
    squeezed = lambda k: F.regexp_replace(F.lower(k), r"[^\p{L}\p{Nd}]", "")
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])
    entries = F.filter(F.map_entries(F.from_json(F.col(record_col), "map<string,string>")), lambda e: e["value"].isNotNull())
    if joined:  # two columns that a rename joins are one everywhere, unless a record fills both
        held = F.transform(entries, lambda e: as_map(names)[squeezed(e["key"])])
        filled = records.select(held.alias("h")).agg(
            *[F.coalesce(F.bool_or(F.array_contains("h", a) & F.array_contains("h", b)), F.lit(False)).alias(f"p{i}") for i, (a, b) in enumerate(joined)]
        ).first()
        one = merged([p for p, both in zip(joined, filled) if not both], list(target))
        names = {n: one[t] for n, t in names.items()}
    known = as_map(names)
    # of the values for one column the one under the column's own name comes first, then the others by name
    routed = F.transform(entries, lambda e: F.struct(
        F.coalesce(F.col("route")[e["key"]], known[squeezed(e["key"])], F.lit("")).alias("t"), e["key"].alias("k"), e["value"].alias("v"),
    ))
    routed = F.array_sort(F.transform(routed, lambda e: F.struct(e["t"].alias("t"), (squeezed(e["k"]) != F.translate(F.lower(e["t"]), "_", "")).alias("alias"), e["k"].alias("k"), e["v"].alias("v"))))
    valid = F.expr(f"is_variant_null(try_parse_json({record_col})) is not null")
    routing = routes(records, log, names, list(target)).withColumnsRenamed({"exporter": "__e", "file_seq": "__s"})
    found = records.join(routing, (F.col("exporter") == F.col("__e")) & (F.col("file_seq") == F.col("__s")), "left")
    base = found.select(*keep, F.when(valid, routed).alias("__r"))
    taken = F.transform("__r", lambda e, i: (e["t"] != "") & (F.array_position("__t", e["t"]) == i + 1))
    base = base.withColumn("__t", F.transform("__r", lambda e: e["t"])).withColumn("__first", taken)
    firsts = F.filter(F.arrays_zip("__r", "__first"), lambda z: z["__first"])
    base = base.withColumn("__m", F.map_from_entries(F.transform(firsts, lambda z: F.struct(z["__r"]["t"], z["__r"]["v"]))))
    cols = [cast_to(as_text(F.col("__m")[name]), kind).alias(name) for name, kind in target.items()]
    # a column that is null though it has a value could not be cast
    uncast = F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name, kind in target.items() if kind != "string"]))
    rest = F.filter(F.arrays_zip("__r", "__first"), lambda z: ~z["__first"] | F.array_contains(uncast, z["__r"]["t"]))
    other = F.map_from_entries(F.transform(rest, lambda z: F.struct(z["__r"]["k"], z["__r"]["v"])))
    return base.select(*keep, *cols, "__r", "__first").select(*keep, *target, other.alias("other_fields"))
