"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, format_copies, names, packing, quota_sample, residue, venues
from citeloom.session import checkpointed, table

Query = Callable[[SparkSession, str], DataFrame]


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "bib_references", "author").select(F.explode(names.split_authors(F.col("author"))))
    listed = table(spark, sf_dir, "instances", "citation_metadata").select(F.explode("citation_metadata.authors"))
    return names.entities(checkpointed(names.spellings(typed, listed)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(checkpointed(_entities(spark, sf_dir)))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with its entity and the number of other spellings linked to it."""
    e = checkpointed(_entities(spark, sf_dir))
    return e.join(e.groupBy("entity").agg((F.count("*") - 1).alias("n_links")), "entity").select("name", "entity", "n_links")


def _venue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "venues", "venue_id", "venue_name", "acronym")
    return v.select(F.col("venue_id").alias("key"), F.col("venue_name").alias("name"), F.col("acronym").alias("alias"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "bib_references", "ref_id", "journal", "booktitle").select(
        F.lit("bib_references").alias("record_table"),
        F.col("ref_id").cast("string").alias("record_key"),
        F.explode(F.map_from_arrays(F.array(F.lit("journal"), F.lit("booktitle")), F.array("journal", "booktitle"))).alias(
            "field_name", "value"
        ),
    )
    inst = (
        table(spark, sf_dir, "instances", "instance_id", "citation_metadata")
        .select(F.col("instance_id").alias("record_key"), F.col("citation_metadata.venue").alias("value"))
        .where("value is not null")
        .groupBy("record_key")
        .agg(F.min("value").alias("value"))
        .select(F.lit("instances").alias("record_table"), "record_key", F.lit("venue").alias("field_name"), "value")
    )
    found = venues.resolve(refs.unionByName(inst), "value", "record_key", _venue_entries(spark, sf_dir))
    return found.select("record_table", "record_key", "field_name", F.col("key").alias("venue_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["entrytype", "id", "title", "author", "year", "journal", "booktitle"]
    refs = table(spark, sf_dir, "bib_references", "ref_id", *cols, "extra_fields")
    found = format_copies.copies(refs, "ref_id", cols, ("extra_fields",), ("title", "id", "year"))
    return found.select(F.col("first_id").alias("first_ref_id"), F.col("copy_id").alias("copy_ref_id"))


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collapsed entry that occurs more than once, with its number of copies."""
    cols = ["entrytype", "id", "title", "author", "year", "journal", "booktitle"]
    refs = table(spark, sf_dir, "bib_references", "ref_id", *cols, "extra_fields")
    found = format_copies.copies(refs, "ref_id", cols, ("extra_fields",), ("title", "id", "year"))
    return found.groupBy("first_id").agg(F.max("n_copies").alias("n_copies")).withColumnRenamed("first_id", "ref_id")


_P4_LABELS = ["true_existence", "true_hallucination_category", "true_alignment"]


def _targets(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The target list: a short configuration table."""
    rows = table(spark, sf_dir, "sample_targets").orderBy("target_id").collect()
    return [
        {
            "id": r["target_id"], "set": r["target_set"], "share": r["share"], "sample_size": r["sample_size"], "min_rows": r["min_rows"],
            "labels": tuple(quota_sample.plain_label(r[c]) for c in _P4_LABELS),
        }
        for r in rows
    ]


def _cells(spark: SparkSession, sf_dir: str, targets: list[dict]) -> DataFrame:
    rows = table(spark, sf_dir, "instances", "instance_id", "true_outputs", "loaded_at").select(
        "instance_id", "loaded_at", *[F.col(f"true_outputs.{c}").alias(c) for c in _P4_LABELS]
    )
    return checkpointed(quota_sample.cell_rows(rows, "instance_id", _P4_LABELS, targets, "loaded_at"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    counts = quota_sample.cell_counts(_cells(spark, sf_dir, targets), 3)
    short = quota_sample.shortfalls(counts, targets)
    return spark.createDataFrame([(k,) for k, n in sorted(short.items()) if n > 0], "target_id int")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target needs, how many rows match it, and what it lacks."""
    targets = _targets(spark, sf_dir)
    counts = quota_sample.cell_counts(_cells(spark, sf_dir, targets), 3)
    short, need = quota_sample.shortfalls(counts, targets), quota_sample.needs(targets)
    rows = [
        (t["id"], need[t["id"]], sum(n for c, n in counts.items() if quota_sample.matches(c, t["labels"])), short[t["id"]])
        for t in targets
    ]
    return spark.createDataFrame(rows, "target_id int, needed bigint, available bigint, lacking bigint")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn samples of all target sets."""
    targets = _targets(spark, sf_dir)
    cells = _cells(spark, sf_dir, targets)
    counts = quota_sample.cell_counts(cells, 3)
    quota = {}
    for name in sorted({t["set"] for t in targets}):
        mine = [t for t in targets if t["set"] == name]
        quota |= {(name, t, c): n for (t, c), n in quota_sample.quotas(counts, mine, seed=7)[0].items()}
    return quota_sample.draw(cells, 3, quota, seed=7).withColumnRenamed("id", "instance_id")


def p4_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was drawn for each target: rows, different ids, and rows whose labels match."""
    targets = _targets(spark, sf_dir)
    labels = spark.createDataFrame([(t["set"], t["id"], *t["labels"]) for t in targets], "target_set string, target_id int, e string, c string, a string")
    cells = _cells(spark, sf_dir, targets).toDF("instance_id", "ce", "cc", "ca")
    fits = lambda want, have: F.col(want).isNull() | (F.col(want) == F.col(have))
    return (
        labels.join(p4_sample(spark, sf_dir), ["target_set", "target_id"], "left").join(cells, "instance_id", "left")
        .groupBy("target_set", "target_id")
        .agg(
            F.count("instance_id").alias("n_rows"), F.countDistinct("instance_id").alias("n_ids"),
            F.count_if(F.col("instance_id").isNotNull() & fits("e", "ce") & fits("c", "cc") & fits("a", "ca")).alias("n_matching"),
        )
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's length after encoding and decoding again."""
    back = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text")))
    return back.select("doc_id", F.md5("text").alias("text_md5"))


def _packs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = table(spark, sf_dir, "pack_capacities", "pack_name", "capacity_tokens").orderBy("pack_name").collect()
    return [(r[0], int(r[1])) for r in rows]


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = bpe.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
    return packing.pack_documents(sized, _packs(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, sf_dir), _packs(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, by section and source, against all."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    marked = residue.residue(docs)
    return (
        docs.select("doc_id", "source").join(marked, "doc_id", "left")
        .groupBy("source").agg(F.count("*").alias("docs"), F.count("kinds").alias("excluded"))
    )


_BARE = "regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"
_P3_KEYED = """
WITH keyed AS (
  SELECT ref_id, concat_ws(chr(1), {fields},
    coalesce(array_to_string(list_sort(list_transform(list_filter(map_entries(extra_fields),
      lambda e: {value} <> ''), lambda e: lower(e.key) || '=' || {value})), chr(1)), '')) AS k
  FROM bib_references),
firsts AS (SELECT k, min(ref_id) AS first_ref_id, count(*) AS n FROM keyed GROUP BY k HAVING count(*) > 1)
""".format(
    fields=", ".join(_BARE.format(c) for c in ["entrytype", "id", "title", "author", "year", "journal", "booktitle"]),
    value=_BARE.format("e.value"),
)

_P4_COUNTED = """
WITH latest AS (
  SELECT instance_id, arg_max(true_outputs, loaded_at) AS o FROM instances WHERE instance_id IS NOT NULL GROUP BY 1),
labelled AS (
  SELECT o.true_existence AS e, o.true_alignment AS a,
    regexp_replace(upper(trim(o.true_hallucination_category)), '[\\s_-]+', '_', 'g') AS c FROM latest),
counted AS (
  SELECT target_id,
    greatest(CAST(ceil(share * sample_size - 1e-6) AS BIGINT), min_rows) AS needed,
    count(l.n) AS available
  FROM sample_targets t LEFT JOIN (SELECT 1 AS n, * FROM labelled) l
    ON (t.true_existence IS NULL OR t.true_existence = l.e)
   AND (t.true_hallucination_category IS NULL OR t.true_hallucination_category = l.c)
   AND (t.true_alignment IS NULL OR t.true_alignment = l.a)
  GROUP BY ALL)
"""

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_copies": p3_copies,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_sample": p4_sample,
    "p4_drawn": p4_drawn,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_kept": p9_kept,
}

SQL: dict[str, str] = {
    "p3_found": _P3_KEYED
    + "SELECT first_ref_id, ref_id AS copy_ref_id FROM keyed JOIN firsts USING (k) WHERE ref_id <> first_ref_id",
    "p3_copies": _P3_KEYED + "SELECT first_ref_id AS ref_id, n AS n_copies FROM firsts",
    "p4_found": _P4_COUNTED + "SELECT target_id FROM counted WHERE available < needed",
    "p4_report": _P4_COUNTED
    + "SELECT target_id, needed, available, greatest(needed - available, 0) AS lacking FROM counted",
    "p4_drawn": _P4_COUNTED
    + """SELECT target_set, target_id, least(needed, available) AS n_rows, least(needed, available) AS n_ids, least(needed, available) AS n_matching
FROM counted JOIN (SELECT target_id, target_set FROM sample_targets) USING (target_id)""",
    "p7_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
}
