"""Queries of the problems solved in the core: drifting schemas and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import drift, nested
from citeloom.session import checkpointed, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "bib_exports", "exporter", "file_seq", "record"))


def p5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's schema fingerprint and number of fields."""
    fielded = drift.fields(table(spark, sf_dir, "bib_exports", "exporter", "file_seq", "record"))
    return drift.fingerprints(drift.schemas(fielded)).select("exporter", "file_seq", "fingerprint", "n_fields")


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one schema."""
    records = table(spark, sf_dir, "bib_exports", "row_no", "exporter", "file_seq", "line_no", "record")
    log = checkpointed(drift.changes(records.select("exporter", "file_seq", "record")))
    return drift.unify(records, log, ["row_no", "exporter", "file_seq", "line_no"])


def p5_leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the consistent table could not place, by exporter, file and raw field."""
    return drift.leftover(checkpointed(p5_unified(spark, sf_dir)), ["exporter", "file_seq"])


TRACES = nested.Shape(
    "trace", wrap=("traces",),
    children=(nested.Shape("trace_author", ("retrieved_metadata", "authors")), nested.Shape("trace_snippet", ("evidence_snippets",))),
)
CITATION = nested.Shape("citation_author", ("authors",))


def latest_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, retrieval_traces) of the state with the latest event_ts; ties go to the latest loaded."""
    v = table(spark, sf_dir, "verification_instances", "instance_id", "event_ts", "loaded_at", "retrieval_traces")
    best = F.max(F.struct("event_ts", "loaded_at", "retrieval_traces")).alias("b")
    return v.where("instance_id is not null").groupBy("instance_id").agg(best).select("instance_id", "b.retrieval_traces")


def delivered(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The instances without repeated deliveries: each instance_id as latest loaded."""
    i = table(spark, sf_dir, "instances", "instance_id", "loaded_at", *cols).where("instance_id is not null")
    return i.groupBy("instance_id").agg(*[F.max_by(c, "loaded_at").alias(c) for c in cols])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = delivered(spark, sf_dir, "citation_metadata").select("instance_id", F.col("citation_metadata.authors").alias("authors"))
    authors = nested.list_nodes(cited, "instance_id", "authors", CITATION.kind).select(
        "kind", "instance_id", F.lit(0).alias("trace_no"), F.col("position").alias("item_no"), "empty"
    )
    found = checkpointed(nested.nodes(latest_traces(spark, sf_dir), "instance_id", "retrieval_traces", TRACES).drop("value"))
    traces = found.where("kind = 'trace'")
    items = nested.link(traces, found.where("kind <> 'trace'"), "instance_id", "trace_no")
    out = authors.unionByName(
        traces.select("kind", "instance_id", F.col("position").alias("trace_no"), F.lit(0).alias("item_no"), "empty")
    ).unionByName(items.select("kind", "instance_id", "trace_no", F.col("position").alias("item_no"), "empty"))
    return out.where("not empty").select(F.col("kind").alias("child_table"), "instance_id", "trace_no", "item_no")


def p6_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of traces with their fields."""
    found = nested.nodes(latest_traces(spark, sf_dir), "instance_id", "retrieval_traces", TRACES).where("kind = 'trace' and not empty")
    fields = "struct<agent_type:string,execution_time_ms:bigint,full_text_scraped:boolean,source_uri:string,confidence_score:double>"
    return found.select("instance_id", F.col("position").alias("trace_no"), F.from_json("value", fields).alias("v")).select(
        "instance_id", "trace_no", "v.*"
    )


def p6_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat one-to-one table of citation_metadata and true_outputs."""
    return delivered(spark, sf_dir, "citation_metadata", "true_outputs").select(
        "instance_id", "citation_metadata.title", "citation_metadata.venue", "citation_metadata.year",
        "citation_metadata.identifiers.doi", "citation_metadata.identifiers.arxiv_id", "citation_metadata.identifiers.url",
        "true_outputs.true_existence", "true_outputs.true_hallucination_category", "true_outputs.true_alignment", "true_outputs.expert_rationale",
    )


_P5_FIELDS = """
WITH recs AS (SELECT DISTINCT exporter, file_seq, record FROM bib_exports WHERE exporter IS NOT NULL AND file_seq IS NOT NULL),
kv AS (
  SELECT exporter, file_seq, record, json_extract_string(record, '$.ID') AS rid, k AS name, json_extract(record, '$."' || k || '"') AS v
  FROM (SELECT *, unnest(json_keys(record)) AS k FROM recs WHERE json_valid(record))),
f AS (
  SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type
  FROM kv WHERE json_type(v) <> 'NULL'),
counted AS (
  SELECT exporter, file_seq, name, type, count(*) AS n,
    list_position(['string','number','boolean','array','object'], type) AS r FROM f GROUP BY ALL),
s AS (
  SELECT exporter, file_seq, name, type FROM counted
  QUALIFY row_number() OVER (PARTITION BY exporter, file_seq, name ORDER BY n DESC, r) = 1)
"""
_P5_FOUND = _P5_FIELDS + """,
files AS (SELECT DISTINCT exporter, file_seq FROM bib_exports),
pairs AS (SELECT a.exporter, a.file_seq FROM files a JOIN files b ON a.exporter = b.exporter AND a.file_seq = b.file_seq + 1),
both_ AS (
  SELECT p.exporter, p.file_seq, name, max(t_new) AS t_new, max(t_old) AS t_old FROM (
    SELECT exporter, file_seq, name, type AS t_new, NULL AS t_old FROM s
    UNION ALL SELECT exporter, file_seq + 1, name, NULL, type FROM s) x JOIN pairs p ON x.exporter = p.exporter AND x.file_seq = p.file_seq
  GROUP BY ALL),
gone AS (SELECT exporter, file_seq, name FROM both_ WHERE t_new IS NULL),
new_ AS (SELECT exporter, file_seq, name FROM both_ WHERE t_old IS NULL),
had AS (SELECT g.exporter, g.file_seq, g.name AS old_field, f.rid, CAST(f.v AS VARCHAR) AS v
        FROM f JOIN gone g ON f.exporter = g.exporter AND f.file_seq + 1 = g.file_seq AND f.name = g.name),
met AS (SELECT h.*, r.record FROM had h JOIN recs r ON r.exporter = h.exporter AND r.file_seq = h.file_seq
        AND json_extract_string(r.record, '$.ID') = h.rid),
asked AS (SELECT exporter, file_seq, old_field, count(*) AS n FROM met GROUP BY ALL),
eq AS (SELECT m.exporter, m.file_seq, m.old_field, f.name AS new_field, count(*) AS k
       FROM met m JOIN f ON f.exporter = m.exporter AND f.file_seq = m.file_seq AND f.record = m.record AND CAST(f.v AS VARCHAR) = m.v
       JOIN new_ w ON w.exporter = f.exporter AND w.file_seq = f.file_seq AND w.name = f.name GROUP BY ALL),
ren AS (SELECT eq.exporter, eq.file_seq, eq.old_field, eq.new_field FROM eq JOIN asked a
        ON eq.exporter = a.exporter AND eq.file_seq = a.file_seq AND eq.old_field = a.old_field AND k = n)
SELECT exporter, file_seq, 'renamed' AS change_type, old_field, new_field FROM ren
UNION ALL SELECT g.exporter, g.file_seq, 'removed', g.name, '' FROM gone g ANTI JOIN ren r
  ON g.exporter = r.exporter AND g.file_seq = r.file_seq AND g.name = r.old_field
UNION ALL SELECT w.exporter, w.file_seq, 'added', '', w.name FROM new_ w ANTI JOIN ren r
  ON w.exporter = r.exporter AND w.file_seq = r.file_seq AND w.name = r.new_field
UNION ALL SELECT exporter, file_seq, 'retyped', name, name FROM both_ WHERE t_old <> t_new
"""
_P6_TRACES = """
WITH latest AS (
  SELECT instance_id, retrieval_traces AS t FROM verification_instances WHERE instance_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY event_ts DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
j0 AS (SELECT instance_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM latest),
j1 AS (SELECT instance_id, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) ELSE j END AS j FROM j0),
j2 AS (SELECT instance_id, CASE WHEN json_type(j) = 'OBJECT' AND json_keys(j) = ['traces'] THEN j->'$.traces' ELSE j END AS j FROM j1),
lists AS (
  SELECT instance_id, CASE
    WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[])
    WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = 0 THEN []
    WHEN json_type(j) = 'OBJECT' AND len(list_filter(json_keys(j), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0
      THEN list_transform(list_sort(list_transform(json_keys(j), lambda k: CAST(k AS BIGINT))), lambda k: json_extract(j, '$."' || k || '"'))
    WHEN json_type(j) = 'OBJECT' THEN [j] ELSE [] END AS l FROM j2),
tr AS (SELECT instance_id, unnest(l) AS t, generate_subscripts(l, 1) AS trace_no FROM lists)
"""
_LATEST = """WITH d AS (SELECT * FROM instances WHERE instance_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY loaded_at DESC) = 1)"""
_LONE = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'VARCHAR' THEN [{0}] ELSE [] END"

QUERIES = {
    "p5_found": p5_found, "p5_versions": p5_versions, "p5_unified": p5_unified, "p5_leftover": p5_leftover,
    "p6_found": p6_found, "p6_traces": p6_traces, "p6_citations": p6_citations,
}
SQL = {
    "p5_found": _P5_FOUND,
    "p5_versions": _P5_FIELDS
    + "SELECT exporter, file_seq, sha256(string_agg(name || ':' || type, chr(10) ORDER BY name || ':' || type)) AS fingerprint, count(*) AS n_fields FROM s GROUP BY ALL",
    "p6_found": _P6_TRACES
    + """, a AS (SELECT instance_id, trace_no, unnest(l) AS v, generate_subscripts(l, 1) AS item_no
  FROM (SELECT instance_id, trace_no, """ + _LONE.format("json_extract(t, '$.retrieved_metadata.authors')") + """ AS l FROM tr)),
sn AS (SELECT instance_id, trace_no, unnest(l) AS v, generate_subscripts(l, 1) AS item_no
  FROM (SELECT instance_id, trace_no, """ + _LONE.format("json_extract(t, '$.evidence_snippets')") + """ AS l FROM tr)),
ca AS (SELECT DISTINCT instance_id, unnest(l) AS v, generate_subscripts(l, 1) AS item_no
  FROM (SELECT instance_id, citation_metadata.authors AS l FROM instances))
SELECT 'trace' AS child_table, instance_id, trace_no, 0 AS item_no FROM tr WHERE json_type(t) <> 'NULL'
UNION ALL SELECT 'trace_author', instance_id, trace_no, item_no FROM a WHERE json_type(v) <> 'NULL' AND trim(v->>'$') <> ''
UNION ALL SELECT 'trace_snippet', instance_id, trace_no, item_no FROM sn
  WHERE json_type(v) <> 'NULL' AND trim(CASE WHEN json_type(v) = 'OBJECT' THEN v->>'$.text' ELSE v->>'$' END) <> ''
UNION ALL SELECT 'citation_author', instance_id, 0, item_no FROM ca WHERE trim(v) <> ''
""",
    "p6_traces": _P6_TRACES
    + """SELECT instance_id, trace_no, t->>'$.agent_type' AS agent_type, CAST(t->>'$.execution_time_ms' AS BIGINT) AS execution_time_ms,
  CAST(t->>'$.full_text_scraped' AS BOOLEAN) AS full_text_scraped, t->>'$.source_uri' AS source_uri,
  CAST(t->>'$.confidence_score' AS DOUBLE) AS confidence_score FROM tr WHERE json_type(t) <> 'NULL'""",
    "p6_citations": _LATEST
    + """ SELECT instance_id, citation_metadata.title, citation_metadata.venue, citation_metadata.year, citation_metadata.identifiers.doi,
  citation_metadata.identifiers.arxiv_id, citation_metadata.identifiers.url, true_outputs.true_existence,
  true_outputs.true_hallucination_category, true_outputs.true_alignment, true_outputs.expert_rationale FROM d""",
}
