"""Writers: reports, partitioned exports, both halves of a split, and resumable appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, **meta: str) -> None:
    """One JSON object for each row, with the run's meta data beside it."""
    df.select(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("meta") if meta else F.lit(None).alias("meta"), F.struct(*df.columns).alias("row")).write.mode("overwrite").json(path)


def write_by_field(df: DataFrame, field: str, path: str) -> None:
    """A folder of JSON files for each value of a field."""
    df.write.mode("overwrite").partitionBy(field).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_dataset(df: DataFrame, path: str, **metadata: str) -> None:
    """A data set as `rows`, and its metadata with the number of rows as the one row of `dataset_metadata`, below one path."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    kept = df.sparkSession.read.parquet(f"{path}/rows")
    kept.agg(F.count("*").alias("n_rows")).select(*[F.lit(v).alias(k) for k, v in metadata.items()], "n_rows").coalesce(1).write.mode("overwrite").json(f"{path}/dataset_metadata")


def write_sidecars(df: DataFrame, name: str, path: str) -> None:
    """A JSON object beside each document: one line for each row, with the document's file name in it, in folders by its first letter."""
    first = F.lower(F.substring(F.regexp_replace(name, r"[^A-Za-z0-9]", "_"), 1, 1))
    df.select(F.struct(*df.columns).alias("s"), first.alias("shelf")).select(F.to_json("s").alias("value"), "shelf").write.mode("overwrite").partitionBy("shelf").text(path)


def markdown_table(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(line_no, line): the rows of a summary as a Markdown table below a title. For reports: a few rows, whose number the caller bounds."""
    cells = lambda cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    w = Window.orderBy(*order)
    rows = df.select(cells([F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]).alias("line"), (F.row_number().over(w) + 4).alias("line_no"))
    head = [(1, f"## {title}"), (2, ""), (3, f"| {' | '.join(df.columns)} |"), (4, "|" + "---|" * len(df.columns))]
    return df.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(rows)


def write_split(df: DataFrame, keep: Column, path: str) -> None:
    """Both halves of a condition in one pass, as the partitions kept=true and kept=false; null counts as false."""
    df.withColumn("kept", F.coalesce(keep, F.lit(False))).write.mode("overwrite").partitionBy("kept").parquet(path)


def append_new(df: DataFrame, key: str, path: str) -> None:
    """Appends the rows whose key the table at path does not hold yet: a repeated run adds nothing."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # the first run: there is no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    new = df.dropDuplicates([key]) if done is None else df.dropDuplicates([key]).join(done, key, "left_anti")
    new.write.mode("append").parquet(path)
