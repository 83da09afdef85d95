"""Readers: JSON containers, CSV lists, text of unknown encoding, BibTeX, archives, and tables of external services.

Network services are not called here. Each has a place where its answers come in as a table or a function: `lookup` for metadata
services, `with_text` for converters of documents, so that a run without network works on stored answers.
"""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.schema import INSTANCE, normalize_instances

CONTAINERS = ("instances", "data", "samples", "adversarial_instances")


def read_instances(spark: SparkSession, path: str, schema: str = INSTANCE) -> DataFrame:
    """Instances from JSON files that hold a list, or an object with the list under one of CONTAINERS; in the current shape."""
    wide = f"{schema}, " + ", ".join(f"{c} array<struct<{schema_as_struct(schema)}>>" for c in CONTAINERS)
    raw = spark.read.schema(wide).option("multiLine", True).json(path)
    plain = [c for c in raw.columns if c not in CONTAINERS]
    own = F.array(F.struct(*plain))
    rows = raw.select(F.explode(F.coalesce(*CONTAINERS, own)).alias("r")).select("r.*")
    return normalize_instances(rows)


def schema_as_struct(ddl: str) -> str:
    """`a string, b struct<..>` as the inside of a struct type."""
    out, depth, at_name = [], 0, True
    for ch in ddl:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            at_name = True
            out.append(",")
        elif ch == " " and depth == 0 and at_name and out and out[-1] not in ", ":
            out.append(":")
            at_name = False
        elif not (ch == " " and depth == 0):
            out.append(ch)
    return "".join(out)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Bibliography entries as maps: (pdf_url, pos, entry), from files with {"pdf_url":.., "references":[..]}, a list, or one entry."""
    raw = spark.read.option("wholetext", True).text(path)
    held = F.from_json("value", "struct<pdf_url:string,references:array<map<string,string>>>")
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<map<string,string>>"))
    entries = F.coalesce(held["references"], listed, F.array(F.from_json("value", "map<string,string>")))
    return raw.select(held["pdf_url"].alias("pdf_url"), F.posexplode(entries).alias("pos", "entry")).where("entry is not null")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, every column as text; quoted fields may hold quotes (doubled) and line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_id_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The non-blank, stripped values of one column of CSV files with a header."""
    d = read_csv(spark, path)
    return d.select(F.trim(column).alias(column)).where(F.col(column) != "")


def read_text(spark: SparkSession, path: str, glob: str = "*", first: int | None = None) -> DataFrame:
    """(path, text) of files of any depth: UTF-8 where it decodes, Latin-1 else; `first` keeps that many characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    return raw.select("path", (F.substring(text, 1, first) if first else text).alias("text"))


def archive_members(files: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """(path, member, content, error) of tar archives in (path, content); nothing is written to disk, links are not followed.

    A member above max_bytes is listed with null content and an error, so the caller sees what was left out; an archive
    that cannot be read to its end gives its members so far and a row without member that says why.
    """
    names = ["path", "member", "content", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(path: str, member: str | None, body: bytes | None, error: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member], pa.string()), pa.array([body], pa.binary()), pa.array([error], pa.string())], names)

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                        for m in tar:
                            if m.isfile():
                                fits = m.size <= max_bytes
                                yield row(path, m.name, tar.extractfile(m).read() if fits else None, None if fits else f"{m.size} bytes")
                except (tarfile.TarError, EOFError, TypeError, zlib.error, OSError) as e:
                    yield row(path, None, None, f"{type(e).__name__}: {e}")

    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary, error string")


def parse_bibtex(text: str) -> Iterator[dict[str, str]]:
    """The entries of BibTeX text as maps with ENTRYTYPE and ID; broken entries end at the next one."""
    i, n = 0, len(text)
    while (i := text.find("@", i)) >= 0:
        brace = text.find("{", i)
        if brace < 0:
            return
        kind = text[i + 1 : brace].strip().lower()
        i = brace + 1
        if not kind.isalpha() or kind in ("comment", "preamble", "string"):
            continue
        comma = text.find(",", i)
        if comma < 0:
            return
        entry = {"ENTRYTYPE": kind, "ID": text[i:comma].strip()}
        i = comma + 1
        while i < n:
            while i < n and (text[i].isspace() or text[i] == ","):
                i += 1
            if i >= n or text[i] == "}" or text[i] == "@":
                break
            eq = text.find("=", i)
            if eq < 0:
                return
            name, i = text[i:eq].strip().lower(), eq + 1
            while i < n and text[i].isspace():
                i += 1
            if i < n and text[i] in '{"':
                close, depth, start = ("}" if text[i] == "{" else '"'), 0, i + 1
                i += 1
                while i < n and not (text[i] == close and depth == 0):
                    depth += text[i] == "{"
                    depth -= text[i] == "}"
                    i += 1
                value, i = text[start:i], i + 1
            else:
                start = i
                while i < n and text[i] not in ",}\n":
                    i += 1
                value = text[start:i]
            if name.replace("-", "").replace("_", "").isalnum():
                entry[name] = " ".join(value.split())
        yield entry


def bibtex_entries(texts: DataFrame, most_lines: int | None = 50_000) -> DataFrame:
    """(path, pos, entry map<string,string>) of BibTeX texts (path, text); files above most_lines are left out, null takes all."""
    kept = texts.where(F.size(F.split("text", "\n")) <= most_lines) if most_lines else texts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, list(e.items())) for p, s in zip(f["path"], f["text"]) for i, e in enumerate(parse_bibtex(s or ""))]
            yield pd.DataFrame(rows, columns=["path", "pos", "entry"])

    return kept.select("path", "text").mapInPandas(run, "path string, pos int, entry array<struct<key:string,value:string>>").withColumn("entry", F.map_from_entries("entry"))


def main_tex(files: DataFrame, paper: str) -> DataFrame:
    """(paper, path): the main file of each paper: by name, else by document class near the start, else the first."""
    name = F.element_at(F.split("path", "/"), -1)
    names = ["main.tex", "paper.tex", "article.tex", "ms.tex"]
    rank = F.when(name.isin(names), F.array_position(F.array(*[F.lit(n) for n in names]), name)).when(F.substring("text", 1, 5000).contains("\\documentclass"), F.lit(50)).otherwise(F.lit(100))
    return files.groupBy(paper).agg(F.min_by("path", F.struct(rank.alias("r"), "path")).alias("path"))


def pages_to_markdown(pages: DataFrame, key: str) -> DataFrame:
    """(key, text): page texts (key, page, text) as Markdown with a header for each page; blank pages are skipped."""
    p = pages.where(F.trim("text") != "")
    one = F.array_sort(F.collect_list(F.struct("page", "text")))
    return p.groupBy(key).agg(one.alias("ps")).select(key, F.array_join(F.transform("ps", lambda x: F.concat(F.lit("## Page "), x["page"].cast("string"), F.lit("\n\n"), x["text"])), "\n\n").alias("text"))


def with_text(files: DataFrame, convert: Callable[[bytes], str | None]) -> DataFrame:
    """(path, text): files (path, content) through a converter, such as one for PDF; its failures give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                try:
                    out.append(convert(data))
                except Exception:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def lookup(df: DataFrame, key: Column, answers: DataFrame, answers_key: str, *cols: str) -> DataFrame:
    """df with columns of a table of stored answers, unique by key: the offline form of a metadata service."""
    side = answers.select(F.col(answers_key).alias("__k"), *cols)
    return df.join(side, key == F.col("__k"), "left").drop("__k")
