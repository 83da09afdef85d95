"""Places for models and services: scorers, embedders and classifiers as plain functions, each with an offline default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: texts -> vectors, texts -> answers
Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[list[str]], list[str]]


def hashing_embedder(texts: list[str], size: int = 64) -> list[list[float]]:
    """Signed feature hashing of words, normalised: deterministic, without a model."""
    out = []
    for s in texts:
        v = [0.0] * size
        for w in (s or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else v)
    return out


def embed(df: DataFrame, key: str, text: str, embedder: Embedder = hashing_embedder) -> DataFrame:
    """(key, embedding): each distinct text is embedded once, in Arrow batches, and joined back."""
    texts = df.select(F.col(text).alias("t")).where("t is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(embedder(b.column(0).to_pylist()), pa.list_(pa.float32()))], ["t", "embedding"])

    vectors = texts.mapInArrow(run, "t string, embedding array<float>")
    return df.select(key, F.col(text).alias("t")).join(vectors, "t", "left").select(key, "embedding")


def generate(df: DataFrame, key: str, prompt: str, model: Generator) -> DataFrame:
    """(key, answer, error): answers of a model; rows without a prompt are not sent, and a failed batch gives an error, not a lost row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = b.column(1).to_pylist()
            try:
                answers, errors = model(prompts), [None] * len(prompts)
            except Exception as e:
                answers, errors = [None] * len(prompts), [str(e)[:500]] * len(prompts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["k", "answer", "error"])

    d = df.select(F.col(key).alias("k"), F.col(prompt).alias("p"))
    asked = d.where("p is not null").mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, answer string, error string")
    rest = d.where("p is null").select("k", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"))
    return asked.unionAll(rest).withColumnRenamed("k", key)


def rule_classifier(prompts: list[str]) -> list[str]:
    """An offline stand-in for an adjudicating model: JSON answers by word overlap of claim and evidence."""
    out = []
    for p in prompts:
        claim, _, evidence = p.partition("\nEvidence: ")
        a, b = set(claim.lower().split()), set(evidence.lower().split())
        share = len(a & b) / max(len(a), 1)
        name = "SUPPORTED" if share >= 0.6 else "PARTIALLY_SUPPORTED" if share >= 0.4 else "UNSUPPORTED" if evidence and share < 0.1 else "UNCERTAIN"
        out.append(f'{{"classification": "{name}", "confidence": {share:.4f}}}')
    return out
