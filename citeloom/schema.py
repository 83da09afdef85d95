"""Schemas of the citation data and the projection that brings older shapes of instances to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CITATION = "struct<title:string,authors:array<string>,venue:string,year:int,identifiers:struct<doi:string,arxiv_id:string,url:string>>"
TRUTH = "struct<true_existence:int,true_hallucination_category:string,true_alignment:int,expert_rationale:string>"
EVIDENCE = "struct<extractive_chunks:array<struct<chunk_id:string,extractive_text:string,relevance_score:double>>,abstractive_synthesis:string>"
#: An instance as it may come, with the places where older files keep the claim and the label.
INSTANCE = (
    f"instance_id string, original_paper string, claim_text string, surrounding_context string, citation_metadata {CITATION}, true_outputs {TRUTH}, "
    f"retrieved_evidences {EVIDENCE}, citing_context struct<claim_text:string>, ground_truth struct<task2_alignment:struct<label:int>>"
)
BIB_ENTRY = "map<string,string>"


def normalize_instances(df: DataFrame) -> DataFrame:
    """Instances in the current shape: the claim and the alignment from the first place that holds them."""
    claim = F.coalesce(F.nullif(F.trim("claim_text"), F.lit("")), F.nullif(F.trim("citing_context.claim_text"), F.lit("")))
    label = F.coalesce("true_outputs.true_alignment", "ground_truth.task2_alignment.label")
    truth = F.struct(
        F.col("true_outputs.true_existence").alias("true_existence"), F.col("true_outputs.true_hallucination_category").alias("true_hallucination_category"),
        label.alias("true_alignment"), F.col("true_outputs.expert_rationale").alias("expert_rationale"),
    )
    return df.withColumns({"claim_text": claim, "true_outputs": truth}).drop("citing_context", "ground_truth")
