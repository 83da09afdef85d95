"""Prompt templates of the steps that a model takes, filled by column expressions. The wording is this package's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_JSON = "Answer with one JSON object with the keys classification and confidence."
_LABELS = "Use one of SUPPORTED, PARTIALLY_SUPPORTED, UNSUPPORTED, UNCERTAIN."
TEMPLATES = {
    "open_book": f"Judge the claim by the evidence alone.\nClaim: {{claim}}\nEvidence: {{evidence}}\n{_LABELS} {_JSON}",
    "closed_book": f"Judge the claim by what you know of the cited work.\nClaim: {{claim}}\nCited work: {{title}} ({{year}})\n{_LABELS} {_JSON}",
    "support": "List what the evidence says for the claim and what it says against it.\nClaim: {claim}\nEvidence: {evidence}",
    "citation_claim": "State in one sentence what the passage says of the cited work.\nPassage: {context}",
    "hypothetical": "Write a short passage that would answer this claim if it stood in the cited work.\nClaim: {claim}",
    "synthesis": "Sum up the evidence that bears on the claim; answer NO_EVIDENCE if none does.\nClaim: {claim}\nEvidence: {evidence}",
    "substitute_title": "Name another real work that could be mistaken for this one: {title}",
    "paraphrase_title": "Say the same title in other words: {title}",
    "fabricate_title": "Invent a title that fits this venue: {venue}",
    "fabricate_authors": "Invent authors for a work named {title}",
    "drift": "Say which ways of distorting this claim its passage allows.\nClaim: {claim}\nPassage: {context}",
    "distort": "Distort the claim so that its passage no longer bears it out.\nClaim: {claim}\nPassage: {context}",
    "judge_distortion": "Say whether the second claim says more than the first.\nFirst: {claim}\nSecond: {rewrite}",
    "audit_label": f"The claim was labelled {{label}}. Label it anew.\nClaim: {{claim}}\nEvidence: {{evidence}}\n{_LABELS} {_JSON}",
    "failure": "Say why the verdict was wrong: retrieval, inference, chain, ambiguity or annotation.\nClaim: {claim}\nTruth: {label}",
    "rewrite_uncertain": "Rewrite the claim so that its passage neither supports nor refutes it.\nClaim: {claim}\nPassage: {context}",
}


def fill(name: str, **parts: Column) -> Column:
    """A template with its parts filled in; null parts are blank."""
    out = F.lit(TEMPLATES[name])
    for k in sorted(parts):
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(parts[k].cast("string"), F.lit("")))
    return out
