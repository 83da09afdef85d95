"""Perturbed citations for negative examples. Every choice is a seeded hash of the row's key: the same in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import seeded


def drop_author(authors: Column, key: Column) -> Column:
    """The authors without one of them, by position; lists of fewer than two stay."""
    n = F.size(authors)
    at = seeded(n, F.lit("drop"), key)
    return F.when(n >= 2, F.filter(authors, lambda _, i: i != at)).otherwise(authors)


def add_author(authors: Column, other: Column, key: Column) -> Column:
    """The authors with another inserted at some position; unchanged if it is one of them already."""
    at = seeded(F.size(authors) + 1, F.lit("add"), key)
    return F.when(F.array_contains(authors, other) | other.isNull(), authors).otherwise(F.concat(F.slice(authors, F.lit(1), at), F.array(other), F.slice(authors, at + 1, F.size(authors))))


def mutate_name(name: Column, key: Column) -> Column:
    """One letter error: two neighbours swapped, a letter doubled, or the first word cut to its initial."""
    n = F.length(name)
    kind = seeded(3, F.lit("kind"), key)
    at = F.lit(2) + seeded(F.greatest(n - 3, F.lit(1)), F.lit("at"), key)
    swapped = F.concat(F.substr(name, F.lit(1), at - 1), F.substr(name, at + 1, F.lit(1)), F.substr(name, at, F.lit(1)), F.substr(name, at + 2))
    doubled = F.concat(F.substr(name, F.lit(1), at), F.substr(name, at))
    initial = F.regexp_replace(name, r"^(\w)\w+", "$1.")
    return F.when(n < 4, name).when(kind == 0, swapped).when(kind == 1, doubled).otherwise(initial)


def corrupt_doi(doi: Column, key: Column) -> Column:
    """A DOI with its last digit shifted by 1 to 8, or with an ending that none has."""
    kind = seeded(3, F.lit("doi"), key)
    last = F.regexp_extract(doi, r"(\d)(\D*)$", 1)
    shift = F.lit(1) + seeded(8, F.lit("shift"), key)
    digit = ((last.try_cast("int") + shift) % 10).cast("string")
    shifted = F.concat(F.regexp_extract(doi, r"^(.*)\d\D*$", 1), digit, F.regexp_extract(doi, r"\d(\D*)$", 1))
    return F.when(doi.isNull() | (doi == ""), F.lit(None)).when((kind == 0) & (last != ""), shifted).when(kind == 1, F.concat(doi, F.lit("x"))).otherwise(F.concat(doi, F.lit(".invalid")))


def shift_year(year: Column, key: Column, low: int = 1960, high: int = 2025) -> Column:
    """The year moved by 1 to 4, kept within bounds, always changed."""
    by = (F.lit(1) + seeded(4, F.lit("by"), key)) * F.when(seeded(2, F.lit("sign"), key) == 0, 1).otherwise(-1)
    moved = F.least(F.greatest(year + by, F.lit(low)), F.lit(high))
    return F.when(moved == year, F.when(year >= high, year - 1).otherwise(year + 1)).otherwise(moved)


def swap_venue(venue: Column, venues: Column, key: Column) -> Column:
    """Another venue of the list."""
    others = F.filter(venues, lambda v: v != F.coalesce(venue, F.lit("")))
    return others[seeded(F.size(others), F.lit("venue"), key)]


#: The ways in which a claim may drift from its source.
DRIFTS = ["scope", "reversal", "strength", "context_shift"]


def drifts(claim: Column) -> Column:
    """The drifts that a claim allows: numbers or quantities for scope and strength, a verb of effect for reversal."""
    low = F.lower(claim)
    return F.filter(
        F.array(
            F.when(low.rlike(r"\d|all|most|many|some"), "scope"), F.when(low.rlike("improve|reduce|increase|outperform|fail|benefit"), "reversal"),
            F.when(low.rlike("suggest|show|may|can|might"), "strength"), F.when(F.length(claim) > 60, "context_shift"),
        ),
        lambda x: x.isNotNull(),
    )
