"""Evidence-typed values: a value, how it is known, and from what. Ambiguity is a value of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From the weakest to the strongest.
GRADES = ("UNRESOLVED", "INFERRED", "DERIVED", "EXPLICIT")


def rank(grade: Column) -> Column:
    """Place of a grade, 0 for the weakest and for what isn't a grade."""
    return F.greatest(F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.coalesce(grade, F.lit("")).cast("string")) - 1, F.lit(0)).cast("int")


def grade(of_rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GRADES]), of_rank + 1)


def weakest(*grades: Column) -> Column:
    return grade(F.least(*[rank(g) for g in grades])) if len(grades) > 1 else grade(rank(grades[0]))


def status_of(candidates: Column) -> Column:
    """UNRESOLVED, RESOLVED or AMBIGUOUS for none, one or several candidates."""
    return F.when(F.coalesce(candidates, F.lit(0)) == 0, "UNRESOLVED").when(candidates == 1, "RESOLVED").otherwise("AMBIGUOUS")


def typed(value: Column, status: Column, evidence: Column) -> Column:
    return F.struct(value.cast("string").alias("value"), status.alias("status"), evidence.alias("evidence"))
