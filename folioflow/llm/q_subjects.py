"""Queries of the subject assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.common import materialize, table
from folioflow.llm.subjects import assign_subjects, composition


def p9_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return assign_subjects(*(table(spark, sf, t) for t in ("documents", "subjects", "subject_labels")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_subjects(spark, sf).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    return composition(materialize(p9_found(spark, sf), "subjects"))


QUERIES = {"p9_found": p9_found, "p9_subjects": p9_subjects, "p9_composition": p9_composition}
ORACLE: dict[str, str] = {}
