"""Naming and structure heuristics on parameters and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.functions import forms, texts


def param_flags(params: DataFrame) -> DataFrame:
    """Every distinct parameter name with its two naming flags; a name may carry both."""
    return params.select("name").distinct().select(
        "name",
        texts.is_idor_name(F.col("name")).alias("is_idor"),
        texts.is_admin_name(F.col("name")).alias("is_admin"),
    )


def form_flags(found_forms: DataFrame) -> DataFrame:
    """``action, found_on, form_pos, method, issues`` of the forms with at least one issue."""
    issues = F.expr(forms.form_issues_sql("method", "inputs", "csrf_protected"))
    return found_forms.select("action", "found_on", "form_pos", "method", issues.alias("issues")).filter(
        F.size("issues") > 0
    )


def form_flag_counts(flags: DataFrame) -> DataFrame:
    """Forms per issue text."""
    return flags.select(F.explode("issues").alias("issue")).groupBy("issue").agg(
        F.count(F.lit(1)).alias("n_forms")
    )
