"""Scores of predictions against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decision import DECISIONS, INVESTMENTS, POLITICS, VIOLATIONS
from .validate import CONTENT_TYPES

FIELDS = ("decision", "violation", "investment", "politics")
LANGUAGES = ("AZ", "EN", "RU", "TR")
CASES = "id string, contentType string, language string, text string, expected struct<decision:string,violation:string,investment:string,politics:string>"


def percentage(right: Column, total: Column) -> Column:
    """Two decimals, or n/a of nothing."""
    return F.when(total == 0, "n/a").otherwise(F.format_string("%.2f", F.round(right * 100 / F.when(total != 0, total), 10)))


def valid_case(expected_keys: Column | None = None) -> Column:
    """Whether a case of the schema CASES is well formed. ``expected_keys``: the names that its expectation holds, where they are known; else its non-null fields."""
    one_of = lambda c, members: F.coalesce(c.isin(*members), F.lit(False))
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    e = {f: F.col(f"expected.{f}") for f in FIELDS}
    has = {f: F.array_contains(expected_keys, f) if expected_keys is not None else e[f].isNotNull() for f in FIELDS}
    kind = F.col("contentType")
    post = one_of(e["investment"], INVESTMENTS) & one_of(e["politics"], POLITICS)
    comment = ~has["investment"] & one_of(e["politics"], POLITICS)
    name = ~has["investment"] & ~has["politics"]
    by_kind = F.when(kind == "POST", post).when(kind == "COMMENT", comment).otherwise(name)
    few = F.size(F.array_except(expected_keys, F.array(*map(F.lit, FIELDS)))) == 0 if expected_keys is not None else F.lit(True)
    return filled(F.col("id")) & filled(F.col("text")) & one_of(F.col("language"), LANGUAGES) & one_of(kind, CONTENT_TYPES) & one_of(e["decision"], DECISIONS) & one_of(e["violation"], VIOLATIONS) & by_kind & few


def dataset_check(cases: DataFrame, expected: int) -> DataFrame:
    """One row: n, n_ids, n_invalid and whether the dataset is valid."""
    return cases.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.sum((~valid_case()).cast("long")).alias("n_invalid")).select("n", "n_ids", F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"), ((F.col("n") == expected) & (F.col("n_ids") == expected) & (F.coalesce("n_invalid", F.lit(0)) == 0)).alias("valid"))


def compared(cases: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per case: id, content_type, language, api_ok, contract_right (of 2), and for each field its expectation, whether it is right (null where nothing is expected), and case_pass.

    ``actual``: id, ok, contentId, contentType, decision, violation, investment, politics. A missing answer is wrong in everything; a missing field equals nothing.
    """
    a = actual.select(F.col("id").alias("a_id"), "ok", "contentId", F.col("contentType").alias("a_type"), *(F.col(f).alias(f"a_{f}") for f in FIELDS))
    rows = cases.join(a, cases["id"] == a["a_id"], "left")
    ok = F.coalesce("ok", F.lit(False))
    right = {f: F.when(F.col(f"expected.{f}").isNotNull(), ok & F.coalesce(F.col(f"a_{f}") == F.col(f"expected.{f}"), F.lit(False))) for f in FIELDS}
    contract = [ok & F.coalesce(F.col("contentId") == F.col("id"), F.lit(False)), ok & F.coalesce(F.col("a_type") == F.col("contentType"), F.lit(False))]
    passed = ok & contract[0] & contract[1]
    for f in FIELDS:
        passed = passed & F.coalesce(right[f], F.lit(True))
    return rows.select("id", F.col("contentType").alias("content_type"), "language", ok.alias("api_ok"), sum((c.cast("int") for c in contract[1:]), contract[0].cast("int")).alias("contract_right"), *(F.col(f"expected.{f}").alias(f"expected_{f}") for f in FIELDS), *(right[f].alias(f"{f}_right") for f in FIELDS), passed.alias("case_pass"))


def summary(rows: DataFrame) -> DataFrame:
    """(metric, value, n_right, n_total, percent) of compared cases: in all, by content type, by language, by field and by expected label. One pass over the cases by grouping sets, one over their fields."""

    def row(metric: str, value: Column | str, right: Column, each: int = 1) -> Column:
        return F.struct(F.lit(metric).alias("metric"), (F.lit(value) if isinstance(value, str) else value).alias("value"), right.cast("long").alias("n_right"), (each * F.col("n")).alias("n_total"))

    by_case = (
        rows.groupingSets([["content_type"], ["language"], []], "content_type", "language")
        .agg(F.grouping_id("content_type", "language").alias("g"), F.sum(F.col("case_pass").cast("long")).alias("exact"), F.sum(F.col("api_ok").cast("long")).alias("api"), F.sum("contract_right").alias("contract"), F.count("*").alias("n"))
        .select(
            F.explode(
                F.when(F.col("g") == 3, F.array(row("exact_case", "all", F.col("exact")), row("api_success", "all", F.col("api")), row("contract", "all", F.col("contract"), 2)))
                .when(F.col("g") == 1, F.array(row("content_type", F.col("content_type"), F.col("exact"))))
                .otherwise(F.array(row("language", F.col("language"), F.col("exact"))))
            ).alias("r")
        )
        .select("r.*")
    )
    fields = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"expected_{f}").alias("label"), F.col(f"{f}_right").alias("right")) for f in FIELDS))).alias("x")).select("x.*").where("label is not null")
    by_field = (
        fields.groupingSets([["field", "label"], ["field"], []], "field", "label")
        .agg(F.grouping_id("field", "label").alias("g"), F.sum(F.col("right").cast("long")).alias("n_right"), F.count("*").alias("n_total"))
        .select(F.when(F.col("g") == 3, "label_field").when(F.col("g") == 1, "field").otherwise(F.concat(F.lit("label:"), F.col("field"))).alias("metric"), F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.col("field")).otherwise(F.col("label")).alias("value"), "n_right", "n_total")
    )
    out = by_case.unionByName(by_field)
    return out.withColumn("percent", percentage(F.col("n_right"), F.col("n_total")))


def exit_code(rows: DataFrame, least_percent: float = 0.0) -> int:
    """2 where calls failed, 3 where exact accuracy is below the least, else 0."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("api_ok").cast("long")).alias("api"), F.sum(F.col("case_pass").cast("long")).alias("exact")).first()
    if (total["api"] or 0) < total["n"]:
        return 2
    return 3 if total["n"] and 100 * (total["exact"] or 0) / total["n"] < least_percent else 0
