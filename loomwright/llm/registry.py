"""Queries of the operators in this package, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import encode, language, leakage, mainbody, mixing, nearcopies, pii, sentences, tokens
from loomwright.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(table(spark, d, "text_rows"), table(spark, d, "lang_samples"))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.documents(table(spark, d, "text_rows"), language.fit(table(spark, d, "lang_samples"))).dropDuplicates(["row_id"])


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "text_rows"), language.fit(table(spark, d, "lang_samples")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return tokens.wrong_counts(table(spark, d, "text_rows"))


def p2_budget(spark: SparkSession, d: str) -> DataFrame:
    """Totals by source, language and domain, built by the delta from an empty corpus."""
    state = tokens.members(table(spark, d, "text_rows"), table(spark, d, "corpora"))
    return tokens.roll_up(tokens.apply_delta(None, tokens.cube_delta(None, state)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(table(spark, d, "text_rows")).select("row_id", "kind", "start_char").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "text_rows")).dropDuplicates(["row_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.NearCopies(table(spark, d, "text_rows")).links()


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.NearCopies(table(spark, d, "text_rows")).documents()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.boilerplate(table(spark, d, "text_rows"))


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.bodies(table(spark, d, "text_rows")).dropDuplicates(["row_id"])


def _budgets(spark: SparkSession, d: str, language: bool = True) -> tuple[DataFrame, DataFrame]:
    counted = mixing.record_tokens(table(spark, d, "text_rows"), language=language)
    return mixing.mix_budgets(table(spark, d, "data_plans"), counted, table(spark, d, "corpora")), counted


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(_budgets(spark, d)[0]).filter("short").select("plan_id", "source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(_budgets(spark, d)[0])


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_selection(*_budgets(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter("kind = 'exact'").select("doc_id", "item_id").distinct()


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).dropDuplicates(["doc_id", "item_id"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_rows(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
