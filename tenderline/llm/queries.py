"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, bpe, exact_dedup, jaccard_join, language_crf, mixing, quality_crf, quality_rules, suffix_dedup, url_filter
from .common import recorded, remove, small_batches, table, unread


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.classify(docs, quality_crf.learn(spark, docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(spark, table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_crf.identify(spark, docs, language_crf.learn(spark, docs))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op(spark, table(spark, sf_dir, "documents"))


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return attention_lm.scored(spark, docs, *attention_lm.learn(spark, docs))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"), whole=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bounded(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            with recorded() as paths:
                out = f(spark, sf_dir)
            remove(spark, unread(paths, out))  # what the result still reads stays
            return out

        run.__name__ = f.__name__
        return run

    return {f.__name__: bounded(f) for f in (op1_quality_classifier, op2_exact_dedup, op3_bpe, op4_language_id, op5_mixing, op6_jaccard_join, op7_attention_lm, op8_quality_rules, op9_url_filter, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.SQL, "op5_mixing": mixing.SQL, "op6_jaccard_join": jaccard_join.SQL, "op9_url_filter": url_filter.SQL, "op10_suffix_dedup": suffix_dedup.SQL}
