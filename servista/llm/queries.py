"""Queries over the training-data tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import binary, decontaminate, fill_middle, fingerprint, hpylm, html, langid, metric, neardup, packing, periodic, suffixes, urls
from .tokens import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, size=4096)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(3, 1).alias("held_out"))
    learned = langid.samples(docs, ~F.col("held_out"))
    return langid.predict(docs, learned, "held_out").select("doc_id", "held_out", "lang_pred", "score")


def op5_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"), width=2, percent=80)


#: Verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, _table(spark, sf_dir, "pages"), URL_RULES)


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(_table(spark, sf_dir, "documents"), langid.held_out(10, 0))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.token_files(spark, _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(_table(spark, sf_dir, "documents"))


def op13_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.groups(_table(spark, sf_dir, "documents"), width=5, percent=80)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_best_fit_packing,
        op3_suffix_dedup,
        op4_language_id,
        op5_minhash_bayes,
        op6_url_rules,
        op7_pitman_yor,
        op8_token_binary,
        op9_order_minhash,
        op10_html_extraction,
        op11_fill_middle,
        op12_periodic_runs,
        op13_metric_join,
    )
}
ORACLE_SQL: dict[str, str] = {}
