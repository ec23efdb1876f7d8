"""A corpus pipeline over documents: five stages, each one operator of servista.llm.

Every function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. Rows are judged by their whole text; a null text
has no letter and goes at the first stage; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from servista.llm import common, decontaminate, langid, neardup, packing, suffixes
from servista.llm.tokens import tokenizer_path

#: A document whose best language explains it no better than another one has no language.
LEAST_SCORE = 1e-9
SHINGLE, PERCENT = 5, 80


def _named(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _hashed(docs: DataFrame, *more: Column) -> Column:
    """A hash of all columns' values and of which are null; maps and variants, which have no hash, go as text."""
    each = []
    for c, f in zip(_named(docs), docs.schema, strict=True):
        plain = not any(k in f.dataType.simpleString() for k in ("map<", "variant"))
        each += [c if plain else F.to_json(F.struct(c.alias("x"))), c.isNull()]
    return F.xxhash64(*more, *each)


def _free(docs: DataFrame, name: str) -> str:
    """A name for a helper column that docs doesn't have."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null or letterless texts, and those no language fits best."""
    own = docs.select("doc_id", "text", "lang", langid.held_out(3, 1).alias("held_out"))
    learned = langid.samples(own, ~F.col("held_out"))
    rows = docs.select(F.struct(*_named(docs)).alias("all"), "doc_id", "text")
    said = langid.predict(rows, learned, "all")
    return said.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select("all.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id (null ids last), of these the one with
    the least hashes of the whole row. Rows go by two 64-bit hashes of all their columns, not by doc_id, which may be null or repeat;
    of rows that are equal in all columns one stays if they have words, else all do. Columns may have any names and types."""
    a, b = _free(docs, "__row"), _free(docs, "__row2")
    rows = docs.withColumns({a: _hashed(docs), b: _hashed(docs, F.lit("second"))})
    keyed = rows.select(F.col(a).alias("a"), F.col(b).alias("b"), "doc_id", "text")
    found = neardup.groups(keyed.select(F.col("a").alias("doc_id"), "b", "text"), SHINGLE, PERCENT, tag="b")
    found = found.groupBy(F.col("doc_id").alias("a"), F.col("tag").alias("b")).agg(F.first("comp").alias("comp"), F.when(F.max("n_shingles") > 0, F.count("*")).otherwise(1).alias("n"))
    ids = keyed.select("a", "b", "doc_id").distinct()
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b", "n"))
    alone = F.col("comp").isNull()  # an empty set
    group = F.struct("comp", F.when(alone, F.col("a")).alias("x"), F.when(alone, F.col("b")).alias("y"))
    kept = common.materialise(found.join(ids, ["a", "b"]).groupBy(group.alias("group")).agg(best.alias("best")).select("best.a", "best.b", "best.n"), "kept")
    left = _matching(rows, kept, a, b, "left_semi")
    repeated = kept.filter("n > 1")  # rows that are equal in all columns
    if repeated.limit(1).count():
        left = _matching(left, repeated, a, b, "left_anti").union(_matching(left, repeated, a, b, "left_semi").dropDuplicates([a, b]))
    return left.drop(a, b)


def _matching(rows: DataFrame, keys: DataFrame, a: str, b: str, how: str) -> DataFrame:
    """The rows whose two hashes are (left_semi) or aren't (left_anti) among keys (a, b)."""
    keys = common.few(keys.select(F.col("a").alias("__a"), F.col("b").alias("__b")).distinct())
    return rows.join(keys, (rows[f"`{a}`"] == F.col("__a")) & (rows[f"`{b}`"] == F.col("__b")), how)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur elsewhere too are cut out; documents of nothing else go."""
    cut = suffixes.cleaned(docs)
    columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else named for c, named in zip(docs.columns, _named(docs), strict=True)]
    return cut.select(*columns).filter(F.col("text").rlike(r"\S"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, by hashes of their text: others of their doc_id stay.

    What one hash finds is searched once more under another, so a clean text goes only where both collide.
    """
    a, b = _free(docs, "__row"), _free(docs, "__row2")
    rows = docs.withColumns({a: F.xxhash64("text"), b: F.xxhash64(F.lit("second"), "text")})
    keyed, benchmark = rows.select(F.col(a).alias("a"), F.col(b).alias("b"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    first = decontaminate.leaks(keyed.select(F.col("a").alias("doc_id"), "text"), benchmark).select("doc_id").distinct()
    again = common.materialise(common.by_key(keyed, common.materialise(first, "leaks"), "a").select("a", "b", "text"), "leaking")
    second = decontaminate.leaks(again.select(F.col("b").alias("doc_id"), "text"), benchmark).select("doc_id").distinct()
    leaking = common.materialise(common.by_key(again.select("a", "b"), second, "b").select("a", "b"), "leaking-rows")
    return _matching(rows, leaking, a, b, "left_anti").drop(a, b)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return packing.pack(spark, docs, tokenizer_path("word_bpe_49k.json"), end_id=1, size=4096)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Suffix sorting, language models and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs
