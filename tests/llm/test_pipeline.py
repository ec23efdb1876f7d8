import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from servista.llm.tokens import tokenizer_path

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def language(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n))


SYLLABLES = {"aa": ["th", "er", "on", "an", "ing", "ou"], "bb": ["sch", "ung", "ein", "ver", "keit", "zu"]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    item = language(rng, SYLLABLES["aa"], 40)
    shared = language(rng, SYLLABLES["bb"], 70)
    rows = [(i, language(rng, SYLLABLES["aa" if i % 2 else "bb"], 60 + i), "aa" if i % 2 else "bb") for i in range(40)]
    rows += [(50, None, "aa"), (51, "", "aa"), (52, "12 34 !!", "bb")]
    rows += [(60 + i, rows[1][1], "aa") for i in range(4)] + [(70, rows[3][1] + " one more word", "aa")]
    rows += [(80 + i, f"{language(rng, SYLLABLES['bb'], 30)} {shared} {language(rng, SYLLABLES['bb'], 30)}", "bb") for i in range(3)]
    rows += [(90, f"{language(rng, SYLLABLES['aa'], 30)} {item} {language(rng, SYLLABLES['aa'], 30)}", "aa")]
    path = tmp_path_factory.mktemp("sf")
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {i: t for i, t, _ in rows}, shared


def test_stages_equal_brute_force(spark, tables):
    path, text, shared = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, path)
        got.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and [f.dataType for f in docs.schema] == [f.dataType for f in spark.createDataFrame([], SCHEMA).schema]
    kept = {r.doc_id: r.text for r in out["language_id"]}
    assert kept == {i: t for i, t in text.items() if t and any(c.isalpha() for c in t)}
    comp = brute.components({i: brute.shingles(t, 5) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    assert {r.doc_id: r.text for r in out["near_duplicates"]} == kept and not {60, 61, 62, 63, 70} & set(kept)
    for i, cut in zip(kept, brute.removed(list(kept.values()), 200), strict=True):
        assert (cut[1] > 0) == (i in (80, 81, 82))
        if cut[1]:
            r = next(r for r in out["repeated_passages"] if r.doc_id == i)
            assert shared not in r.text and r.n_chars == len(r.text) and hashlib.sha256(r.text.encode()).hexdigest() == cut[3]
            kept[i] = r.text
    assert {r.doc_id: r.text for r in out["repeated_passages"]} == kept
    del kept[90]
    assert {r.doc_id: r.text for r in out["decontamination"]} == kept
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in kept.items()}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in out["best_fit_packing"]} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def test_null_and_repeated_ids(spark, tables, tmp_path):
    rng = random.Random(12)
    item = language(rng, SYLLABLES["aa"], 40)
    a, b, c, d, e, f = (language(rng, SYLLABLES["aa"], 50) for _ in range(6))
    rows = [(None, a), (None, b), (7, c), (7, d), (9, d), (None, c), (8, e), (8, e), (5, f), (7, f + " more"), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    order = lambda r: (r[0] is None, r)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=order) == sorted([(None, a), (None, b), (7, c), (7, d), (8, e), (5, f), (4, ""), (4, "")], key=order)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{a} {item}"), (None, b), (7, f"{item} {c}"), (7, d), (8, e), (8, e), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(repr, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(repr, [rows[k] for k in (1, 3, 4, 5, 6, 7)]))


def test_columns_of_any_name_and_type(spark, tables):
    """Names with dots, the helpers' own names, and a map go through every stage that returns documents."""
    path, text, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.select("*", F.col("doc_id").alias("a.b"), F.concat(F.lit("r"), "doc_id").alias("__row"), F.lit(None).cast("string").alias("__ROW2"), F.create_map(F.lit("k"), "lang").alias("m"), F.col("source").alias("all"))
    odd = odd.union(odd.filter("doc_id = 20"))  # a row twice, equal in all columns
    plain = docs.union(docs.filter("doc_id = 20"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd, plain = stage(spark, odd, path), stage(spark, plain, path)
        odd.write.parquet(f"{path}/odd-{name}")
        plain.write.parquet(f"{path}/plain-{name}")
        odd, plain = spark.read.parquet(f"{path}/odd-{name}"), spark.read.parquet(f"{path}/plain-{name}")
        assert odd.columns[-5:] == ["a.b", "__row", "__ROW2", "m", "all"]
        rows = odd.select("doc_id", "text", F.col("`a.b`").alias("ab"), "__row", "m").collect()
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in plain.collect())
        assert all(r.ab == r.doc_id and r["__row"] == f"r{r.doc_id}" and set(r.m) == {"k"} for r in rows)
    assert [r.doc_id for r in rows].count(20) == 1


def test_run_and_empty(spark, tables, tmp_path):
    path, _, _ = tables
    assert corpus_pipeline.run(spark, path).count() == 43
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
