import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from servista.llm import langid

from . import brute


def longest_match_phrases(symbols, learned):
    """Phrases of a text, each the longest that occurs in the learned one."""
    i = n = 0
    while i < len(symbols):
        k = 1
        while i + k <= len(symbols) and symbols[i : i + k] in learned:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_automaton_counts_longest_matches():
    rng = random.Random(2)
    for _ in range(20):
        learned = "".join(rng.choice("abcd") for _ in range(60))
        texts = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 30))) for _ in range(9)]
        assert phrases(langid.Automaton([ord(c) - 97 for c in learned], 5), [[ord(c) - 97 for c in t] for t in texts]) == [longest_match_phrases(t, learned) for t in texts]


def phrases(automaton, texts):
    n = np.array([len(t) for t in texts])
    other = langid.Automaton([0, 1] * 50, automaton.width)
    got = langid.Parser([other, automaton, other], automaton.width).phrases(np.concatenate(texts).astype(np.uint16), np.cumsum(n) - n, n)
    assert got[0].tolist() == got[2].tolist()
    return got[1].tolist()


def test_whole_texts_are_parsed_without_cuts(monkeypatch):
    rng = random.Random(6)
    learned = "".join(rng.choice("abcd") for _ in range(4000))
    text = lambda n: "".join(learned[k : k + rng.randint(1, 900)] for k in (rng.randrange(4000) for _ in range(n)))
    texts = [text(3) for _ in range(20)] + [text(60), text(20), learned, "e", "abe", text(1), "e" * 300, "", learned + learned[900:1900]]
    want = [longest_match_phrases(t, learned) for t in texts]
    for stretch in (langid.STRETCH, 100, 7):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert phrases(langid.Automaton([ord(c) - 97 for c in learned], 6), [[ord(c) - 97 for c in t] for t in texts]) == want


def test_automaton_of_many_symbols():
    rng = random.Random(4)
    learned = [rng.randrange(700) if rng.random() < 0.5 else rng.randrange(3) for _ in range(900)]
    texts = [[rng.randrange(3) if rng.random() < 0.7 else rng.randrange(1000) for _ in range(40)] for _ in range(30)] + [learned[k : k + 40] for k in range(0, 600, 40)]
    want = [longest_match_phrases("".join(chr(c + 300) for c in t), "".join(chr(c + 300) for c in learned)) for t in texts]
    assert phrases(langid.Automaton(learned, 1000), texts) == want


def test_languages_of_more_letters_than_a_table_holds():
    rng = random.Random(5)
    letters = {"aa": range(0x3B1, 0x3C2), "bb": range(0x5E00, 0x5F90), "cc": range(0x6E00, 0x6F90), "dd": range(0x4E00, 0x4F90), "ee": range(0xAC00, 0xAE00)}
    text = lambda k, n: " ".join("".join(chr(rng.choice(letters[k])) for _ in range(3)) for _ in range(n))
    model = langid.Model({k: text(k, 1500) for k in letters})
    assert model.predict([text(k, 20) for k in letters])[0] == [*letters]


def language(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


SYLLABLES = {"aa": ["th", "er", "on", "an"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["eau", "ñé", "oi", "que"]}


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(8)
    rows = [(i, language(rng, SYLLABLES[lang], 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ... !?", "bb"), (1003, language(rng, SYLLABLES["bb"], 20_000), None), (None, "schung ein", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("held_out", langid.held_out(3, 1))
    learned = langid.samples(docs, ~F.col("held_out"))
    assert set(learned) == set(SYLLABLES)
    out = langid.predict(docs, learned, "held_out", "lang").collect()
    test = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(test) > 30 and all(r.lang_pred == r.lang for r in test) and all(0 < r.score <= 1 for r in test)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "bb" and len(out) == len(rows)


def plain_prediction(samples, text):
    """Language and score by longest matches counted one language after the other."""
    known = {c for t in samples.values() for c in t.lower() if c.isalpha()}
    plain = lambda t: re.sub(" +", " ", "".join(c if c in known else "?" if c.isalpha() else " " for c in t.lower())).lstrip(" ")
    own = plain(text)
    if not re.search(r"[^ ]", own):
        return "und", 0.0
    cost = sorted((longest_match_phrases(own, plain(t)) * math.log2(max(2, len(plain(t)))) / len(own), k) for k, t in samples.items())
    return cost[0][1], 1 - cost[0][0] / cost[1][0]


def test_predictions_by_brute_force():
    rng = random.Random(10)
    samples = {k: language(rng, SYLLABLES[k], 120) + ", 12 " for k in SYLLABLES}
    texts = [language(rng, SYLLABLES[rng.choice([*SYLLABLES])], rng.randrange(1, 30)) for _ in range(40)] + ["Thon, ERON -- 99 xyz!", "", " 1 2 ", "жизнь", "a", "  ungschein "]
    texts += [" ".join(language(rng, SYLLABLES[k], 3) for k in rng.choices([*SYLLABLES], k=5)) for _ in range(20)]
    said, score, _ = langid.Model(samples).predict(texts)
    for text, lang, one in zip(texts, said, score.tolist(), strict=True):
        want = plain_prediction(samples, text)
        assert lang == want[0] and one == pytest.approx(want[1])


def test_ties_go_to_the_first_name():
    rng = random.Random(9)
    text = language(rng, SYLLABLES["aa"], 200)
    model = langid.Model({"zz": text, "bb": text, "cc": language(rng, SYLLABLES["cc"], 200)})
    said, score, _ = model.predict([language(rng, SYLLABLES["aa"], 20), "", "12"])
    assert said == ["bb", "und", "und"] and score.tolist() == [0, 0, 0]


def test_nothing_to_learn_from(spark):
    docs = brute.table(spark, [(1, "text")])
    assert langid.samples(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) == {}
    assert [r.lang_pred for r in langid.predict(docs, {}).collect()] == ["und"]
    assert langid.predict(docs.limit(0), {"aa": "text"}).count() == 0
