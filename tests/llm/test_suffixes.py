import collections
import random

import numpy as np
import pytest

from servista.llm import common, suffixes

from . import brute


def check(spark, rows, depth=200, digit=50):
    got = {}
    for r in suffixes.digest(brute.table(spark, rows), depth, digit).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = {}
    for (i, _), w in zip(rows, brute.removed([t for _, t in rows], depth), strict=True):
        want.setdefault(i, []).append(w)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return want


def test_equals_brute_force(spark):
    want = check(spark, [r for r in brute.awkward() if r[0] != 7])
    assert any(w[0][1] for w in want.values()) and not all(w[0][1] for w in want.values())


@pytest.mark.parametrize("group", [2, 2000])
def test_short_alphabet_and_hot_anchors(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0 if group == 2 else 10**6)
    rng = random.Random(3)
    core = "".join(rng.choice("abc") for _ in range(30))
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(40)]
    rows += [(100 + i, "".join(rng.choice("abc") for _ in range(20)) + core + "".join(rng.choice("abc") for _ in range(20))) for i in range(25)]
    check(spark, rows, depth=16, digit=5)


def test_one_anchor_of_very_many_runs(spark):
    """60,000 texts around one phrase: an anchor in it has over 50,000 runs, which are divided by their bytes."""
    rng = random.Random(17)
    core = "".join(rng.choice("abcdefgh") for _ in range(13))
    rows = [(i, "".join(rng.choice("pqrst") for _ in range(9)) + core + "".join(rng.choice("uvwxyz") for _ in range(9))) for i in range(60_000)]
    found = suffixes.repeats(brute.table(spark, rows), 16, 12)[0]
    runs = found.selectExpr("explode(anchor) AS anchor", "doc_id").groupBy("anchor").count().orderBy("count", ascending=False).first()["count"]
    assert runs >= 50_000
    want = check(spark, rows, 16, 12)
    assert 0.1 < sum(w[0][1] > 0 for w in want.values()) / 60_000
    assert any(0 < w[0][1] < 31 for w in want.values())


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 20])
def test_radix_passes_leave_what_repeats(depth):
    rng = random.Random(depth)
    data = np.array([rng.randrange(2) + 97 for _ in range(600)] * 2 + [rng.randrange(256) for _ in range(300)], np.uint8)
    start = np.array(rng.sample(range(len(data) - depth + 1), 900))
    group = np.array([rng.randrange(5) for _ in start])
    seen = collections.Counter((int(g), data[s : s + depth].tobytes()) for s, g in zip(start, group, strict=True))
    want = [k for k, (s, g) in enumerate(zip(start, group, strict=True)) if seen[int(g), data[s : s + depth].tobytes()] > 1]
    assert sorted(suffixes.radix(data, start, group, depth).tolist()) == want and want
    assert not len(suffixes.radix(data, start[:0], group[:0], depth))


def test_very_many_equal_runs(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_RUNS", 5)
    monkeypatch.setattr(suffixes, "HOT_SHARE", 0.0)
    rng = random.Random(8)
    line, other = brute.prose(rng, 60), brute.prose(rng, 60)
    rows = [(i, f"{brute.prose(rng, 9)} {line} {brute.prose(rng, 9)}") for i in range(12)] + [(50 + i, f"{brute.prose(rng, 9)} {other} {line}") for i in range(3)]
    check(spark, rows)


def test_repeated_rows(spark):
    text = brute.prose(random.Random(5), 100)
    check(spark, [(1, text), (1, text), (1, "short"), (None, "x" + text[:300])])


def test_empty(spark):
    assert suffixes.digest(brute.table(spark, []).limit(0)).count() == 0


def test_cleaned_keeps_rows_and_columns(spark):
    rng = random.Random(6)
    passage = brute.prose(rng, 60, 5000)
    rows = [(1, f"{brute.prose(rng, 9)} {passage} ä"), (2, f"ü {passage} {brute.prose(rng, 9)}"), (3, None), (4, brute.prose(rng, 50, 5000))]
    docs = brute.table(spark, rows)
    out = suffixes.cleaned(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert passage not in text[1] and passage not in text[2] and text[1].endswith("ä") and text[4] == rows[3][1] and text[3] is None
