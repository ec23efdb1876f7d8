import random

import numpy as np
import pytest

from servista.llm import common, metric, neardup

from . import brute


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def want(rows, width=5, percent=80):
    sets = {i: brute.shingles(t, width) for i, t in rows}
    comp = brute.components(sets, percent)
    return {i: (len(sets[i]), comp[i]) for i, _ in rows}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def clusters(seed):
    """Near copies at all distances around several texts, chains of them, and texts that share a passage only."""
    rng = random.Random(seed)
    rows, at = [], 200
    for size in (40, 150, 400):
        base = brute.prose(rng, size, 3000).split()
        chain = base
        for i in range(24):
            rows.append((at, " ".join(edited(rng, base, rng.randrange(1 + size // 25)))))
            chain = edited(rng, chain, max(1, size // 90))
            rows.append((at + 1, " ".join(chain)))
            at += 2
    passage = brute.prose(rng, 60, 3000)
    for i in range(40):
        rows.append((at + i, f"{brute.prose(rng, rng.randrange(8), 3000)} {passage} {brute.prose(rng, rng.randrange(40), 3000)}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, percent", [(5, 80), (2, 60), (1, 40)])
def test_equals_brute_force(spark, width, percent):
    rows = brute.awkward() + clusters(1)
    assert got(metric.groups(brute.table(spark, rows), width, percent)) == want(rows, width, percent)


def test_without_broadcast_small_blocks_and_no_recursion(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 300)
    monkeypatch.setattr(metric, "SHRINK", 0)
    rows = clusters(2)
    assert got(metric.groups(brute.table(spark, rows))) == want(rows)


def test_order_of_shingles_changes_no_link(spark, monkeypatch):
    rows = clusters(3)
    monkeypatch.setattr(metric, "OFTEN", 1)
    monkeypatch.setattr(metric, "STRETCH", 100)
    assert got(metric.groups(brute.table(spark, rows))) == want(rows)


def test_a_link_of_the_window_counts(spark):
    """b is within reach of a, c of b, but c is not of a, the pivot."""
    w = [f"w{i}" for i in range(104)]
    b, c = w.copy(), w.copy()
    b[50] = b[51] = b[52] = b[53] = b[54] = "b"
    c[50] = c[51] = c[52] = c[53] = c[54] = "b"
    c[10] = c[11] = c[12] = c[13] = c[14] = "c"
    rows = [(1, " ".join(w)), (2, " ".join(b)), (3, " ".join(c))]
    sets = [brute.shingles(t, 5) for _, t in rows]
    similar = lambda x, y: len(x & y) / len(x | y)
    assert similar(sets[0], sets[1]) >= 0.8 and similar(sets[1], sets[2]) >= 0.8 and 0.6 < similar(sets[0], sets[2]) < 0.8
    assert {k: v[1] for k, v in got(metric.groups(brute.table(spark, rows))).items()} == {1: 1, 2: 1, 3: 1}


def test_bins_never_hide_a_shared_shingle():
    rng = np.random.default_rng(1)
    for n, m, both in ((1, 1, 1), (5, 4, 4), (300, 260, 250), (4000, 5000, 3900), (64, 90_000, 10)):
        every = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
        x, y = np.sort(every[:n]), np.sort(every[n - both :])
        assert both <= metric.most_shared(metric.bins(x), metric.bins(y)) <= min(n, m)
    same = np.arange(0, 2**20, 2**10, dtype=np.uint64)  # all in one bin of up to 1024
    assert metric.most_shared(metric.bins(same), metric.bins(same)) == len(same)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other words here"), (0, "A b\tc"), (None, "a b c"), (None, "nobody"), (4, None), (5, "")]
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in metric.groups(brute.table(spark, rows)).collect()]
    assert sorted(out, key=repr) == sorted([(0, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 1), (None, 1, 0), (None, 1, None), (4, 0, 4), (5, 0, 5)], key=repr)


def test_empty_table_and_wordless_texts(spark):
    assert metric.groups(brute.table(spark, []).limit(0)).count() == 0
    assert got(metric.groups(brute.table(spark, [(1, " "), (2, None)]))) == {1: (0, 1), 2: (0, 2)}
