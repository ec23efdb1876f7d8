import pytest

from servista.llm import common, neardup

from . import brute


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def want(rows, width):
    sets = {i: brute.shingles(t, width) for i, t in rows}
    comp = brute.components(sets)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i, _ in rows}


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, width):
    rows = brute.awkward()
    assert got(neardup.groups(brute.table(spark, rows), width)) == want(rows, width)


def test_without_broadcast_and_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 300)
    rows = brute.awkward(2)
    assert got(neardup.groups(brute.table(spark, rows), 2)) == want(rows, 2)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other words here"), (0, "a b c"), (None, "a b c")]
    out = [(r.doc_id, r.component_id) for r in neardup.groups(brute.table(spark, rows)).collect()]
    assert sorted(out, key=repr) == [(0, 0), (1, 0), (1, 0), (1, 1), (None, 0)]


def test_empty_table(spark):
    assert neardup.groups(brute.table(spark, []).limit(0)).count() == 0


def test_bound_keeps_similar_pairs():
    least = neardup.least_matches(0.8)
    assert len(least) == 5 and all(m < 0.8 * 40 * (k + 1) for k, m in enumerate(least)) and least[-1] > 0.5 * 200
