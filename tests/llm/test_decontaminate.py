import random
from itertools import combinations

import numpy as np
import pytest

from servista.llm import decontaminate

WORDS = [f"w{i:03d}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def altered(rng, item, every):
    """The item with one of so many words replaced, never two side by side."""
    words = item.split()
    for k in range(every // 2, len(words), every):
        words[k] = rng.choice(WORDS) + "x"
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    items = [(i, text(rng, 30)) for i in range(8)] + [(8, None), (9, "too short"), (10, text(rng, 6)), (11, "")]
    docs = [(i, text(rng, 200), "en") for i in range(20)]
    docs += [(100, text(rng, 50) + " " + items[0][1].upper() + "! " + text(rng, 50), "en")]
    docs += [(101, text(rng, 20) + "\n" + altered(rng, items[1][1], 6) + "\t" + text(rng, 9), None)]
    docs += [(102, items[2][1], "de"), (103, None, "de"), (104, "", None), (105, "...", "x"), (106, items[10][1] + ", " + text(rng, 20), "x")]
    docs += [(107, text(rng, 30000) + " " + items[3][1], "x"), (108, items[4][1] + " " + text(rng, 9) + " " + items[5][1] + " " + items[4][1], "x"), (102, items[2][1], "de")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


WANT = {100: [0], 101: [1], 102: [2], 106: [10], 107: [3], 108: [4, 5]}


def test_finds_copies_and_substitutions_only(tables):
    docs, items = tables
    got = decontaminate.contaminated(docs, items).collect()
    assert {r.doc_id: r.item_ids for r in got} == WANT


def test_spans_are_the_passages(tables):
    docs, items = tables
    text_of = {r.doc_id: r.text for r in docs.collect()}
    item_of = {r.item_id: r.text for r in items.collect()}
    for r in decontaminate.leaks(docs, items).filter("doc_id in (100, 102, 107)").collect():
        span = text_of[r.doc_id].encode()[r.doc_start : r.doc_end].decode().lower()
        assert span == item_of[r.item_id] and r.n_equal == 30


def test_longest_stretch_is_the_rule():
    rng = np.random.default_rng(3)
    for whole in [*range(5, 41)] * 10:
        item = np.arange(whole)
        equal = rng.random(whole) < rng.choice([0.5, 0.75, 0.8, 0.9])
        runs = [(a, b) for a in range(whole) for b in range(a + 1, whole + 1) if 4 * equal[a:b].sum() >= 3 * (b - a)]
        runs = [b - a for a, b in runs if b - a >= min(8, whole) and (b - a >= 0.6 * whole or b - a >= 20)] or [b - a for a, b in runs if b - a >= 13 and equal[a:b].all()]
        got = decontaminate.confirm(item, np.where(equal, item, -1), 0)
        assert (got[1] - got[0] if got else None) == max(runs, default=None)
        assert got is None or got[2] == equal[got[0] : got[1]].sum()


@pytest.mark.parametrize(("n", "gone"), [(15, range(3, 15, 4)), (40, range(3, 40, 4)), (8, [4])])
def test_items_with_three_of_four_equal_words(spark, n, gone):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(n)]
    copy = " ".join("other" if i in gone else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, f"{text(rng, 30)} {copy} {text(rng, 30)}"), (2, text(rng, 90))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.leaks(docs, items).select("doc_id", "n_words", "n_equal").collect()] == [(1, n, n - len(gone))]


def seen(mask, gone, length):
    """Whether a mask fits somewhere into a stretch without looking at a replaced word."""
    bits = [k for k, c in enumerate(mask) if c == "1"]
    return any(not any(at + k in gone for k in bits) for at in range(length - len(mask) + 1))


@pytest.mark.parametrize("n", range(8, 22))
def test_masks_hit_every_stretch_with_three_of_four_equal(n):
    masks = [m for m in decontaminate.MASKS if "0" in m] + [m for m in decontaminate.MASKS if "0" not in m]
    masks += decontaminate.MIDDLE_MASKS if n <= 16 else ()
    for gone in combinations(range(n), n // 4):
        assert any(seen(m, gone, n) for m in masks), gone
    least = max(decontaminate.MIN_WORDS, -(-decontaminate.MIDDLE * 6 // 10))
    assert least > 16  # longer items match by stretches that need no middle masks


@pytest.mark.parametrize("n", [8, 9, 10, 12, 16, 26])
def test_items_of_middle_length_are_found(spark, n):
    """Every item of which a quarter at random is replaced is found: recall is 1."""
    rng = random.Random(n)
    items = [[f"i{k}w{j}" for j in range(n)] for k in range(120)]
    docs = []
    for k, words in enumerate(items):
        gone = rng.sample(range(n), n // 4)
        docs.append((k, f"{text(rng, 15)} {' '.join('other' if j in gone else w for j, w in enumerate(words))} {text(rng, 15)}"))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k in range(120)}


def plain_leaks(doc, item):
    """Whether some laying of the item along the document has a stretch that meets the rule."""
    whole = len(item)
    if whole < decontaminate.MIN_ITEM:
        return bool(item) and doc == item
    for shift in range(1 - whole, len(doc)):
        lo, hi = max(0, -shift), min(whole, len(doc) - shift)
        equal = [item[k] == doc[k + shift] for k in range(lo, hi)]
        for a in range(len(equal)):
            for b in range(a + 1, len(equal) + 1):
                n = b - a
                if n >= min(8, whole) and (n >= 0.6 * whole or n >= 20) and 4 * sum(equal[a:b]) >= 3 * n or n >= 13 and all(equal[a:b]):
                    return True
    return False


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_word_replaced_by_brute_force(spark, monkeypatch, broadcast):
    """At every place of items of every length; nothing is reported that no laying of the item allows."""
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
        monkeypatch.setattr(decontaminate, "TOGETHER", 5)
    rng = random.Random(12)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 20, 30)}
    docs, holds = [], {}
    for n, words in items.items():
        for gone in [None, *range(n)]:
            copy = ["other" if k == gone else w for k, w in enumerate(words)]
            for before, after in ((0, 0), (12, 12)):
                doc = text(rng, before).split() + copy + text(rng, after).split()
                docs.append((len(docs), " ".join(doc)))
                holds[docs[-1][0]] = {m for m, its in items.items() if plain_leaks(doc, its)}
    got = {i: set() for i in holds}
    for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")).collect():
        got[r.doc_id].add(r.item_id)
    assert got == holds and sum(map(len, holds.values())) > 200


def test_random_passages_by_brute_force(spark):
    """Copies with every fifth word at random replaced: whatever is reported is a leak, and few are missed."""
    rng = random.Random(13)
    items = [text(rng, rng.randrange(12, 40)).split() for _ in range(30)]
    docs, found = [], set()
    for i, item in enumerate(items):
        copy = [w if rng.random() < 0.85 else "other" for w in item]
        docs.append((i, " ".join(text(rng, 20).split() + copy + text(rng, 20).split())))
    for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect():
        found.add((r.doc_id, r.item_id))
    want = {(i, j) for i, t in docs for j, item in enumerate(items) if plain_leaks(t.split(), item)}
    assert found <= want and len(found) >= 0.9 * len(want) and len(want) > 20


def test_items_of_equal_text(spark):
    rng = random.Random(14)
    item = text(rng, 25)
    docs = spark.createDataFrame([(1, f"{text(rng, 9)} {item}")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(3, item), (4, item.upper()), (None, item)], "item_id long, text string")).first()
    assert got.item_ids == [3, 4] and got.n_spans == 3


def test_both_ways_agree(tables, monkeypatch):
    docs, items = tables
    narrow = {tuple(r) for r in decontaminate.leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert {tuple(r) for r in decontaminate.leaks(docs, items).collect()} == narrow


def test_both_ways_agree_on_null_and_equal_ids(spark, monkeypatch):
    rng = random.Random(9)
    items = [(None, text(rng, 20)), (None, text(rng, 20)), (3, text(rng, 20)), (3, text(rng, 20))]
    docs = [(None, f"{text(rng, 9)} {items[0][1]}"), (None, items[3][1]), (None, text(rng, 40)), (7, items[1][1]), (7, f"{items[2][1]} {items[1][1]}"), (8, items[2][1]), (8, items[2][1])]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    narrow = sorted(map(repr, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert sorted(map(repr, decontaminate.leaks(docs, items).collect())) == narrow and len(narrow) == 7


def test_empty_tables(tables):
    docs, items = tables
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
