import hashlib
import random
import zlib

import numpy as np
import pytest

from servista.llm import common, periodic

from . import brute


def runs_of(words, least=12):
    """All runs by their definition: (start, length, period)."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)  # the smallest period comes first
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_version(doc_id, text):
    words = brute.WORD.findall(text or "")
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *digests)


def strings(seed, count, most=120):
    """Sequences in which runs nest, touch and overlap."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        w = []
        while len(w) < rng.randrange(1, most):
            part = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            w += part * rng.choice([1, 1, 2, 3, 7]) + part[: rng.randrange(len(part))]
        out.append(w)
    return out


def symbols(sequences):
    at = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    every = [(i, w) for i, s in enumerate(sequences) for w in s]
    number = {x: k for k, x in enumerate(sorted(set(every)))}
    return np.array([number[x] for x in every], np.int32), at


@pytest.mark.parametrize("pairs", [1 << 19, 8])
def test_runs_equal_the_definition(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    sequences = [*strings(1, 60 if pairs > 8 else 12), [], ["a"], ["a"] * 11, ["a"] * 12, ["a", "b"] * 30, list("abcabc" * 40 + "abd" * 9)]
    got = periodic.find(*symbols(sequences))
    assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, s in enumerate(sequences) for r in runs_of(s)]


def test_extensions_equal_comparison():
    rng = random.Random(3)
    for n in (1, 2, 17, 200, 600):
        s = np.array([rng.randrange(3) for _ in range(n)], np.int32)
        s[n // 3 : n // 3 * 2] = 1
        index = periodic.Index(s)
        i, j = np.array([(rng.randrange(n), rng.randrange(-1, n + 2)) for _ in range(500)]).T
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            k = 0
            while 0 <= b and max(a, b) + k < n and s[a + k] == s[b + k]:
                k += 1
            want.append(k)
        assert index.lce(i, j).tolist() == want


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents_equal_brute_force(spark):
    rows = [r for r in brute.awkward() if r[0] != 7] + [(1000 + i, "  ".join(w)) for i, w in enumerate(strings(5, 120))]
    rows += [(3000 + i, brute.prose(random.Random(i), 150, 60)) for i in range(60)]  # every tenth gets a run
    rows += [(None, "a b c " * 9), (None, None), (5, "x " * 30), (5, "x " * 30), (-7, "ä ß\tä ß\nä ß ä ß ä ß ä ß ä ß"), (2, "end\n" * 12)]
    got = rows_of(periodic.digest(brute.table(spark, rows)))
    assert got == sorted((plain_version(i, t) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 60


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(common, "STEP_BYTES", 3000)
    rng = random.Random(8)
    phrase = brute.prose(rng, 3000, 4000)
    text = " ".join([brute.prose(rng, 5000, 4000), phrase, phrase, phrase, brute.prose(rng, 20_000, 4000), "go " * 40])
    row = next(iter(periodic.repeats(brute.table(spark, [(1, text), (2, "after it")]).filter("doc_id = 1")).collect()))
    assert [(r.start, r.length, r.period) for r in row.runs if r.length > 30] == [(5000, 9000, 3000), (34_000, 40, 1)]
    assert len(row.collapsed.split()) == row.n_words - 6000 - 39


def test_repeats_leaves_texts_alone(spark):
    rows = [(i, "one two three four") for i in range(200)]
    assert {(r.n_words, tuple(r.runs), r.collapsed) for r in periodic.repeats(brute.table(spark, rows)).collect()} == {(4, (), "one two three four")}


def test_empty_table(spark):
    empty = brute.table(spark, []).limit(0)
    assert periodic.digest(empty).count() == 0
