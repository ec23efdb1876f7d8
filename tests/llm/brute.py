"""Plain versions of the operators, for small tables, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(_LOWER))


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(sets, percent=80):
    """Smallest key reachable over links of similar sets, for {key: set}."""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in keys}


def removed(texts, depth):
    """For each text: kept bytes, removed bytes and removed runs."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - depth + 1):
            seen[b[i : i + depth]] = seen.get(b[i : i + depth], 0) + 1
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):03d}" for _ in range(n))


def awkward(seed=1):
    """(doc_id, text): null, empty, wordless, one word, very long, exact and near copies, repeated rows, clashing ids left out."""
    rng = random.Random(seed)
    base = prose(rng, 120, 5000)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "two words"), (6, "zwei Wörter"), (7, prose(rng, 40_000, 50_000))]
    rows += [(10 + i, base) for i in range(5)]
    for i in range(30):
        w = base.split()
        for _ in range(i // 3):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((20 + i, " ".join(w)))
    rows += [(60 + i, prose(rng, 60, 5000)) for i in range(20)]
    passage = prose(rng, 60, 5000)
    rows += [(90 + i, f"{prose(rng, 20, 5000)} {passage} {prose(rng, 20, 5000)}") for i in range(6)]
    rows += [(100, "ab" * 400), (101, "line of text\n" * 50), (102, "é" * 300), (103, "日本語 " * 100)]
    return rows


SCHEMA = "doc_id long, text string, lang string, n long, node string, row string"


def table(spark, rows):
    """The rows as documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, k, "x", None) for k, (i, t) in enumerate(rows)], SCHEMA)
