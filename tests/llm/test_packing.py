import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from servista.llm import packing
from servista.llm.tokens import tokenizer_path

from . import brute

PATH = tokenizer_path("word_bpe_49k.json")


def best_fit(lengths, size):
    """Sequences that plain best-fit decreasing makes."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else size) - n)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 50, 4096])
    lengths = [min(size, 1 + int(rng.expovariate(1 / rng.choice([3, size / 4, size])))) for _ in range(300)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    places = {}
    for n, a, b, first, each, base in packing.plan(counts, size):
        for i in range(a, b):
            places.setdefault(first + (i - a) // each, []).append((base + (i - a) % each * n, n))
    assert sorted(n for p in places.values() for _, n in p) == sorted(lengths)
    for p in places.values():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at <= size
    assert len(places) == best_fit(lengths, size)


def test_documents(spark):
    rows = [*brute.awkward(), (3, "one"), (None, "no id"), (3, "another text of the same id")]
    size = 64
    got = packing.pack(spark, brute.table(spark, rows), PATH, end_id=1, size=size).collect()
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k // size, k, len(ids[k : k + size]), zlib.crc32(ids[k : k + size].tobytes())) for k in range(0, len(ids), size)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in by.values():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at <= size
    assert len(by) == best_fit([w[3] for w in want], size)


def test_empty(spark):
    assert packing.pack(spark, brute.table(spark, []).limit(0), PATH).count() == 0
