import hashlib
import random
import re

import numpy as np
import pytest

from servista.llm import common, fill_middle as fim

from . import brute

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_version(doc_id, text):
    """The contract, character by character."""
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd(seed, count):
    """Texts of pieces that the automaton must tell apart."""
    rng = random.Random(seed)
    pieces = ["<", ">", "P", "S", "M", "<P", "S>", "<<P", "<Px>", "word", "é", "日本", "🙂", "́", " ", "\n", "\0", "Zz", "߿", "￿"]
    return [(1000 + i, "".join(rng.choice(pieces) for _ in range(rng.choice([1, 3, 30, 300, 1500])))) for i in range(count)]


SPECIAL = [(2000, "<P>"), (2001, "a<S>b"), (2002, "x" * 254 + "<M>"), (2003, "x" * 255 + "<M>" + "y" * 300), (2004, "<<P>>"), (2005, "x" * 253 + "é日🙂" * 200), (-5, "negative id"), (None, "no id"), (None, None), (7, "same id"), (7, "same id"), (7, "<" * 700)]


def rows_of(df):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    rows = brute.awkward() + odd(1, 150) + SPECIAL
    got = rows_of(fim.transform(brute.table(spark, rows)))
    assert got == sorted(((i, *plain_version(i, t)) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_digest_rebuilds_every_text(spark):
    rows = brute.awkward(3) + odd(2, 80) + SPECIAL
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digest(brute.table(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, sha(plain_version(i, t)[4]), sha(t or "")) for i, t in rows), key=repr)


@pytest.mark.parametrize("stretch, side", [(5, 3), (64, 1), (1024, 4096)])
def test_stretches_change_nothing(monkeypatch, stretch, side):
    monkeypatch.setattr(fim, "STRETCH", stretch)
    monkeypatch.setattr(fim, "SIDE", side)
    texts = [t for _, t in odd(4, 60)] + ["", "a", "<M>"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    seen = fim.Scan(data, offs)
    units = [UNITS.findall(t) for t in texts]
    assert seen.of_texts(seen.units).tolist() == [len(u) for u in units]
    assert seen.of_texts(seen.chars).tolist() == [len(t) for t in texts]
    assert (seen.of_texts(seen.found) > 0).tolist() == [any(s in t for s in ("<P>", "<S>", "<M>")) for t in texts]
    cuts = [(i, k) for i, u in enumerate(units) for k in {0, len(u) // 3, len(u)}]
    place, chars = seen.locate(np.array([i for i, _ in cuts]), np.array([k for _, k in cuts]))
    assert chars.tolist() == [len("".join(units[i][:k])) for i, k in cuts]
    assert place.tolist() == [len("".join(units[i][:k]).encode()) for i, k in cuts]


def test_other_sentinels():
    to, emit, back = fim.automaton(["aab", "ab"])
    for text in ("aab", "xab", "aaab", "ba", "aaba"):
        state, found = 0, []
        for i, byte in enumerate(text.encode()):
            code = state * 256 + byte
            if emit[code] & fim.SENTINEL:
                found.append(i)
            state = to[code]
        assert found == [i for i in range(len(text)) if text[: i + 1].endswith("ab")], text
    assert back == 3


def test_empty_table(spark):
    empty = brute.table(spark, []).limit(0)
    assert fim.digest(empty).count() == 0 and fim.transform(empty).columns == [f.split()[0] for f in fim.FIELDS.split(", ")]


def test_one_text_longer_than_a_step(spark, monkeypatch):
    monkeypatch.setattr(common, "STEP_BYTES", 1000)
    rows = [(1, "long é " * 9000), (2, "b"), (3, None)]
    assert rows_of(fim.transform(brute.table(spark, rows))) == sorted(((i, *plain_version(i, t)) for i, t in rows), key=repr)
