import hashlib

import numpy as np

from servista.llm import common, fingerprint as fp

from . import brute


def plain_signature(text, k, entries, take):
    """Order MinHash by its definition, with the same hash functions."""
    chars = fp.code_points(text)
    if not len(chars):
        return np.zeros(entries, np.uint16)
    h, x = fp._numbered(chars, k)
    out = []
    for e in range(entries):
        y = [(int(v) ^ int(fp._XOR[e])) * int(fp._MUL[e]) % 2**32 for v in x]
        best = sorted(sorted(range(len(y)), key=lambda i: (y[i], i))[:take])
        t = np.zeros(1, np.uint64)
        for i in best:
            t = t * fp._TUPLE + h[i]
        out.append(int(common.mix(t)[0] >> np.uint64(48)))
    return np.array(out, np.uint16)


def test_signature_is_order_minhash(monkeypatch):
    monkeypatch.setattr(fp, "_STEP", 64 * 16)
    for text in ("a", "ab", "abcdef", "abcdefg", "abababababab", "the quick brown fox jumps over the lazy dog", "ñandú " * 9, ""):
        assert (fp.signature(fp.code_points(text)) == plain_signature(text, fp.K, fp.ENTRIES, fp.TAKE)).all()


def test_order_matters():
    a, b = "abcdefghij" * 3 + "klmnopqrst" * 3, "klmnopqrst" * 3 + "abcdefghij" * 3
    s = [fp.signature(fp.code_points(t)) for t in (a, b, a)]
    assert fp.likeness(s[0], s[2]) == 1.0 and fp.likeness(s[0], s[1]) < 0.7


def test_documents(spark):
    rows = sorted(((i, t) for i, t in brute.awkward() if i != 7), key=lambda r: r[0])
    docs = brute.table(spark, rows[::-1])
    many = fp.with_following(docs, shard_bytes=common.input_bytes(docs) // 5)[1]
    assert many > 2
    got = {r.doc_id: r for r in fp.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    sig = {i: fp.signature(fp.code_points(t or "")) for i, t in rows}
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        text = fp.edited(t or "", u or "")
        r = got[i]
        assert r.n_chars == len(t or "") and r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.near_next == fp.likeness(sig[i], sig[j]) and r.near_edited == fp.likeness(sig[i], fp.signature(fp.code_points(text)))
    assert len({got[i].fingerprint for i in range(10, 15)}) == 1


def test_shards_give_the_same_as_one(spark, monkeypatch):
    rows = [(i // 2 * 3, f"text {i} " * (i % 7)) for i in range(60)] + [(None, "n"), (None, "m")]
    docs = brute.table(spark, rows)
    one = sorted(map(tuple, fp.fingerprints(docs).collect()), key=repr)
    whole = fp.with_following
    monkeypatch.setattr(fp, "with_following", lambda d: whole(d, shard_bytes=1))
    assert sorted(map(tuple, fp.fingerprints(docs).collect()), key=repr) == one and len(one) == 62


def test_one_row_and_empty(spark):
    docs = brute.table(spark, [(5, "abcdef")])
    r = fp.fingerprints(docs).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and r[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert fp.fingerprints(docs.limit(0)).count() == 0
