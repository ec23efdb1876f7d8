import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from servista.llm import hpylm, langid

from . import brute

D, S = hpylm.DISCOUNT, hpylm.STRENGTH


def test_counts_and_base_score(spark):
    rows = [*brute.awkward(), (3, "one"), (200, "unseen words only zzz")]
    out = hpylm.score(brute.table(spark, rows).withColumn("held_out", F.lit("clash")).withColumn("score", F.lit("clash")), langid.held_out(10, 0)).collect()
    assert len(out) == len(rows)
    tokens = [(i, zlib.crc32(str(i).encode()) % 10 == 0, [*brute.words(t), "\0"]) for i, t in rows]
    c = collections.Counter(w for _, h, ws in tokens if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, h, len(ws), sum(c[w] > 0 for w in ws), n) for i, h, ws in tokens)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out) == want
    base = {i: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for i, _, ws in tokens}
    assert all(r.base_score == pytest.approx(base[r.doc_id]) for r in out)
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in out)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in out)


def buckets(spark, rows, how):
    docs = brute.table(spark, rows).withColumn("held_out", F.lit(False))
    table = hpylm.tabulate(hpylm.gather(hpylm.deal(docs), how), how).cache()
    totals, told = hpylm.train(table, how)
    own = [r.asDict() for r in table.drop("asked").collect()]
    heard = told.toArrow()
    out = []
    for r in own:
        number = r.pop("bucket")
        b = hpylm._bucket(**r, how=how)
        inbox = heard.filter(np.array(heard["bucket"]) == number) if heard.num_rows else heard
        got, states = hpylm._inbox(inbox, 3, b, how)
        b.customers = got[0][0]
        b.restore(states[-3:])
        out.append((b, got))
    return out, totals


@pytest.mark.parametrize("how", [hpylm.Deal(1, {}), hpylm.Deal(3, {int(hpylm.END): 2})])
def test_probabilities_sum_to_one(spark, how):
    rows = [(i, "a b c a b d e" if i % 2 else f"a a f g b x{i}") for i in range(40)]
    found, totals = buckets(spark, rows, how)
    parent, cells, groups, c_u = {}, {}, {}, {}
    total, last = totals[2][-1], None
    for b, got in found:
        assert (b.t >= 1).all() and (b.t <= b.c).all() and (b.t2 <= b.c2()).all() and (b.t3 <= b.c3()).all()
        root, p = b.root(total), b.predictive(total, got[2][-1])
        for k in range(len(b.c)):
            g = b.of[k]
            w, u = int(b.words[b.word_of[g]]), int(b.contexts[b.nth[k]])
            parent[w] = root[b.word_of[g]]
            groups[int(b.cell_group[g]), w] = b.c2()[g] - D[1] * b.t2[g]
            cells[u, w] = (b.c[k] - D[2] * b.t[k], p[k])
            c_u[u] = (int(got[0][0][b.nth[k]]), int(got[2][-1][b.nth[k]]))
    assert totals[0][0].v == len(parent) and totals[0][0].n == sum(len(t.split()) + 1 for _, t in rows)
    unknown = (S[0] + D[0] * total.t3) / (total.v + 1) / (S[0] + total.c3)
    assert sum(parent.values()) + unknown == pytest.approx(1.0)
    for u, (c, t) in c_u.items():
        g = u >> 32
        above = {w: (groups.get((g, w), 0) + (S[1] + D[1] * total.t2[g]) * p) / (S[1] + total.c2[g]) for w, p in [*parent.items(), (None, unknown)]}
        assert sum(above.values()) == pytest.approx(1.0)
        own = {w: (cells.get((u, w), (0, 0))[0] + (S[2] + D[2] * t) * p) / (S[2] + c) for w, p in above.items()}
        assert sum(own.values()) == pytest.approx(1.0)
        assert all(own[w] == pytest.approx(p) for (x, w), (_, p) in cells.items() if x == u)


def one_by_one(rng, customers, others, strength, d, x, n, y=1):
    t = 1
    for j in range(1, customers):
        w = (strength + d * (others + t)) * (x + y * t) / (n + y * t)
        t += rng.random() < w / (w + j - d * t)
    return t


@pytest.mark.parametrize("customers,others,x,n", [(3, 1, 0.7, 1.5), (40, 0, 2.0, 30.0), (2000, 0, 500.0, 1000.0), (3000, 900, 4.0, 9000.0)])
def test_seating_is_customer_by_customer(customers, others, x, n):
    """Also where a cell's own tables are most of its restaurant's, and in runs of many customers."""
    rng, draw = random.Random(1), np.random.default_rng(1)
    want = [one_by_one(rng, customers, others, 1.0, 0.5, x, n) for _ in range(150)]
    many = 1500
    got = hpylm.seat(np.full(many, customers), np.full(many, 1.0 + 0.5 * others), 0.5, (x, 1, n), draw)
    error = 4 * np.std(want) / math.sqrt(len(want)) + 0.01 * np.mean(want)
    assert abs(got.mean() - np.mean(want)) < error and got.std() == pytest.approx(np.std(want), rel=0.25, abs=0.1)
    assert hpylm.seat(np.array([0, 1, 10**6]), np.ones(3), 0.5, (1.0, 0, 2.0), draw).tolist()[:2] == [0, 1]


def plain_model(texts, sweeps, burn, rng):
    """log10 probability of each text under a three-level model seated customer by customer in one memory."""
    level = lambda v: v if v is None else "\0" + v[-2:].rjust(2, "\1")
    tokens = [[(p, level(p), w) for p, w in zip([None, *ws], [*ws, "\0"], strict=True)] for ws in map(str.split, texts)]
    c = collections.Counter((u, w) for ts in tokens for u, _, w in ts)
    group = {u: g for ts in tokens for u, g, _ in ts}
    t, v = dict.fromkeys(c, 1), len({w for _, w in c})
    t2, t3 = {(group[u], w): 1 for u, w in c}, {w: 1 for _, w in c}
    sums = lambda d, k: collections.Counter({x: sum(n for key, n in d.items() if k(key) == x) for x in {k(key) for key in d}})
    total = np.zeros(len(texts))
    token_p = [[0.0] * len(ts) for ts in tokens]
    for k in range(sweeps):
        for cell in c:
            u, w = cell
            g = group[u]
            del_t = t.pop(cell)
            c2 = sum(n for (a, b), n in t.items() if b == w and group[a] == g)
            c2_all = sum(n for (a, _), n in t.items() if group[a] == g)
            t2_all = sum(n for (a, _), n in t2.items() if a == g)
            c3, c3_all, t3_all = sum(n for (_, b), n in t2.items() if b == w), sum(t2.values()), sum(t3.values())
            root = (c3 - D[0] * t3[w] + (S[0] + D[0] * t3_all) / (v + 1)) / (S[0] + c3_all)
            x = c2 - D[1] * min(t2[g, w], c2) + (S[1] + D[1] * t2_all) * root
            t[cell] = one_by_one(rng, c[cell], sum(n for (a, _), n in t.items() if a == u), S[2], D[2], x, S[1] + c2_all)
            assert del_t >= 1
        for g, w in list(t2):
            del t2[g, w]
            rest, c3_all, t3_all = sum(n for (_, b), n in t2.items() if b == w), sum(t2.values()), sum(t3.values())
            x = rest - D[0] * min(t3[w], rest) + (S[0] + D[0] * t3_all) / (v + 1)
            own = sum(n for (a, b), n in t.items() if b == w and group[a] == g)
            t2[g, w] = one_by_one(rng, own, sum(n for (a, _), n in t2.items() if a == g), S[1], D[1], x, S[0] + c3_all)
        for w in list(t3):
            del t3[w]
            t3[w] = one_by_one(rng, sum(n for (_, b), n in t2.items() if b == w), sum(t3.values()), S[0], D[0], 1.0, v + 1, 0)
        if k >= burn:
            c_u, t_u = sums(c, lambda x: x[0]), sums(t, lambda x: x[0])
            c2 = collections.Counter()
            for (u, w), n in t.items():
                c2[group[u], w] += n
            c2_g, t2_g, c3 = sums(c2, lambda x: x[0]), sums(t2, lambda x: x[0]), sums(t2, lambda x: x[1])
            for i, ts in enumerate(tokens):
                for j, (u, g, w) in enumerate(ts):
                    p = (c3[w] - D[0] * t3[w] + (S[0] + D[0] * sum(t3.values())) / (v + 1)) / (S[0] + sum(t2.values()))
                    p = (c2[g, w] - D[1] * t2[g, w] + (S[1] + D[1] * t2_g[g]) * p) / (S[1] + c2_g[g])
                    token_p[i][j] += (c[u, w] - D[2] * t[u, w] + (S[2] + D[2] * t_u[u]) * p) / (S[2] + c_u[u]) / (sweeps - burn)
    for i, ps in enumerate(token_p):
        total[i] = sum(map(math.log10, ps))
    return total, np.mean([t[x] for x in t])


def test_scores_of_a_plain_sampler(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["the", "of", "cat", "hat", "mat", "sat", "on", "an", "ran", "dog"]
    texts = [" ".join(rng.choices(vocabulary, [9, 7, 5, 4, 3, 3, 2, 2, 1, 1], k=rng.randrange(4, 12))) for _ in range(30)]
    want = np.mean([plain_model(texts, 12, 4, random.Random(k))[0] for k in range(3)], axis=0)
    monkeypatch.setattr(hpylm, "BUCKET_BYTES", 100)
    for spread in (2, 0.2):  # by word alone, and with frequent words dealt on
        monkeypatch.setattr(hpylm, "SPREAD", spread)
        out = sorted(hpylm.score(brute.table(spark, list(enumerate(texts))), F.lit(False)).collect())
        got, n = np.array([r.score for r in out]), np.array([r.n_tokens for r in out])
        assert np.abs((got - want) / n).max() < 0.05 and abs((got - want).sum() / n.sum()) < 0.015


def test_words_dealt_on(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["hot", "hot", "hot", f"w{rng.randrange(50)}"]) for _ in range(30))) for i in range(60)]
    docs = brute.table(spark, rows)
    want = {r.doc_id: r for r in hpylm.score(docs, langid.held_out(10, 0)).collect()}
    monkeypatch.setattr(hpylm, "BUCKET_BYTES", 500)
    monkeypatch.setattr(hpylm, "SPREAD", 0.5)
    how = hpylm.plan(hpylm.deal(docs.withColumn("held_out", F.lit(False))))
    assert len(how.words) >= 1 and how.parts.max() > 1
    for r in hpylm.score(docs, langid.held_out(10, 0)).collect():
        assert r[:6] == want[r.doc_id][:6] and r.score == pytest.approx(want[r.doc_id].score, rel=0.05)


def test_texts_seen_twice_are_told_apart(spark):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(60))
    rows = [(i, text()) for i in range(400)]
    out_ids = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    copies = out_ids[::2]
    spare = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10]
    rows += [(j, rows[i][1]) for i, j in zip(copies, spare, strict=False)]
    out = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in hpylm.score(brute.table(spark, rows), langid.held_out(10, 0)).collect()}
    alone = sorted(out[i] for i in out_ids if i not in copies)
    assert sum(out[i] > alone[int(0.9 * len(alone))] for i in copies) >= 0.9 * len(copies)


def test_long_text_beside_short_ones(spark):
    rng = random.Random(9)
    rows = [(1, " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000))), (2, "w1 w2"), (3, None)]
    out = {r.doc_id: r for r in hpylm.score(brute.table(spark, rows), F.lit(False)).collect()}
    assert out[1].n_tokens == 60_001 and out[3].n_tokens == 1 and all(r.score > r.base_score for r in out.values())


def test_no_training_and_empty(spark):
    docs = brute.table(spark, [(1, "a b"), (2, None)])
    out = hpylm.score(docs, F.lit(True)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in out} == {(1, 3, 0, 0), (2, 1, 0, 0)} and all(math.isfinite(r.score) for r in out)
    assert hpylm.score(docs.limit(0), F.lit(False)).count() == 0
