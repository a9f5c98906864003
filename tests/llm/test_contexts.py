"""Every word has a context restaurant of its own, however rare it is."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from evistrata.llm import common, pitman_yor

END = b" "


def h(w):
    return xxhash.xxh64_intdigest(w)


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(toks, driver, buckets):
    """The model on plain dictionaries with all words as contexts, one bucket after the other, with the same draws."""
    train = [ws for i, ws in sorted(toks.items()) if not held(i)]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    often = sorted({w for w in c if c[w] * driver >= n} | {END}, key=h)
    place, k = {w: i for i, w in enumerate(often)}, len(often) + 1
    wide = {w: i for i, w in enumerate(w for w in often if c[w] * driver >= max(1, n))}
    of = lambda ws: list(zip([END, *ws], ws, strict=False))
    types = Counter((w, u) for ws in train for u, w in of(ws))
    index = lambda u: place.get(u, k + h(u))

    def bucket(w, u):
        if w not in wide:
            return h(w) % buckets
        return ((place[u] + k * wide[w]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % buckets if u in place else h(u) % buckets

    d0, d1 = (pitman_yor.discount(sum(x == 1 for x in y.values()), sum(x == 2 for x in y.values())) for y in (c, types))
    groups = {}
    for w, u in sorted(types, key=lambda t: (h(t[0]), index(t[1]))):
        groups.setdefault(bucket(w, u), []).append((w, u))
    tables, customers = dict.fromkeys(types, 1), Counter()
    for (_, u), x in types.items():
        customers[u] += x
    root = dict.fromkeys(c, 1)

    def sums():
        by_word, by_context = Counter(), Counter()
        for (w, u), x in tables.items():
            by_word[w] += x
            by_context[u] += x
        return by_word, by_context

    def state():
        by_word, by_context = sums()
        weight = (1 + d0 * sum(root.values())) / (v + 1)
        p0 = {w: (by_word[w] - d0 * root.get(w, 0) + weight) / (1 + sum(by_word.values())) for w in [*c, None]}
        return p0, by_context, weight

    after, now = [], state()
    for i in range(pitman_yor.BURN + pitman_yor.SAMPLES):
        p0, by_context, weight = now
        for b, ts in groups.items():
            rng = np.random.default_rng([pitman_yor.SEED, b + 1, i])
            got = pitman_yor._seat(np.array([types[t] for t in ts]), np.array([(1 + d1 * by_context[u]) * p0[w] for w, u in ts]), d1, rng)
            tables.update(zip(ts, got.tolist(), strict=True))
            mine = {}
            for w, u in ts:
                mine[w] = mine.get(w, 0) + tables[w, u]
            seats = pitman_yor._seat(np.array(list(mine.values())), np.full(len(mine), weight), d0, rng)
            root.update({w: x for w, x in zip(mine, seats.tolist(), strict=True) if w not in wide})
        by_word = sums()[0]
        seats = pitman_yor._seat(np.array([by_word[w] for w in wide], dtype=np.int64), np.full(len(wide), weight), d0, np.random.default_rng([pitman_yor.SEED, 0, i + 1]))
        root.update(zip(wide, seats.tolist(), strict=True))
        now = state()
        if i >= pitman_yor.BURN:
            after.append((now, dict(tables)))

    def p(w, u):
        return float(np.mean([((types[w, u] - d1 * t.get((w, u), 0)) + (1 + d1 * m[1][u]) * m[0].get(w, m[0][None])) / (1 + customers[u]) for m, t in after]))

    return {i: sum(math.log10(p(w, u)) for u, w in of(ws)) for i, ws in toks.items()}, p, c


@pytest.mark.parametrize("driver", [1, 12, 60])
def test_all_contexts(spark, driver):
    """Scores against the model on plain dictionaries where most contexts are too rare for the driver."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(70)]
    texts += ["w1 w2 " * 150, "rare words rare words rare words", "", None, "only here", "w50 w51 w52 w50 w51 w52"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    toks = {i: [*(t or "").encode().split(), END] for i, t in enumerate(texts)}
    want, p, c = brute(toks, driver, common.partitions(spark))
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(docs, driver=driver).collect()}
    assert len(got) == len(want) and all(math.isclose(got[i], x, rel_tol=1e-6, abs_tol=1e-5) for i, x in want.items())
    for u in (END, b"w0", b"w50", b"rare", b"never seen"):
        assert math.isclose(sum(p(w, u) for w in [*c, b"unknown"]), 1, rel_tol=1e-9)


def test_rare_contexts_foretell(spark):
    """What follows a word of two in 90,000 tokens is learnt: once all contexts this rare shared one restaurant."""
    rng = random.Random(7)
    train, out = ([i for i in range(3000) if held(i) == x] for x in (False, True))
    rows = [(i, " ".join(rng.choices([f"c{k}" for k in range(50)], k=40))) for i in train[:2200]]
    rows += [(i, " ".join(f"k{r} v{r} c0" for r in range(j % 2 * 200, j % 2 * 200 + 200))) for j, i in enumerate(train[2200:2204])]
    rows += [(out[0], "k7 v7"), (out[1], "k7 v8"), (out[2], "k300 v300"), (out[3], "k300 v7")]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[out[0]] - got[out[1]] > 1 and got[out[2]] - got[out[3]] > 1
