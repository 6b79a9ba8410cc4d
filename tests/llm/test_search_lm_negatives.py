"""Lexical search, the n-gram model and hard negatives against brute force; special rows with defined results."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from sluice.llm import hard_negatives, lexical, ngram_lm, queries
from tests.conftest import rows_of
from tests.llm.test_operators import empty, prose, special

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_hard_negatives"])
def test_sql(spark, sf_dir, duck, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(queries.ORACLE_SQL[name]).df())


# --- 11 lexical search ---


def plain_search(docs, items, k=10):
    terms = [(i, TERM.findall((t or "").translate(CAPITALS))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    df = collections.Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in items:
        found = []
        for i, t in terms:
            tf, m = collections.Counter(t), 25 + 75 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in TERM.findall((text or "").translate(CAPITALS)) if w in tf)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(df, items, **kw):
    return sorted((tuple(r) for r in lexical.search(lexical.build(df, **({"shard_bytes": 300} if "k" in kw else {})), items, **kw).collect()), key=str)


def test_search(spark):
    rnd = random.Random(3)
    docs = [(i, prose(rnd, rnd.randrange(1, 40), 60)) for i in range(150)]
    docs += [(400 + i, "Same text 7 times, Ünïcode x") for i in range(30)] + [(900, None), (901, ""), (902, " .,;! "), (None, "same text here"), (400, "Same text 7 times, Ünïcode x"), (903, "w " * 5000)]
    rnd.shuffle(docs)
    items = [(j, prose(rnd, 12, 60)) for j in range(25)] + [(50, "same SAME text, same"), (51, None), (52, ""), (53, "absent zzz"), (54, "ünïcode X"), (50, "times"), (None, "text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = searched(df, spark.createDataFrame(items, "item_id long, text string"), k=10, block_bytes=600)
    assert got == plain_search(docs, items)
    assert searched(df, spark.createDataFrame(items, "item_id long, text string"), k=3) == plain_search(docs, items, 3)


def test_search_special(spark):
    items = spark.createDataFrame([(1, "a text without word5x", 9), (2, None, 9)], "item_id long, text string, score long")
    own = [(r.doc_id, r.text) for r in special(spark).collect()]
    assert searched(special(spark), items) == plain_search(own, [(1, "a text without word5x")])
    assert searched(empty(spark), items) == [] and searched(special(spark), items.limit(0)) == []


def test_ties_stay_whole():
    acc = np.array([5, 9, 5, 0, 5, 9, 1])
    assert lexical.top(acc, 3, 0).tolist() == [1, 5, 0] and sorted(lexical.top(acc, 10, 0)) == [0, 1, 2, 4, 5, 6]
    assert sorted(lexical.top(acc, 10, 6)) == [1, 5] and len(lexical.top(np.zeros(9, np.int64), 3, 0)) == 0


# --- 12 language model ---


def plain_model(docs, order, priors):
    texts = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(CAPITALS)), None]) for i, t in docs]
    train = [t for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(tuple(t[a : a + k]) for t in train for k in range(1, order + 1) for a in range(len(t) - k + 1))
    n, v = sum(map(len, train)), sum(len(g) == 1 for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 1) / (n + v + 1)
        mu = priors[min(len(gram) - 2, len(priors) - 1)]
        return (count[gram] + mu * p(gram[1:])) / (count[gram[:-1]] + mu)

    out = []
    for i, t in texts:
        base = sum(math.log10((count[(w,)] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, a - order + 1) : a + 1]))) for a in range(len(t)))
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(count[(w,)] > 0 for w in t), n, base, score))
    return out


def close(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6), r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6
        assert abs(a[6] - b[6]) <= 3 * a[2] / ngram_lm.STEPS  # each value is rounded once, at most as many as the order add up


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_model(spark, order):
    rnd = random.Random(order)
    docs = [(i, prose(rnd, rnd.randrange(0, 60), 25) + rnd.choice(["", " End", "\n\n", " é"])) for i in range(120)] + [(500, None), (501, ""), (None, "w w w"), (3, "again again"), (3, "again again"), (777, "never seen before")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    priors = (7.0, 3.0)
    close(ngram_lm.scored(df, order, priors, run_bytes=900, part_keys=500).collect(), plain_model(docs, order, priors))


def test_model_special(spark):
    rows = [(r.doc_id, r.text) for r in special(spark).collect()]
    close(ngram_lm.scored(special(spark)).collect(), plain_model(rows, 3, ngram_lm.PRIORS))
    assert ngram_lm.scored(empty(spark)).count() == 0
    # 2 is the fold of all of these, so nothing is learnt
    held = [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = ngram_lm.scored(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert all(r.held_out and r.train_tokens == r.n_known == r.base_score == r.score == 0 and r.n_tokens == 3 for r in got)


def test_probabilities_sum_to_one():
    rnd = np.random.default_rng(5)
    codes = rnd.integers(0, 12, 300).astype(np.int32)
    words, first = rnd.integers(0, 1 << 63, 15).astype(np.uint64), np.array([0, 100, 300])
    grams = ngram_lm.grams_of(words, codes, first, np.array([True, True]), 3)
    trie = ngram_lm.trie_of(grams, [g.trained for g in grams], 300, 12, (4.0, 2.0))
    for context in ([3], [7, 3], [1, 2]):
        total = 1 / 313  # of a word that has never been seen; the three other codes are such words, too
        for w in range(12):
            text = np.array([*context, w], np.int32)
            own = ngram_lm.grams_of(words, np.append(codes, text), np.array([0, 100, 300, 300 + len(text)]), np.array([True, True, False]), 3)
            costs = trie_costs(trie, own)
            total += 10 ** (-costs[-1] / ngram_lm.STEPS)
        assert abs(total - 1) < 0.02


def trie_costs(trie, grams):
    out = np.empty(max(int(g.tokens.max()) for g in grams) + 1, np.int64)
    for g, cost in zip(grams, trie.costs(grams), strict=True):
        out[g.tokens] = cost[g.at]
    return out


def test_elias_fano(tmp_path):
    rnd = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 1 << 40), (500, 3), (500, 500), (3000, 1 << 20), (3000, 1 << 45), (64, 64)):
        values = np.sort(rnd.integers(0, top, n))
        ef = ngram_lm.EliasFano.of(values)
        if not n:
            continue
        assert (ef.at(np.arange(n)) == values).all()
        x = np.concatenate([values, values + 1, rnd.integers(0, top + 5, 500), [0, top, top * 3 + 70]])
        at, same = ef.successor(x)
        assert (at == np.searchsorted(values, x, "left")).all() and (same == np.isin(x, values)).all()
    # all on one high part, and a gap of many empty buckets
    for values in (np.full(400, 7), np.append(np.arange(300), np.arange(1 << 20, (1 << 20) + 300))):
        ef = ngram_lm.EliasFano.of(values)
        x = np.concatenate([values, values + 1, values - 1, [0]])
        x = x[x >= 0]
        assert (ef.at(np.arange(len(values))) == values).all() and (ef.successor(x)[0] == np.searchsorted(values, x, "left")).all()


def test_trie_in_a_mapped_file(tmp_path):
    rnd = np.random.default_rng(2)
    codes, words, first = rnd.integers(0, 40, 2000).astype(np.int32), rnd.integers(0, 1 << 63, 40).astype(np.uint64), np.array([0, 700, 2000])
    grams = ngram_lm.grams_of(words, codes, first, np.array([True, False]), 4)
    trie = ngram_lm.trie_of(grams, [g.trained for g in grams], 700, 40, (5.0,))
    (tmp_path / "trie").write_bytes(trie.buffer())
    mapped = ngram_lm.Trie.opened(np.memmap(tmp_path / "trie", np.uint8, "r"))
    assert isinstance(mapped.levels[2].value.base, np.memmap) or isinstance(mapped.levels[2].value, np.memmap)
    for a, b in zip(trie.costs(grams), mapped.costs(grams), strict=True):
        assert (a == b).all()
    # a context's words are found by successor, others aren't
    context, word = np.divmod(np.arange(40 * 40), 40)
    seen = {(int(g), int(w)): i for i, (g, w) in enumerate(zip(grams[1].context[grams[1].trained > 0], grams[1].word[grams[1].trained > 0], strict=True))}
    assert trie.child(1, context, word).tolist() == [seen.get((int(c), int(w)), -1) for c, w in zip(context, word, strict=True)]


def test_key_order_does_not_matter(spark):
    docs = [(i, f"one two three word{i % 5} word{i % 3}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a = ngram_lm.scored(df.repartition(7), run_bytes=200, part_keys=100)
    b = ngram_lm.scored(df.coalesce(1))
    assert sorted((r.doc_id, r.score) for r in a.collect()) == sorted((r.doc_id, r.score) for r in b.collect())


# --- 13 hard negatives ---

VECS = "vec_id long, embedding array<double>, label int, score double, slot int"


def plain_mining(rows, scale=256):
    ok = [(i, [math.floor(scale * x) if abs(x) < 1e15 else int(x) * scale for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for a, (i, v, y) in enumerate(ok):
        if i is None or i % 50:
            continue
        scores = sorted((-cut(sum(p * q for p, q in zip(v, w, strict=False))), j is None, j or 0, j, z == y) for b, (j, w, z) in enumerate(ok) if b != a)
        for p, *_, j, _ in [s for s in scores if s[4]][:5]:
            negatives = [s for s in scores if not s[4] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, r, s[3], -p, -s[0]) for r, s in enumerate(negatives, 1)]
    return sorted(out, key=str)


def mined(df, **kw):
    return sorted((tuple(r) for r in hard_negatives.mined(df, **kw).collect()), key=str)


@pytest.mark.parametrize("kind", ["dense", "ties", "huge", "negative"])
def test_mining(spark, kind):
    rnd = np.random.default_rng(len(kind))
    rows = []
    for i in range(400):
        v = rnd.normal(0, 1, 6) + (2 if i % 3 else 0)
        v = {"dense": v, "ties": np.round(v / 2), "huge": v * (1e12 if i % 4 else 1.0), "negative": -np.abs(v) if i % 2 else v}[kind]
        rows.append((int(i), v.tolist(), int(i % 4)))
    rows += [(None, [1.0] * 6, 1), (50, [1.0] * 6, 1), (50, [1.0] * 6, 1), (100, [2.0, 3.0], 2), (150, [], 2), (1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 6, 1), (1150, [1.0] * 6, None), (1200, [float("inf")], 2)]
    df = spark.createDataFrame([(*r, 0.5, 3) for r in rows], VECS).repartition(4)
    assert mined(df, shard_rows=37, block_bytes=1500) == plain_mining(rows)


def test_mining_special(spark):
    assert mined(spark.createDataFrame([], VECS)) == []
    alone = spark.createDataFrame([(50, [1.0], 1, 0.0, 0), (51, [1.0], 2, 0.0, 0)], VECS)
    assert mined(alone) == []  # no positive
    assert mined(spark.createDataFrame([(50, [1.0], 1, 0.0, 0), (57, [1.0], 1, 0.0, 0), (58, [2.0], 2, 0.0, 0)], VECS)) == []  # none in the window
