"""Operators of the package against brute force, libraries and round trips; special rows with defined results."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import bagminhash, bpe, common, decontaminate, fmindex, maxscore, quality, secret_scan, token_count, toxicity, warc, wordhash
from tests.conftest import rows_of

DOCS = "doc_id long, text string, score double, node long, key binary, words array<string>, h long, n int"


LETTERS = str.maketrans("0123456789", "abcdefghij")


def special(spark):
    """Null and empty texts, a null id, repeated rows, a long text, columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 997}x" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (None, "a text without an id"), (4, "same row " * 20), (4, "same row " * 20), (5, long), (6, long), (7, "naïve café ☕ 中文 " * 3)]
    return spark.createDataFrame([(i, t, 0.5, 9, b"k", ["w"], 1, 2) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rnd, n, words=3000):
    return " ".join("w" + str(rnd.randrange(words)).translate(LETTERS) for _ in range(n))


def brute_classes(rows, threshold=0.8):
    items = []
    for i, t in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        items.append((i, collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None))
    up = {i: i for i, _ in items}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, (i, c) in enumerate(items):
        for j, e in items[:k]:
            if c and e and (both := sum((c & e).values())) / (sum(c.values()) + sum(e.values()) - both) >= threshold:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in items}


# --- 1 secrets ---


def plain_scan(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, sf_dir):
    rnd = random.Random(1)
    parts = ["token = 'abc", "secret=token:abcdefgh", "Password: hunter22", "api_key=\"" + "f" * 30 + '"', "AKIA" + "Q" * 16, "AKIAQQ", "0123456789abcdef" * 2, "é ", "tokenize", "PASSWD=", "=", ": ", "x" * 30]
    texts = ["".join(rnd.choice(parts) for _ in range(12)) for _ in range(300)]
    detector = secret_scan.trained(secret_scan.samples([], 1500))
    assert [secret_scan.base_spans(t) for t in texts] == [plain_scan(t) for t in texts]
    fresh = secret_scan.samples([], 400, seed=99)
    assert all(detector.ratio(s) > detector.threshold for s, y in fresh if y)
    assert sum(detector.ratio(s) > detector.threshold for s, y in fresh if not y and len(s) >= 20) <= 4
    hidden = "see Zk3vQ9xT7pLm2RbYw8NcJd5H here"
    df = spark.createDataFrame([(1, texts[0]), (2, hidden), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.found(df, detector).collect()}
    assert got[2].spans == "markov:4:28" and got[2].n_hex == 0
    assert got[1].base_sha256 == hashlib.sha256(secret_scan.spelled(plain_scan(texts[0])).encode()).hexdigest()
    assert got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.redacted(df, detector).where("doc_id = 2").first().text == "see [SECRET] here"
    assert secret_scan.found(special(spark), detector).count() == 9 and secret_scan.found(empty(spark), detector).count() == 0
    assert secret_scan.redacted(special(spark), detector).schema == special(spark).schema
    secret_scan.fit(empty(spark))


def test_markov_spans_by_hand(spark):
    rows = secret_scan.samples(["house", "garden"], 300)
    detector, rnd = secret_scan.trained(rows), random.Random(21)
    n = len(secret_scan.ALPHABET)

    def chances(texts):
        first, step = collections.Counter(t[0] for t in texts), collections.Counter(p for t in texts for p in zip(t, t[1:], strict=False))
        before = collections.Counter(a for t in texts for a in t[:-1])
        return lambda s: (np.log((first[s[0]] + 0.5) / (len(texts) + 0.5 * n)) + sum(np.log((step[p] + 0.5) / (before[p[0]] + 0.5 * n)) for p in zip(s, s[1:], strict=False))) / len(s)

    random_of, ordinary_of = chances([s for s, y in rows if y]), chances([s for s, y in rows if not y])
    tokens = [s for s, _ in secret_scan.samples([], 40, seed=8)] + ["short", "secret=abcdefgh", "0123456789abcdef" * 2, "AKIA" + "Z" * 20, "é" * 30]
    texts = ["", *[" ".join(rnd.choice(tokens) + rnd.choice(["", "==", ".", "é"]) for _ in range(8)) for _ in range(60)]]
    got = {r.doc_id: r.spans for r in secret_scan.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), detector).collect()}
    hits = 0
    for i, t in enumerate(texts):
        base, more = plain_scan(t), []
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", t):
            if all(b <= m.start() or m.end() <= a for a, _, b in base) and random_of(m[0]) - ordinary_of(m[0]) > detector.threshold:
                more.append((m.start(), 3, m.end()))
        hits += len(more)
        assert got[i] == secret_scan.spelled(sorted(base + more))
    assert hits > 50


# --- 2, 5 classifiers ---


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def labelled(spark, n, mark, share):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        y = int(rnd.random() < share)
        w = prose(rnd, 60, 400).split()
        if y:
            w[rnd.randrange(60)] = rnd.choice(mark)
        rows.append((i, " ".join(w), "en"))
        labels.append((i, y))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, label int")


@pytest.mark.parametrize(("module", "name"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, name):
    docs, labels = labelled(spark, 900, ["nasty", "vile"] if module is toxicity else ["fine", "good"], 0.3)
    model = module.fit(docs, labels.withColumnRenamed("label", name))
    got = module.scored(docs, model).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and auc(held.score.to_numpy(), held.label.to_numpy()) > (0.95 if module is toxicity else 0.75)
    assert got.score.between(0, 1).all()
    shuffled = module.scored(docs.repartition(7), model).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(shuffled, got.sort_values("doc_id").score.to_numpy())
    assert module.scored(special(spark), model).count() == 9 and module.scored(empty(spark), model).count() == 0
    blank = module.fit(empty(spark), labels.withColumnRenamed("label", name).limit(0))
    assert module.scored(special(spark), blank).where("score between 0 and 1").count() == 9


def test_identifier_words_come_from_whole_texts(spark, monkeypatch):
    seen, samples = [], secret_scan.samples
    monkeypatch.setattr(secret_scan, "samples", lambda words, n: seen.extend(words) or samples(words, n))
    secret_scan.fit(spark.createDataFrame([(1, "near " * 500 + "farther")], "doc_id long, text string"), n=50)
    assert seen == ["farther", "near"]


# --- 3 decontamination ---


def test_decontamination(spark):
    rnd = random.Random(3)
    items = [(i, f"Anna has {12 + i} apples and gives {3 + i} of them to Ben who then " + prose(rnd, 25, 500) + f" so that Anna keeps {9} kg in total") for i in range(20)]
    other = prose(rnd, 300, 500)
    text = dict(items)
    same = re.sub("Anna", "Maria", re.sub("Ben", "Luis", text[5])).replace("17", "40").replace(" 8 ", " 21 ")
    mixed = text[6].replace("Anna has", "Zoe has")  # one Anna became Zoe, the other did not
    docs = [(1, other), (2, other + " " + text[3] + " " + other), (3, other + " " + same), (4, ""), (5, None), (6, " ".join(text[7].split()[:6])), (7, other + " " + mixed), (2, other + " " + text[3] + " " + other)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, "too short"), (98, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.flagged(df, bench).collect()}
    assert set(got) >= {(2, 3), (3, 5)} and {d for d, _ in got} <= {2, 3, 7}
    assert got[2, 3].n_changed == 0 and got[3, 5].n_changed > 0
    by_join = {(r.doc_id, r.item_id) for r in decontaminate.flagged(df, bench, broadcast_rows=0).collect()}
    assert by_join == set(got)
    assert sorted(r.doc_id for r in decontaminate.kept(df, bench).collect())[:2] == [1, 4]
    assert decontaminate.flagged(special(spark), bench).count() == 0 and decontaminate.flagged(empty(spark), bench).count() == 0
    assert decontaminate.kept(special(spark), bench.limit(0)).count() == 9


def test_decontamination_finds_passages_at_any_alignment(spark):
    rnd = random.Random(8)
    words = {1: 8, 2: 9, 3: 10, 4: 5, 5: 40}
    items = {i: prose(rnd, n, 10**6) for i, n in words.items()}
    said = {i: t if i < 5 else " ".join(t.split()[:17]) for i, t in items.items()}  # of the last item only a part
    docs = [(10 * i + shift, f"{prose(rnd, 20 + shift, 10**6)} {said[i]} {prose(rnd, 30, 10**6)}") for i in items for shift in range(4)]
    df, bench = spark.createDataFrame([*docs, (99, prose(rnd, 50, 10**6))], "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {(i, i // 10) for i, _ in docs}
    for rows in (200_000, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.flagged(df, bench, broadcast_rows=rows).collect()} == want
    assert [r.doc_id for r in decontaminate.kept(df, bench).collect()] == [99]


def test_decontamination_in_capitals_names_and_numbers(spark):
    rnd = random.Random(9)
    items = {1: prose(rnd, 30, 10**6), 2: prose(rnd, 12, 10**6), 3: "Berlin Paris Rome Oslo Bern Riga Kyiv Baku Lima Doha", 4: "31 41 59 26 53 58 97 93 23 84 62", 5: "7 kg of Zinc", 6: f"It weighs 12 kg when {prose(rnd, 9, 10**6)}"}
    said = {1: items[1].upper(), 2: items[2].title(), 3: items[3], 4: items[4], 5: items[5], 6: items[6].upper().replace("12 KG", "40 LB")}
    rows = [(i, f"{prose(rnd, 21, 10**6)}. {t}. {prose(rnd, 30, 10**6)}") for i, t in said.items()] + [(7, "8 kg of Zinc"), (8, "31 41 59 27 53 58 98 93 23 85 62"), (9, prose(rnd, 40, 10**6).upper())]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    for n in (200_000, 0):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.flagged(df, bench, broadcast_rows=n).collect()}
        assert set(got) == {(i, i) for i in items}
        assert got[1, 1].n_covered == got[1, 1].n_tokens == 30 and got[6, 6].n_changed == 2
    assert sorted(r.doc_id for r in decontaminate.kept(df, bench).collect()) == [7, 8, 9]


# --- 4 search ---


def test_maxscore(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (450, 16))
    x[100:200] = x[0]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 16), (1002, [None] * 16), (300, [0.5] * 16), (1100, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in maxscore.top_k(df, 10, 100, shard_rows=64, block_rows=3).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    valid = [(i, np.floor(1024 * np.pad(np.array(v, float), (0, 16 - len(v)))).astype(int)) for i, v in rows if i not in (1000, 1001, 1002)]
    for q in (0, 100, 200, 400, 1100):
        own = next(v for i, v in valid if i == q)
        best = sorted(((-int(own @ v), i) for i, v in valid if i != q))[:10]
        assert [(s, i) for _, i, s in sorted(got[q])] == [(-s, i) for s, i in best]
    assert len(got[300]) == 20  # two rows of this id, each a query
    assert maxscore.top_k(df.limit(0)).count() == 0


def best_products(rows, every=10, k=5):
    valid = [(i, None if j is None else int(j), [int(np.floor(1024 * x)) if abs(x) < 2**40 else int(x) * 1024 for x in v]) for i, (j, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q, a in valid:
        if q is not None and q % every == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), j) for n, j, b in valid if n != i]
            out += [(q, s) for s, _ in sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]]
    return sorted(out)


@pytest.mark.parametrize("kind", ["sparse", "clustered", "huge"])
def test_maxscore_of_other_vectors(spark, kind):
    rng = np.random.default_rng(5)
    n, width = 400, 40
    x = rng.normal(0, 0.3, (n, width))
    if kind == "sparse":
        x *= rng.random((n, width)) < np.where(np.arange(width) < 30, 0.05, 0.6)
    elif kind == "clustered":
        x = x[rng.integers(0, 12, n)] + rng.normal(0, 0.01, (n, width))
    else:
        x[::7] *= 10.0 ** rng.integers(0, 30, (len(x[::7]), 1))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(None, rows[3][1]), (None, rows[10][1]), (410, []), (420, None), (20, rows[20][1]), (430, [0.0] * width)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("row", F.lit("clash"))
    got = maxscore.top_k(df, 5, 10, shard_rows=37, block_rows=16).collect()
    assert sorted((r.query_id, r.score) for r in got) == best_products(rows)
    for q in {r.query_id for r in got} - {20}:
        assert sorted(r["rank"] for r in got if r.query_id == q) == [1, 2, 3, 4, 5]
    assert kind == "huge" or any(r.vec_id is None for r in got)


# --- 6 near duplicates ---


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(0), []
    for _ in range(30):
        h = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        a, b = rng.integers(1, 6, 200), rng.integers(1, 12, 200)
        order = np.argsort(h)
        s = bagminhash.signatures(np.concatenate([h, h]), np.repeat([0, 1], 200), np.concatenate([a, b]), 2, 256)
        errors.append((s[0] == s[1]).mean() - bagminhash.overlap((h[order], a[order]), (h[order], b[order])))
    assert abs(np.mean(errors)) < 0.02


def test_near_duplicates(spark):
    rnd = random.Random(5)
    base, rows = prose(rnd, 150, 10**6).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(150)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, prose(rnd, 80, 10**6)) for i in range(40)] + [(300 + i, rows[i][1].upper()) for i in range(5)] + [(400, "one two"), (401, "One, two!"), (402, ""), (403, None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in bagminhash.classes(df).collect()} == want
    assert {r.doc_id for r in bagminhash.kept(df).collect()} == set(want.values())
    got = bagminhash.kept(special(spark))
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["1", "2", "3", "None", "4", "5", "7"]) and got.columns == special(spark).columns
    assert bagminhash.classes(special(spark)).count() == 9 and bagminhash.classes(empty(spark)).count() == 0


def test_near_duplicates_with_a_null_id(spark):
    rnd = random.Random(12)
    base = prose(rnd, 120, 10**6).split()
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (20, 60, 100)]
    rows = [(None, " ".join(base)), *[(i, " ".join(base)) for i in range(10, 14)], *[(20 + i, t) for i, t in enumerate(near)], (40, prose(rnd, 90, 10**6)), (41, prose(rnd, 90, 10**6))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in bagminhash.classes(df).collect()}
    assert got == {i: i if i in (40, 41) else None for i, _ in rows}
    assert sorted(str(r.doc_id) for r in bagminhash.kept(df).collect()) == ["40", "41", "None"]


# --- 7, 10 tokens ---


def test_bpe(spark):
    tiktoken, vocab = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = vocab.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    rnd = random.Random(6)
    signs = "ab strevmdl'' \n\t  1²٣é中!#$    \x85\x1c😀ſIS"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["a" * 500, "!" * 3000, " " * 999, "x's 're'll", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(df, path, with_ids=True).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.offsets == list(np.cumsum([0, *[len(own.decode_single_token_bytes(i)) for i in ids]])[:-1])
    assert bpe.encode_decode(special(spark), path).count() == 9 and bpe.encode_decode(empty(spark), path).count() == 0
    back = bpe.decode(bpe.encode_decode(df.limit(50), path, with_ids=True), path).collect()
    assert all(bytes(r.bytes).decode() == texts[r.doc_id] for r in back)


def test_token_counts(spark, tmp_path):
    tokenizers, vocab = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path, cache = vocab.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    own = tokenizers.Tokenizer.from_file(path)
    texts = ["a b", "a b", "", None, "<|endoftext|> x", "naïve " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in enumerate(texts)]
    for _ in range(2):
        assert sorted(map(tuple, token_count.counted(df, path, cache).collect())) == want
        assert spark.read.parquet(cache).count() == 4  # distinct texts, encoded once
    more = df.union(spark.createDataFrame([(9, "new")], df.schema))
    assert token_count.counted(more, path, cache).count() == 7 and spark.read.parquet(cache).count() == 5
    assert token_count.counted(special(spark), path).count() == 9 and token_count.counted(empty(spark), path).count() == 0


# --- 8 substrings ---


def brute_removal(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "k", "hot", "vocabulary"), [(35, 8, 200, 5000), (10, 3, 1, 5), (12, 4, 2, 400)])
def test_substrings(spark, window, k, hot, vocabulary):
    rnd = random.Random(window)
    shared = [prose(rnd, 60, vocabulary).split() for _ in range(6)]
    texts = []
    for i in range(120):
        w = prose(rnd, rnd.randrange(0, 90), vocabulary).split()
        for s in rnd.sample(shared, rnd.randrange(0, 3)):
            a = rnd.randrange(0, 20)
            at = rnd.randrange(0, len(w) + 1)
            w[at:at] = s[a : a + rnd.randrange(window - 3, window + 20)]
        texts.append(rnd.choice([" ", "\n", " \t "]).join(w))
    texts += ["z " * 80, texts[3], texts[3], "", None, "y " * (window + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, fmindex.deduplicated(df, window, k, hot, shard_bytes=2000).drop("spans").collect()))
    assert got == [(i, *r) for i, r in enumerate(brute_removal(texts, window))]


def test_substrings_special(spark):
    assert fmindex.deduplicated(special(spark)).count() == 9 and fmindex.deduplicated(empty(spark)).count() == 0


# --- 9 archives ---


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "é\r\n\r\n" * 400), (3, None, big), (None, "u", big)]
    pages = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, payload string")
    got = warc.round_trip(pages).collect()
    assert len(got) == 9
    for r in got:
        h = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == hashlib.sha1(h.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (1, 2, None) else ("response", None))
    whole = warc.archived(warc.typed(pages)).collect()
    (tmp_path / "a.warc.gz").write_bytes(bytes(whole[0].content))
    members = warc.normalised(warc.read_files(spark, str(tmp_path / "a.warc.gz"))).collect()[0]
    assert gzip.decompress(bytes(members.content)) == gzip.decompress(bytes(whole[0].content))
    for e in members.entries:
        assert gzip.decompress(bytes(members.content)[e.offset : e.offset + e.length]).startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- identities of words ---


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_two_letters_are_told_apart(spark):
    rnd, rows = random.Random(2), []
    for size in (64, 128, 256, 512, 1024, 4096):
        a, b = thue_morse(size)
        raw = np.frombuffer((a + b).encode(), np.uint8)
        one, other = wordhash.span_hashes(raw, np.array([0, size]), np.array([size, 2 * size]))
        assert one != other
        words = prose(rnd, 40, 10**6).split()
        rows += [(10 * size + i, " ".join([*words[:20], w, *words[20:]])) for i, w in enumerate((a, b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # no window of 35 words leaves out the word in the middle, and 5 of 37 shingles differ
    assert {r.n_removed for r in fmindex.deduplicated(df).collect()} == {0}
    assert {r.doc_id: r.class_id for r in bagminhash.classes(df).collect()} == {i: i for i, _ in rows}


def test_word_hashes_do_not_depend_on_the_place():
    raw = np.frombuffer(("x" * 300 + " naïve " + "y" * 9 + " " + "x" * 300 + " naïve").encode(), np.uint8)
    start, end, _ = wordhash.spans(raw, np.array([0, len(raw)]))
    h = wordhash.span_hashes(raw, start, end)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_near_duplicates_whose_names_collide(spark, monkeypatch):
    signed = bagminhash._signed
    monkeypatch.setattr(bagminhash, "_signed", lambda docs: signed(docs).withColumn("node", F.pmod("node", F.lit(3))))
    rnd = random.Random(14)
    rows = [(i, prose(rnd, 60, 10**6)) for i in range(12)] + [(20, None), (21, "")]
    rows += [(30 + i, t + " more") for i, t in rows[:4]] + [(40 + i, t) for i, t in rows[:2]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in bagminhash.classes(df).collect()} == brute_classes(rows)


def one_by_one(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


def test_toxicity_score_is_the_plain_forward_pass():
    rng, rnd = np.random.default_rng(3), random.Random(3)
    filters = [rng.normal(0, 1, (w * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    emb = rng.normal(0, 1, (1 << toxicity.BITS, toxicity.DIM)).astype(np.float32)
    k = len(toxicity.WIDTHS) * toxicity.FILTERS
    bias, out = rng.normal(0, 1, k), rng.normal(0, 1, k)
    model = toxicity.assembled(emb, filters, bias, out, 0.3)
    texts = ["", "one", "One, two!", *[prose(rnd, rnd.randrange(1, 40), 200) for _ in range(30)], " \n", "é 中文 x"]
    got = model.raw(*one_by_one(texts))
    for t, score in zip(texts, got, strict=True):
        w, h, _ = toxicity.words(*one_by_one([t]))
        x = [emb[a] + emb[b] for a, b in zip(w, h, strict=True)] + [np.zeros(toxicity.DIM)] * 2
        peak = []
        for width, f in zip(toxicity.WIDTHS, filters, strict=True):
            for q in range(toxicity.FILTERS):
                sums = [sum(float(x[i + j] @ f[j * toxicity.DIM : (j + 1) * toxicity.DIM, q]) for j in range(width)) for i in range(len(w))]
                peak.append(max([0.0, *sums]))
        assert score == pytest.approx(float(np.maximum(np.array(peak) + bias, 0) @ out + 0.3), rel=1e-3, abs=1e-3)


def test_quality_score_is_the_plain_dot_product():
    rng, rnd = np.random.default_rng(4), random.Random(4)
    model = quality.Model(rng.normal(0, 1, 1 << 12).astype(np.float32), -0.4, 12)
    texts = ["", "A", "A a AA!! 12", *[prose(rnd, rnd.randrange(1, 40), 200).title() for _ in range(20)], "é\n中文"]
    got = model.score(*one_by_one(texts))
    for t, score in zip(texts, got, strict=True):
        bucket, _ = quality.features(*one_by_one([t]), 12)
        z = -0.4 + quality.SCALE * sum(float(model.weights[b]) for b in bucket) / max(1, len(bucket))
        assert score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)
        plain = re.findall(r"[a-z\x80-\U0010ffff]+|[0-9]+|([^a-z0-9\s\x80-\U0010ffff])\1*", t.lower()) and [m[0] for m in re.finditer(r"[a-z\x80-\U0010ffff]+|[0-9]+|([^a-z0-9\s\x80-\U0010ffff])\1*", t.lower())]
        assert len(bucket) == max(0, 3 * len(plain) - 1)  # words, their shapes, pairs


def test_ftrl_follows_its_definition():
    rng = np.random.default_rng(6)
    rows = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 16, 4)), None) for _ in range(40)]
    rows = [(y, i, rng.random(len(i))) for y, i, _ in rows]
    got = quality.ftrl(rows, 4, epochs=2)
    z, n, order = [0.0] * 17, [0.0] * 17, np.random.default_rng(7)
    weight = lambda i: 0.0 if abs(z[i]) <= 0.002 else -(z[i] - np.sign(z[i]) * 0.002) / ((1.0 + np.sqrt(n[i])) / 0.3 + 0.01)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            y, index, value = rows[k]
            at = [*zip(index.tolist(), value.tolist(), strict=True), (16, 1.0)]
            error = 1 / (1 + np.exp(-sum(weight(i) * x for i, x in at))) - y
            for i, x in at:
                g, w = error * x, weight(i)
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / 0.3 * w
                n[i] += g * g
    assert np.allclose(got.weights, [weight(i) for i in range(16)], atol=1e-5) and got.bias == pytest.approx(weight(16))


def test_training_adds_to_the_words_it_starts_from():
    rnd, rows = random.Random(8), []
    for _ in range(700):
        w, kind = prose(rnd, 30, 300).split(), rnd.randrange(4)
        at = rnd.randrange(0, 28)
        w[at : at + 2] = {0: ["so", "nasty"], 1: ["nasty", "so"], 2: [w[at], "so"], 3: ["nasty", w[at]]}[kind]  # only this order is toxic
        whole, head, _ = toxicity.words(*one_by_one([" ".join(w)]))
        rows.append((int(kind == 0), whole, head))
    y = np.array([r[0] for r in rows[500:]])
    of = lambda epochs: auc(np.array([toxicity._raw_of(m, w, h) for m in [toxicity.assembled(*toxicity.train(rows[:500], epochs))] for _, w, h in rows[500:]]), y)
    before, after = of(0), of(12)
    assert after > 0.9 and after > before + 0.05


def test_samples_are_bounded_and_repeated_ids_count_once(spark):
    docs, labels = labelled(spark, 300, ["fine"], 0.4)
    both = docs.union(docs)
    own = common.labelled_sample(both, labels.withColumnRenamed("label", "quality"), "quality", 100, lang=True)
    rows = common.bounded(own.select("doc_id", "label", F.encode("text", "utf-8").alias("x")), ["x"], 1 << 30).toArrow().to_pylist()
    assert len(rows) == 100 == len({r["doc_id"] for r in rows})
    few = common.bounded(own.select("doc_id", "label", F.encode("text", "utf-8").alias("x")), ["x"], 5000).toArrow().to_pylist()
    assert 0 < sum(len(r["x"]) for r in few) <= 5000 and {r["doc_id"] for r in few} < {r["doc_id"] for r in rows}
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        one, two = (module.fit(d, labels.withColumnRenamed("label", name), 80) for d in (docs, both))
        assert [r.score for r in module.scored(docs, one).orderBy("doc_id").limit(20).collect()] == [r.score for r in module.scored(docs, two).orderBy("doc_id").limit(20).collect()]


def test_slots_have_to_be_consistent(spark):
    rnd = random.Random(15)
    fill = " ".join(f"then {{a}} {prose(rnd, 6, 10**6)} {{b}} {prose(rnd, 6, 10**6)}" for _ in range(4))
    item = fill.format(a="Anna", b="Berta")
    docs = [(1, fill.format(a="Maria", b="Luisa")), (2, re.sub("Anna|Berta", lambda m, n=iter("Maria Zoe Ida Eva Uma Ada Lea Kim".split()): next(n), item))]
    df = spark.createDataFrame([(i, f"{prose(rnd, 10, 10**6)} {t} {prose(rnd, 10, 10**6)}") for i, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    # each window has a name, so that only templates can match; one name became four in the second document
    got = {r.doc_id: r for r in decontaminate.flagged(df, bench).collect()}
    assert set(got) == {1} and got[1].n_covered == got[1].n_tokens and got[1].n_changed == 2
    loose = {r.doc_id for r in decontaminate.flagged(df, bench, consistent=0.0).collect()}
    assert loose == {1, 2}


def test_streams_that_end_early_are_errors(spark):
    pages = spark.createDataFrame([(i, "u", "payload " * 50) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    content = bytes(warc.archived(warc.typed(pages)).collect()[0].content)
    assert len(list(warc.records(warc.inflated(content)))) == 5
    assert len(list(warc.records(warc.inflated(content + b"\0" * 300)))) == 5
    assert len(list(warc.records(warc.inflated(content + content, 7)))) == 10
    whole = gzip.decompress(content)
    z = __import__("zlib").compressobj(6, 8, 31)
    cut = z.compress(whole) + z.flush(2)  # all records, but no end of the stream
    for bad in (cut, content[:-1], content[: len(content) // 2]):
        with pytest.raises(ValueError, match="early|within"):
            list(warc.records(warc.inflated(bad)))


# --- queries and pipeline ---


def test_sql_equivalents(spark, sf_dir, duck):
    from sluice.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want), name


def test_near_duplicates_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    from sluice.llm import queries

    assert {r.doc_id: r.class_id for r in queries.op6_bagminhash(spark, sf_dir).collect()} == brute_classes(rows)


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, sf_dir), "test")
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert docs.count() == before.count() and docs.where(F.col("n_tokens") < 0).isEmpty()


@pytest.mark.parametrize("make", [special, empty])
def test_pipeline_of_special_rows(spark, sf_dir, make):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = make(spark).withColumn("lang", F.lit("en"))
    for name, stage in pipeline.STAGES:
        out = common.written(stage(spark, docs, sf_dir), "test")
        if name == pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()
            break
        assert out.columns == docs.columns and (out.count() > 0) == (make is special)
        # quality may drop rows; what the other stages keep of these rows is fixed
        docs = out if name != pipeline.STAGES[0][0] else docs
    if make is special:
        assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(["1", "2", "3", "None", "4", "5", "7"])


def test_pipeline_against_brute_force(spark, sf_dir):
    """Near duplicates, contamination and tokens of a small table, stage by stage."""
    pipeline, vocab = pytest.importorskip("corpus_pipeline"), pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    rnd = random.Random(31)
    items = [r.text for r in common.table(spark, sf_dir, "benchmark").orderBy("item_id").limit(2).collect()]
    base = prose(rnd, 90, 10**6).split()
    rows = [(1, " ".join(base)), (2, " ".join([*base[:40], "other", *base[41:]])), (3, prose(rnd, 60, 10**6)), (4, f"{prose(rnd, 30, 10**6)} {items[0]} {prose(rnd, 9, 10**6)}"), (5, prose(rnd, 40, 10**6) + " AKIA" + "Q" * 16), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = dict(rows)
    stages = dict(pipeline.STAGES)
    docs = stages["near-duplicate removal"](spark, docs, sf_dir)
    classes = brute_classes(rows)
    want = {i: t for i, t in want.items() if classes[i] == i}
    assert {r.doc_id: r.text for r in docs.collect()} == want == {i: t for i, t in rows if i != 2}
    docs = stages["benchmark decontamination"](spark, docs, sf_dir)
    del want[4]
    assert {r.doc_id: r.text for r in docs.collect()} == want
    docs = stages["secret redaction"](spark, docs, sf_dir)
    want[5] = want[5].replace("AKIA" + "Q" * 16, "[SECRET]")
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in want.items()}
    own = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocab.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in stages["byte-level BPE"](spark, docs, sf_dir).collect()} == {i: len(own.encode_ordinary(t)) for i, t in want.items()}
