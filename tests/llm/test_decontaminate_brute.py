"""Decontamination against a plain search of every window, on random items and texts."""

from __future__ import annotations

import collections
import random

import pytest
import regex

from sluice.llm import decontaminate as dc

TYPES = (dc.NUMBER, dc.NAME, dc.UNIT)


def forms(text):
    """By key, the words and what is compared of them."""
    words = regex.findall(r"\d+(?:[.,]\d+)*|\p{Lu}[\p{L}\p{M}]*(?: \p{Lu}[\p{L}\p{M}]*)*|[\p{L}\p{M}]+", text or "")

    def typed(tokens):
        out = [dc.NUMBER if regex.fullmatch(r"\d+(?:[.,]\d+)*", t) else t for t in tokens]
        return [dc.UNIT if i and out[i - 1] == dc.NUMBER and t in dc.UNITS else t for i, t in enumerate(out)]

    form = typed([dc.NAME if regex.match(r"[\p{Lu}\p{Lt}]", w) else w.lower() for w in words])
    folded = " ".join(words).lower().split(" ") if words else []
    return {dc.TEMPLATE: (words, form), dc.FOLDED: (folded, typed(folded)), dc.EXACT: (folded, folded)}


def plain(docs, items, width, literals, consistent, coverage):
    hits = collections.defaultdict(lambda: (set(), set()))
    read = {(i, t): forms(t) for i, t in docs}
    for item, text in items:
        own = forms(text)
        typed = own[dc.FOLDED][1]
        for key, (words, form) in own.items():
            w = min(width, len(form))
            for at in range(len(form) - w + 1) if form else ():
                n = sum(t not in TYPES for t in (form if key == dc.TEMPLATE else typed)[at : at + w])
                if (n < literals) != (key == dc.EXACT):
                    continue
                for doc, has in read.items():
                    said, its = has[key]
                    for pos in range(len(its) - w + 1):
                        if its[pos : pos + w] == form[at : at + w]:
                            places, pairs = hits[doc, item, key == dc.TEMPLATE, len(form), w, pos - at]
                            places.add(at)
                            pairs.update((words[at + k].lower(), said[pos + k].lower()) for k in range(w) if form[at + k] in TYPES)
    whole = collections.defaultdict(lambda: [set(), 0])
    for (doc, item, template, n, w, _), (places, pairs) in hits.items():
        if not pairs or len({i for i, _ in pairs}) >= consistent * len(pairs):
            found = whole[doc, item, template, n, w]
            found[0] |= places
            found[1] += sum(i != d for i, d in pairs)
    best = {}
    for (doc, item, template, n, w), (places, changed) in whole.items():
        covered = len({p + k for p in places for k in range(w)})
        if covered >= coverage * n:
            row = (covered / n, template, len(places), covered, n, changed)
            best[doc, item] = max(best.get((doc, item), row), row)
    return sorted(((doc[0], item, *row[2:]) for (doc, item), row in best.items()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_every_window_is_searched(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["run", "tree", "Anna", "Bert", "Élan", "5", "12", "3,5", "km", "kg", "days", "the", "of", "IS", "ünd", "sum"]
    said = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ".", ","]) for _ in range(n))
    items = [(i, said(rnd.choice([1, 2, 4, 7, 9, 15, 24]))) for i in range(14)] + [(90, None), (91, ""), (92, "...")]
    docs = [(i, said(rnd.randrange(30))) for i in range(12)]
    for i in range(30):  # whole items, parts and copies with other fillers
        words = rnd.choice(items[:14])[1].split()
        cut = words[rnd.randrange(3) :][: rnd.choice([5, 9, 30])]
        turned = [rnd.choice(["Carla", "Anna"]) if w[:1].isupper() and rnd.random() < 0.5 else "7" if w[:1].isdigit() and rnd.random() < 0.5 else w for w in cut]
        docs.append((100 + i, f"{said(rnd.randrange(5))} {' '.join(turned)} {said(rnd.randrange(5))}"))
    docs += [(200, None), (201, ""), (None, items[3][1]), (5, items[5][1]), (5, items[5][1]), (202, items[6][1].upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for width, literals, consistent, coverage in ((8, 4, 0.8, 0.4), (4, 2, 0.5, 0.7)):
        want = plain(set(docs), items, width, literals, consistent, coverage)
        assert len(want) > 5
        for rows in (200_000, 0):
            got = dc.flagged(df, bench, width=width, literals=literals, consistent=consistent, coverage=coverage, broadcast_rows=rows)
            assert sorted(map(tuple, got.collect()), key=str) == want
