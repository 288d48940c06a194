"""Collocations against plain rules."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pagewright.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, share=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(g >= least and 100 * g >= share * a and p[0] == lang and len(p) == 4 and (p[1:3] == tuple(w) or p[2:] == tuple(w)) for p, g in f.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    return {(lang, ranks.update([lang]) or ranks[lang], *rest) for lang, *rest in out if ranks[lang] < top}


def texts(rng, n):
    words = ["the", "The", "of", "a", "é", "bank", "x" * 40, "È", "и"]
    gaps = [" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", " ; ", "\xa0"]
    return [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def test_against_plain_rules(spark):
    rows = texts(random.Random(3), 80) + [("en", None), (None, ""), ("en", "?!"), ("de", "the of a " * 3000)]
    docs = spark.createDataFrame([(x, t, "p", 1) for x, t in rows], "lang string, text string, phrase string, n int").repartition(5)
    for least, top, most in ((10, 2000, None), (3, 7, 5), (2, 2000, 1)):  # groups of one word, of two and of three
        got = C.collocations(docs, least=least, top=top, most=most).collect()
        assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == plain(rows, least, top)
    assert C.collocations(docs.limit(0)).count() == 0


def test_parts_of_texts_and_batches(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)
    monkeypatch.setattr(C, "HELD", 16)
    rows = texts(random.Random(4), 60) + [("en", "one two three " * 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])
    expected = Counter()
    words = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words.update((lang or "und", x) for x in w)
            expected.update((lang or "und", *w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
    listed = [r for b in C._lists([batch.slice(0, 30), batch.slice(30)], 1) for r in b.to_pylist()]
    got, name = Counter(), {}
    for r in listed:
        if r["bucket"] is None:
            got[r["lang"], r["word"]] += r["n"]
            name[r["id"]] = (r["lang"], r["word"])
    assert got == words and len(name) == len(words)
    twos = np.zeros(C.BUCKETS, np.int64)
    for r in listed:
        if r["bucket"] is not None:
            twos[r["bucket"]] += r["n"]
    assert twos.sum() == sum(n for p, n in expected.items() if len(p) == 3)
    groups = C.Groups(twos, twos, 40)
    leaves = [r for b in C._suffixes([batch.slice(0, 30), batch.slice(30)], 1, groups) for r in b.to_pylist()]
    leaves.sort(key=lambda r: (r["a"], r["b"], r["c"], r["part"]))
    table = pa.Table.from_pylist(leaves)
    nodes = [r for b in C._subtrees(table.to_batches(max_chunksize=7), 1, 10**9) for r in b.to_pylist()]
    found = Counter()
    for r in nodes:
        found[name[r["a"]][0], name[r["a"]][1], name[r["b"]][1], *([] if r["c"] is None else [name[r["c"]][1]])] += r["n"]
    assert found == expected


def test_exact_beyond_64_bits(spark):
    big = 10**13
    row = spark.createDataFrame([(big, big + 1, big + 3)], "a long, l long, r long")
    assert row.select(C._score("a", "l", "r")).first()[0] == 1000000 * big * big // ((big + 1) * (big + 3))
