"""Spelling variants against plain rules."""

import random
import zlib
from collections import Counter

from pagewright.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def plain_forms(n):
    out = {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (n[w], len(near), best if best and n[best] >= 5 * n[w] else None)
    rows = set()
    for w, (k, near, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, k, near, form, n[form] if form else None, root))
    return rows


def found(spark, n, shared):
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.forms(rows, shared=shared).collect()}


def test_all_pairs_meet_whatever_is_shared(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(150)}
    words |= {"prefix" + "".join(rng.choice("ab") for _ in range(4)) + "ation" for _ in range(30)}
    n = {w: rng.choice([1, 2, 5, 10, 50, 250, 1250]) for w in words}
    expected = plain_forms(n)
    assert any(r[3] and r[5] != r[3] for r in expected)  # some chains are longer than one
    assert found(spark, n, shared=2) == expected  # keys are lengthened several times
    assert found(spark, n, shared=1000) == expected


def test_ties_repeats_nulls_and_no_words(spark):
    assert found(spark, {"aaaaaa": 1, "aaaaab": 5, "aaaaac": 5}, 48) == {("aaaaaa", 1, 2, "aaaaab", 5, "aaaaab"), ("aaaaab", 5, 2, None, None, "aaaaab"), ("aaaaac", 5, 2, None, None, "aaaaac")}
    rows = spark.createDataFrame([("abcdef", 2), ("abcdef", 3), (None, 9)], "word string, n long")
    assert [tuple(r) for r in spelling.forms(rows).select("word", "n", "n_near", "form", "root").collect()] == [("abcdef", 5, 0, None, "abcdef")]
    assert spelling.forms(rows.limit(0)).count() == 0


def test_words_and_slips_of_whole_texts(spark):
    rng = random.Random(7)
    letters = "abcXYZÀÿ÷é"
    texts = [(i, " 1Ā".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(60))) for i in range(20)]
    texts += [(None, "Nullkey Nullkey nullkey NULLKEY nullkeyé"), (77, None), (78, ""), (79, "longword" * 40_000 + " Endings")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, word string, n string")
    import re

    expected = Counter()
    lower = str.maketrans(spelling._UPPER, spelling._LOWER)
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 3 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            expected[w] += len(w) >= 6
    got = {r.word: r.n for r in spelling.counted(spelling.with_slips(spelling.runs(docs), 3), least=1).collect()}
    assert got == {w: n for w, n in expected.items() if n}
