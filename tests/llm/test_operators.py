"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import bpe, components, knn, language, license_scan, minhash, mixing, sketch, substring_dedup, suffix_array, text_hash, toxicity, url_filter
from pagewright.llm.word_features import fold_of, labelled_sample

DOC = "doc_id long, text string, lang string, source string"
FIRST = ["alpha", "beta", "gamma", "delta", "edge", "fox", "golf", "hotel", "india", "jazz"]


def words(rng, n):
    return " ".join(rng.choice(FIRST) + rng.choice("xyzuvw") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Texts with copies, near copies, shared passages, odd and long ones."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 120)) for _ in range(25)]
    shared = words(rng, 70)
    out = [*base, *base[:6], "", None, "   \t\n", "two words", "two  WORDS", "ÉÀ ß", "😀" * 300, "x" * 5000, "ab " * 3000]
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [words(rng, 20) + " " + shared + " " + words(rng, 20) for _ in range(4)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 % 101, t, "en" if i % 2 else None, ["a", "b", None][i % 3]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).cache()


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_word_hashes_of_odd_texts():
    rng = np.random.default_rng(1)
    long = "w" * 70_000
    column = pa.array(["A b", None, "", "a  B\n", long + " a b " + long, " ".join(map(str, rng.integers(0, 99, 60_000)))])
    got = list(text_hash.texts_words(column))
    assert got[0].tolist() == got[3].tolist() and len(got[1]) == len(got[2]) == 0
    assert got[4][0] == got[4][3] and got[4][1:3].tolist() == got[0].tolist() and len(got[5]) == 60_000
    assert len(set(got[5].tolist())) == 99


def test_near_duplicates(spark, docs, texts):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {i: shingles(t, 4) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs.withColumn("bands", F.lit(1)), width=4).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_of_null_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(rows).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("7", "7", True), ("None", "None", True)]
    assert minhash.near_duplicates(rows.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in minhash.drop_near_duplicates(rows).collect()) == ["5", "7", "None"]


def test_groups_with_unlinked_members_are_searched_whole(spark):
    """Near copies of which only some are linked: every link counts, whoever leads the bucket."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = base.copy()
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 5) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}
    assert len(set(got.values())) > 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 30))]
        order = suffix_array.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for r, n in enumerate(suffix_array.common_prefixes(s, order)):
            a, b = (s[order[r - 1] :], s[order[r] :]) if r else ([], [])
            assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("length", [40, 100, 400])
def test_repeats(spark, docs, length):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = {}
    for _, b in rows:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        want.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.remove_repeats(docs.withColumn("kept", F.lit("clash")), length)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == sorted(want)
    assert substring_dedup.remove_repeats(docs.limit(0), length).count() == 0


def test_suffix_array_decides_in_a_block():
    rng = random.Random(7)
    length, shared = 60, words(rng, 40)
    data = [f"{words(rng, 30)} {shared} {words(rng, 30)}".encode() for _ in range(3)] + [words(rng, 50).encode(), b"ab" * 200]
    parts = [substring_dedup.cut_part(i, i, 0, np.frombuffer(t, np.uint8), length) for i, t in enumerate(data)]
    repeats, stands = substring_dedup.block_classes(parts, length)
    strings = [t[p : p + length] for t in data for p in range(len(t) - length + 1)]
    places = [(p, lo, hi) for p in parts for lo, hi in zip(p.lo, p.hi, strict=True)]
    kinds = {}
    for (p, lo, hi), twice in zip(places, repeats, strict=True):
        context = data[p.id][lo : hi + length]
        assert not twice or all(strings.count(context[k : k + length]) > 1 for k in range(hi - lo + 1))
        kinds[context] = kinds.get(context, 0) + 1
    # all but the edges of the shared passage are found inside the block, and copies have one row
    found = sum(hi - lo + 1 for (p, lo, hi), twice in zip(places, repeats, strict=True) if twice and p.id < 3)
    assert found > 3 * (len(shared) - length) * 0.5
    assert len(kinds) <= stands.sum() < len(places) - 6


def test_repeats_of_null_keys(spark):
    rng = random.Random(9)
    shared = words(rng, 30)
    rows = [(None, shared + " " + words(rng, 9)) for _ in range(3)] + [(None, None), (None, words(rng, 60)), (3, shared), (3, "other " + words(rng, 40)), (3, shared)]
    cut = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")), 80).collect()
    assert len(cut) == len(rows) and {r.id for r in cut} == {"clash"}
    assert sorted((r.doc_id or -1, r.n_removed > 0) for r in cut) == [(-1, False)] * 2 + [(-1, True)] * 3 + [(3, False), (3, True), (3, True)]


def test_shorter_repeats_are_told(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 512)
    rng = random.Random(11)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    start, middle, end, whole, line = (fresh(n) for n in (300, 255, 255, 260, 200))
    data = [
        fresh(300) + middle + fresh(600), fresh(900) + middle + fresh(90), start + fresh(700), fresh(2500) + start, fresh(350) + end, end, fresh(30) + end,
        whole, whole, *[fresh(200) + line + fresh(500) + line + fresh(100)], *(fresh(n) for n in (254, 255, 399, 400, 511, 912, 913, 3000)), "", None,
    ]
    cut = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").withColumn("repeats", F.lit("clash")), 400, passage=255)
    got = {r.doc_id: (r.repeats, r.n_removed) for r in cut.collect()}
    assert got == {i: (int(i < 9), 0) for i in range(len(data))}


def test_repeats_of_common_cores(spark, docs, monkeypatch):
    cut = lambda: sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256, r.repeats) for r in substring_dedup.remove_repeats(docs, 100, passage=70).collect())
    want = cut()
    monkeypatch.setattr(substring_dedup, "CORE_ROWS", 1)
    monkeypatch.setattr(substring_dedup, "BLOCK", 500)
    assert cut() == want and any(r[1] for r in want)


def test_told_repeats_are_whole(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    holders = {}
    for i, b in texts.items():
        for p in range(len(b) - 254):
            holders.setdefault(b[p : p + 255], set()).add(i)
    want = {i for h in holders.values() if len(h) > 1 for i in h}
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, 400, passage=255).collect()}
    told = {i for i, r in got.items() if r.repeats}
    assert want <= told and want - {i for i, r in got.items() if r.n_removed} and told < set(got)


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 64)
    data = np.frombuffer((words(random.Random(3), 60)).encode(), np.uint8)
    lo = []
    for a, part in substring_dedup.segments(data, 30):
        own = substring_dedup.intervals(part, 30)
        lo += [p for x, y in zip(own[0] + a, own[1] + a, strict=True) for p in range(x, y + 1)]
    assert lo == list(range(len(data) - 29))


def test_mixing(spark, docs):
    out = mixing.mix(docs, [5.0, 2.0, 1.0], keep=["doc_id", "source"]).collect()
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len((r.text or "").encode().split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight, total = dict(zip(order, [5, 2, 1], strict=True)), sum(size.values())
    target, left, free = {}, total, set(order)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    for r in out:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.copies <= 3
    taken = {s: sum(r["size"] * r.copies for r in out if r.source == s) for s in order}
    assert abs(sum(taken.values()) - total) < 0.6 * total
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs, [5.0, 2.0, 1.0], keep=["doc_id", "source"]).collect()))
    whole = mixing.mix(docs, [5.0, 2.0, 1.0], keep=["doc_id", "text"], extra_source=True)
    assert sorted((r.doc_id, r.copies) for r in whole.collect()) == sorted((r.doc_id, r.copies) for r in out)
    assert mixing.mix(docs.limit(0), [1.0]).count() == 0


def test_license_scan(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "MIT license, mit  LICENSE! the Apache License, version 2.0"), (3, "licensed under CC BY-NC 4.0"), (4, None), (5, ""),
        (6, "GNU Lesser General Public License v3"), (7, "no rights here"), (8, "word " * 3000 + "GNU General Public License"), (8, "mitlicense"),
    ]
    got = [r.asDict(recursive=True) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash"))).collect()]
    places = [sum(b["places"] for b in r["base_places"]) for r in got]
    assert places == [1, 3, 0, 0, 0, 1, 0, 1, 0]
    assert [r["labels"] for r in got] == [["mit"], ["apache", "mit"], ["cc-by-nc"], [], [], ["gpl", "lgpl"], [], ["gpl"], []]
    assert [r["n_words"] for r in got] == [5, 10, 7, 0, 0, 6, 3, 3004, 1]
    assert got[7]["base_places"][2]["first"] == got[7]["base_places"][2]["last"] == 3001 and all(0 <= r["score"] <= 1 for r in got)
    assert len(license_scan.rules()) > 200


def samples(tree):
    """Strings a regex accepts: the shortest one first, and one for each alternative and option."""
    parts = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name in ("ANY", "NOT_LITERAL"):
            parts.append(["x"])
        elif name == "IN":
            parts.append([chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg])
        elif name == "BRANCH":
            parts.append([s for branch in arg[1] for s in samples(branch)])
        elif name == "SUBPATTERN":
            parts.append(samples(arg[3]))
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT")
            low, high, inner = arg
            parts.append([s * n for n in (low, min(int(high), low + 1)) for s in (samples(inner) if n else [""])])
    least = [p[0] for p in parts]
    return list(dict.fromkeys("".join([*least[:i], s, *least[i + 1 :]]) for i, p in enumerate(parts or [[""]]) for s in p))


def test_license_scan_is_exhaustive(spark):
    """The scan against all rules tried everywhere and compared in pairs: each alternative of each rule, and shuffled fragments."""
    import re

    rules = license_scan.rules()
    texts = list(dict.fromkeys(s for r in rules for s in samples(re._parser.parse(r[3]))))
    texts += ["Public-\nDomain", "dedicated to the Public-\nDomain", "licensed under creative commons attribution noderivatives", "Expat License", "ASL license", "GPLv licence", "relicenced under isc", "mit licencing"]
    texts += ["mit x11 license" + " word" * 12 + " license", "Released under GPLv3.", "released into the public domain", "mit license, mit license; MIT License", "copyright " + "holder " * 38 + "all rights reserved", "Copyright 2019 " + "w " * 41 + "all rights reserved"]
    rng = random.Random(5)
    pool = "mit x11 expat license licensed under the terms of gpl gplv3 version 2 0 or later apache software released public domain into copyright c 2001 all rights reserved cc by nc sa licensing gnu general lesser".split()
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(2, 120))) for _ in range(150)]
    patterns = [(label, re.compile(f"(?<= ){r}(?= )"), p, c) for label, _, _, r, p, c in rules]

    def everywhere(text):
        line = f" {' '.join(re.findall(license_scan.WORD, text.lower()))} "
        found = {(label, line.count(" ", 0, m.start()) - 1, line.count(" ", 0, m.end()), p, c) for label, r, p, c in patterns for m in r.finditer(line)}
        words, since = line.split(), 0
        for i in range(len(words)):
            if i >= since and words[i : i + 3] == ["all", "rights", "reserved"]:
                if "copyright" in words[since:i]:
                    found.add((license_scan.RESERVED[0], max(j for j in range(since, i) if words[j] == "copyright"), i + 3, *license_scan.RESERVED[1:]))
                since = i + 3
        beaten = lambda x, y: y[1] <= x[1] and y[2] >= x[2] and (y[3] > x[3] or (y[3] == x[3] and y[2] - y[1] > x[2] - x[1]))
        return sorted(x for x in found if not any(beaten(x, y) for y in found))

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in license_scan.scan_licenses(rows).select("doc_id", "labels", "detections").collect()}
    for i, t in enumerate(texts):
        found = everywhere(t)
        assert sorted((x.label, x.start, x.end, x.priority, x.confidence) for x in got[i].detections) == found, t
        line = f" {' '.join(re.findall(license_scan.WORD, t.lower()))} "
        assert got[i].labels == sorted({x[0] for x in found} | {label for phrase, label in license_scan.BASE if f" {phrase} " in line})
    labels = {t: got[i].labels for i, t in enumerate(texts)}
    assert labels["Expat License"] == ["mit"] and labels["ASL license"] == ["apache"] and labels["dedicated to the Public-\nDomain"] == ["public-domain"]
    assert labels["licensed under creative commons attribution noderivatives"] == ["cc-by-nd"] and len(texts) > 1000
    assert labels[texts[-156]] == ["mit"] and labels["Released under GPLv3."] == ["gpl"] and labels["released into the public domain"] == ["public-domain"]
    assert [x.priority for x in got[texts.index("mit license, mit license; MIT License")].detections].count(4) == 3
    assert labels[texts[-152]] == ["all-rights-reserved"] and labels[texts[-151]] == ["all-rights-reserved"]


def test_license_tags_and_texts(spark):
    texts = {
        "SPDX-License-Identifier: MIT": ["mit"], "// SPDX-License-Identifier: BSD-3-Clause": ["bsd"], "SPDX-License-Identifier: GPL-2.0-or-later": ["gpl"], "SPDX-License-Identifier: Apache-2.0": ["apache"],
        "SPDX-License-Identifier: CC-BY-SA-4.0": ["cc-by-sa"], "Permission is hereby granted, free of charge, to any person obtaining a copy": ["mit"],
        "Redistribution and use in source and binary forms, with or without modification": ["bsd"], "GNU AGPL version 3": ["agpl"], "it is under the GNU LGPL v2.1": ["lgpl"],
        "This program is free software; you can redistribute it and/or modify it": ["gpl"], "Copyright Ann " + "and Bob " * 30 + "All rights reserved.": ["all-rights-reserved"],
        "copyright a all rights reserved b all rights reserved": ["all-rights-reserved"], "all rights reserved copyright": [], "Permission to go home": [], "identifier MIT": [], "an altered contributor": [],
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(rows).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_a_key_with_two_texts_is_one_document(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g")
    rows = [(3, a), (5, a), (5, b), (7, b), (5, None), (9, c), (9, ""), (8, c), (2, None), (None, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("3", "3", True), ("5", "3", False), ("5", "3", False), ("7", "3", False), ("5", "3", False), ("9", "8", False), ("9", "8", False), ("8", "8", True), ("2", "2", True), ("None", "None", True)]
    )


def test_urls(spark):
    urls = ["http://a.www.EXAMPLE.com/en/x?q", "https://example.com/en/", "https://x.example.com/en", "http://net/es/1", "ftp://b.net#x", "http://example.com", "nothing", None, "http://notexample.com/en/", "http://net/es/1", "x://h.com/a://b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got[0] == ("a.www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block")
    assert got[2][2:] == ("com/", "allow") and got[3][2:] == ("net/es/", "block") and got[4] == ("b.net", "", None, "allow")
    assert got[5] == ("example.com", "", None, "allow") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("com/", "allow") and got[9] == got[3] and got[10][:2] == ("h.com", "/a://b")
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_sketches(spark, docs):
    got = sketch.edited_pairs(docs).collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id, r.text is not None, (r.text or "").encode()))
    assert len(got) == len(order)
    want = []
    for me, after in zip(order, [*order[1:], order[0]], strict=True):
        t, u = me.text or "", after.text or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + u[:half]
        want.append((me.doc_id, len(t), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = {}
    for r in sketch.fingerprints(docs, keep=["doc_id"]).collect():
        by_text.setdefault(r.doc_id, r.fingerprint)
    assert {r.doc_id: r.fingerprint for r in got} == by_text
    assert sketch.edited_pairs(docs.limit(0)).count() == 0
    one = sketch.edited_pairs(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_sketch_estimates(spark):
    rng = random.Random(5)
    a, b = words(rng, 3000).split(), words(rng, 1500).split()
    x, y = " ".join(a), " ".join(a[:1500] + b)
    sx, sy = shingles(x, 5), shingles(y, 5)
    kx, ky = sketch.sketch(x.encode()), sketch.sketch(y.encode())
    assert abs(sketch.resemblance(kx, ky) - len(sx & sy) / len(sx | sy)) < 0.15
    assert abs(sketch.containment(kx, ky) - len(sx & sy) / len(sx)) < 0.2
    assert abs(sketch.distinct(kx) / len(sx) - 1) < 0.3
    parts = spark.createDataFrame([("g", x), ("g", y), ("e", "")], "g string, text string")
    merged = {r.g: r.fingerprint for r in sketch.merge_fingerprints(sketch.fingerprints(parts, keep=["g"]), "g").collect()}
    assert merged == {"g": sketch.to_text(sketch.merge(kx, ky)), "e": ""}
    assert np.array_equal(sketch.from_text(sketch.to_text(kx)), kx)


def test_bpe(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.parse_ranks(f)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_texts(docs.withColumn("ids", F.lit(0)), path, public_tokenizers.PATTERN, keep=["doc_id"]).join(docs.groupBy("doc_id").agg(F.first("text").alias("text")), "doc_id").collect():
        ids = theirs.encode_ordinary(r.text or "")
        if ids == list(r.ids):
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        else:
            assert docs.where(F.col("doc_id") == r.doc_id).count() > 1
    machine = bpe.Transducer(ranks)
    rng, vocabulary = random.Random(6), list(ranks)
    pieces = [b"".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(200)] + [b"", b"a" * 9000, b"".join(rng.choice(vocabulary) for _ in range(3000))]
    for keep in (machine.KEEP, 300):  # the second forgets its states again and again
        machine.KEEP = keep
        tokens, counts = machine.encode(pa.array(pieces, pa.binary()))
        assert machine.nodes.n < keep + 20_000
        ends = np.cumsum(counts)
        for p, a, b in zip(pieces, ends - counts, ends, strict=True):
            assert machine.ids[tokens[a:b]].tolist() == (theirs._encode_single_piece(p) if p else [])
    parts = list(machine.stream(pieces[-1]))
    assert len(parts) > 2 and sum(machine.size[parts[0]]) > machine.EMIT - 2 * machine.longest
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    codec.PART = 7  # texts come in parts
    odd = ["", "a b  c\n\n d1234 'll 日本 " * 9, "x", "", "e" * 40]
    got = [[] for _ in odd]
    for i, t in codec.encode(odd):
        got[i] += codec.machine.ids[t].tolist()
    assert got == [theirs.encode_ordinary(t) for t in odd]
    assert bpe.encode_texts(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(1, theirs.encode_ordinary(odd[1])), (2, []), (3, None), (4, [int(ranks[b"\xe6"])])], "k long, ids array<int>").withColumn("text", F.lit(0))
    assert {r.k: r.text for r in bpe.decode_ids(ids, path, public_tokenizers.PATTERN).collect()} == {1: odd[1], 2: "", 3: None, 4: "\ufffd"}


def test_utf8_stream():
    text = "aé日😀\x00" * 5
    data = text.encode()
    for n in (1, 2, 3, 5):
        machine = bpe.Utf8Stream()
        assert "".join(machine.feed(data[i : i + n]) for i in range(0, len(data), n)) == text and machine.finish()
    machine = bpe.Utf8Stream()
    machine.feed(data[:2])
    assert not machine.finish()
    rng = random.Random(3)
    for _ in range(2000):  # bytes that are no UTF-8, cut anywhere
        data = b"".join(rng.choice([b"a", bytes([rng.randrange(128, 256)]), "é日😀"[rng.randrange(3)].encode(), b"\xed\xa0\x80", b"\xf0\x82", b"\xe0\x80"]) for _ in range(rng.randint(0, 12)))
        machine, n = bpe.Utf8Stream(), rng.randint(1, 6)
        got = "".join(machine.feed(data[i : i + n]) for i in range(0, len(data), n))
        assert (got if machine.finish() else got + "\ufffd") == data.decode("utf-8", "replace")


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-40, 40, (90, 6))
    v[10:40] = v[10]
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(90)] + [(200, None), (None, [1.0] * 6), (201, [float("nan")] * 6), (202, [1.0, None]), (5, [float(x) for x in v[5]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ready = table.where(knn.usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: F.floor(x)).alias("vector"))
    for n_pivots, block in ((3, 8), (1, 1000)):
        got = {}
        for r in knn.top_k(ready, ready.where("vec_id % 5 = 0"), 4, n_pivots=n_pivots, query_block=4, data_block=block, sent_rows=5 * block - 33).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        ids = [*range(90), 5]
        for q in range(0, 90, 5):
            best = sorted(((-int(v[q] @ v[i]), i) for i in ids if i != q))[:4]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert knn.top_k(ready.limit(0), ready, 3).count() == 0
    few = ready.where("vec_id IN (0, 1, 2)")
    assert knn.top_k(few, few, 5).count() == 6


def language_rows(n):
    rng = random.Random(8)
    stems = {"aa": ["kala", "moro", "tupi"], "bb": ["schwen", "grund", "stark"]}
    out = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        out.append((i, " ".join(rng.choice(stems[lang]) + rng.choice("xyz") for _ in range(rng.randint(3, 40))), lang, 1 if i % 5 == 3 else 0))
    return out


def test_language(spark):
    rows = language_rows(200)
    docs = spark.createDataFrame([(i, t, x) for i, t, x, _ in rows] + [(900, None, "aa"), (901, "123 ...", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    tagger = language.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs.withColumn("score", F.lit(9)), tagger, keep=["doc_id"]).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 10 and all(got[i][0] == x for i, _, x, _ in rows if i in held)
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    mixed = np.concatenate([tagger.emissions(p) for p in language.pieces(rows[0][1] + " " + rows[1][1])])
    (chance,) = tagger.chances([mixed])
    assert chance[0].argmax() != chance[-1].argmax() and np.allclose(chance.sum(1), 1)
    runs = language.identify(spark.createDataFrame([(rows[0][1] + " " + rows[1][1],), (None,)], "text string"), tagger, runs=True).collect()
    first, second = (len(rows[i][1].split()) for i in (0, 1))
    assert [(r.lang, r.first, r.words) for r in runs[0].runs] == [("bb", 0, first), ("aa", first, second)] and runs[0].sure > 0.9 > runs[0].score
    assert runs[1].runs == [] and runs[1].lang_pred == "und"
    assert language.train(docs.limit(0)).predict(["abc", None]) == [("und", 0.0)] * 2


def test_forward_backward_is_exact():
    tagger = language.Tagger(["a", "b", "c"])
    rng = np.random.default_rng(2)
    tagger.moves = rng.normal(size=(3, 3))
    e = [rng.normal(size=(n, 3)) for n in (4, 1, 0, 3)]
    for emission, chance in zip(e, tagger.chances(e), strict=True):
        n = len(emission)
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n) if n else []:
            weight = np.exp(sum(emission[t, path[t]] for t in range(n)) + sum(tagger.moves[path[t], path[t + 1]] for t in range(n - 1)))
            for t in range(n):
                want[t, path[t]] += weight
        assert np.allclose(chance, want / want.sum(1, keepdims=True) if n else want)


def test_toxicity(spark):
    rng = random.Random(1)
    rows = []
    for i, t, lang, bad in language_rows(400):
        rows.append((i, t + (" vilestuff" + rng.choice(["en", "er", "es"]) if bad else "") + " end", lang, bad))
    docs = spark.createDataFrame([(i, t, x) for i, t, x, _ in rows] + [(900, None, None), (901, "", "aa")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, b) for i, _, _, b in rows] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    model, thresholds = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.withColumn("flagged", F.lit(9)), model, thresholds, keep=["doc_id"]).collect()}
    held = [(i, b) for i, _, _, b in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i].score >= 0.5) == (b == 1) for i, b in held) and got[900].score == got[901].score < 0.5
    assert None in thresholds and toxicity.train(docs, labels.limit(0))[0] is None


def test_sample_has_every_label(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 1500}") for i in range(6000)] + [(None, "x", "l0"), (7, None, "l7"), (8, "long " * 99, "l8")], "doc_id long, text string, lang string")
    got = labelled_sample(docs, "lang", 2, "doc_id", 100, ["doc_id", "text", "lang"])
    count = {}
    for r in got:
        count[r.lang] = count.get(r.lang, 0) + 1
    usable = {f"l{i % 1500}" for i in range(6000) if zlib.crc32(str(i).encode()) % 5}
    assert set(count) == usable and max(count.values()) <= 2 and all(len(r.text) < 100 for r in got)
    few = labelled_sample(docs.withColumn("lang", F.lit("one")), "lang", 5, "doc_id", 100, ["doc_id"])
    assert len(few) == 5 and few == labelled_sample(docs.withColumn("lang", F.lit("one")).repartition(7), "lang", 5, "doc_id", 100, ["doc_id"])


def test_folds(spark):
    rows = spark.range(50).withColumn("f", fold_of(F.col("id"))).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """A mark that one row of thousands has, in a text of more than 64 KB, is learned; shards make one model, however rows are dealt."""
    rng = random.Random(3)
    rows = [(i, words(rng, 8), "aa", i % 2) for i in range(1, 400)]
    docs = spark.createDataFrame([(i, t + (" vilestuff" if bad else "") + " end", x) for i, t, x, bad in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, b) for i, *_, b in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 50)
    model, thresholds = toxicity.train(docs, labels)
    again, same = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.weights(), again.weights()) and thresholds == same
    score = lambda m, t: float(m.score(m.pooled(t)))
    assert score(model, "alphax vilestuff") > 0.5 > score(model, "alphax")
    long = spark.createDataFrame([(i, t + " end" + (" vilestuff" + " golfy" * 12_000 if bad else ""), x) for i, t, x, bad in rows[:60]], "doc_id long, text string, lang string")
    far, _ = toxicity.train(long, labels)
    seen = toxicity._started(toxicity.cut_to_table(toxicity._features(long.join(labels, "doc_id").selectExpr("toxic", "lang", "false AS held", "0 AS shard", "doc_id AS turn", "text"))))
    assert seen.table[toxicity.document("vilestuff")[0, 0], 0] > 0.3 and score(far, "vilestuff") > score(far, "alphax")


def test_toxicity_thresholds(spark):
    n = np.zeros((toxicity.STEPS + 1, 2), np.int64)
    n[100, 0], n[300, 1], n[700, 1] = 9, 4, 4
    assert toxicity._threshold(n) == 0.3
    n[100, 0], n[300, 1] = 0, 0
    assert toxicity._threshold(n) == 0.5
