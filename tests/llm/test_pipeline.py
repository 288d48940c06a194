"""The pipeline's stages on a small table against plain rules."""

import hashlib
import random

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, text(rng.randint(30, 90)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(5)]  # exact copies
    rows += [(200 + i, text(40) + " " + passage + " " + text(40), "en", "s2") for i in range(3)]
    rows += [(300, None, "en", "s0"), (301, "123 456", "en", "s0"), (302, "", None, None)]
    docs = spark.createDataFrame([(i, t, x, s, len(t or "")) for i, t, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert ids["language_id"] == {i for i, *_ in rows} - {300, 301, 302}
    assert ids["near_dedup"] == ids["language_id"] - set(range(100, 105))
    assert ids["repeat_removal"] == ids["near_dedup"]
    whole = dict((i, t) for i, t, *_ in rows)
    for r in kept["repeat_removal"]:
        assert r.n_chars == len(r.text)
        assert (passage not in r.text and len(r.text) > 100) if r.doc_id >= 200 else r.text == whole[r.doc_id]
    assert ids["source_mix"] <= ids["repeat_removal"]
    mixed = {r.doc_id: r.text for r in kept["source_mix"]}
    assert len(kept["encode"]) == len(kept["source_mix"])
    for r in kept["encode"]:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(mixed[r.doc_id].encode()).hexdigest()


def test_run_is_all_stages(spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "repeat_removal", "source_mix", "encode"]
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
