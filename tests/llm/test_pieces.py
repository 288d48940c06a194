"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pagewright.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return pieces.Codec(f.read())


def adversarial(library):
    rng = random.Random(8)
    known = [library.id_to_piece(i) for i in range(259, 32000)]
    out = ["", " ", "  ", "▁", "▁ ▁a", " a", "a ", "\n", "\t x", "<s>", "</s><unk><0x0A>", "\x00", "日本語テキスト", "👩‍👩‍👧‍👦 é", "�\U0010ffff", "x" * 5000, " " * 3000 + "end" + " " * 700]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (1, 2, 3, 100, 4000)]
    out += ["".join(rng.choice(known) for _ in range(rng.randint(1, 40))).replace("▁", rng.choice(["", " ", "▁"])) for _ in range(1500)]
    out += ["".join(rng.choice(" ▁\nabeinorst") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    out += ["".join(rng.choice("abé€") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    return out


def test_encode_and_decode_like_the_library(library, codec):
    texts = adversarial(library)
    expected = library.encode(texts, add_bos=True, add_eos=True)
    got = codec.encode(texts)
    assert [list(x) for x in got] == expected
    assert [codec.decode(x) for x in got] == [library.decode(x) for x in expected]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_the_queue_gives_the_same(library, codec, rounds):
    texts = [t for t in adversarial(library) if t][:1200]
    words = [w for t in texts for w in codec.splitter.findall("▁" + t.replace(" ", "▁"))]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words])
    a = codec.merge(codec.symbol[points], sizes)
    b = codec.merge(codec.symbol[points], sizes, rounds)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_any_ids_decode_like_the_library(library, codec):
    rng = random.Random(9)
    for _ in range(3000):
        low = rng.choice([0, 0, 3, 259])
        ids = [rng.randrange(low, rng.choice([259, 300, 32000]) if low < 259 else 32000) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_rows(spark, library):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "y"), (None, None, None), (2, "", "z"), (3, "Ünïcode ▁ text " * 5000, "w")]
    docs = spark.createDataFrame([(i, t, c, 7) for i, t, c in rows], "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = pieces.encode_texts(docs, MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        expected.append((i, len(ids), ids, sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    back = {(r.doc_id, r.text) for r in pieces.decode_ids(got.union(got.selectExpr("9L", "0L", "null", "null", "null").limit(1)), MODEL).collect()}
    assert back == {(i, (t or "").replace("▁", " ")) for i, t, _ in rows} | {(9, None)}
    assert pieces.encode_texts(docs.limit(0), MODEL).count() == 0
