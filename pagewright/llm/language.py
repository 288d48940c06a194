"""Language ID: a linear-chain conditional random field labels the words of code-switched text.

Features of a word are hashed affixes, letter n-grams and the word itself (the lexicon); transitions are
learned.  Forward-backward gives each word's chances, and a text's language is the one with the most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .text_hash import small_batches
from .word_features import Words, fold_of, labelled_sample, pieces

#: Parameters: texts learned from at most, of each language, and bytes of a text at most.
SAMPLE, SAMPLE_BYTES = 300, 1 << 14
BITS, AFFIXES, GRAMS = 16, (1, 2, 3), (3,)
#: Sequences of so many words, made of runs of two languages, so that switching is learned.
LENGTH, STEPS, SEQUENCES = 48, 160, 64
_LETTER = regex.compile(r"\p{L}")


def _features(w: Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows of the weight table: some for each word, and n-grams with the words that hold them."""
    cut = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int64)
    fixed = np.stack([cut(w.whole()), *[cut(w.prefix(n)) for n in AFFIXES], *[cut(w.suffix(n)) for n in AFFIXES]], 1)
    grams = []
    for n in GRAMS:
        h, word = w.grams(n)
        grams.append((cut(h), word))
    return fixed, grams


class Tagger:
    """Weights of features and transitions for each language."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.weights = np.zeros((1 << BITS, len(langs)), np.float32)
        self.moves = np.eye(len(langs))

    def emissions(self, data: np.ndarray) -> np.ndarray:
        """The sum of a word's weights, for each word of a piece."""
        w = Words(data)
        out = np.zeros((len(w), len(self.langs)))
        if len(w):
            fixed, grams = _features(w)
            for k in range(fixed.shape[1]):
                out += self.weights[fixed[:, k]]
            for ids, word in grams:
                total = np.zeros((len(ids) + 1, len(self.langs)))
                np.cumsum(self.weights[ids], 0, out=total[1:])
                end = np.searchsorted(word, np.arange(len(w)), "right")
                out += total[end] - total[np.searchsorted(word, np.arange(len(w)), "left")]
        return out

    def chances(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Each word's chance of each language, by forward-backward over all sequences in step."""
        size = np.array([len(s) for s in sequences])
        turn = np.argsort(-size, kind="stable")
        size = size[turn]
        start = np.cumsum(size) - size
        total, k = int(size.sum()), len(self.langs)
        if not total:
            return [np.zeros((0, k))] * len(sequences)
        e = np.concatenate([sequences[i] for i in turn])
        e = np.exp(e - e.max(1, keepdims=True))
        move = np.exp(self.moves - self.moves.max())
        ahead, back = np.empty((total, k)), np.empty((total, k))
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than t
        for t in range(int(size[0])):
            n = live[t]
            at = start[:n] + t
            a = e[at] if t == 0 else (a[:n] @ move) * e[at]
            a = a / a.sum(1, keepdims=True)
            ahead[at] = a
        b = np.empty((0, k))
        for t in range(int(size[0]) - 1, -1, -1):
            n = live[t]
            at = start[:n] + t
            new = np.ones((n, k))
            if len(b):
                new[: len(b)] = (b * e[at[: len(b)] + 1]) @ move.T
            b = new / new.sum(1, keepdims=True)
            back[at] = b
        both = ahead * back
        both /= both.sum(1, keepdims=True)
        out = [None] * len(sequences)
        for rank, i in enumerate(turn):
            out[i] = both[start[rank] : start[rank] + size[rank]]
        return out

    def fit(self, texts: list[list[np.ndarray]], seed: int = 5) -> None:
        """Likelihood gradient steps; ``texts`` has the texts' pieces of each language."""
        rng = np.random.default_rng(seed)
        k = len(self.langs)
        pools = []
        for own in texts:
            fixed, grams, base = [], [], 0
            for data in own:
                w = Words(data)
                if len(w):
                    f, g = _features(w)
                    fixed.append(f)
                    grams.append([(ids, word + base) for ids, word in g])
                    base += len(w)
            ids = [np.concatenate([g[j][0] for g in grams]) for j in range(len(GRAMS))] if grams else []
            word = [np.concatenate([g[j][1] for g in grams]) for j in range(len(GRAMS))] if grams else []
            edges = [np.searchsorted(x, np.arange(base + 1)) for x in word]
            pools.append((np.concatenate(fixed) if fixed else None, ids, edges, base))
        usable = [i for i in range(k) if pools[i][3] > LENGTH]
        if not usable:
            return
        square = np.full(self.weights.shape, 1e-6, np.float32)
        for step in range(STEPS):
            rows, owner, label = [], [], []
            for s in range(SEQUENCES):
                one, two = rng.choice(usable, 2)
                cut = LENGTH if rng.random() < 0.4 else int(rng.integers(1, LENGTH))
                for lang, a, n in ((one, s * LENGTH, cut), (two, s * LENGTH + cut, LENGTH - cut)):
                    if not n:
                        continue
                    fixed, ids, edges, base = pools[lang]
                    at = int(rng.integers(0, base - n + 1))
                    rows.append(fixed[at : at + n].ravel())
                    owner.append(np.repeat(np.arange(a, a + n), fixed.shape[1]))
                    for g in range(len(ids)):
                        lo, hi = edges[g][at], edges[g][at + n]
                        rows.append(ids[g][lo:hi])
                        owner.append(a + np.repeat(np.arange(n), np.diff(edges[g][at : at + n + 1])))
                    label += [lang] * n
            rows, owner, label = np.concatenate(rows), np.concatenate(owner), np.array(label)
            e = np.zeros((len(label), k))
            np.add.at(e, owner, self.weights[rows])
            e = e.reshape(SEQUENCES, LENGTH, k)
            goal = np.eye(k)[label].reshape(SEQUENCES, LENGTH, k)
            x, move = np.exp(e - e.max(2, keepdims=True)), np.exp(self.moves - self.moves.max())
            ahead, back = np.empty_like(x), np.ones_like(x)
            for t in range(LENGTH):
                a = x[:, t] if t == 0 else (ahead[:, t - 1] @ move) * x[:, t]
                ahead[:, t] = a / a.sum(1, keepdims=True)
            pair = np.zeros((k, k))
            for t in range(LENGTH - 2, -1, -1):
                b = back[:, t + 1] * x[:, t + 1]
                joint = ahead[:, t, :, None] * move * b[:, None, :]
                pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                b = b @ move.T
                back[:, t] = b / b.sum(1, keepdims=True)
            seen = ahead * back
            seen /= seen.sum(2, keepdims=True)
            seen_moves = np.einsum("stk,stl->kl", goal[:, :-1], goal[:, 1:])
            self.moves += 0.5 * (seen_moves - pair) / (SEQUENCES * LENGTH) * k
            wrong = (goal - seen).reshape(-1, k)[owner].astype(np.float32)
            grad = np.zeros_like(self.weights)
            np.add.at(grad, rows, wrong)
            square += grad * grad
            self.weights += 0.15 * grad / np.sqrt(square)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float, list[tuple[str, int, int]]]]:
        """Of whole texts: the language with the greatest share of its words' chances, that share, how sure
        the labels of the words are (the mean of each word's greatest chance), and runs of words of one
        label (language, first word, words).  ``und``, 0, 0 and no runs for texts without a letter."""
        out: list = [("und", 0.0, 0.0, [])] * len(texts)
        if not self.langs:
            return out
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        found = []
        for i in some:
            parts = [self.emissions(p) for p in pieces(texts[i])]
            found.append(np.concatenate(parts) if parts else np.zeros((0, len(self.langs))))
        for i, chance in zip(some, self.chances(found), strict=True):
            if not len(chance):  # letters of no word: all languages are alike
                out[i] = (self.langs[0], 1 / len(self.langs), 1 / len(self.langs), [])
                continue
            mean, label = chance.mean(0), chance.argmax(1)
            best = int(mean.argmax())
            first = np.append(0, np.flatnonzero(np.diff(label)) + 1)
            runs = [(self.langs[x], a, n) for x, a, n in zip(label[first].tolist(), first.tolist(), np.diff(np.append(first, len(label))).tolist(), strict=True)]
            out[i] = (self.langs[best], float(mean[best]), float(chance.max(1).mean()), runs)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of whole texts."""
        return [x[:2] for x in self.judge(texts)]


def train(docs: DataFrame, key: str = "doc_id", lang: str = "lang", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Tagger:
    """A tagger of the languages of ``docs``, learned from a bounded sample of each; only keys outside
    fold 0 are learned from.  Without labelled texts it knows no language."""
    rows = labelled_sample(docs.select(F.col(key), "text", F.col(lang).alias("lang")), "lang", sample, key, most_bytes, ["text", "lang"])
    langs = sorted({r.lang for r in rows})
    tagger = Tagger(langs)
    tagger.fit([[p for r in rows if r.lang == x for p in pieces(r.text)] for x in langs])
    return tagger


def identify(docs: DataFrame, tagger: Tagger, text: str = "text", keep: list[str] | None = None, runs: bool = False) -> DataFrame:
    """``docs``'s columns ``keep`` with ``lang_pred``, ``score`` and ``sure``; with ``runs`` also ``runs``.

    ``score`` is the share of the words' chances that the language has, ``sure`` the mean of each word's
    greatest chance (high for code-switched text with clear words), ``runs`` the runs of words of one
    label: an array of (lang, first, words), words counted from 0.  ``und`` with score 0: null texts, texts
    without a letter, and all texts if no language is known.  Rows are judged one by one, so null keys and
    repeated rows are kept as they are; columns named like the results are not kept.
    """
    small_batches(docs.sparkSession)
    names = ["lang_pred", "score", "sure", *(["runs"] if runs else [])]
    keep = [c for c in (keep or docs.columns) if c not in names]
    table = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    known = docs.sparkSession.sparkContext.broadcast(tagger)  # a table of fixed size
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches):
        for b in batches:
            found = known.value.judge(b.column("_text").to_pylist())
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())]
            if runs:
                more.append(pa.array([[dict(zip(("lang", "first", "words"), r, strict=True)) for r in x[3]] for x in found], run_type))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], *names])

    kinds = [f"_k{i} {kind}" for i, (_, kind) in enumerate(table.drop("_text").dtypes)]
    made = table.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, sure double", *(["runs array<struct<lang:string,first:int,words:int>>"] if runs else [])]))
    return made.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def op6_language(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, train(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "sure")
