"""Collocations: the phrases of two and three words that stand together more often than their parts would.

The counts come from a suffix tree over words, truncated to three of them, that is built in parts.  First
the words are counted (prefixes of one word) and so are buckets of word pairs.  Prefixes are then grouped
until a group holds as many suffixes as memory allows; what begins with a word that is too frequent for
one group is grouped by two words, and by three where two are too frequent as well (vertical partitioning).
Each group builds its own subtree: its suffixes, cut to three words and counted before they are shuffled,
arrive sorted, so they are the leaves in order; a leaf's total is a phrase of three words, the sum of the
leaves below a node a phrase of two.  A task holds one batch of leaves and the node still open.

Words are known by 64-bit hashes of language and word, which are checked to be distinct.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut_to_table, partitions
from .text_hash import U64, _LOWER, column_bytes, hash_words, mix64, small_batches

#: A candidate occurs at least so often; it is dropped if a longer one has at least this percentage of its occurrences.
LEAST, SHARE = 10, 50
#: Phrases of a language that are returned.
TOP = 2000
#: Suffixes of a group at most (those of one phrase of three words, counted before, excepted).
GROUP = 1 << 20
#: Buckets of prefixes of one word and of two; their totals are all that the driver sees.
BUCKETS = 4096
#: Bytes of text cut into words at once, at the end of a piece; words that a task holds before it counts them.
BLOCK, HELD = 1 << 20, 400_000
#: Slices of a language that rank their phrases before the language does.
SLICES = 64

_PIECE, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_PIECE[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP[[*b" \t"]] = True


def _blocks(ends: np.ndarray, data: np.ndarray):
    """Parts [from, to) of a batch's bytes of about BLOCK, cut where a text or a piece ends; a piece is not cut."""
    at = 0
    while at < len(data):
        to = at + BLOCK
        if to >= len(data):
            to = len(data)
        elif (k := np.searchsorted(ends, to, "right") - 1) >= 0 and ends[k] > at:
            to = int(ends[k])
        else:
            last = np.flatnonzero(_PIECE[data[at:to]])
            if len(last):
                to = at + int(last[-1]) + 1
            else:
                end = int(ends[np.searchsorted(ends, to, "right")])
                ahead = np.flatnonzero(_PIECE[data[to:end]])
                to = to + int(ahead[0]) + 1 if len(ahead) else end
        yield at, to
        at = to


def _words(batch: pa.RecordBatch, seed: int):
    """For each block of a batch (lang, text): its bytes, starts and ends of words, their language (a place in the
    list of languages), id, and the number of the piece that they stand in."""
    data, off = column_bytes(batch.column("text"))
    coded = batch.column("lang").dictionary_encode()
    names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], U64)
    table = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(seed))[_LOWER]
    for a, b in _blocks(off[1:], data):
        part = data[a:b]
        ends_piece = _PIECE[part]
        ink = ~(ends_piece | _GAP[part])
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        cuts = off[(off > a) & (off < b)] - a
        first[cuts] |= ink[cuts]
        last[cuts - 1] |= ink[cuts - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        text = np.searchsorted(off, starts + a, "right") - 1
        lang = which[text]
        ids = mix64(hash_words(part, starts, stops, table) ^ salt[lang]) if len(starts) else np.empty(0, U64)
        ids[ids == 0] = 1
        yield part, starts, stops, names, lang, ids, np.cumsum(ends_piece)[starts] + text


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * U64(0x9E3779B97F4A7C15) + mix64(b))


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> U64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _lists(batches, seed: int):
    """Words and pairs of a task: (languages, words, ids, counts) of what about HELD words hold, and pairs by bucket at the end."""
    pairs = np.zeros(BUCKETS, np.int64)
    held, total = [], 0

    def counted():
        ids, lang, word, n = (np.concatenate([h[k] for h in held]) for k in range(4))
        ids, at, back = np.unique(ids, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang[at], pa.string()), pa.array(word[at], pa.string()), pa.array(ids.view(np.int64)), pa.array(np.bincount(back, n).astype(np.int64)), pa.nulls(len(ids), pa.int32())],
            names=["lang", "word", "id", "n", "bucket"],
        )

    for batch in batches:
        for part, starts, stops, names, lang, ids, piece in _words(batch, seed):
            if not len(ids):
                continue
            together = piece[1:] == piece[:-1]
            pairs += np.bincount(_bucket(_pair(ids[:-1][together], ids[1:][together])), minlength=BUCKETS)
            own, at, n = np.unique(ids, return_index=True, return_counts=True)
            low = _LOWER[part].tobytes()
            word = np.array([low[s:e].decode() for s, e in zip(starts[at], stops[at], strict=True)], object)
            held.append((own, np.array(names, object)[lang[at]], word, n))
            total += len(own)
            if total >= HELD // 2:
                yield counted()
                held, total = [], 0
    if held:
        yield counted()
    some = np.flatnonzero(pairs)
    pa.default_memory_pool().release_unused()
    yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int64()), pa.array(pairs[some]), pa.array(some.astype(np.int32))], names=["lang", "word", "id", "n", "bucket"])


class Groups:
    """Which group a suffix belongs to, from the totals of the buckets of one word and of two."""

    def __init__(self, ones: np.ndarray, twos: np.ndarray, most: int):
        def packed(totals):  # neighbouring buckets until a group is full; -1 for those that fill more than one
            place, group, room = np.full(BUCKETS, -1), -1, 0
            for i, n in enumerate(totals.tolist()):
                if n <= most:
                    if n > room or group < 0:
                        group, room = group + 1, most
                    place[i], room = group, room - n
            return place, group + 1

        (self.one, k), (self.two, m) = packed(ones), packed(twos)
        self.two, self.whole = np.where(self.two >= 0, self.two + k, -1), k + m  # groups from ``whole`` on hold parts of pairs
        self.split = max(1, -(-int(twos[twos > most].sum()) // most))

    def of(self, a, b, c):
        out = self.one[_bucket(a)]
        hot = np.flatnonzero(out < 0)
        pair = _pair(a[hot], b[hot])
        out[hot] = self.two[_bucket(pair)]
        rest = out[hot] < 0
        out[hot[rest]] = self.whole + (_pair(pair[rest], c[hot[rest]]) % U64(self.split)).astype(np.int64)
        return out


def _suffixes(batches, seed: int, groups: Groups):
    """Suffixes of two words at least, cut to three (0: the piece has no more), counted, with their groups."""
    held, total = [], 0

    def counted():
        own, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        k = U64(len(own) + 1)
        at, code = 0, []
        for ids, follows, own_rows in held:
            x = back[at : at + len(ids)].astype(U64) + U64(1)
            y = np.where(follows, np.append(x[1:], U64(0)), U64(0))
            z = np.where(follows, np.append(y[1:], U64(0)), U64(0))
            code.append(((x * k + y) * k + z)[:own_rows][follows[:own_rows]])
            at += len(ids)
        code, n = np.unique(np.concatenate(code), return_counts=True)
        own = np.append(U64(0), own)
        x, y, z = own[code // k // k], own[code // k % k], own[code % k]
        group = groups.of(x, y, z).astype(np.int32)
        for i in range(0, len(code), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(group[j]), *(pa.array(v[j].view(np.int64)) for v in (x, y, z)), pa.array(n[j].astype(np.int64))], names=["part", "a", "b", "c", "n"])

    for batch in batches:
        for _, _, _, _, _, ids, piece in _words(batch, seed):
            for s in range(0, len(ids), HELD):  # the two words after it come along
                own, part = ids[s : s + HELD + 2], piece[s : s + HELD + 2]
                held.append((own, np.append(part[1:] == part[:-1], False), HELD))
                total += len(own)
                if total >= HELD:
                    yield from counted()
                    held, total = [], 0
    if held:
        yield from counted()
    pa.default_memory_pool().release_unused()


def _subtrees(batches, least: int, whole: int):
    """Nodes of the subtrees whose leaves (part, a, b, c, n) come in order: (a, b, null, n) and (a, b, c, n).

    Nodes of fewer than ``least`` are left out, but not pairs of parts from ``whole`` on, which go on elsewhere.
    """
    names = ["a", "b", "c", "n"]
    open_leaf = open_node = None

    def runs(keys, n, carried):
        """Sums of equal neighbours, with the run that the batch before left open; the last run stays open."""
        keys, n = (np.concatenate([[c], x]) for c, x in zip(carried[0], keys, strict=True)) if carried else keys, np.append(carried[1], n) if carried else n
        keys = list(keys)
        new = np.zeros(len(n), bool)
        new[0] = True
        for x in keys:
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new)
        keys, n = [x[at] for x in keys], np.add.reduceat(n, at)
        return [x[:-1] for x in keys], n[:-1], ([x[-1] for x in keys], n[-1])

    def rows(a, b, c, n, part):
        good = (n >= least) & (c != 0) if c is not None else (n >= least) | (part >= whole)
        arrays = [pa.array(a[good]), pa.array(b[good]), pa.array(c[good]) if c is not None else pa.nulls(int(good.sum()), pa.int64()), pa.array(n[good])]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        if batch.num_rows:
            part, a, b, c, n = (batch.column(x).to_numpy() for x in ("part", *names))
            leaf, m, open_leaf = runs([a, b, c], n, open_leaf)
            yield rows(*leaf, m, None)
            (a, b, part), m, open_node = runs([a, b, part], n, open_node)
            yield rows(a, b, None, m, part)
    if open_leaf:
        (a, b, c), n = open_leaf
        yield rows(*(np.array([x]) for x in (a, b, c, n)), None)
        (a, b, part), n = open_node
        yield rows(*(np.array([x]) for x in (a, b)), None, np.array([n]), np.array([part]))


def counts(docs: DataFrame, least: int = LEAST, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` (lang, text): words (id, lang, word, n), pairs (a, b, n) and triples (a, b, c, n) of ids.

    Words are all of them, pairs and triples those that occur at least ``least`` times within pieces.
    A group has at most ``most`` suffixes: GROUP, or fewer, so that each partition gets several groups.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in range(8):
        listed = cut_to_table(docs.mapInArrow(lambda batches, seed=seed: _lists(batches, seed), "lang string, word string, id long, n long, bucket int"))
        words = cut_to_table(listed.where("bucket IS NULL").groupBy("lang", "word", "id").agg(F.sum("n").alias("n")))
        if not (words.groupBy("id").count().where("count > 1").isEmpty()):
            continue  # two words have one hash: another hash is taken
        break
    else:
        raise ValueError("no hash tells all words apart")
    ones, twos = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    top = F.shiftrightunsigned("id", 64 - BUCKETS.bit_length() + 1).cast("int")
    for to, totals in ((ones, words.groupBy(top.alias("bucket")).agg(F.sum("n").alias("n"))), (twos, listed.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")))):
        for r in totals.collect():  # BUCKETS rows at most
            to[r.bucket] = r.n
    n_parts = partitions(spark)
    groups = Groups(ones, twos, most or max(1, min(GROUP, int(ones.sum()) // (8 * n_parts))))
    suffixes = docs.mapInArrow(lambda batches: _suffixes(batches, seed, groups), "part int, a long, b long, c long, n long")
    sorted_leaves = suffixes.repartition(n_parts, "part").sortWithinPartitions("a", "b", "c", "part")
    nodes = cut_to_table(sorted_leaves.mapInArrow(lambda batches: _subtrees(batches, least, groups.whole), "a long, b long, c long, n long"))
    pairs = nodes.where("c IS NULL").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, pairs, nodes.where("c IS NOT NULL")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) of columns; decimals of 38 digits hold the products of counts up to 10^16."""
    a, left, right = (f"CAST({x} AS DECIMAL(38, 0))" for x in (a, left, right))
    return F.expr(f"(CAST(1000000 AS DECIMAL(38, 0)) * {a} * {a}) div ({left} * {right})")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, most: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two or three words.

    A phrase is scored at the cut where a * a / (l * r) is least (ties: after the fewest words), with a, l and
    r the occurrences of the phrase, of what stands before the cut and after it, in pieces of texts that end at
    ``. , ; : ! ?`` and line ends.  Phrases of two words of which one of three keeps ``share`` percent go.
    Order: score and a descending, phrase ascending.  Null texts are empty; a null language is ``und``; equal
    rows count each; a table without words gives no rows.  Other columns of ``docs`` are not looked at.
    """
    words, pairs, triples = counts(docs, least, most)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    often = words.where(F.col("n") >= least)
    pairs, triples = cut_to_table(pairs), cut_to_table(triples)

    def word(k):
        return often.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"n_{k}"))

    def pair(x, y):
        return pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(f"n_{x}{y}"))

    inside = triples.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), "n").groupBy("p.a", "p.b").agg(F.max("n").alias("longer"))
    two = pairs.join(inside, ["a", "b"], "left").where("longer IS NULL OR 100 * longer < %d * n" % share)
    first = often.select(F.col("id").alias("a"), "lang", F.col("word").alias("a_word"), F.col("n").alias("n_a"))
    two = two.join(first, "a").join(word("b"), "b").select("lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("n").alias("a"), F.col("n_a").alias("l"), F.col("n_b").alias("r"), _score("n", "n_a", "n_b").alias("score"))
    three = triples.join(pair("b", "c"), ["b", "c"]).join(pair("a", "b"), ["a", "b"]).join(first, "a").join(word("b"), "b").join(word("c"), "c")
    three = three.withColumns({"s1": _score("n", "n_a", "n_bc"), "s2": _score("n", "n_ab", "n_c")})
    late = F.col("s2") < F.col("s1")
    three = three.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), F.col("n").alias("a"), F.when(late, F.col("n_ab")).otherwise(F.col("n_a")).alias("l"), F.when(late, F.col("n_c")).otherwise(F.col("n_bc")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slice_ = F.pmod(F.xxhash64("phrase"), F.lit(SLICES))
    best = two.union(three).withColumn("rank", F.row_number().over(Window.partitionBy("lang", slice_).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_lang").alias("n"), "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), u AS (
  SELECT lang, x AS phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL
), p AS (
  SELECT lang, w[i] || ' ' || w[i + 1] AS phrase, w[i] AS x, w[i + 1] AS y, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10
), t AS (
  SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10
), cut AS (
  SELECT p.lang, p.phrase, 1 AS k, p.f AS a, l.f AS l, r.f AS r FROM p JOIN u l ON l.lang = p.lang AND l.phrase = x JOIN u r ON r.lang = p.lang AND r.phrase = y
  WHERE NOT EXISTS (FROM t WHERE t.lang = p.lang AND (t.x || ' ' || t.y = p.phrase OR t.y || ' ' || t.z = p.phrase) AND 100 * t.f >= 50 * p.f)
  UNION ALL SELECT t.lang, t.phrase, 1, t.f, l.f, r.f FROM t JOIN u l ON l.lang = t.lang AND l.phrase = t.x JOIN p r ON r.lang = t.lang AND r.phrase = t.y || ' ' || t.z
  UNION ALL SELECT t.lang, t.phrase, 2, t.f, l.f, r.f FROM t JOIN p l ON l.lang = t.lang AND l.phrase = t.x || ' ' || t.y JOIN u r ON r.lang = t.lang AND r.phrase = t.z
), scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM best JOIN (SELECT lang, sum(f) AS n FROM u GROUP BY lang) USING (lang) QUALIFY rank <= 2000
"""
