"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form each belongs to.

Of two words that are one edit apart the shorter (of equal lengths: either) is cut into two disjoint
chunks.  The edit falls into one of them, so the other stands unchanged in the other word, at most one
place further on.  A word therefore gives its two chunks, and gives, for every length a partner may have,
the grams of those lengths at the places within shift one; equal keys are joined and each pair is verified.
Chunks that too many words share (an ending, say) are not joined as they are: the part of the word that
may hold the edit is cut in two again, so the key grows by the half that stays, until few words share it
or the part is a single character.  Every pair still meets, and no key joins more words than the bound or
the characters that can stand in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut_to_table

#: Characters of a word: Latin letters and the block U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: A word has at least so many characters and occurrences; a form has at least so many times the word's.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 6, 5, 5
#: Words that share a key are joined if there are at most so many; more share a longer key.
SHARED = 48
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["length", "low", "high", "kept"]


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``key`` and ``word``, a row for each maximal run of at least ``least`` letters, A-Z lower-cased.  Null texts have none."""
    found = docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    return found.select("key", lower_ascii(F.col("run")).alias("word"))


def with_slips(words: DataFrame, every: int) -> DataFrame:
    """``words`` (key, word) in which some words lack one character.

    With h the crc32 of ``<key>:<word>``, a word whose h is divisible by ``every`` loses the character at
    h % length.  A word with a null key loses none.
    """
    h = F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    place = (F.col("h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.char_length("word")))
    return words.withColumn("h", h).select("key", F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and its occurrences ``n``, of words long and frequent enough."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """The two longer keys of each row, whose word may differ from its partner's within [low, high) of the shorter.

    ``more`` is 1 for a word that stands for the longer of two lengths, ``length`` the shorter's.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    part = F.explode(F.array(F.struct(F.col("low").alias("low"), F.col("middle").alias("high")), F.struct(F.col("middle").alias("low"), F.col("high").alias("high"))))
    cut = rows.withColumn("middle", middle).withColumn("part", part).select("word", "n", "more", "length", "part.low", "part.high")
    kept = F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit(" "), F.substring("word", F.col("high") + F.col("more") + 1, F.char_length("word")))
    return cut.withColumn("kept", kept)


def near_pairs(words: DataFrame, shared: int = SHARED) -> DataFrame:
    """``a``, ``n_a``, ``b``, ``n_b``: each pair of words (``word``, ``n``, distinct) one edit apart, once."""
    size = F.char_length("word").cast("int")
    as_short = words.select("word", "n", F.lit(0).alias("more"), size.alias("length"))
    as_long = words.select("word", "n", F.lit(1).alias("more"), (size - 1).alias("length"))
    rows = as_short.union(as_long).where("length > 0").withColumns({"low": F.lit(0), "high": F.col("length")})
    met = []
    while True:
        keyed = cut_to_table(_halves(rows))
        # a row for each key; a key of one word, or of none that may be the shorter, joins nothing
        sizes = keyed.groupBy(*_KEY).agg(F.count("*").alias("members"), F.sum(1 - F.col("more")).alias("short")).where("members > 1 AND short > 0")
        marked = cut_to_table(keyed.join(sizes.select(*_KEY, ((F.col("members") <= shared) | (F.col("high") - F.col("low") < 2)).alias("last")), _KEY))
        few = marked.where("last")
        x = few.where("more = 0").select(*_KEY, F.col("word").alias("a"), F.col("n").alias("n_a"))
        y = few.select(*_KEY, "more", F.col("word").alias("b"), F.col("n").alias("n_b"))
        pairs = x.join(y, _KEY).where(((F.col("more") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        met.append(pairs.select("a", "n_a", "b", "n_b"))
        rows = marked.where("NOT last").drop("kept", "last")
        if rows.isEmpty():
            return reduce(DataFrame.union, met).distinct()


def forms(words: DataFrame, times: int = FORM_TIMES, shared: int = SHARED) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of words (``word``, ``n``).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is at least
    ``times`` the word's n; ``root`` is the last word that forms lead to, the word itself without one.
    Rows of one word are added up; null words take no part; an empty table gives an empty result.
    """
    words = cut_to_table(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    pairs = cut_to_table(near_pairs(words, shared))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    whole = words.join(best, "word", "left").withColumn("good", -F.col("best.m") >= times * F.col("n"))
    whole = cut_to_table(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("good"), F.col("best.near")).alias("form"), F.when(F.col("good"), -F.col("best.m")).alias("form_n")))
    led = whole.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # each step doubles how far a root has been followed; n grows along a chain, so it ends
        led = cut_to_table(led)
        further = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if led.join(further, "root", "left_semi").isEmpty():
            break
        led = led.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return whole.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` texts, with planted slips, and their forms."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = forms(counted(with_slips(runs(docs), 199)))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = """
WITH RECURSIVE grid AS (
  SELECT i AS byte, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM grid WHERE step < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM grid WHERE step = 8),
run AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents
), occ AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM run WHERE length(r) >= 6 GROUP BY ALL
), hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda ch:
        CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [(192 | (ord(ch) >> 6))::BIGINT, (128 | (ord(ch) & 63))::BIGINT] END))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM occ, crc
), slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM hashed
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
  SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), edges AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT h.word, v.word, v.n FROM holes h JOIN v ON h.rest = v.word
  UNION SELECT DISTINCT v.word, h.word, h.n FROM holes h JOIN v ON h.rest = v.word
), best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY m DESC, encode(b)) AS near, max(m) AS m FROM edges GROUP BY a
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN near END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain c USING (word) JOIN f AS last ON last.word = c.at AND last.form IS NULL
"""
