"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Rules name a host and a path prefix.  Every url is expanded to the canonical keys that a rule could
have (each host suffix with each path prefix of a listed length); the keys are probed against a
blocked Bloom filter of the listed keys and only possible hits reach the exact join, which removes
the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A Bloom filter of at most this many listed keys (48 bytes a block of 16 keys: 24 MB) is broadcast.
BROADCAST_KEYS = 8_000_000
#: An exact list of at most this many rows is broadcast.
BROADCAST_RULES = 100_000
KEYS_PER_BLOCK, LANES = 16, 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _lanes(key: Column) -> list[Column]:
    """The bits of a key in the four 64-bit lanes of its block, two to a lane."""
    h = F.xxhash64(F.lit(17), key)
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * j).bitwiseOR(bit(2 * j + 1)) for j in range(LANES)]


def build_bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """Blocked Bloom filter of ``keys``: one row per non-empty block, its lanes OR-ed together."""
    bits = keys.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *[b.alias(f"lane{j}") for j, b in enumerate(_lanes(F.col(key)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"lane{j}").alias(f"lane{j}") for j in range(LANES)])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``rule`` (host and path prefix, such as ``net/``) and ``verdict``.  A rule fits its
    host and every subdomain if the url's path starts with the rule's path.  The longest rule wins,
    ties go to the smaller rule string and verdict.  Urls that no rule fits get ``default``.

    Null urls and urls without ``://`` have empty host and path and fit no rule.  Repeated rows are
    judged alike and all kept; rules that are null or have no ``/`` fit nothing; columns of ``pages``
    named like the four results are replaced.  Empty tables give empty results or defaults.
    """
    spark = pages.sparkSession
    listed = rules.select(F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict")).where(F.instr("_rule", "/") > 0)
    # path lengths are at most as many as the longest listed path has characters
    lengths = sorted(r[0] for r in listed.select((F.length("_rule") - F.instr("_rule", "/") + 1).alias("n")).distinct().collect())
    n_listed = listed.count()
    n_blocks = max(1, -(-n_listed // KEYS_PER_BLOCK))
    bloom = build_bloom(listed, "_rule", n_blocks)
    if n_listed <= BROADCAST_KEYS:
        bloom = F.broadcast(bloom)
    if n_listed <= BROADCAST_RULES:
        listed = F.broadcast(listed)

    host, path = split_url(F.col(url))
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    out = judged.columns
    parts = F.split(F.col("host"), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    heads = F.array_distinct(F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))) if lengths else F.array().cast("array<string>")
    keys = (
        judged.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("_suffix"), heads.alias("_heads"))
        .select("host", "path", "_suffix", F.explode("_heads").alias("_head"))
        .select("host", "path", F.concat("_suffix", "_head").alias("_key"))
    )
    possible = keys.withColumn("block", F.pmod(F.xxhash64("_key"), F.lit(n_blocks))).join(bloom, "block")
    hit = reduce(lambda a, b: a & b, [F.col(f"lane{j}").bitwiseAND(b) == b for j, b in enumerate(_lanes(F.col("_key")))])
    exact = possible.where(hit).select("host", "path", "_key").join(listed, F.col("_key") == F.col("_rule"))
    best = exact.groupBy("host", "path").agg(F.min(F.struct((-F.length("_rule")).alias("n"), F.col("_rule"), F.col("_verdict"))).alias("_best"))
    best = best.withColumnsRenamed({"host": "_host", "path": "_path"})
    found = judged.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return found.select(*[F.col(f"`{c}`") for c in out], F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))


#: Rules of the registered query.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by ``RULES``; unlisted urls are allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule, verdict) AS (
  VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), k AS (
  SELECT rule, verdict, substr(rule, 1, position('/' IN rule) - 1) AS rhost, substr(rule, position('/' IN rule)) AS rpath FROM r
), f AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM s) JOIN k ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2
)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict FROM s LEFT JOIN f USING (host, path)
"""
