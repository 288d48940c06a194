"""MinHash near-dedup with circulant signatures.

One permutation scatters the shingles, a second one, circularly shifted by 0, 1, 2, ..., gives all
coordinates of the signature.  Coordinates are cut into bands; documents that agree on a band are
candidates, and each link is confirmed on the full shingle sets.  Documents of equal sets are one node
of the graph, and a bucket is searched by comparing its members to few leaders, so groups of copies
never become all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut_lineage, partitions
from .components import components
from .text_hash import U64, mix64, shingle_set, small_batches, texts_words

#: Parameters: a pair of likeness 0.8 misses all of 32 bands of 5 with a chance of 3 in a million.
BANDS, ROWS = 32, 5
#: Partners of a leader that are compared in one task.
FAN = 64
#: Members of a block where a group is compared within; a task holds two blocks.
BLOCK = 256
#: Keys that are sought or dropped are broadcast if there are at most so many (8 bytes each).
BROADCAST_KEYS = 1_000_000


def _permute(x: np.ndarray) -> None:
    """The second permutation: a bijection of 32-bit words, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x7FEB352D)
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= np.uint32(0x846CA68B)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t


def signature(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """``n`` coordinates: the least of the second permutation, shifted by k, over the first one's places."""
    places = (mix64(shingles) >> U64(32)).astype(np.uint32)
    shifts = np.arange(n, dtype=np.uint32)[:, None]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(places), 512):
        block = places[None, a : a + 512] + shifts
        _permute(block)
        np.minimum(out, block.min(1), out=out)
    return out


def band_keys(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band."""
    rows = coordinates.reshape(bands, -1).astype(U64)
    key = np.arange(1, bands + 1, dtype=U64)
    for j in range(rows.shape[1]):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    a, b = mix64(s + U64(1)).sum(dtype=U64), mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _signed(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """id, n_shingles, s1, s2, bands of each row."""
    table = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            n, s1, s2, bands = [], [], [], []
            for words in texts_words(b.column("text")):
                s = shingle_set(words, width)
                n.append(len(s))
                one, two = _set_key(s) if len(s) else (None, None)
                s1.append(one)
                s2.append(two)
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "s1", "s2", "bands"],
            )

    return table.mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """id and shingle set (8 bytes each) of the rows of ``docs`` whose id is in ``ids``."""
    ids = cut_lineage(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
    table = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")

    def run(batches):
        for b in batches:
            sets = [shingle_set(words, width).tobytes() for words in texts_words(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return table.mapInArrow(run, "id long, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    A leader's partners are dealt over groups of about ``FAN``; each group streams the leader's set and
    then its partners'.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("long").alias("n"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).alias("salt"))
    own = sets.withColumnsRenamed({"id": "b"})
    partners = salted.join(own, "b").select("a", "salt", F.lit(1).alias("turn"), "b", "shingles")
    leaders = salted.select("a", "salt").distinct().join(sets.withColumnsRenamed({"id": "a"}), "a").select("a", "salt", F.lit(0).alias("turn"), F.col("a").alias("b"), "shingles")
    dealt = leaders.union(partners).repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "turn")

    def run(batches):
        held, leader = None, []
        for b in batches:
            found = []
            for a, salt, turn, other, raw in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                s = np.frombuffer(raw.as_py(), U64)
                if (a, salt) != held:
                    held, leader = (a, salt), []
                if turn == 0:
                    leader.append(s)
                    continue
                for x in leader:
                    small, large = sorted((len(x), len(s)))
                    if 100 * small < percent * large:
                        continue
                    both = len(np.intersect1d(x, s, assume_unique=True))
                    if 100 * both >= percent * (small + large - both):
                        found.append((a, other))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _compare(rows: list[tuple], same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between the two blocks of ``rows`` (block, id, component, set), or within the one block.

    Only sets of different components are compared, and a link found joins two components, so the
    links connect what is connected and no more.
    """
    lower = min(r[0] for r in rows)
    probes = [r for r in rows if r[0] == lower]
    others = probes if same else [r for r in rows if r[0] != lower]
    if not others:
        return []
    root = {r[2]: r[2] for r in rows}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    def laid(some: list[tuple]):
        size = np.array([len(r[3]) for r in some])
        return some, size, np.cumsum(size) - size, np.concatenate([r[3] for r in some])

    found = []
    comps, counts = np.unique([r[2] for r in others], return_counts=True)
    main = comps[counts.argmax()]
    all_of, rest_of = laid(others), [r for r in others if r[2] != main]
    rest_of = laid(rest_of) if rest_of else None
    for _, me, comp, own in probes:
        against = rest_of if comp == main else all_of
        if against is None or len(comps) == 1 and comp == main:
            continue
        some, size, start, flat = against
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[at] == flat).astype(np.int64), start)
        for i in np.flatnonzero(100 * both >= percent * (len(own) + size - both)):
            if some[i][1] != me and (x := find(comp)) != (y := find(some[i][2])):
                root[max(x, y)] = min(x, y)
                found.append((me, some[i][1]))
    return found


def _linked_within(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the members (rep, comp) of each group (lead) as all their links do.

    A group is cut into blocks of about ``BLOCK``; each pair of blocks is compared in a task of its own.
    """
    blocks = groups.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("n"))
    placed = groups.join(blocks, "lead").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    spread = spread.select("lead", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp")
    dealt = spread.join(sets.withColumnsRenamed({"id": "rep"}), "rep").select("lead", "i", "j", "block", "rep", "comp", "shingles")
    dealt = dealt.repartition(partitions(groups.sparkSession), "lead", "i", "j").sortWithinPartitions("lead", "i", "j")

    def run(batches):
        held, rows = None, []
        for b in batches:
            found = []
            for lead, i, j, block, rep, comp, raw in zip(*(b.column(k).to_pylist() for k in range(6)), b.column(6), strict=True):
                if (lead, i, j) != held:
                    found += _compare(rows, held[1] == held[2], percent) if rows else []
                    held, rows = (lead, i, j), []
                rows.append((block, rep, comp, np.frombuffer(raw.as_py(), U64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
        found = _compare(rows, held[1] == held[2], percent) if rows else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles are ``width`` words (fewer words: the
    whole sequence), and documents are linked with 100 * intersection >= ``percent`` * union of their
    sets.  ``component_id`` is the least key reachable over links, ``kept`` whether it is the row's own.

    Null and empty texts have no shingles and are linked with nothing.  Rows of null key take no part:
    their component is null and they are kept.  Rows of one key are one document, linked if any of
    their texts is.  Equal texts are linked exactly, other links are found but for the bands' chance.
    """
    small_batches(docs.sparkSession)
    signed = cut_lineage(_signed(docs, key, text, width))
    reps = signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))
    slots = reps.select("rep", F.explode("bands").alias("bucket"))
    lead = slots.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("other")).where("lead <> other").drop("other")
    members = cut_lineage(slots.join(lead, "bucket").select("bucket", "lead", "rep").distinct())
    sets = cut_lineage(_sets(docs, members.select(F.col("rep").alias("id")).distinct(), key, text, width))

    pairs = cut_lineage(members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    links = cut_lineage(_linked(pairs, sets, percent))
    # a key with several sets is one document: its sets' representatives are linked
    several = cut_lineage(signed.where("id IS NOT NULL").select("id", "s1", "s2").distinct().groupBy("id").count().where("count > 1").select("id"))
    repeated = not several.isEmpty()
    if repeated:
        sets_of = signed.where("n_shingles > 0").select("id", "s1", "s2").distinct().join(several, "id").join(reps.select("s1", "s2", "rep"), ["s1", "s2"]).select("id", "rep")
        first = sets_of.groupBy("id").agg(F.min("rep").alias("a"))
        links = cut_lineage(links.union(sets_of.join(first, "id").where("a <> rep").select("a", F.col("rep").alias("b"))).distinct())
    graph = components(links)
    # a leader is compared with all of its buckets; what still has two components is compared in blocks
    named = members.where("rep <> lead").join(graph, F.col("rep") == F.col("node"), "left").select("bucket", "lead", "rep", F.coalesce("component", "rep").alias("comp"))
    open_ = named.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("bucket")
    groups = cut_lineage(named.join(open_, "bucket", "left_semi").select("lead", "rep", "comp").distinct())
    if not groups.isEmpty():
        more = cut_lineage(_linked_within(groups, sets, percent))
        if not more.isEmpty():
            graph = components(links.union(more))
    named = reps.select("s1", "s2", "rep").join(graph, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    if repeated:  # a row without words goes with its key's others
        whole = cut_lineage(rows.join(several, "id").groupBy("id").agg(F.min("component").alias("whole")))
        rows = rows.join(whole, "id", "left").withColumn("component", F.coalesce("whole", "component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose component begins with them: one document of each group, of least key.

    Rows of null key and texts without words all stay.  Of rows of one key that of the least text stays.
    """
    judged = near_duplicates(docs, key, text, width, percent)
    gone = cut_lineage(judged.where(~F.col("kept")).select(key).distinct())
    stay = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti").select(*docs.columns)
    twice = docs.groupBy(key).count().where(f"count > 1 AND `{key}` IS NOT NULL").select(key)
    if twice.isEmpty():
        return stay
    first = F.row_number().over(Window.partitionBy(key).orderBy(text, F.xxhash64(*docs.columns)))
    once = stay.join(twice, key, "left_semi").withColumn("_first", first).where("_first = 1").drop("_first")
    return stay.join(twice, key, "left_anti").unionByName(once)


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` by four-word shingles at a likeness of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=4)
