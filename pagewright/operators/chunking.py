"""Chunks of structured lines: sections, parents and children, procedures, table rows and identifiers.

Every chunk carries its evidence: the lines that its own units were made of, through splitting, packing and
overlap.  Its pages are the pages of its evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..runtime import cut_to_table
from .packing import grouped_lists, grouped_rows, packed

#: Caps in characters, overlap, and steps of a group.
SECTION, PARENT, CHILD, OVERLAP, PROCEDURE, GROUP = 2400, 6000, 1400, 240, 1800, 4
COLUMNS = ["chunk_id", "document_id", "section", "page", "pages", "content", "kind", "strategy", "parent_chunk_id", "overlap_before", "retrieval_profiles", "evidence", "at", "part"]


def chunk_id(strategy: str, document: Column, section: Column, pages: Column, content: Column) -> Column:
    """A stable id from what a chunk says and where."""
    whole = F.concat_ws("|", document, F.lit(strategy), section, F.array_join(F.transform(pages, lambda p: p.cast("string")), ","), content)
    return F.concat(F.lit(f"{strategy}:"), F.substring(F.sha2(whole, 256), 1, 24))


def units(lines: DataFrame) -> DataFrame:
    """document_id, section, at, unit, block, text, evidence: runs of one block type of each section, in order.

    Blank lines are skipped and a heading is a run of its own.  ``at`` is the place of the section's first
    line, ``unit`` that of the run's first line; ``evidence`` has a row for each line.
    """
    x = lines.where((F.trim("text") != "") & (F.col("section") != "")).withColumn("block", T.block_type(F.trim("text"), F.col("is_heading")))
    w = Window.partitionBy("document_id", "section").orderBy("pos")
    changed = F.lag("block").over(w).isNull() | (F.lag("block").over(w) != F.col("block")) | (F.lag("block").over(w) == "heading")
    x = x.withColumn("_run", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.withColumn("at", F.min("pos").over(Window.partitionBy("document_id", "section")))
    line = F.struct("pos", F.trim("text").alias("t"), evidence_of(F.col("text")).alias("e"))
    u = x.groupBy("document_id", "section", "at", "_run").agg(F.first("block").alias("block"), F.array_sort(F.collect_list(line)).alias("own"))
    return u.select("document_id", "section", "at", F.element_at("own", 1)["pos"].alias("unit"), "block", F.array_join(F.col("own.t"), "\n").alias("text"), F.col("own.e").alias("evidence"))


def evidence_of(content: Column) -> Column:
    """The evidence of a line: where it stands, and what it says."""
    line = F.col("line_index").cast("long")
    return F.struct("source_file", "page", "section", content.alias("content"), line.alias("line_start"), line.alias("line_end"))


def said(evidence: Column, content: Column) -> Column:
    """Evidence whose places are kept and whose content is that of a piece."""
    return F.transform(evidence, lambda e: F.struct(e["source_file"].alias("source_file"), e["page"].alias("page"), e["section"].alias("section"), content.alias("content"), e["line_start"].alias("line_start"), e["line_end"].alias("line_end")))


def pieces(text: Column, most: int) -> Column:
    """A text cut at white space into pieces whose words, with one more character each, stay within ``most``; no word is cut."""
    return F.regexp_extract_all(F.regexp_replace(F.trim(text), r"\s+", " "), F.lit(rf"(?s)(\S{{{most},}}|.{{1,{max(1, most - 1)}}})(?= |$) ?"), F.lit(1))


def grouped(parts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, part, text, evidence: lists of the units of each group of ``parts`` (keys, unit, text, evidence).

    Groups take units while the lengths plus one each stay within ``most``.  A longer unit is cut at words,
    none of which is cut, and each piece, the last too, is a group of its own; its evidence says the piece.
    """
    x = parts.select(*keys, "unit", F.posexplode(cut(F.col("text"), F.col("evidence"), most)).alias("piece", "u")).select(*keys, "unit", "piece", "u.*")
    return grouped_rows(x, keys, ["unit", "piece"], ["text", "evidence"], F.col("size"), F.col("alone"), most)


def cut(text: Column, evidence: Column, most: int) -> Column:
    """A unit, or its pieces if it is longer than ``most``, as a list of text, evidence, size and alone."""
    row = lambda t, e, alone: F.struct(t.alias("text"), e.alias("evidence"), (F.length(t) + 1).cast("long").alias("size"), F.lit(alone).alias("alone"))
    return F.when(F.length(text) > most, F.transform(pieces(text, most), lambda t: row(t, said(evidence, t), True))).otherwise(F.array(row(text, evidence, False)))


def joined(groups: DataFrame) -> DataFrame:
    """``groups`` with the texts and the evidence of their units as one."""
    return groups.withColumn("content", F.array_join("text", "\n\n")).withColumn("evidence", F.flatten("evidence")).drop("text")


def first_of_equal(df: DataFrame, evidence: str = "evidence") -> DataFrame:
    """``df`` whose evidence has each content of a place (file, page, section) once, the first, in order."""
    keyed = F.array_sort(F.transform(evidence, lambda e, i: F.struct(F.struct(e["source_file"], e["page"], e["section"], e["content"]).alias("k"), i.alias("i"), e.alias("e"))))
    x = df.withColumn("_keyed", keyed)
    kept = F.filter("_keyed", lambda v, i: (i == 0) | ~v["k"].eqNullSafe(F.get("_keyed", i - 1)["k"]))
    ordered = F.array_sort(F.transform(kept, lambda v: F.struct(v["i"].alias("i"), v["e"].alias("e"))))
    return x.withColumn(evidence, F.transform(ordered, lambda v: v["e"])).drop("_keyed")


def profiles(kind: Column) -> Column:
    """Indexes that a chunk of a kind belongs to."""
    lit = lambda *x: F.array(*map(F.lit, x))
    return F.when(kind == "identifier", lit("exact", "bm25")).when(kind == "table_row", lit("exact", "bm25", "vector")).when(kind == "parent", lit("context")).otherwise(lit("bm25", "vector"))


def finished(g: DataFrame, strategy: str, kind: str | Column, role: str | None = None) -> DataFrame:
    """Chunks of ``g`` (document_id, section, content, evidence, at, part and maybe parent_chunk_id, over): ids, pages and profiles."""
    g = first_of_equal(g).withColumn("pages", F.array_sort(F.array_distinct(F.col("evidence.page"))))
    have, kind = set(g.columns), F.lit(kind)
    return g.withColumns({
        "chunk_id": chunk_id(strategy, F.col("document_id"), F.col("section"), F.col("pages"), F.col("content")), "page": F.element_at("pages", 1),
        "kind": kind, "strategy": F.lit(strategy), "parent_chunk_id": F.col("parent_chunk_id") if "parent_chunk_id" in have else F.lit(None).cast("string"),
        "overlap_before": F.col("over") if "over" in have else F.lit(0), "retrieval_profiles": profiles(F.lit(role) if role else kind), "at": F.col("at").cast("long"),
    })


def section_chunks(lines: DataFrame) -> DataFrame:
    """Chunks of whole sections."""
    return finished(joined(grouped(units(lines), ["document_id", "section", "at"], SECTION)), "section", "section").select(*COLUMNS)


def parent_child_chunks(lines: DataFrame) -> DataFrame:
    """Parents and their overlapping children, which name them; children are made in their parent's row."""
    keys = ["document_id", "section", "at"]
    up = grouped(units(lines), keys, PARENT)
    pages = F.array_sort(F.array_distinct(F.flatten("evidence")["page"]))
    own = chunk_id("parent_child", F.col("document_id"), F.col("section"), pages, F.array_join("text", "\n\n"))
    up = up.select(*keys, F.col("part").alias("parent"), own.alias("parent_chunk_id"), F.arrays_zip("text", "evidence").alias("_u"))
    whole = F.transform("_u", lambda u: F.struct(u["text"].alias("text"), u["evidence"].alias("evidence"), (F.length(u["text"]) + 1).cast("long").alias("size"), F.lit(False).alias("alone")))
    # a parent's pieces are the units of its children
    inner = F.flatten(F.transform("_u", lambda u: cut(u["text"], u["evidence"], CHILD - OVERLAP)))
    two = F.array(F.struct(F.lit("parent").alias("kind"), whole.alias("units")), F.struct(F.lit("child").alias("kind"), inner.alias("units")))
    x = up.select(*keys, "parent", "parent_chunk_id", F.explode(two).alias("_k")).select(*keys, "parent", "parent_chunk_id", "_k.kind", "_k.units")
    is_parent = F.col("kind") == "parent"
    g = grouped_lists(x, [*keys, "parent", "parent_chunk_id", "kind"], ["text", "evidence"], F.when(is_parent, 2**31).otherwise(CHILD - OVERLAP), OVERLAP)
    g = g.withColumns({"part": F.when(is_parent, F.col("parent")).otherwise(F.col("parent") * 100_000 + F.col("part")), "parent_chunk_id": F.when(~is_parent, F.col("parent_chunk_id"))})
    return finished(joined(g), "parent_child", F.col("kind")).select(*COLUMNS)


def procedure_chunks(procedures: DataFrame) -> DataFrame:
    """Each procedure as a parent, and groups of up to four steps with its prerequisites and warnings.

    A step that is longer than what the prerequisites and warnings leave is cut at words.
    """
    keys = ["document_id", "run"]
    frame = F.concat(F.transform("prerequisites", lambda e: F.concat(F.lit("Prerequisite: "), e["content"])), F.transform("warnings", lambda e: F.concat(F.lit("Warning: "), e["content"])))
    taken = F.length(F.array_join("frame", "\n")) + (F.size("frame") > 0).cast("int")
    x = procedures.withColumn("frame", frame).withColumn("room", F.greatest(F.lit(200), F.lit(PROCEDURE - 100) - taken))
    numbered = lambda s: F.concat(s["number"].cast("string"), F.lit(". "), s["content"])
    framing = F.concat("prerequisites", "warnings")
    parents = x.withColumns({"content": F.array_join(F.concat("frame", F.transform("steps", numbered)), "\n"), "evidence": F.concat(framing, F.transform("steps", lambda s: s["evidence"])), "at": F.col("run"), "part": F.lit(0)})
    parents = cut_to_table(finished(parents, "procedure", "procedure", "parent"))  # read three times
    step = parents.select(*keys, "room", F.posexplode("steps").alias("unit", "step"))
    words = F.when(F.length("step.content") > F.col("room"), F.split(F.trim("step.content"), r"\s+")).otherwise(F.array("step.content"))
    words = step.select(*keys, "unit", "room", F.posexplode(words).alias("_n", "_word"))
    cut = packed(words, [*keys, "unit"], ["_n"], F.length("_word") + 1, F.col("room")).groupBy(*keys, "unit", "room", F.col("part").alias("piece"))
    cut = cut.agg(F.array_join(F.array_sort(F.collect_list(F.struct("_n", "_word")))["_word"], " ").alias("text"))
    groups = packed(cut, keys, ["unit", "piece"], F.length("text"), F.col("room"), GROUP)
    own = groups.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("unit", "piece", "text"))).alias("own"))
    g = own.join(parents.select(*keys, "section", "frame", "steps", framing.alias("framing"), F.col("chunk_id").alias("parent_chunk_id")), keys)
    of = lambda o: F.element_at("steps", o["unit"] + 1)
    lines = F.transform("own", lambda o: F.concat(of(o)["number"].cast("string"), F.lit(". "), o["text"]))
    g = g.withColumns({"content": F.array_join(F.concat("frame", lines), "\n"), "evidence": F.concat("framing", F.transform("own", lambda o: of(o)["evidence"])), "at": F.col("run"), "part": F.col("part") + 1})
    return parents.select(*COLUMNS).unionByName(finished(g, "procedure", "step_group").select(*COLUMNS))


def table_row_chunks(rows: DataFrame) -> DataFrame:
    """A chunk for each table row: ``header: cell``; what has no counterpart is left out."""
    cell = F.transform(F.arrays_zip("headers", "cells"), lambda z: F.concat(z["headers"], F.lit(": "), z["cells"]))
    x = rows.withColumns({"content": F.array_join(F.array_compact(cell), " | "), "evidence": F.array(evidence_of(F.col("text"))), "at": F.col("table_pos"), "part": F.col("row_index")})
    return finished(x, "table_row", "table_row").select(*COLUMNS)


def identifier_chunks(found: DataFrame) -> DataFrame:
    """A chunk for each identifier: its line, with kind and value."""
    x = found.withColumns({"content": F.col("context"), "evidence": F.array(evidence_of(F.col("context"))), "at": F.col("occurrence"), "part": F.lit(0), "identifier_kind": F.col("kind")})
    return finished(x, "exact", "identifier").select(*COLUMNS, "identifier_kind", "normalized_value")


def every_strategy(*strategies: DataFrame) -> DataFrame:
    """The chunks of all strategies, with the place ``_s`` of theirs."""
    out = None
    for i, s in enumerate(strategies):
        s = s.select(*COLUMNS, (s["normalized_value"] if "normalized_value" in s.columns else F.lit(None).cast("string")).alias("normalized_value")).withColumn("_s", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out


def with_ordinals(chunks: DataFrame) -> DataFrame:
    """The chunks of ``every_strategy`` with their ordinals in the document: strategy by strategy, in order."""
    order = Window.partitionBy("document_id").orderBy("_s", "at", "part", "kind", "chunk_id", F.col("normalized_value").asc_nulls_first())
    # a table, so that who needs no ordinals sorts nothing
    return cut_to_table(chunks).withColumn("ordinal", F.row_number().over(order) - 1).drop("_s", "at", "part")


def violations(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the ``reasons`` why a chunk can't be cited; an empty array means none."""
    e = F.col("evidence")
    checks = [
        (F.trim(F.coalesce("content", F.lit(""))) == "", "empty_content"), (F.trim(F.coalesce("model", F.lit(""))) == "", "unresolved_model"), (F.trim(F.coalesce("version", F.lit(""))) == "", "unresolved_version"),
        (F.coalesce(F.size("pages"), F.lit(0)) <= 0, "no_pages"), (F.array_sort(F.array_distinct("pages")) != F.col("pages"), "pages_not_sorted"),
        (F.col("page") != F.element_at("pages", 1), "page_not_first"), (F.coalesce(F.size(e), F.lit(0)) <= 0, "no_evidence"),
        (F.size(F.array_except(F.transform(e, lambda v: v["page"]), F.col("pages"))) > 0, "evidence_page_unknown"),
        (F.size(F.array_distinct(F.transform(e, lambda v: v["source_file"]))) > 1, "several_sources"),
    ]
    return chunks.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in checks])))
