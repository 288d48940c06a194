"""License scans: ordered signature rules over normalised words, with DataFrame functions only.

A text is normalised to words joined by single blanks.  Texts without a gate substring need no more
work.  A rule is tried on the whole text if the text has one of the rule's keywords and one of its
anchors as words, as every match does; all its matches count.  Overlapping finds of all rules are
resolved by priority and containment of their word intervals in one sweep.  All of it is row-local: no
join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted exactly, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Substrings of which every match of a rule has one.
GATES = ["licen", "copyright", "domain", "under", "gpl", "permission", "redistribut", "warranty", "cc0", "cddl", "endorse", "altered", "contributor", "invariant", "proprietary", "unauthori"]

#: Label, keywords (each match has one as a word), regex of the name in normalised words.
NAMES = [
    ("mit", "mit expat", "(?:mit|expat)(?: x11)?"),
    ("x11", "x11", "x11"),
    ("apache", "apache asl", "(?:apache|asl)(?: software)?"),
    ("gpl", "gpl gplv gpl1 gpl2 gpl3 gplv1 gplv2 gplv3", "(?:gnu )?gplv?[123]?"),
    ("gpl", "public", "gnu general public"),
    ("lgpl", "lgpl lgplv lgpl2 lgpl3 lgplv2 lgplv3", "(?:gnu )?lgplv?[23]?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public"),
    ("lgpl", "library", "(?:gnu )?library general public"),
    ("agpl", "agpl agplv agpl1 agpl3 agplv1 agplv3", "(?:gnu )?agplv?[13]?"),
    ("agpl", "affero", "(?:gnu )?affero(?: general)? public"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl"),
    ("gfdl", "documentation", "(?:gnu )?free documentation"),
    ("bsd", "bsd", "(?:new |modified |simplified |revised |original )?(?:[0234] clause )?bsd(?: [0234] clause)?"),
    ("isc", "isc", "isc"),
    ("mpl", "mpl", "mpl"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl", "epl", "epl"),
    ("epl", "eclipse", "eclipse (?:public|distribution)"),
    ("eupl", "eupl", "eupl"),
    ("eupl", "european", "european union public"),
    ("cddl", "cddl", "cddl"),
    ("cddl", "development", "common development and distribution"),
    ("cpl", "common", "common public"),
    ("ipl", "ibm", "ibm public"),
    ("artistic", "artistic", "(?:perl )?artistic"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost", "boost", "boost(?: software)?"),
    ("unlicense", "unlicense", "the unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql"),
    ("python", "python", "python(?: software foundation)?"),
    ("php", "php", "php"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("ofl", "ofl", "(?:sil )?ofl"),
    ("ofl", "font", "(?:sil )?open font"),
    ("odbl", "odbl", "odbl"),
    ("odbl", "database", "open (?:data commons )?(?:open )?database"),
    ("osl", "osl", "osl"),
    ("osl", "software", "open software"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "reciprocal", "microsoft reciprocal"),
    ("cc0", "cc0", "cc0"),
    ("cc-by-nc", "nc noncommercial", "(?:cc|creative commons)(?: attribution| by)?(?: nc| noncommercial)"),
    ("cc-by-sa", "sa sharealike", "(?:cc|creative commons)(?: attribution| by)?(?: sa| sharealike)"),
    ("cc-by-nd", "nd noderivatives", "(?:cc|creative commons)(?: attribution| by)?(?: nd| noderivatives)"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial"),
    ("cc-by-sa", "sharealike alike", "creative commons attribution share ?alike"),
    ("cc-by", "by", "cc by"),
    ("cc", "commons", "creative commons"),
    ("cecill", "cecill", "cecill(?: [abc])?"),
    ("proprietary", "commercial", "(?:a )?commercial"),
    ("proprietary", "proprietary", "(?:a )?proprietary"),
]
VERSION = "(?: (?:v|version|v?[0-9]+))?(?: [0-9]+){0,2}(?: or (?:any )?later)?"
LICENSE = "licen[sc]es?"
GIVEN = "(?:released|distributed|available|published|provided|offered|covered)"
LICENSES, LICENSED = "license licence licenses licences", "licensed licenced relicensed relicenced"
#: Shapes of a statement: anchors (each match has one as a word), regex, priority, confidence.  ``{n}`` stands for the name.
SHAPES = [
    (LICENSES, "(?:re)?licen[sc]ed (?:to you )?under (?:the )?(?:terms of )?(?:the )?{n} " + LICENSE + VERSION, 6, 1.0),
    (LICENSES, GIVEN + " under (?:the )?(?:terms of )?(?:the )?{n} " + LICENSE + VERSION, 6, 1.0),
    (LICENSED, "(?:re)?licen[sc]ed (?:to you )?under (?:the )?(?:terms of )?(?:the )?{n}" + VERSION, 5, 0.95),
    ("under", GIVEN + " under (?:the )?(?:terms of )?(?:the )?{n}" + VERSION, 5, 0.9),
    (LICENSES, "(?:the )?{n} " + LICENSE + VERSION, 4, 0.85),
    (LICENSES, LICENSE + " (?:is )?(?:the )?{n}" + VERSION, 3, 0.75),
    ("licensed licenced licensing licencing", "{n}" + VERSION + " licen[sc](?:ed|ing)", 2, 0.6),
    ("identifier", "spdx licen[sc]e identifier {n}(?: [0-9]+){0,2}(?: only| or later)?", 6, 1.0),
]
#: Statements of a license that are more than a name in a shape, most of them the opening words of its
#: text: label, keywords, anchors, regex, priority, confidence.
STATEMENTS = [
    ("mit", "hereby", "person", "permission is hereby granted free of charge to any person obtaining a copy", 5, 0.95),
    ("boost", "hereby", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy", 5, 0.95),
    ("isc", "permission", "distribute", "permission to use copy modify and or distribute this software for any purpose", 5, 0.95),
    ("postgresql", "permission", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose", 5, 0.9),
    ("bsd", "redistribution", "binary", "redistribution and use in source and binary forms", 5, 0.95),
    ("bsd", "redistributions", "retain", "redistributions of source code must retain the above copyright notice", 5, 0.9),
    ("bsd", "redistributions", "reproduce", "redistributions in binary form must reproduce the above copyright notice", 5, 0.9),
    ("bsd", "endorse", "promote", "neither the name of .{1,120}? may be used to endorse or promote products", 4, 0.85),
    ("zlib", "warranty", "express", "this software is provided as is without any express or implied warranty", 4, 0.85),
    ("zlib", "altered", "versions", "altered source versions must be plainly marked as such", 5, 0.9),
    ("apache", "compliance", "except", "you may not use this file except in compliance with the license", 4, 0.9),
    ("apache", "contributor", "royalty", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free", 4, 0.85),
    ("gpl", "redistribute", "modify", "this program is free software you can redistribute it and or modify it", 4, 0.9),
    ("gpl", "gnu", "received", "you should have received a copy of the gnu general public licen[sc]e", 5, 0.95),
    ("lgpl", "redistribute", "modify", "this library is free software you can redistribute it and or modify it", 4, 0.9),
    ("lgpl", "gnu", "received", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 5, 0.95),
    ("agpl", "gnu", "received", "you should have received a copy of the gnu affero general public licen[sc]e", 5, 0.95),
    ("agpl", "affero", "network", "gnu affero general public licen[sc]e .{1,400}? users interacting with it remotely through a computer network", 5, 0.95),
    ("gpl", "gpl gplv1 gplv2 gplv3", "gnu", "gnu gpl(?:v[123]| v?[123]| version [123])(?: 0)?(?: or (?:any )?later| only)?", 4, 0.85),
    ("lgpl", "lgpl lgplv2 lgplv3", "gnu", "gnu lgpl(?:v[23]| v?[23]| version [23])(?: [01])?(?: or (?:any )?later| only)?", 4, 0.85),
    ("agpl", "agpl agplv1 agplv3", "gnu", "gnu agpl(?:v[13]| v?[13]| version [13])(?: 0)?(?: or (?:any )?later| only)?", 4, 0.85),
    ("gfdl", "invariant", "sections", "with no invariant sections no front cover texts and no back cover texts", 5, 0.9),
    ("mpl", "mozilla", "subject", "this source code form is subject to the terms of the mozilla public licen[sc]e", 6, 1.0),
    ("epl", "eclipse", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 6, 1.0),
    ("cddl", "cddl development", "contents", "the contents of this file are subject to the terms of the (?:common development and distribution licen[sc]e|cddl)", 6, 1.0),
    ("unlicense", "unencumbered", "released", "this is free and unencumbered software released into the public domain", 6, 1.0),
    ("wtfpl", "fuck", "want", "do what the fuck you want to public licen[sc]e", 5, 0.95),
    ("cc0", "waiving", "dedicated", "has dedicated the work to the public domain by waiving all of his or her rights", 5, 0.95),
    ("cc0", "cc0", "universal", "cc0 1 0 universal", 5, 0.95),
    ("cc", "commons", "work", "this work is licen[sc]ed under (?:a|the) creative commons", 4, 0.9),
    ("ofl", "font", "sil", "this font software is licen[sc]ed under the sil open font licen[sc]e", 6, 1.0),
    ("artistic", "perl", "itself", "under the same terms as perl itself", 4, 0.7),
    ("python", "python", "agreement", "this licen[sc]e agreement is between the python software foundation", 6, 1.0),
    ("ms-pl", "microsoft", "ms", "microsoft public licen[sc]e ms pl", 6, 1.0),
    ("proprietary", "confidential", "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 3, 0.8),
    ("proprietary", "unauthorized unauthorised", "prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution) .{1,120}? (?:is )?(?:strictly )?prohibited", 3, 0.75),
    ("copyright", "copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 1, 0.5),
    ("public-domain", "domain", "domain", "(?:released into|dedicated to|placed in|placed into) the public domain", 1, 0.7),
]
#: Fixed values: ``copyright`` and the next ``all rights reserved``, however far: label, priority, confidence.
RESERVED = ("all-rights-reserved", 1, 0.7)
PRIORITIES = 6


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """All rules: label, keywords, anchors, regex, priority, confidence."""
    named = [(label, word, anchors, shape.replace("{n}", f"(?:{name})"), p, c) for label, word, name in NAMES for anchors, shape, p, c in SHAPES]
    return named + STATEMENTS


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _words(x: str) -> Column:
    return F.array(*map(F.lit, x.split()))


def _rule_array() -> Column:
    kind = "array<struct<label:string,keywords:array<string>,anchors:array<string>,regex:string,priority:int,confidence:double>>"
    return F.array(*[F.struct(F.lit(a), _words(k), _words(n), F.lit(f"(?<= ){r}(?= )"), F.lit(p), F.lit(c)) for a, k, n, r, p, c in rules()]).cast(kind)


def _reserved() -> Column:
    """From the last ``copyright`` before each ``all rights reserved`` and after the one before it, to its end.

    The line is cut at ``all rights reserved``; the words of a part after its last ``copyright`` say where that is.
    """
    label, priority, confidence = RESERVED
    parts = F.split("_line", " all rights reserved(?= )")
    sized = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(
        _spaces(p).cast("long").alias("n"), F.when(F.contains(F.concat(p, F.lit(" ")), F.lit(" copyright ")), _spaces(F.substring_index(F.concat(p, F.lit(" ")), " copyright ", -1)).cast("long")).alias("after")))
    none = F.array().cast("array<struct<label:string,start:bigint,end:bigint,priority:int,confidence:double>>")

    def step(s: Column, p: Column) -> Column:
        here = s["at"] + p["n"]
        found = F.struct(F.lit(label).alias("label"), (here - p["after"] - 1).alias("start"), (here + 3).alias("end"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))
        return F.struct((here + 3).alias("at"), F.when(p["after"].isNotNull(), F.concat(s["finds"], F.array(found))).otherwise(s["finds"]).alias("finds"))

    return F.aggregate(sized, F.struct(F.lit(0).cast("long").alias("at"), none.alias("finds")), step, lambda s: s["finds"])


def _unbeaten(finds: Column) -> Column:
    """The finds that no other suppresses, by start: one that contains the find's interval and has a higher
    priority, or the same and more words.

    Those before a find in the order of start, then of falling end and priority, are all that can contain
    it, so one sweep needs only the greatest end (and the least start with it) of each priority.
    """
    order = F.transform(finds, lambda x: F.struct(x["start"], (-x["end"]).alias("e"), (-x["priority"]).alias("p"), x["label"], x["confidence"]))
    sorted_ = F.array_sort(F.array_distinct(order))
    none = F.transform(F.sequence(F.lit(1), F.lit(PRIORITIES)), lambda _: F.struct(F.lit(-1).cast("long").alias("end"), F.lit(-1).cast("long").alias("start")))

    def step(s: Column, x: Column) -> Column:
        end, p = -x["e"], -x["p"]
        beaten = F.exists(F.transform(s["far"], lambda y, i: ((i + 1 > p) & (y["end"] >= end)) | ((i + 1 == p) & ((y["end"] > end) | ((y["end"] == end) & (y["start"] < x["start"]))))), lambda z: z)
        far = F.transform(s["far"], lambda y, i: F.when((i + 1 == p) & (end > y["end"]), F.struct(end.alias("end"), x["start"].alias("start"))).otherwise(y))
        return F.struct(far.alias("far"), F.concat(s["stays"], F.when(beaten, F.lit("0")).otherwise(F.lit("1"))).alias("stays"))

    stays = F.aggregate(sorted_, F.struct(none.alias("far"), F.lit("").alias("stays")), step, lambda s: s["stays"])
    kept = F.transform(F.arrays_zip(sorted_.alias("x"), F.split(stays, "").alias("y")), lambda z: z)
    kept = F.filter(kept, lambda z: z["y"] == "1")
    return F.transform(kept, lambda z: F.struct(z["x"]["label"].alias("label"), z["x"]["start"].alias("start"), (-z["x"]["e"]).alias("end"), (-z["x"]["p"]).alias("priority"), z["x"]["confidence"].alias("confidence")))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``base_places``, ``detections``, ``labels`` and ``score``.

    ``base_places`` has a struct (label, places, first, last) for each phrase of ``BASE``, counted over
    the whole text; ``detections`` all matches of the rules that nothing suppresses (label, start, end in
    words, priority, confidence), by start.  A match is suppressed by one that contains its interval and
    has a higher priority, or the same priority and more words; equal finds of two rules are one.  ``labels`` are the distinct sorted labels of both;
    ``score`` is the highest confidence, 0.85 at least for a base phrase, else 0.

    Null and empty texts have no words, no finds and score 0.  Rows are judged one by one, so repeated
    rows, null keys and empty tables need no rule; columns of ``docs`` with the results' names are replaced.
    """
    out = ["n_words", "base_places", "detections", "labels", "score"]
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    d = docs.drop(*[c for c in docs.columns if c in out]).withColumn("_low", low)
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("_low", F.lit(g))
    d = d.withColumn("_words", F.when(gate, F.regexp_extract_all("_low", F.lit(WORD), F.lit(0))))
    d = d.withColumn("n_words", F.when(F.col("_words").isNull(), F.regexp_count("_low", F.lit(WORD))).otherwise(F.size("_words")).cast("long"))
    d = d.withColumn("_line", F.when(F.col("_words").isNotNull(), F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))))

    def base(phrase: str, label: str) -> Column:
        framed, n = f" {phrase} ", len(phrase.split())
        places = F.when(F.col("_line").isNull(), F.lit(0)).otherwise(F.regexp_count("_line", F.lit(f" {phrase}(?= )"))).cast("long")
        first = _spaces(F.substring_index("_line", framed, 1)).cast("long")
        last = F.col("n_words") - _spaces(F.substring_index("_line", framed, -1)) - n
        return F.struct(F.lit(label).alias("label"), places.alias("places"), F.when(places > 0, first).alias("first"), F.when(places > 0, last.cast("long")).alias("last"))

    d = d.withColumn("base_places", F.array(*[base(p, label) for p, label in BASE]))
    known = sorted({"copyright", "reserved", *(w for _, k, n, *_ in rules() for w in (k + " " + n).split())})
    d = d.withColumn("_keys", F.array_intersect("_words", F.array(*map(F.lit, known)))).withColumn("_rules", _rule_array())

    def finds(r: Column) -> Column:
        # the begins and ends of all matches are marked, and found again as words
        marked = F.split(F.call_function("regexp_replace", F.col("_line"), r["regex"], F.lit("\u0001$0\u0002")), " ")

        def places(mark: Column, at: str) -> Column:
            return F.filter(F.transform(marked, lambda w, i: F.when(F.call_function(at, w, mark), i)), lambda i: i.isNotNull())

        both = F.arrays_zip(places(F.lit("\u0001"), "startswith").alias("a"), places(F.lit("\u0002"), "endswith").alias("b"))
        return F.transform(both, lambda m: F.struct(r["label"].alias("label"), (m["a"] - 1).cast("long").alias("start"), m["b"].cast("long").alias("end"), r["priority"].alias("priority"), r["confidence"].alias("confidence")))

    fit = F.filter("_rules", lambda r: F.arrays_overlap(r["keywords"], F.col("_keys")) & F.arrays_overlap(r["anchors"], F.col("_keys")))
    fit = F.filter(fit, lambda r: F.call_function("rlike", F.col("_line"), r["regex"]))
    kind = "array<struct<label:string,start:bigint,end:bigint,priority:int,confidence:double>>"
    d = d.withColumn("_finds", F.when(F.size("_keys") > 0, F.concat(F.flatten(F.transform(fit, finds)), F.when(F.array_contains("_keys", "copyright") & F.array_contains("_keys", "reserved"), _reserved()).otherwise(F.array().cast(kind)))))
    d = d.withColumn("detections", F.when(F.size("_finds") > 0, _unbeaten(F.col("_finds"))).otherwise(F.array()).cast(kind))
    based = F.transform(F.filter("base_places", lambda b: b["places"] > 0), lambda b: b["label"])
    d = d.withColumn("labels", F.array_sort(F.array_distinct(F.concat(based, F.transform("detections", lambda x: x["label"])))))
    top = F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0))
    d = d.withColumn("score", F.greatest(top, F.when(F.size(based) > 0, F.lit(0.85)).otherwise(F.lit(0.0))))
    return d.drop("_low", "_words", "_line", "_keys", "_rules", "_finds")


def op9_license_scans(spark, sf_dir: str) -> DataFrame:
    """License phrases and labels of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    places = F.transform("base_places", lambda b: b["places"])
    based = F.array_sort(F.transform(F.filter("base_places", lambda b: b["places"] > 0), lambda b: b["label"]))
    return scan_licenses(docs).select(
        "doc_id", "n_words",
        F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        F.array_min(F.transform("base_places", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base_places", lambda b: b["last"])).alias("last_word"),
        F.array_join(based, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
