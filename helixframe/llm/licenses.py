"""License scans: sparse TF-IDF cosine to templates, then inheritance by directory.

Units of a text that names a licence, a copyright or the public domain, or begins a
grant, are its lines of that kind, its paragraphs of that kind (headers; comment signs
alone make no line) and the whole text (licence files). A unit is a vector of its words;
names of licences (SPDX identifiers, titles, names in sentences) are one token each. The
templates are notices, sentences around a name, headers and whole texts, several for
each licence. A word weighs its frequency by its inverse frequency over the licences (of
which any template has it), a name twice that; every word that no template has lengthens the vector by one.
So a document's score does not depend on the other documents, nothing reaches the
driver, and each unit is scored in its own row, without a join or a shuffle. A
document's own licence is that of the template nearest to any unit, if its cosine is
``threshold`` or more (ties: the smaller name).

A licence file stands for its directory: a document with a licence whose whole text is
near a template, of which ``file_share`` of the lines with words are units, or whose name
is that of a licence file.
Documents without a licence of their own take that of the nearest directory above them
that has one (of several files there, the smallest path). Directories, not documents,
are joined with their ancestors, so a directory that holds a third of all documents is
looked up once; its documents then meet that row where they are (hot directories are
broadcast).

Built-in functions only. Defined results: null or empty texts have no licence of their
own and may inherit; a null path neither gives nor takes; repeated rows give one row
each; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, stored, table
from .license_templates import FRAMES, NAMES, TEXTS, whole_texts

#: The customary notices of licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: What makes a line, a paragraph or a text a unit, in any case.
UNIT = r"(?i)licen[cs]e|copyright|spdx|public domain|permission\s+is\s+hereby|permission\s+to\s+use|redistribution\s+and\s+use|\bcc[ -]by\b|\bcc0\b|\bapache[ -]2\.0|\b[al]?gpl[ -]?v?[23]|\bmpl[ -]?v?2"
#: A line without letters or digits parts paragraphs.
BLANK = r"\n[^\p{L}\p{N}\n]*(?=\n)"
LICENSE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying)s?(?:[.-][^/]*)?$"
#: Words: letters and digits, with dots or hyphens between.
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: How much more the name of a licence weighs than a word that is as rare; with it the
#: threshold parts sentences that grant from those that only mention a licence.
NAME_WEIGHT = 2.0
#: Least cosine of a unit, and least share of units among the lines of a licence file.
THRESHOLD, FILE_SHARE = 0.8, 0.2


def token(name: str) -> str:
    """The word that stands for the names of a licence."""
    return f"id:{name.lower()}"


def words_of(text: Column) -> Column:
    clean = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), " ")
    for name, pattern in NAMES.items():
        clean = F.regexp_replace(clean, pattern, token(name))
    return F.split(clean, " ")


def template_words(text: str) -> list[str]:
    """words_of() for a template."""
    clean = " ".join(re.findall(WORD, text.lower()))
    for name, pattern in NAMES.items():
        clean = re.sub(pattern, token(name), clean)
    return clean.split(" ")


def all_templates(notices: dict[str, str]) -> tuple[list[tuple[str, list[str]]], list[tuple[str, list[str]]]]:
    """(licence, words) of the short templates and of the long ones, in the order of
    names. Notices other than TEMPLATES stand alone.
    """
    short = [(n, template_words(t)) for n, t in notices.items()]
    long: list[tuple[str, list[str]]] = []
    if notices is TEMPLATES:
        short += [(n, [token(n) if w == "hfname" else w for w in template_words(f.format("hfname"))]) for n in NAMES for f in FRAMES]
        long = [(n, template_words(t)) for n, t in TEXTS + whole_texts()]
    return sorted(short, key=lambda x: x[0]), sorted(long, key=lambda x: x[0])


def weights(short: list[tuple[str, list[str]]], long: list[tuple[str, list[str]]]) -> dict[str, dict]:
    """For each word of a template its inverse frequency and its share in each unit
    template vector, of the short ones and of the long ones (empty where none has it).
    """
    having: dict[str, set[str]] = {}
    for name, words in short + long:
        for w in words:
            having.setdefault(w, set()).add(name)
    total = len({name for name, _ in short + long})
    idf = {w: (math.log((1 + total) / (1 + len(names))) + 1) * (NAME_WEIGHT if w.startswith("id:") else 1.0) for w, names in having.items()}
    out: dict[str, dict] = {w: {"idf": idf[w], "short": [], "long": []} for w in having}
    for kind, templates in (("short", short), ("long", long)):
        for j, (_, words) in enumerate(templates):
            vector = {w: n * idf[w] for w, n in Counter(words).items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            for w, v in vector.items():
                out[w][kind] = out[w][kind] or [0] * len(templates)
                out[w][kind][j] = round(v / norm, 7)
    return out


def scan_licenses(docs: DataFrame, id_col: str, text_col: str, path: Column, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """One row for each document: ``id_col``, directory, license and score (its own best
    unit's, null below the threshold), inherited (the nearest directory's licence, where
    it has none itself) and inherited_from (that directory).
    """
    short, long = all_templates(templates or TEMPLATES)
    known = weights(short, long)
    vocabulary = F.split(F.lit(" ".join(sorted(known))), " ")
    table_ = F.from_json(F.lit(json.dumps(known)), "map<string,struct<idf:double,short:array<double>,long:array<double>>>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    parts = F.filter(F.split(text, BLANK, -1), lambda x: F.contains(F.trim(x), F.lit("\n")))
    named = lambda units: F.filter(units, lambda x: F.rlike(x, F.lit(UNIT)))
    units = F.when(F.rlike(text, F.lit(UNIT)), F.concat(F.array(text), named(lines), named(parts)))
    rows = docs.select(F.col(id_col).alias("_hf_id"), path.alias("path"), F.coalesce(units, F.array().cast("array<string>")).alias("units"), F.size(named(lines)).alias("named"), F.size(lines).alias("lines"))
    each = F.transform("units", lambda u: F.struct(words_of(u).alias("words")))

    def cosines(terms: Column, kind: str, templates: list, norm: Column) -> Column:
        held = F.filter(terms, lambda t: F.size(t["t"][kind]) > 0)
        sums = F.aggregate(held, F.array_repeat(F.lit(0.0), len(templates)), lambda acc, t: F.zip_with(acc, t["t"][kind], lambda x, y: x + t["n"] * t["t"]["idf"] * y))
        labels = F.array(*[F.lit(n) for n, _ in templates]) if templates else F.array().cast("array<string>")
        return F.zip_with(sums, labels, lambda x, name: F.struct(F.round(x / norm, 6).alias("score"), name.alias("name")))

    def scored(u: Column) -> Column:
        count = lambda w: F.size(u["words"]) - F.size(F.array_remove(u["words"], w))
        terms = F.transform(F.array_intersect(u["words"], vocabulary), lambda w: F.struct(count(w).alias("n"), F.try_element_at(table_, w).alias("t")))
        squares = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.pow(t["n"] * t["t"]["idf"], F.lit(2.0)))
        other = F.size(u["words"]) - F.aggregate(terms, F.lit(0), lambda acc, t: acc + t["n"])
        return F.struct(terms.alias("terms"), F.sqrt(F.greatest(squares + other, F.lit(1.0))).alias("norm"))

    def nearest_(v: Column) -> Column:
        every = F.concat(cosines(v["terms"], "short", short, v["norm"]), cosines(v["terms"], "long", long, v["norm"]))
        # Of equal scores the smaller name.
        return F.aggregate(every, F.struct(F.lit(0.0).alias("score"), F.lit("").alias("name")), lambda acc, x: F.when((x["score"] > acc["score"]) | ((x["score"] == acc["score"]) & (x["name"] < acc["name"])), x).otherwise(acc))

    judged = rows.withColumn("_hf_vectors", F.transform(F.transform(each, scored), nearest_))
    first = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("name"))
    judged = judged.withColumn("_hf_best", F.aggregate("_hf_vectors", first, lambda acc, x: F.when((x["score"] > acc["score"]) | ((x["score"] == acc["score"]) & (x["name"] < acc["name"])), x).otherwise(acc)))
    best = F.col("_hf_best")
    good = best["score"] >= threshold
    whole = F.coalesce(F.get("_hf_vectors", F.lit(0))["score"] >= threshold, F.lit(False))
    file = good & (whole | (F.col("named") >= file_share * F.col("lines")) | F.coalesce(F.rlike("path", F.lit(LICENSE_FILE)), F.lit(False)))
    directory = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    own = stored(judged.select("_hf_id", "path", directory.alias("directory"), F.when(good, best["name"]).alias("license"), F.when(good, best["score"]).alias("score"), file.alias("file")), "license-own")
    given = own.filter("file AND path IS NOT NULL").groupBy("directory").agg(F.min(F.struct("path", "license"))["license"].alias("inherited"))
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    places = own.filter("directory IS NOT NULL").groupBy("directory").agg(F.count("*").alias("n"))
    met = places.select(F.col("directory").alias("_hf_dir"), F.explode(F.array_distinct(above)).alias("directory")).join(given, "directory")
    nearest = met.groupBy(F.col("_hf_dir").alias("directory")).agg(F.max(F.struct(F.length("directory").alias("n"), F.col("directory").alias("d"), "inherited")).alias("x"))
    # Every directory once, with its documents counted, and those without a path as they are.
    every = places.join(nearest, "directory", "left").select("directory", "n", "x.d", "x.inherited")
    lost = own.filter("directory IS NULL").withColumns({"d": F.lit(None).cast("string"), "inherited": F.lit(None).cast("string")})
    out = spread_join(own, every, ["directory"], "n", own.count()).unionByName(lost)
    lacks = F.col("license").isNull()
    return out.select(F.col("_hf_id").alias(id_col), "directory", "license", "score", F.when(lacks, F.col("inherited")).alias("inherited"), F.when(lacks, F.col("d")).alias("inherited_from"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, directory, license, score, inherited and inherited_from of every document;
    its path is made of source, language and id.
    """
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text", path)
