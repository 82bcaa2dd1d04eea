"""Toxicity: maximum-scoring segments over word log-odds.

1. Over labelled documents, count for each word, and for each beginning of four to
   seven letters (which stand for word families), the toxic and the clean documents
   that hold it; its log-odds has an informative Dirichlet prior from both classes.
   Words or beginnings whose log-odds is above ``LEAST_ODDS`` even at the lower end of
   its confidence interval make up the model. A rule by effect instead of significance
   chooses the same features however many labels there are.
2. In every document each word scores its log-odds if it is in the model, and a loss if
   not. The loss is fitted: the mean score of a word of clean labelled text is negative
   by a set margin, which the extreme-value law needs. A linear scan finds all maximal
   scoring segments (no segment can be extended or split for a higher score).
3. A segment's score S in a text of m words has the expectation E = K m exp(-L S)
   under the extreme-value law of clean text; L solves sum p(s) exp(L s) = 1 over the
   whole histogram of scores of clean words and K matches the number of segments seen
   in clean labelled documents. The evidence of a document is the sum of max(0, -ln E)
   over its segments, and a logistic curve over ln(1 + evidence) is its score.

A quarter of the labelled rows chooses no features: it fits loss, law and curve, so that
these see texts as new ones are. The classifier is fitted on at most ``max_labelled``
labelled rows (those of smallest hash of the document id), which bounds what it holds;
documents are scored whole and without a limit, in one pass.

Defined results: a null text counts as empty and scores what an evidence of 0 does;
a null id is not held out; labels of documents that are not there, or null, do not
count; repeated labels of a document count as toxic if one is; documents with the
same id share their label and are scored row by row; with no labels, or of one class
only, all scores are the share of toxic labels (0 if there are none). Only the named
columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, least_hashed, stored, table

WORD = re.compile(r"[^\W\d_]+")
#: Letters of the beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
#: Weight of the prior: a share of the counts of both classes, and a count for each feature.
PRIOR, FLOOR = 0.002, 0.5
#: Least log-odds of a feature (twelve times the odds), at that many standard errors below
#: its estimate, and least toxic documents that hold it.
LEAST_ODDS, ERRORS, LEAST_DOCS = 2.5, 1.28, 4
#: Least loss of a word outside the model, and loss as a multiple of what clean words gain.
LEAST_LOSS, MARGIN = 0.03, 3.0


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    loss: float = LEAST_LOSS
    scale: float = 1.0  # L
    factor: float = 1.0  # K
    intercept: float = -20.0
    slope: float = 0.0

    def gain(self, word: str) -> float:
        """Score of a word, 0 for one outside the model."""
        return max(self.words.get(word, 0.0), *(self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if len(word) >= n), 0.0)

    def passages(self, places: list[int], gains: list[float]) -> list[tuple[int, int, float]]:
        """Maximal scoring segments (first hit, last hit, score) of the words at ``places``
        that gain, with the loss of the words between them.
        """
        scores = [x for i, g in enumerate(gains) for x in (self.loss * -(places[i] - places[i - 1] - 1) if i else 0.0, g)]
        return [(a // 2, (b - 1) // 2, s) for a, b, s in segments(scores)]

    def evidence(self, words: int, found: list[tuple[int, int, float]]) -> float:
        """The sum of max(0, -ln E) over segments in a text of ``words`` words."""
        base = -math.log(self.factor * max(1, words))
        return math.fsum(max(0.0, base + s * self.scale) for _, _, s in found)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.intercept + self.slope * math.log1p(evidence)))))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) by a linear scan: each kept
    candidate remembers the sums before and after it, and a new one swallows those
    that make a higher sum together with it.
    """
    kept: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = (kept[j][0], new[1], kept[j][2], new[3])
            del kept[j:]
    return [(a, b, r - l) for a, b, l, r in kept]


def held_out(id_col: str) -> Column:
    """Rows that no fit may use."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled(labels: DataFrame, id_col: str, label_col: str, max_labelled: int) -> DataFrame:
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    one = one.groupBy(F.col(id_col).alias("_hf_id")).agg(F.max(F.col(label_col) == 1).alias("_hf_toxic"))
    return least_hashed(one, F.xxhash64("_hf_id"), max_labelled)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        names = list(counts[0] | counts[1])
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], names=["feature", "toxic", "clean"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text.as_py() or "").lower()))
            mine = counts[0] if toxic else counts[1]
            mine.update(words)
            for n in BEGINNINGS:
                mine.update({w[:n] + "*" for w in words if len(w) >= n})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield flush()
    yield flush()


def fit_words(known: DataFrame) -> Model:
    """The features of the model, from labelled texts (_hf_text, _hf_toxic)."""
    counts = known.select("_hf_text", "_hf_toxic").mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = stored(counts, "toxicity-counts")
    whole = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = whole["t"] or 0, whole["c"] or 0
    model = Model()
    if t and c:
        prior, weight = FLOOR + PRIOR * (F.col("toxic") + F.col("clean")), PRIOR * (t + c)
        a, b = F.col("toxic") + prior, F.col("clean") + prior
        delta = F.log(a / (t + weight - a)) - F.log(b / (c + weight - b))
        sure = delta - ERRORS * F.sqrt(1 / a + 1 / b)
        for r in counts.filter((F.col("toxic") >= LEAST_DOCS) & (sure >= LEAST_ODDS)).select("feature", F.round(delta, 2).alias("delta")).collect():
            if r["feature"].endswith("*"):
                model.beginnings[r["feature"][:-1]] = r["delta"]
            else:
                model.words[r["feature"]] = r["delta"]
    dropped(counts.sparkSession, counts)
    return model


def hits(text: str, model: Model, starts: set[str], with_places: bool) -> tuple[int, list[int], list[float], list[tuple[int, int]]]:
    """Number of words, place and gain of each word in the model, and its characters."""
    found = WORD.findall(text)
    words, shortest = model.words, BEGINNINGS[0]
    gains = {w: g for w in set(found) if (w in words or w[:shortest] in starts) and (g := model.gain(w))}
    if not gains:
        return len(found), [], [], []
    places = [i for i, w in enumerate(found) if w in gains]
    spans = [m.span() for m in WORD.finditer(text) if m[0] in gains] if with_places else []
    return len(found), places, [gains[found[i]] for i in places], spans


def fit_law(model: Model, clean: list[tuple[int, list[int], list[float]]]) -> None:
    """Loss, L and K from words, places and gains of clean labelled documents."""
    known = [*model.words.values(), *model.beginnings.values()]
    if not known:
        return
    usual, least = sum(known) / len(known), min(known)
    histogram = Counter({usual: 0.5})  # half a word, where clean text holds none
    for _, _, gains in clean:
        histogram.update(gains)
    m = sum(n for n, _, _ in clean) + 1.0
    model.loss = max(LEAST_LOSS, MARGIN * sum(s * n for s, n in histogram.items()) / m)
    losing = max(0.5, m - sum(histogram.values())) / m

    def grown(x: float) -> float:
        return losing * math.exp(-model.loss * x) + sum(n / m * math.exp(min(700.0, s * x)) for s, n in histogram.items())

    low, high = 1e-9, 1.0
    while grown(high) < 1:
        high *= 2
    if grown(low) >= 1:
        raise ValueError("toxicity: the words of clean text do not lose on the whole, so no extreme-value law holds")
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 1 else (low, mid)
    model.scale = low
    # No segment scores below the least gain: as many are above it as the law says.
    seen = sum(len(model.passages(p, g)) for _, p, g in clean) + 0.5
    model.factor = seen / m * math.exp(model.scale * least)


def fit_curve(model: Model, rows: list[tuple[float, bool]]) -> None:
    """Logistic curve over ln(1 + evidence) by Newton steps, slightly held to 0."""
    bins: dict[float, list[int]] = {}
    for e, t in rows:
        bins.setdefault(round(math.log1p(e), 3), [0, 0])[t] += 1
    clean, toxic = (sum(b[i] for b in bins.values()) for i in (0, 1))
    if not toxic or not clean:
        model.intercept, model.slope = (50.0 if toxic else -50.0), 0.0
        return
    a, b = math.log(toxic / clean), 0.0
    for _ in range(60):
        ga, gb = -1e-3 * a, -1e-3 * b
        haa, hab, hbb = 1e-3, 0.0, 1e-3
        for x, (c, t) in bins.items():
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x))))
            off, w = t - (t + c) * p, (t + c) * p * (1 - p)
            ga, gb = ga + off, gb + off * x
            haa, hab, hbb = haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    model.intercept, model.slope = a, max(0.0, b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 200_000) -> Model:
    """The model of at most ``max_labelled`` labelled rows; their texts are written once."""
    spark = docs.sparkSession
    sample = stored(labelled(labels, id_col, label_col, max_labelled), "toxicity-labels")
    texts = docs.select(F.col(id_col).alias("_hf_id"), F.col(text_col).alias("_hf_text")).join(F.broadcast(sample), "_hf_id")
    texts = stored(texts.withColumn("_hf_check", F.xxhash64(F.lit("check"), "_hf_id") % 4 == 0), "toxicity-texts")
    model = fit_words(texts.filter(~F.col("_hf_check")))
    starts = {x[: BEGINNINGS[0]] for x in model.beginnings}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(toxic, *hits((text.as_py() or "").lower(), model, starts, False)[:3]) for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("toxic", "words", "places", "gains"), r, strict=True)) for r in rows], schema=pa.schema([("toxic", pa.bool_()), ("words", pa.int64()), ("places", pa.list_(pa.int64())), ("gains", pa.list_(pa.float64()))]))

    checked = [tuple(r) for r in texts.filter("_hf_check").select("_hf_text", "_hf_toxic").mapInArrow(find, "toxic boolean, words long, places array<long>, gains array<double>").collect()]
    share = texts.agg(F.count_if("_hf_toxic").alias("t"), F.count_if(~F.col("_hf_toxic")).alias("c")).first()
    if not share["t"] or not share["c"]:
        model = Model(intercept=50.0 if share["t"] else -50.0)
    else:
        fit_law(model, [r[1:] for r in checked if not r[0]])
        fit_curve(model, [(model.evidence(n, model.passages(p, g)), t) for t, n, p, g in checked])
    for df in (sample, texts):
        dropped(spark, df)
    return model


SCORED = "_hf_id long, text_hash long, score double, evidence double, passages array<struct<start: long, end: long, score: double>>"


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score, evidence and every maximal scoring passage of each document, with its place
    in characters of the lower-cased text.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind]
    names = ["_hf_id", "text_hash", "score", "evidence", "passages"]
    starts = {x[: BEGINNINGS[0]] for x in model.beginnings}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value, digest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words, places, gains, spans = hits((value.as_py() or "").lower(), model, starts, True)
                found = model.passages(places, gains)
                e = model.evidence(words, found)
                rows.append((key, digest, model.score(e), e, [{"start": spans[a][0], "end": spans[b][1], "score": s} for a, b, s in found]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    return docs.select(F.col(id_col).cast("long").alias("_hf_id"), F.col(text_col).alias("_hf_text"), F.xxhash64(text_col).alias("_hf_hash")).mapInArrow(find, SCORED)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 200_000, text_hash: bool = False) -> DataFrame:
    """One row for each document: ``id_col``, held_out, score, predicted, evidence and
    passages (start, end, score of each maximal scoring passage, in characters);
    with ``text_hash`` also the xxhash64 of its text.
    """
    out = apply(docs, fit(docs, labels, id_col, text_col, label_col, max_labelled), id_col, text_col)
    return out.select(F.col("_hf_id").alias(id_col), held_out("_hf_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages", *(["text_hash"] if text_hash else []))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")
