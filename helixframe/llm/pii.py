"""Personal data by weak supervision: labelers vote, reliabilities are estimated, and a
final classifier decides.

Base spans are the matches of four patterns (email, ip, card, phone), leftmost and
without overlap for each kind; matches that fail their kind's test are dropped, without
a second try. They always stay. Wider patterns (an address with its signs spelt out, a
telephone number without its country, an address of the sixth version, a card in other
groups) give further candidates.

Four labelers vote on every candidate, base, failed or wide, with yes, no or nothing:
the pattern and its test (that of the base pattern, or of the wide one: check digits,
number plans, a name before the sign), a gazetteer of the kind (top-level domains,
country codes, issuer numbers, reserved networks), the words before it, and the
characters around it. They are counted over all documents by kind, votes and shape of
the span (length, share of digits, other signs, each in four steps), a table of at most
4 x 81 x 64 rows. Expectation-maximisation estimates from the votes, without labels, how
often each labeler votes how on real and on false candidates. A logistic classifier for
each kind is trained on votes and shape against these posteriors; wide candidates that it
gives ``threshold`` or more, and that touch no base span, are added.

Built-in functions only. The patterns are possessive and start at the beginning of a
run of their characters or where the last match ended, which finds the same matches in
a time in proportion to the text. Text without digits or signs is passed over early.

Defined results: null text counts as empty; repeated rows and ids give one row each; an
empty table gives no rows; the longest texts are searched whole. Only the named columns
are read. Places are code points, the end is exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in the form that Java finds in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}){1,6}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9/_]|\.[0-9])",
    "phone": r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])",
}
#: What a text holds at least for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
WIDE_NEEDS = {"email": r"[(\[{]at[)\]}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][./_][0-9]", "phone": r"[0-9][.-][0-9]"}
#: Gazetteers: endings, country codes, issuers, and networks that are nobody's.
YES = {
    "email": r"\.(?:com|org|net|edu|gov|mil|int|info|biz|io|eu|de|fr|es|it|nl|be|at|ch|uk|ie|pt|pl|se|no|fi|dk|cz|gr|ru|ua|tr|us|ca|mx|br|ar|au|nz|jp|cn|kr|in|za)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6011|64[4-9]|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9]",
}
NO = {
    "email": r"(?:^|[@.])(?:invalid|localhost|test)$",
    "ip": r"^(?:0|10|127|255)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.",
    "card": r"^(?:0|1|9)",
    "phone": r"^\+0|(?:0000000|1111111|1234567)",
}
BEFORE_YES = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach|reply|address|kontakt|correo|courriel)\b",
    "ip": r"\b(?:ip|host|server|client|address|from|login|peer|gateway)\b",
    "card": r"\b(?:card|credit|debit|visa|mastercard|amex|payment|karte|tarjeta|carte)\b",
    "phone": r"\b(?:phone|call|tel|telephone|mobile|cell|fax|contact|telefon|llame|appelez)\b",
}
BEFORE_NO = r"\b(?:version|release|isbn|issn|doi|order|invoice|serial|build|section|figure|part no|item)\W*$"
LABELERS = ("test", "gazetteer", "before", "around")
#: What tells a span's shape, each 0 to 3.
SHAPE = ("size", "digits", "marks")


def prefix_sums(values: Column) -> Column:
    """The sums before each value and at the end, by two levels of blocks, so that a
    long array is not copied for each of its values.
    """
    zero = F.lit(0).cast("long")

    def running(some: Column, start: Column) -> Column:
        return F.aggregate(some, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    count = F.ceil(F.size(values) / 256).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(values, b * 256 + 1, 256))).otherwise(F.array(F.slice(values, 1, 0)))
    starts = running(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero)
    each = F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, s: F.slice(running(b, s), 1, F.size(b)))
    return F.concat(F.flatten(each), F.array(F.element_at(starts, -1)))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:  # the i-th digit from the right, from 1
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The test of a base match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.rlike(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def passes_wide(kind: str, match: Column) -> Column:
    """The test of a wide match: does it hold what such data must hold?"""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.rlike(match, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._%+-]* ?[(\[{]")) & F.rlike(match, F.lit(r"[A-Za-z]{2,}$"))
    if kind == "ip":  # more than one group that is not zero
        return F.rlike(match, F.lit(r"[1-9A-Fa-f][0-9A-Fa-f]*:.*[1-9A-Fa-f]"))
    if kind == "card":
        return luhn(digits)
    return F.rlike(digits, F.lit("^[2-9][0-9]{2}[2-9]")) & ~F.rlike(digits, F.lit("^[0-9]11|^[0-9]{3}[0-9]11"))


def add_candidates(rows: DataFrame, kind: str, wide: bool) -> DataFrame:
    """Column <kind>_base or <kind>_wide: an array of start, end, good and the votes."""
    pattern, needs = (WIDE[kind], WIDE_NEEDS[kind]) if wide else (BASE[kind], NEEDS[kind])
    text, out = F.col("_hf_text"), f"{kind}_{'wide' if wide else 'base'}"
    some = F.contains(text, F.lit("@")) if needs == "@" else F.rlike(text, F.lit(needs))
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("_hf_found", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
    rows = rows.withColumn("_hf_parts", F.when(F.size("_hf_found") > 0, F.split(text, pattern, -1)).otherwise(empty))
    lengths = F.zip_with(F.slice("_hf_parts", 1, F.size("_hf_found")), "_hf_found", lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    rows = rows.withColumn("_hf_sums", F.when(F.size("_hf_found") > 0, prefix_sums(lengths)).otherwise(F.array().cast("array<long>")))

    def one(match: Column, i: Column) -> Column:
        before, after = F.lower(F.right(F.get("_hf_parts", i), F.lit(40))), F.left(F.get("_hf_parts", i + 1), F.lit(1))
        end = F.get("_hf_sums", i + 1)
        plain = F.regexp_replace(match, "[^0-9]", "") if kind == "card" else F.lower(match)
        good = F.lit(False) if wide else passes(kind, match)
        test = F.when(passes_wide(kind, match) if wide else good, 1).otherwise(-1)
        gazetteer = F.when(F.rlike(plain, F.lit(NO[kind])), -1).when(F.rlike(plain, F.lit(YES[kind])), 1).otherwise(0)
        context = F.when(F.rlike(before, F.lit(BEFORE_NO)), -1).when(F.rlike(before, F.lit(BEFORE_YES[kind])), 1).otherwise(0)
        glued = F.rlike(F.right(before, F.lit(1)), F.lit(r"[\p{L}\p{N}_]")) | F.rlike(after, F.lit(r"[\p{L}\p{N}_@]"))
        around = F.when(glued, -1).otherwise(1)
        numbers = F.length(F.regexp_replace(match, "[^0-9]", ""))
        signs = F.length(F.regexp_replace(match, "[A-Za-z0-9]", ""))
        shape = (F.least(F.lit(3), F.floor(F.length(match) / 10)), F.floor(numbers * 3 / F.length(match)), F.least(F.lit(3), signs))
        told = [v.cast("int").alias(n) for n, v in zip(LABELERS + SHAPE, (test, gazetteer, context, around, *shape), strict=True)]
        return F.struct((end - F.length(match)).alias("start"), end.alias("end"), good.alias("good"), *told)

    return rows.withColumn(out, F.transform("_hf_found", one)).drop("_hf_found", "_hf_parts", "_hf_sums")


def find_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_hf_id, and the candidates of each kind as two arrays."""
    rows = docs.select(F.col(id_col).alias("_hf_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_hf_text"))
    for kind in KINDS:
        rows = add_candidates(add_candidates(rows, kind, False), kind, True)
    return rows.drop("_hf_text")


Counts = dict[tuple[int, ...], int]


def reliabilities(counts: Counts, rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Posteriors by combination of votes, and each labeler's chances of its votes on
    real and false candidates, by expectation-maximisation from agreement.
    """
    chance = [{(v, y): (0.1, 0.2, 0.7)[v * (1 if y else -1) + 1] for v in (-1, 0, 1) for y in (0, 1)} for _ in LABELERS]
    prior, total, post = 0.5, sum(counts.values()), {}
    for _ in range(rounds):
        for votes in counts:
            real = prior * math.prod(chance[i][v, 1] for i, v in enumerate(votes))
            false = (1 - prior) * math.prod(chance[i][v, 0] for i, v in enumerate(votes))
            post[votes] = real / (real + false)
        prior = (1 + sum(n * post[k] for k, n in counts.items())) / (2 + total)
        for i in range(len(LABELERS)):
            for y in (0, 1):
                # A labeler is held to be right rather than wrong by the start's ten votes.
                mass = {v: 10 * (0.1, 0.2, 0.7)[v * (1 if y else -1) + 1] for v in (-1, 0, 1)}
                for k, n in counts.items():
                    mass[k[i]] += n * (post[k] if y else 1 - post[k])
                whole = sum(mass.values())
                for v in mass:
                    chance[i][v, y] = mass[v] / whole
    return post, chance


def features(told: tuple[int, ...]) -> list[float]:
    """1, yes and no of each labeler, and the steps of each sign of the shape."""
    votes, shape = told[: len(LABELERS)], told[len(LABELERS) :]
    return [1.0, *[float(v == s) for v in votes for s in (1, -1)], *[float(v == s) for v in shape for s in (1, 2, 3)]]


def classifier(counts: Counts, post: dict[tuple[int, ...], float], ridge: float = 0.05) -> list[float]:
    """Weights of a logistic curve over features() against the posteriors of the votes,
    by Newton steps on the counted combinations.
    """
    rows = sorted(counts)
    size = len(features((0,) * len(LABELERS + SHAPE)))
    if not rows:
        return [0.0] * size
    x = np.array([features(r) for r in rows])
    n, y = np.array([counts[r] for r in rows], float), np.array([post[r[: len(LABELERS)]] for r in rows])
    w = np.zeros(size)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(size), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def fit(candidates: DataFrame) -> dict[str, list[float]]:
    """A classifier for each kind; only counts of votes and shapes reach the driver."""

    def told(kind: str) -> Column:
        return F.transform(F.concat(f"{kind}_base", f"{kind}_wide"), lambda c: F.struct(F.lit(kind).alias("kind"), *[c[n].alias(n) for n in LABELERS + SHAPE]))

    rows = candidates.select(F.explode(F.concat(*map(told, KINDS))).alias("c")).select("c.*")
    counted: dict[str, Counts] = {k: {} for k in KINDS}
    for r in rows.groupBy("kind", *LABELERS, *SHAPE).count().collect():
        counted[r["kind"]][tuple(r[n] for n in LABELERS + SHAPE)] = r["count"]
    return {k: classifier(c, reliabilities(votes_of(c))[0]) for k, c in counted.items()}


def votes_of(counts: Counts) -> Counts:
    """The counts by votes alone."""
    out: Counts = {}
    for told, n in sorted(counts.items()):
        out[told[: len(LABELERS)]] = out.get(told[: len(LABELERS)], 0) + n
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """One row for each document: ``id_col`` and, for each kind, <kind>_base (start, end)
    and <kind>_added (start, end of the spans that the classifier adds).
    """
    found = stored(find_candidates(docs, id_col, text_col), "pii-candidates")
    weights = fit(found)
    for k in KINDS:
        found = found.withColumn(f"{k}_base", F.transform(F.filter(f"{k}_base", lambda c: c["good"]), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    taken = F.concat(*[f"{k}_base" for k in KINDS])

    def added(kind: str) -> Column:
        def wanted(c: Column) -> Column:
            w = iter(weights[kind])
            z = F.lit(next(w))
            for n in LABELERS:
                z = z + F.when(c[n] == 1, next(w)).when(c[n] == -1, next(w)).otherwise(0.0)
            for n in SHAPE:
                z = z + F.when(c[n] == 1, next(w)).when(c[n] == 2, next(w)).when(c[n] == 3, next(w)).otherwise(0.0)
            return (1 / (1 + F.exp(-z)) >= threshold) & ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))

        return F.transform(F.filter(f"{kind}_wide", wanted), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))

    found = found.select("*", *[added(k).alias(f"{k}_added") for k in KINDS])
    return found.select(F.col("_hf_id").alias(id_col), *[f"{k}_{x}" for k in KINDS for x in ("base", "added")])


def _told(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256 and spans of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.array_join(F.concat(*[_told(k, F.col(f"{k}_base")) for k in KINDS]), ",")
    spans = F.array_join(F.concat(*[_told(k, F.array_sort(F.concat(f"{k}_base", f"{k}_added"))) for k in KINDS]), ",")
    return found.select("doc_id", *[F.size(f"{k}_base").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))
