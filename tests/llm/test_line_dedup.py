import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.llm import line_dedup as L


def edits(a, b):
    """Is b one word edit from a?"""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return 2
    h = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    t = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), len(b))
    return 1 if h + t >= len(a) - 1 else 2


def brute(rows, min_words=5):
    lines = sorted((i, n, w) for i, t in rows if i is not None and t is not None for n, s in enumerate(t.split("\n")) if (w := re.findall(r"[^\x20\x09-\x0D]+", s)))
    out = {}
    for x, (i, n, w) in enumerate(lines):
        for j, m, v in lines[:x]:
            d = edits(v, w)
            if d == 0 or (d == 1 and min(len(v), len(w)) >= min_words):
                out[i, n] = (j, m)
                break
    return out


def rows(seed, size=120):
    rnd = random.Random(seed)
    voc = [chr(97 + i) for i in range(rnd.choice([2, 5, 30]))]
    pool = [[rnd.choice(voc) for _ in range(rnd.choice([1, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 32, 40]))] for _ in range(12)]
    out = []
    for i in range(size):
        lines = []
        for _ in range(rnd.randint(0, 4)):
            w = list(rnd.choice(pool))
            act = rnd.randrange(5)
            at = rnd.randrange(len(w))
            if act == 0:
                w[at] = rnd.choice([*voc, "zz"])
            elif act == 1:
                del w[at]
            elif act == 2:
                w.insert(at, rnd.choice([*voc, "yy"]))
            lines.append(rnd.choice([" ", "  ", "\t"]).join(w))
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_equals_brute_force(spark, docs, seed):
    data = rows(seed)
    got = L.repeats(docs(data, ["line", "first", "keys"])).collect()
    assert {(r.doc, r.line): (r.first_doc, r.first_line) for r in got} == brute(data) and len(got) == len(brute(data))


def test_edge_cases(spark, docs):
    data = [(3, "one two three four five\n\nshort"), (1, None), (2, ""), (4, "one two three four six\r\nshort\nown words of this line"), (5, "one two three four five\nshort"), (None, "short\nshort"), (7, "x " * 30_000 + "y"), (8, "x " * 30_000 + "z"), (9, "a\n\n")]
    got = {(r.doc, r.line): (r.first_doc, r.first_line, r.edits) for r in L.repeats(docs(data)).collect()}
    assert got == {(4, 0): (3, 0, 1), (4, 1): (3, 2, 0), (5, 0): (3, 0, 0), (5, 1): (3, 2, 0), (8, 0): (7, 0, 1)}
    cleaned = L.clean_documents(docs(data, ["line", "doc"]), L.repeats(docs(data)))
    assert {(r.doc_id, r.text) for r in cleaned.collect()} == {(3, data[0][1]), (1, None), (2, ""), (4, "own words of this line"), (None, "short\nshort"), (7, data[6][1]), (9, "a\n\n")}
    assert cleaned.columns == docs(data, ["line", "doc"]).columns
    assert L.repeats(docs([])).count() == 0


def test_repeated_rows_share_a_place(spark, docs):
    data = [(1, "the same words stand here"), (1, "the same words stand here"), (2, "the same words stand here")]
    assert {(r.doc, r.line) for r in L.repeats(docs(data)).collect()} == {(2, 0)}


def test_one_word_lines_of_a_hot_kind(spark, docs):
    data = [(i, "common line of five words\nnumber " + str(i) + " of a long row") for i in range(400)]
    got = {(r.doc, r.line): r.edits for r in L.repeats(docs(data)).collect()}
    assert got == {(i, 0): 0 for i in range(1, 400)} | {(i, 1): 1 for i in range(1, 400)}


def test_texts_are_split_once(spark, docs):
    """What a plan filters by holds no split and no replacement of whole texts again."""
    plan = L.worded_lines(docs([(1, "some words\nof\ttwo lines")]), "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter" in x]
    assert filters and not any("split(" in x or "replace(" in x for x in filters) and plan.count("split(text") + plan.count("split(replace") == 1
    got = L.worded_lines(docs([(1, "some  words\n \t\nof\ttwo lines"), (2, None), (None, "a b"), (3, "")]), "doc_id", "text").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "some words"), (1, 2, "of two lines")]


def test_left_texts_are_made_once(spark, docs):
    """A text that loses lines is split once, not for each line that stays, nor again to see
    whether any words are left; ends of lines are compared without turning them round.
    """
    gone = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 2)], "doc long, line long")
    data = [(1, "a b\nc\n d\t\n"), (2, "only\n \t"), (3, "x\ny\nz"), (4, None), (5, "kept"), (None, "e\nf")]
    cleaned = L.clean_documents(docs(data), gone)
    assert {(r.doc_id, r.text) for r in cleaned.collect()} == {(1, "a b\n d\t\n"), (3, "y"), (4, None), (5, "kept"), (None, "e\nf")}
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    long = "\n".join(f"row {i}" for i in range(30_000))
    (row,) = L.clean_documents(docs([(1, long)]), gone.filter("doc = 1")).collect()
    assert row.text == long.replace("row 1\n", "", 1)
    pairs = spark.createDataFrame([("a b c d", "a b c"), ("a b c d", "b c d"), ("a b c d", "a c d"), ("a b c d", "a x c d"), ("a b c d", "x b c y"), ("a a a a", "a a a"), ("a b c d", "d c b")], "a string, b string")
    edit = pairs.select(L.one_edit(F.split("a", " "), F.split("b", " ")).alias("e"))
    assert [r.e for r in edit.collect()] == [True, True, True, True, False, True, False] and "reverse(" not in edit._jdf.queryExecution().optimizedPlan().toString()
