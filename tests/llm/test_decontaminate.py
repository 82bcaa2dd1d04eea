import random
from itertools import combinations

import pytest

from helixframe.llm import decontaminate as D


@pytest.mark.parametrize("n", range(D.LEAST_WORDS, D.WINDOW + 1))
def test_masks_lose_nothing(n):
    size, errors = D.shape(n)
    for bad in combinations(range(size), errors):
        assert any(not {s + p for p in m} & set(bad) for m in D.masks_for(size, errors) for s in range(size - m[-1]))


def brute(items, doc):
    out = set()
    for i, w in items:
        if len(w) < D.LEAST_WORDS:
            continue
        size, errors = D.shape(len(w))
        if any(sum(x != y for x, y in zip(doc[a : a + size], w[b : b + size], strict=True)) <= errors for a in range(len(doc) - size + 1) for b in range(len(w) - size + 1)):
            out.add(i)
    return out


def cases(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        voc = [chr(97 + i) * 3 for i in range(rnd.choice([3, 8, 25]))]
        items = [(i, [rnd.choice(voc) for _ in range(rnd.randint(3, 30))]) for i in range(5)]
        doc = [rnd.choice([*voc, "zzz"]) for _ in range(rnd.randint(0, 50))]
        for _, w in items[:3]:
            a = rnd.randint(0, len(w))
            j = rnd.randint(0, len(doc))
            doc[j:j] = [x if rnd.random() > 0.15 else "qq" for x in w[a : a + rnd.randint(3, 25)]]
        yield items, doc


def test_equals_brute_force():
    for items, doc in cases(1, 150):
        assert {x[1] for x in D.Seeds(items).overlaps([[], doc, ["q"]])} == brute(items, doc)


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_tables(spark, docs, rows):
    items, texts, want = [], [], set()
    for n, (its, doc) in enumerate(cases(2, 6)):
        its = [(n * 10 + i, [f"{w}{n}" for w in ws]) for i, ws in its]
        doc = [f"{w}{n}" for w in doc]
        items += [(i, " ".join(w)) for i, w in its]
        texts.append((n, "\n".join(doc)))
        want |= {(n, i) for i in brute(its, doc)}
    texts += [(90, None), (91, ""), (0, texts[0][1]), (92, "word " * 30_000)]
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = D.contaminated(docs(texts, ["item_id", "score"]), bench, broadcast_rows=rows).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert D.contaminated(docs([]), bench, broadcast_rows=rows).count() == 0
    assert D.contaminated(docs(texts), bench.limit(0), broadcast_rows=rows).count() == 0


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_null_and_large_ids(spark, docs, rows):
    passage = " ".join(f"word{i}" for i in range(20))
    texts = [(None, f"before {passage} after"), (None, "nothing of that kind " * 5), (2**62 + 1, passage), (3, "clean text " * 10)]
    got = D.contaminated(docs(texts), spark.createDataFrame([(7, passage)], "item_id long, text string"), broadcast_rows=rows).collect()
    assert sorted((str(r.doc_id), r.item_id, r.first_word) for r in got) == [("4611686018427387905", 7, 0), ("None", 7, 1)]


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_short_items_are_whole_lines(spark, docs, rows):
    bench = spark.createDataFrame([(1, "Yes, it is!"), (2, "yes"), (3, "Yes it IS"), (4, "one two three four five")], "item_id long, text string")
    texts = [(1, "first line here\nyes it is\nlast"), (2, "yes it is so\nand no"), (3, "a\n YES. \nb"), (4, "x one two three four five y"), (5, "yes\nyes"), (6, None)]
    got = D.contaminated(docs(texts), bench, broadcast_rows=rows).collect()
    assert sorted((r.doc_id, r.item_id, r.first_word, r.end_word, r.same_words) for r in got) == [(1, 1, 3, 6, 3), (1, 3, 3, 6, 3), (3, 2, 1, 2, 1), (4, 4, 1, 6, 5), (5, 2, 0, 1, 1)]
