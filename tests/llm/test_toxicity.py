import math
import random

import pytest

from helixframe.llm import toxicity as T


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then both sides."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a = -best[2]
    b = a - best[1]
    return brute_segments(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_segments():
    rnd = random.Random(2)
    assert [x[:2] for x in T.segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5])] == [(0, 1), (2, 3), (4, 11)]
    for _ in range(300):
        s = [rnd.choice([-2.0, -1.0, -0.5, 1.0, 2.0, 3.5]) + rnd.random() / 1000 for _ in range(rnd.randint(0, 14))]
        assert [(a, b, round(x, 6)) for a, b, x in T.segments(s)] == [(a, b, round(x, 6)) for a, b, x in brute_segments(s)]


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(1)
    voc = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(voc) for _ in range(rnd.randint(20, 120))]
        bad = i % 9 == 0
        if bad:
            for _ in range(5):
                words[rnd.randrange(len(words))] = rnd.choice(["zidiot", "zmoron", "zscum"])
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, "zidiot " * 20_000), (None, "zscum zmoron zidiot here"), (1, rows[1][1])]
    labels += [(1, 1, 0), (777_777, 0, 1), (2, 0, None), (None, 0, 1)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, words string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, T.score_documents(docs, lab).collect()


def test_learns_and_scores_all(scored):
    rows, got = scored
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    real = [(r.predicted, int(r.doc_id % 9 == 0)) for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert sum(a == b for a, b in real) / len(real) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by[5000].score == by[5001].score and by[5000].predicted == 0 and by[5002].predicted == 1 and by[None].predicted == 1 and by[None].held_out is False


def test_passages_are_places_of_the_text(scored):
    rows, got = scored
    texts = dict(rows)
    hit = [r for r in got if r.doc_id == 9][0]
    words = " ".join(texts[9][p["start"] : p["end"]] for p in hit.passages)
    assert sum(w in words for w in ("zidiot", "zmoron", "zscum")) > 0


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in T.score_documents(docs, none).collect()] == [0]
    one = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert T.score_documents(docs.limit(0), one).count() == 0


def invented(copies, seed=5):
    """Documents in which a thirtieth of the words are of a topic that toxic ones hold
    more often, and toxic words only in toxic ones: labels grow with ``copies``.
    """
    rnd = random.Random(seed)
    voc = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    topic = ["".join(rnd.choice("klmnopq") for _ in range(6)) for _ in range(300)]
    bad = ["xidiot", "xmoron", "xscum", "xtrash"]
    rows = []
    for i in range(600 * copies):
        toxic = rnd.random() < 0.11
        share = 0.1 if toxic else 0.033
        words = [rnd.choice(topic) if rnd.random() < share else rnd.choice(voc) for _ in range(rnd.randint(20, 150))]
        for _ in range(4 if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.mark.parametrize("copies", [1, 3, 10])
def test_does_not_change_with_the_number_of_labels(spark, copies):
    rows = invented(copies)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 5 != 1], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert model.scale > 0.3 and model.loss >= T.LEAST_LOSS
    got = T.score_documents(docs, labels).select("doc_id", "predicted").collect()
    truth = {i: t for i, _, t in rows}
    clean, toxic = ([r.predicted for r in got if truth[r.doc_id] == t] for t in (0, 1))
    assert sum(clean) / len(clean) < 0.01 and sum(toxic) / len(toxic) > 0.9


def test_one_document_many_times_over(spark):
    """Copies under new ids are no new evidence, but may not break the law either."""
    rows = [(i + 600 * m, t, x) for m in range(10) for i, t, x in invented(1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 3], "doc_id long, toxic int")
    got = T.score_documents(docs, labels).select("doc_id", "predicted").collect()
    truth = {i: t for i, _, t in rows}
    assert sum(r.predicted != truth[r.doc_id] for r in got) / len(got) < 0.02


def test_evidence_is_not_capped():
    model = T.Model(words={"bad": 5.0}, scale=1.0, factor=0.01, intercept=-3.0, slope=2.0)
    some = [model.score(model.evidence(100, [(0, 1, s)])) for s in (5.0, 50.0, 500.0, 5000.0, 50_000.0)]
    assert some == sorted(set(some)) and some[-1] < 1


def test_no_law_is_an_error():
    """Where clean words gain as much as they can lose, an error says so."""
    model = T.Model(words={"bad": 3.0})
    with pytest.raises(ValueError):
        T.fit_law(model, [(10, list(range(10)), [3.0] * 10)])


def test_scores_equal_a_loop(spark):
    """Evidence and score of every document from a dense scan by the definition."""
    rows = invented(1, seed=9)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = {r["_hf_id"]: r for r in T.apply(docs, model).collect()}
    assert any(r.passages for r in got.values())
    for i, text, _ in rows[::3]:
        words = text.split()
        found = brute_segments([model.gain(w) or -model.loss for w in words])
        evidence = sum(max(0.0, -math.log(model.factor * len(words)) + model.scale * s) for _, _, s in found)
        assert [round(p.score, 6) for p in got[i].passages] == [round(s, 6) for _, _, s in found]
        assert got[i].evidence == pytest.approx(evidence) and got[i].score == pytest.approx(1 / (1 + math.exp(-(model.intercept + model.slope * math.log1p(evidence)))))
