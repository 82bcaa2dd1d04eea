import random

import public_tokenizers

import corpus_pipeline as P
from helixframe.llm import bpe


def corpus():
    rnd = random.Random(9)
    voc = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    say = lambda n: " ".join(rnd.choice(voc) for _ in range(n))
    docs, labels, items = {}, [], [(i, say(30)) for i in range(5)]
    for i in range(300):
        docs[i] = "\n".join(say(rnd.randint(12, 40)) for _ in range(4))
    for i in range(0, 300, 10):
        for w in ("zidiot", "zscum", "zmoron"):
            docs[i] = docs[i].replace(" ", f" {w} ", 1)
    labels = [(i, 1, int(i % 10 == 0)) for i in range(300) if i % 3]
    passage = say(60)
    docs[301] = say(30) + "\n" + passage
    docs[302] = say(30) + "\n" + passage
    docs[303] = docs[1]
    docs[304] = "\n".join(" ".join(w if j % 30 else "zz" for j, w in enumerate(line.split())) for line in docs[2].split("\n"))
    docs[305] = say(20) + "\n" + items[3][1] + "\n" + say(20)
    docs[306] = None
    docs[307] = ""
    return docs, labels, items, passage


def test_stages(spark, tmp_path):
    docs, labels, items, passage = corpus()
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs.items()] + [(4, docs[4], "en", "src0", len(docs[4]))]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    seen, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in now.collect()}
    toxic = {i for i in range(0, 300, 10)}
    assert toxic.isdisjoint(seen["toxicity"]) and set(docs) - set(seen["toxicity"]) == toxic
    lines = seen["line_dedup"]
    assert passage in lines[301].text and passage not in lines[302].text and lines[302].n_chars == len(lines[302].text)
    assert 303 not in lines and set(seen["toxicity"]) - set(lines) <= {303, 304}
    assert all(lines[i].text == docs[i] for i in lines if i < 300)
    near = seen["near_duplicates"]
    assert 306 in near and 307 not in near and now.filter("doc_id = 4").count() == 1
    leaks = seen["decontamination"]
    assert set(near) - set(leaks) == {305}
    own = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(leaks)
    for i, r in got.items():
        ids = own.encode(leaks[i].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == bpe._hex(" ".join(map(str, ids)))


def test_rows_of_one_id_are_judged_apart(spark, tmp_path):
    docs, labels, items, _ = corpus()
    toxic, clean, leak = docs[0], "plain words of no harm " * 6, f"some text {items[2][1]} more text"
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs.items()] + [(i, t, "en", "src0", len(t)) for i in (None, 900) for t in (toxic, clean, leak)] + [(901, None, "en", "src0", 0), (None, None, "en", "src0", 0)]
    for name, data, schema in (("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage, gone in ((P.drop_toxic, toxic), (P.drop_leaks, leak)):
        kept = [(r.doc_id, r.text) for r in stage(spark, table, str(tmp_path)).collect()]
        for i in (None, 900):
            assert {t for j, t in kept if j == i and t} == {toxic, clean, leak} - {gone}
        assert (901, None) in kept and (None, None) in kept


def test_empty_tables_and_long_texts(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("documents", schema)):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    long = "\n".join(f"line {i} of a text that goes on and on" for i in range(20_000))
    rows = [(1, long, "en", "s", len(long)), (2, "short words in a line", "en", "s", 21), (2, "others under that id", "en", "s", 20), (None, None, None, None, None)]
    now = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {(r.doc_id, r.text) for r in now.collect()}
    # Each line is one replaced word from the first: those after it go.
    assert kept == {(1, "line 0 of a text that goes on and on"), (2, "short words in a line"), (2, "others under that id"), (None, None)}
