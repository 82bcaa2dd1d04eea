"""Queries on odd rows and on tables that grow: against their SQL or a plainer form."""

import random

import duckdb
import numpy as np
import pyarrow as pa

from helixframe.functions import codec
from helixframe.operators import grouping, kmers, segments
from helixframe.plans import catalog, collection
from helixframe.plans.tables import stored


def documents(spark, path, rows):
    """A folder with ``rows`` (doc_id, text, lang, source, n_chars) as its documents."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def as_sql(name, path):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    got = db.sql(catalog.ORACLES[name])
    at = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=str)


def as_query(spark, name, path):
    got = catalog.QUERIES[name](spark, path)
    return sorted((tuple(r) for r in got.select(*sorted(got.columns)).collect()), key=str)


def test_number_codes_of_nothing_and_of_none(spark, tmp_path):
    sf = documents(spark, tmp_path, [(i, "x", "en", "s", n) for i, n in enumerate([0, 0, None, 1, 127, 128, 499, 500, 999, 1000, 16511, 16512, 2113664])])
    assert as_query(spark, "fn42_number_codes", sf) == as_sql("fn42_number_codes", sf)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_contigs(spark, seed, n=40):
    rnd = random.Random(seed)
    parent = "".join(rnd.choices("ACGT", (5, 2, 1, 4), k=900))
    rows = [("s0" if i < 4 else f"s{i % 3}", f"c{i}", "".join(c if rnd.random() > 0.02 else rnd.choice("ACGTN") for c in parent[rnd.randint(0, 300) : rnd.randint(300, 900)])) for i in range(n)]
    return spark.createDataFrame([*rows, ("s1", "none", None), ("s1", "empty", ""), ("s2", "short", "ACG"), ("s2", "n", "N" * 50)], "sample string, contig string, seq string")


def by_shuffle(monkeypatch):
    for where in (kmers, segments):
        monkeypatch.setattr(where, "EXACT_K", 0)


def test_contigs_are_cut_where_they_are(spark, monkeypatch):
    df = some_contigs(spark, 1)
    first = segments.first_sample(df)
    told = {}
    for way in ("here", "by shuffle"):
        if way == "by shuffle":
            by_shuffle(monkeypatch)
        split = segments.determine_splitters(first, 9, 60)["splitters"]
        single = kmers.contig_counts(df, 9).filter("n = 1").select("kmer")
        known = kmers.contig_counts(first, 9).select("kmer")
        out = [split, single, kmers.occurrences(df, 9, split), segments.segment(df, split, 9), segments.segment(df, split, 9, reset=False), segments.segment(df, split, 9, whole_tail=False), segments.splitters_among(df, single, 9, 60), segments.splitters_among(df, single, 9, 60, to_break=False)]
        out += [segments.new_splitters(df, kmers.enumerate_kmers(df, 9), known, 9, 60), segments.adaptive_splitters(df, 9, 60)]
        told[way] = [sorted(map(str, x.select(*sorted(x.columns)).collect())) for x in out]
        if way == "here":  # nothing of a contig meets anything but what was broadcast
            assert not [i for i in (2, 3, 4, 5, 6, 7, 8) if "Exchange" in plan(out[i])]
    assert told["here"] == told["by shuffle"]
    assert all(told["here"])


def test_long_contigs_are_read_in_parts(monkeypatch):
    rnd = random.Random(5)
    seqs = pa.array(["".join(rnd.choices("ACGTN", (9, 2, 1, 4, 0.1), k=n)) for n in (30, 700, 0, 5, 64, 65, 300)])
    whole = [[np.concatenate(x).tolist() for x in zip(*f(seqs, 5))] for f in (kmers.scanned, kmers.own_singles)]
    spaced = segments.Spaced(7)
    rows, pos = (np.array(x) for x in whole[0][:2])
    once = spaced.take(rows, pos).tolist()
    monkeypatch.setattr(kmers, "BLOCK", 64)
    assert [[np.concatenate(x).tolist() for x in zip(*f(seqs, 5))] for f in (kmers.scanned, kmers.own_singles)] == whole
    spaced, parts, before = segments.Spaced(7), [], 0
    for row, place, _, _ in kmers.scanned(seqs, 5):
        parts += (spaced.take(row, place) + before).tolist()
        before += len(row)
    assert parts == once


def test_letters_of_texts(spark, tmp_path):
    texts = ["aCgTn NN x", "", None, "ünïcode ẗ ﬆ Tag", "\n\t", "GATTACA" * 3]
    sf = documents(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    assert [r.seq for r in catalog.contigs(spark, sf, "N").orderBy("contig").collect()] == ["ACGTNNN", "", None, "NCTAG", "", "GATTACA" * 3]
    want = pa.array(texts).slice(3, 3)
    assert codec.only_bases_column(want).to_pylist() == ["CTAG", "", "GATTACA" * 3]


def test_shared_kmers_add_up_without_a_join(spark, monkeypatch):
    df = some_contigs(spark, 2).filter("seq IS NOT NULL")
    held = {r.contig: {w for i in range(len(r.seq) - 8) if "N" not in (w := canonical(r.seq[i : i + 9]))} for r in df.collect()}
    index = {g: set(random.Random(g).sample(sorted(held[f"c{g}"]), min(60 + g, len(held[f"c{g}"])))) for g in range(30)}
    index[41] = index[40] = index[3]  # ties
    code = lambda w: sum("ACGT".index(c) * 4 ** (8 - i) for i, c in enumerate(w))
    table = spark.createDataFrame([(code(w), g) for g, some in index.items() for w in some], "kmer long, group_id long")
    want = set()
    for contig, own in held.items():
        best = sorted((-n, g) for g, some in index.items() if (n := len(own & some)) >= 5)[:10]
        want |= {(contig, g, -n, i + 1) for i, (n, g) in enumerate(best) if 2 * n <= best[0][0]}
    for size in (grouping.POSTINGS, 700):  # in one part, and in some
        monkeypatch.setattr(grouping, "POSTINGS", size)
        got = grouping.shared_kmer_candidates(df, table, 9, 5)
        assert {(r.contig, r.group_id, r.shared, r.rank) for r in got.collect()} == want
        assert "Join" not in plan(got)


def canonical(word):
    return min(word, word[::-1].translate(str.maketrans("ACGT", "TGCA")))


def plain_tokens(differ, target):
    """Differ.tokens() base by base."""
    data, text, out, i, expected = target.tobytes(), differ.text, [], 0, 0
    alike = lambda i, j: next((n for n in range(min(len(data) - i, len(text) - j)) if data[i + n] != text[j + n]), min(len(data) - i, len(text) - j))
    single = lambda n: n < len(out) and out[-1 - n][0] in ("literal", "equal")
    if data == text:
        return []
    while i < len(data):
        run = len(data[i:]) - len(data[i:].lstrip(b"\x04"))
        if run >= 4:
            out.append(("run", i, run, 0))
            i += run
            continue
        best = (0, 0, 0)
        for at in differ.index.get(data[i : i + differ.word], ())[:64]:
            back = 0
            while single(back) and at - back > 0 and data[i - back - 1] == text[at - back - 1]:
                back += 1
            best = max(best, (alike(i, at) + back, -abs(at - expected), at), key=lambda x: x[:2])
        if best[0] >= differ.min_match:
            at, back = best[2], 0
            while back < len(out) and single(0) and at - back > 0 and data[i - back - 1] == text[at - back - 1]:
                back += 1
                out.pop()
            out.append(("match", i - back, alike(i, at) + back, at - back))
            i, expected = i + alike(i, at), at + alike(i, at)
            continue
        out.append(("equal" if expected < len(text) and text[expected] == data[i] else "literal", i, 1, expected))
        i, expected = i + 1, expected + 1
    return out


def test_differences_base_by_base():
    rnd = random.Random(4)
    for n in range(300):
        ref = "".join(rnd.choices("ACGTN", (5, 1, 1, 4, 0.2), k=rnd.choice([0, 11, 60, 400]))) * rnd.choice([1, 1, 3])
        target = "".join(c if rnd.random() > 0.04 else rnd.choice(["", "A", "NNNN", "TTG"]) for c in ref[rnd.randint(0, len(ref)) :] + ref)
        differ, codes = codec.Differ(codec.to_codes(ref), rnd.choice([5, 12, 20])), codec.to_codes(target)
        assert differ.tokens(codes) == plain_tokens(differ, codes)
        text, costs = differ.encode(codes), [differ.costs(codes, at) for at in (True, False)]
        assert differ.decode(text).tolist() == codes.tolist()
        assert [c.sum() for c in costs] == [len(text) if len(codes) else 0] * 2 == [differ.estimate(codes)] * 2
        assert codec.as_list(costs[0]) == ",".join(map(str, costs[0].tolist())).encode()


class Seen(bytes):
    read = 0

    def __getitem__(self, at):
        out = bytes(self)[at]
        Seen.read += len(out) if isinstance(at, slice) else 1
        return out


def test_a_match_reads_what_is_alike_only():
    a, b = Seen(b"\x00\x01" * 50_000), Seen(b"\x00\x01" * 7 + b"\x02" * 99_986)
    assert codec.Differ._common(a, 0, b, 0) == 14
    assert Seen.read < 100


def test_packs_are_made_once(spark, tmp_path, monkeypatch):
    """Rows that are dealt by range are told twice unless they are stored."""
    names = []
    monkeypatch.setattr(collection, "stored", lambda df, name: names.append(name) or stored(df, name))
    made = collection.create(some_contigs(spark, 3).filter("seq IS NOT NULL"), str(tmp_path / "c"), k=9, segment_size=60, min_match=12)
    assert "packs" in names and made.k == 9 and made.min_match == 12
    assert made.table("params").count() == 1
