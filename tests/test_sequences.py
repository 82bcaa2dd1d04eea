import gzip
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import compare, grouping, kmers, segments
from helixframe.operators.ranking import numbered
from helixframe.plans import collection
from helixframe.sources import fasta
from helixframe.streaming import ingest

TURN = str.maketrans("ACGT", "TGCA")


def contigs(spark, *rows):
    return spark.createDataFrame(list(rows), "sample string, contig string, seq string")


def brute_kmers(seq, k):
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if set(w) <= set("ACGT"):
            code = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
            yield i + 1, min(code(w), code(w[::-1].translate(TURN))), code(w) <= code(w[::-1].translate(TURN))


def brute_splits(seq, k, hits):
    out, last = [], None
    for pos in sorted(hits):
        if last is None or pos - last >= k:
            out.append(pos)
            last = pos
    return out


def family(seed=4):
    rnd = random.Random(seed)
    parent = "".join(rnd.choice("ACGT") for _ in range(4000))

    def child():
        s = list(parent)
        for _ in range(10):
            s[rnd.randrange(len(s))] = rnd.choice("ACGT")
        return "".join(s)

    return [("a#0", "c1", parent), ("b#0", "c1", child()), ("b#0", "c2", child()[::-1].translate(TURN)), ("c#0", "c1", child()[:2000] + "N" * 40 + child()[2000:]), ("c#0", "tiny", "ACG"), ("d#0", "c1", parent)]


def test_kmers(spark):
    rows = [("s", "a", "ACGTACGT"), ("s", "b", "ACNGTAC"), ("s", "c", "AC"), ("s", "d", ""), ("s", "e", "NNNN"), ("t", "f", "GATTACAGATTACARYK")]
    got = {(r.contig, r.pos, r.kmer, r.is_dir) for r in kmers.enumerate_kmers(contigs(spark, *rows), 3).collect()}
    assert got == {(c, *x) for _, c, s in rows for x in brute_kmers(s, 3)}


def test_golden_singletons(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 2, 3, 3, 3, 4, 5, 5, 6]], "kmer long")
    assert sorted(r.kmer for r in kmers.singletons(df).collect()) == [1, 4, 6]
    assert sorted(r.kmer for r in kmers.duplicates(df).collect()) == [2, 3, 5]
    one = kmers.enumerate_kmers(contigs(spark, ("s", "a", "ACGTACGT")), 3)
    assert kmers.singletons(one).count() == 0
    assert kmers.enumerate_kmers(contigs(spark, ("s", "a", "ACGT")), 3).count() == 2
    assert kmers.enumerate_kmers(contigs(spark, ("s", "a", "ACNGT")), 3).count() == 0


def test_identical_contigs_have_no_splitters(spark):
    found = segments.determine_splitters(contigs(spark, ("s", "a", "ACGTCATG"), ("s", "b", "ACGTCATG")), 3, 100)
    assert found["splitters"].count() == 0 and found["singletons"].count() == 0 and found["duplicates"].count() > 0


def test_spaced(spark):
    df = spark.range(1).select(F.array(*[F.struct(F.lit(p).cast("long").alias("pos")) for p in (1, 3, 7, 8, 20)]).alias("a"))
    assert [x["pos"] for x in df.select(segments.spaced(F.col("a"), F.lit(5)).alias("t")).first()["t"]] == [1, 7, 20]


@pytest.mark.parametrize("k", [5, 9])
def test_segments_match_a_scan(spark, k):
    rnd = random.Random(k)
    rows = [(f"s{i % 3}", f"c{i}", "".join(rnd.choice("ACGTN" if i % 4 == 0 else "ACGT") for _ in range(rnd.choice([0, 1, k - 1, k, 40, 300])))) for i in range(40)]
    df = contigs(spark, *rows)
    split = segments.determine_splitters(segments.first_sample(df), k, 20)["splitters"]
    known = {r.kmer for r in split.collect()}
    got = {}
    for r in segments.segment(df, split, k).collect():
        got.setdefault(r.contig, []).append((r.part, r.start, r.raw_length))
    for _, c, s in rows:
        cuts = brute_splits(s, k, [p for p, m, _ in brute_kmers(s, k) if m in known])
        want, begin = [], 0
        for p in cuts:
            want.append((begin, p - 1 + k - begin))
            begin = p - 1
        if s:
            want.append((begin, len(s) - begin))
        assert sorted(got.get(c, [])) == [(i, *w) for i, w in enumerate(want)]


def test_layout_is_the_same_for_any_partitioning(spark):
    df = contigs(spark, *family())
    split = segments.determine_splitters(segments.first_sample(df), 9, 100)["splitters"]
    rows = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append({tuple(r) for r in collection.layout(df.repartition(int(n)), split, 9).select("sample", "contig", "part", "group_id", "in_group_id", "is_rev_comp", "seq").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
    equal = {(g, i) for s, *_, g, i, _, q in rows[0] if g >= 16 and i == 0}
    assert len(equal) == len({g for *_, g, i, _, q in rows[0] if g >= 16})


def test_collection_round_trip(spark, tmp_path):
    rows = family()
    c = collection.create(contigs(spark, *rows), str(tmp_path / "c"), k=11, segment_size=200, min_match=12)
    got = {(r.sample, r.contig): r.seq for r in c.sample("a#0", "b#0", "c#0", "d#0").collect()}
    assert got == {(s, k): q for s, k, q in rows}
    assert [r.sample for r in c.samples().collect()] == ["a#0", "b#0", "c#0", "d#0"] and c.samples("b").count() == 1
    turned = rows[2][2]
    for a, b in [(0, 10), (290, 330), (100, 3900), (3990, 6000), (7, 7), (20, 7), (6000, 7000)]:
        assert c.range("b#0", "c2", a, b) == (turned[a:b] if a < b else "")
    assert c.length("c#0", "c1") == 4040 and c.contig("c#0", "tiny") == "ACG"
    assert {r.contig for r in c.contigs("b#0").collect()} == {"c1", "c2"}
    with pytest.raises(KeyError):
        c.contigs("nobody")
    with pytest.raises(KeyError):
        c.range("b#0", "nothing", 0, 5)
    stats = c.group_statistics().collect()
    assert sum(r.total for r in stats) == c.segments().count() and all(r.references <= 2 or r.group_id >= 16 for r in stats)
    delta = {r.stream: r for r in c.storage_statistics().collect()}["delta"]
    assert delta.packed < delta.raw / 4
    assert c.by_prefix("a").count() == 1 and len(c.reference(16)) > 0


def test_big_group_packs(spark):
    base = "ACGTTGCATGCCGATTACAGGCTTAACCGGTT"
    rows = [(f"s{i:03}", "c", base if i % 4 == 0 else base[:10] + "ACGT"[i % 4] * (i % 50) + base[10:]) for i in range(120)]
    df = contigs(spark, *rows).select("*", F.lit(0).alias("part"), F.lit(16).cast("long").alias("group_id"), F.col("contig").alias("contig_name"))
    got = grouping.in_group_ids(df).collect()
    assert {r.in_group_id for r in got if r.seq == base} == {0}
    ids = {}
    for r in got:
        ids.setdefault(r.seq, set()).add(r.in_group_id)
    assert all(len(v) == 1 for v in ids.values())
    assert sorted(next(iter(v)) for v in ids.values()) == list(range(len(ids)))
    packs = spark.createDataFrame([(16, 1), (16, 50), (16, 51), (3, 49), (3, 50)], "g long, i long").select(grouping.pack_of(F.col("g"), F.col("i")).alias("p")).collect()
    assert [r.p for r in packs] == [0, 0, 1, 0, 1]


def test_keys(spark):
    rows = [(5, 9, True, True), (9, 5, True, True), (5, 5, True, True), (5, None, True, None), (5, None, False, None), (None, 5, None, True), (None, 5, None, False), (None, None, None, None)]
    df = spark.createDataFrame([("s", "c", i, *r) for i, r in enumerate(rows)], "sample string, contig string, part int, front long, back long, front_is_dir boolean, back_is_dir boolean")
    got = [(r.key_front, r.key_back, r.is_rev_comp) for r in grouping.with_keys(df).orderBy("part").collect()]
    assert got == [(5, 9, False), (5, 9, True), (5, 5, True), (5, None, False), (None, 5, True), (None, 5, False), (5, None, True), (None, None, False)]


def test_middle_splitter(spark):
    groups = spark.createDataFrame([(16, 1, 4), (17, 4, 9), (18, 1, 7), (19, 7, 9), (20, 1, None)], "group_id long, key_front long, key_back long")
    pairs = spark.createDataFrame([(1, 9), (2, 9)], "front long, back long")
    assert [tuple(r) for r in grouping.middle_splitters(pairs, groups).select("front", "back", "middle").collect()] == [(1, 9, 4)]


def test_numbered(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1009)
    assert all(r.n == i + 1 for i, r in enumerate(numbered(df, ["x"]).orderBy("x").collect()))


def test_fasta(spark, tmp_path):
    (tmp_path / "one.fa").write_text(">seq1 first\nACGT\nacgtn\n>\nAAAA\n>empty\n>S#1#chr2\nTG-CA\r\n")
    with gzip.open(tmp_path / "two.fa.gz", "wt") as f:
        f.write(">x\nACGTRY\n")
    got = {(r.sample, r.contig): r.seq for r in fasta.contigs(spark, [str(tmp_path / "one.fa"), str(tmp_path / "two.fa.gz")], by_file=True).collect()}
    assert got == {("one", "seq1 first"): "ACGTACGTN", ("S#1", "chr2"): "TGCA", ("two", "x"): "ACGTRY"}
    long = contigs(spark, ("s", "c", "ACGT" * 45))
    fasta.write_fasta(long, str(tmp_path / "out"))
    back = fasta.records(spark, str(tmp_path / "out")).collect()
    assert [(r.header, r.raw) for r in back] == [("c", "ACGT" * 45)]
    fasta.split_by_sample(contigs(spark, ("a#0", "c", "AC"), ("b/1", "d", "GT")), str(tmp_path / "split"))
    assert (tmp_path / "split" / "name=a_0").is_dir() and (tmp_path / "split" / "name=b_1").is_dir()
    (tmp_path / "i.fai").write_text("chr1\t10\t5\t80\t81\n")
    assert fasta.fai(spark, str(tmp_path / "i.fai")).first().length == 10


def test_sample_order(spark):
    df = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A")], "at long, sample string")
    blocks = {r.sample: (r.first, r.blocks, r.contiguous) for r in fasta.sample_blocks(df, F.col("at")).collect()}
    assert blocks == {"A": (0, 2, False), "B": (1, 1, True)}
    with pytest.raises(Exception, match="not contiguous"):
        fasta.require_contiguous(df, F.col("at")).collect()
    assert fasta.require_contiguous(df.filter("at < 2"), F.col("at")).count() == 2


def test_comparison_of_a_collection_with_itself(spark):
    df = contigs(spark, *family())
    split = segments.determine_splitters(segments.first_sample(df), 9, 100)["splitters"]
    m = collection.layout(df, split, 9).cache()
    assert {r.status for r in compare.compare_boundaries(m, m).collect()} == {"same"}
    assert all(r.only_a == 0 and r.only_b == 0 for r in compare.compare_grouping(m, m).collect())
    assert all(r.same for r in compare.compare_references(m, m).collect())
    assert compare.compare_orientations(m, m).count() == 0
    assert all(r.packs_a == r.packs_b for r in compare.compare_packs(m, m).collect())
    m.unpersist()


def test_adaptive_splitters(spark):
    rnd = random.Random(8)
    other = "".join(rnd.choice("ACGT") for _ in range(1000))
    df = contigs(spark, *family()[:2], ("z#0", "new", other))
    plain = segments.determine_splitters(segments.first_sample(df), 13, 100)["splitters"]
    more = segments.adaptive_splitters(df, 13, 100)
    assert more.count() > plain.count() and plain.exceptAll(more).count() == 0


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.fa").write_text(">A#0#c1\nACGT\n>A#0#c2\nGG\n")
    run = lambda: ingest.ingest(ingest.contig_stream(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    run()
    (src / "b.fa").write_text(">B#0#c1\nTTTT\n")
    run()
    assert {(r.sample, r.contig, r.seq) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("A#0", "c1", "ACGT"), ("A#0", "c2", "GG"), ("B#0", "c1", "TTTT")}
    (src / "c.fa").write_text(">A#0#c9\nTT\n")
    with pytest.raises(Exception, match="earlier batch"):
        run()
