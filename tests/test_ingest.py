"""Collections that grow by batches, and the command line, against what went in."""

import gzip
import random

import pytest

from helixframe import __main__ as cli
from helixframe.operators import grouping
from helixframe.plans import collection
from helixframe.plans.collection import Collection
from helixframe.sources import archive
from helixframe.sources import fasta as fasta_source
from helixframe.streaming import ingest

TURN = str.maketrans("ACGT", "TGCA")


def fasta(rows):
    return "".join(f">{s}#{c}\n{x}\n" for s, c, x in rows)


@pytest.fixture(scope="module")
def batches():
    rnd = random.Random(9)
    parent = "".join(rnd.choice("ACGT") for _ in range(1500))

    def child():
        s = list(parent)
        for _ in range(12):
            s[rnd.randrange(len(s))] = rnd.choice("ACGT")
        return "".join(s)

    out = [[("A#0", "c1", parent), ("A#0", "short", "ACGTTGCA")]]
    for x in "BD":
        out.append([(f"{x}#0", f"c{i}", child() if i % 2 else child()[::-1].translate(TURN)) for i in range(2)] + [(f"{x}#0", "same", parent), (f"{x}#0", "odd", "GGNNACCA" + x.replace("B", "G").replace("D", "T"))])
    return out


def test_collection_of_batches(spark, tmp_path, batches):
    src, path = tmp_path / "src", str(tmp_path / "c")
    src.mkdir()
    want = {}
    for n, rows in enumerate(batches):
        (src / f"{n}.fa").write_text(fasta(rows))
        ingest.ingest_collection(ingest.contig_stream(spark, str(src)), path, str(tmp_path / "ck"), k=11, segment_size=150, min_match=12).awaitTermination()
        want |= {(s, c): x for s, c, x in rows}
        c = Collection(spark, path)
        assert {(r["sample"], r.contig): r.seq for r in c.rebuilt(c.segments()).collect()} == want
    segs = c.segments().collect()
    # Equal keys share a group over batches, and equal sequences an id in it.
    groups = spark.read.parquet(f"{path}/groups").collect()
    assert len({(r.key_front, r.key_back) for r in groups}) == len(groups) == len({r.group_id for r in groups})
    same = [[(r.group_id, r.in_group_id) for r in sorted((r for r in segs if r["sample"] == f"{x}#0" and r.contig == name), key=lambda r: r.part)] for x, name in (("A", "c1"), ("B", "same"), ("D", "same"))]
    assert all(x == same[0] for x in same) and all(i == 0 for g, i in same[0] if g >= grouping.FIRST_GROUP)
    raw = [(r.group_id, r.in_group_id) for r in segs if r.group_id < grouping.FIRST_GROUP]
    assert len(raw) == len(set(raw))
    before = spark.read.parquet(f"{path}/packs").count()
    c = ingest.finalize(spark, path)
    assert c.table("packs").count() < before
    assert {(r["sample"], r.contig): r.seq for r in c.sample("A#0", "D#0").collect()} == {k: v for k, v in want.items() if k[0] in ("A#0", "D#0")}
    # A batch that is run again gives the same; a sample of an earlier one is refused.
    held = sorted(map(str, spark.read.parquet(f"{path}/segments").collect()))
    again = spark.createDataFrame(batches[2], "sample string, contig string, seq string")
    ingest.add_batch(again, path, 2, 11, 150, 12)
    assert sorted(map(str, spark.read.parquet(f"{path}/segments").collect())) == held
    with pytest.raises(ValueError, match="earlier batch"):
        ingest.add_batch(again, path, 3, 11, 150, 12)


def test_command_line(spark, tmp_path, batches, capsys):
    files, rows = [], [x for b in batches for x in b]
    for n, b in enumerate(batches):
        files.append(str(tmp_path / f"{n}.fa"))
        (tmp_path / f"{n}.fa").write_text(fasta(b))
    path = str(tmp_path / "c")

    def said(*argv):
        code = cli.main(list(argv), spark)
        out = capsys.readouterr()
        return out.out.splitlines() if code == 0 else (code, out.err.strip())

    assert said("create", path, *files, "-k", "11", "-s", "150", "-l", "12") == []
    assert said("listset", path) == ["A#0", "B#0", "D#0"] and said("listset", path, "--prefix", "D") == ["D#0"]
    assert said("listctg", path, "A#0") == ["A#0\tc1", "A#0\tshort"]
    seqs = {(s, c): x for s, c, x in rows}
    text = "\n".join(said("getset", path, "B#0", "A#0"))
    got = {tuple(r.split("\n", 1)[0].rsplit("#", 1)): r.split("\n", 1)[1].replace("\n", "") for r in text[1:].split("\n>")}
    assert got == {k: v for k, v in seqs.items() if k[0] in ("A#0", "B#0")}
    assert said("getctg", path, "A#0", "c1", "--range", "100-300") == [">A#0:c1 c1:100-300", seqs["A#0", "c1"][100:180], seqs["A#0", "c1"][180:260], seqs["A#0", "c1"][260:300]]
    assert said("length", path, "B#0", "c1") == ["1500"]
    assert said("getctg", path, "A#0", "none")[0] == 1 and said("listctg", path, "Z")[1] == "no such sample: Z"
    assert {x.split("\t")[0] for x in said("inspect", path)} == {"ref", "delta"}
    layout = said("inspect", path, "--layout")
    assert len(layout) == Collection(spark, path).segments().count()
    member = next(r for r in Collection(spark, path).segments("B#0").collect() if r.in_group_id > 0 and r.group_id >= 16)
    costs = said("costs", path, "B#0", member.contig, str(member.part))
    assert len(costs) == 1 + member.raw_length and int(costs[0].split("\t")[1]) == sum(int(x.split("\t")[1]) for x in costs[1:]) == sum(int(x.split("\t")[2]) for x in costs[1:])
    assert said("inspect", path, "--pack", str(member.group_id), "0")
    assert said("-o", str(tmp_path / "out.txt"), "listset", path) == [] and (tmp_path / "out.txt").read_text() == "A#0\nB#0\nD#0\n"


@pytest.mark.parametrize("packed", [False, True])
def test_indexed_ranges(spark, tmp_path, packed):
    rnd = random.Random(7)
    seqs = {f"S#{i}#c": "".join(rnd.choice("ACGTN") for _ in range(n)) for i, n in enumerate((1, 60, 61, 5000, 777, 0))}
    data, index = b"", []
    for name, x in seqs.items():
        data += f">{name}\n".encode()
        index.append(f"{name}\t{len(x)}\t{len(data)}\t60\t61")
        data += "".join(x[i : i + 60] + "\n" for i in range(0, len(x), 60)).encode()
    path = tmp_path / ("s.fa.gz" if packed else "s.fa")
    (tmp_path / f"{path.name}.fai").write_text("\n".join(index) + "\n")
    if packed:
        places, out = [], b""
        for i in range(0, len(data), 900):
            places += [(len(out), i)] if i else []
            out += gzip.compress(data[i : i + 900])
        path.write_bytes(out)
        (tmp_path / "s.fa.gz.gzi").write_bytes(b"".join(x.to_bytes(8, "little") for x in [len(places), *(y for p in places for y in p)]))
    else:
        path.write_bytes(data)
    wanted = [(name, a, b) for name, x in seqs.items() for a, b in [(0, len(x)), (0, 10_000), (-3, 2), (5, 5), (9, 4), *((rnd.randrange(0, 5000), rnd.randrange(0, 5000)) for _ in range(6))]] + [("none", 0, 5)]
    got = fasta_source.fetch(spark, str(path), spark.createDataFrame(wanted, "name string, start long, end long")).collect()
    assert sorted(tuple(r) for r in got) == sorted((n, a, b, seqs[n][max(0, a) : b] if max(0, a) < b else "") for n, a, b in wanted if n in seqs)


def test_archive_round_trip(spark, tmp_path, batches):
    rows = [x for b in batches for x in b]
    df = spark.createDataFrame(rows, "sample string, contig string, seq string")
    c = collection.create(df, str(tmp_path / "c"), 11, 150, 12)
    archive.export(c, str(tmp_path / "a.bin"))
    a = archive.Archive(spark, str(tmp_path / "a.bin"))
    assert a.params == {"k": 11, "min_match_len": 12, "pack_cardinality": 50, "segment_size": 150}
    assert [r["sample"] for r in a.samples().orderBy("at").collect()] == sorted({s for s, _, _ in rows})
    names = ["sample", "contig", "part", "group_id", "in_group_id", "raw_length", "is_rev_comp"]
    assert sorted(tuple(r) for r in a.segments().collect()) == sorted(tuple(r) for r in c.segments().select(*names).collect())
    assert {(r["sample"], r.contig): r.seq for r in a.contigs().collect()} == {(s, x): seq for s, x, seq in rows}
    one = a.sequences(a.segments().filter("contig = 'same' AND part = 1")).collect()
    assert {r.seq for r in one} == {r.seq for r in c.sequences(c.segments().filter("contig = 'same' AND part = 1")).collect()}


def test_archive_metadata_by_hand():
    assert archive.read_params(bytes([21, 0, 0, 0, 20, 0, 0, 0, 50, 0, 0, 0])) == {"k": 21, "min_match_len": 20, "pack_cardinality": 50, "segment_size": 60_000}
    assert archive.read_params(b"".join(x.to_bytes(4, "little") for x in (31, 20, 50, 1000, 16)))["segment_size"] == 1000
    with pytest.raises(ValueError):
        archive.read_params(b"12345678")
    # Names: whole, as before but for a letter, the same first part, other parts.
    coded = [b"chr 1 one", b"\x81 2 \x81", bytes([253]) + b" 2 \xffx\xff", b"other"]
    data = b"\x01\x04" + b"".join(x + b"\0" for x in coded)
    assert archive.read_contigs(data) == [["chr 1 one", "chr 2 one", "chr 2 oxe", "other"]]
    assert archive.items(b"ab\xffc\xff") == [b"ab", b"c"] and archive.items(b"ab\xffc") == [b"ab", b"c"]
