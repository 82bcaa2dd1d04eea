import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import bases as B
from helixframe.functions import codec as C


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_headers(spark):
    h = F.col("h")
    got = values(spark, [("S288C#1#chrI",), ("AAA#0#chrI_1",), ("simple_name",), ("a#b",), ("a#b#c#d",)], "h string", B.sample_of(h), B.contig_of(h), B.sample_of_two(h))
    assert got == [("S288C#1", "chrI", "S288C#1"), ("AAA#0", "chrI_1", "AAA#0"), ("unknown", "simple_name", None), ("unknown", "a#b", "a#b"), ("a#b", "c#d", "a#b")]


def test_sizes_and_files(spark):
    assert values(spark, [("512M",), ("2G",), ("64k",), ("7",), ("x",)], "s string", B.size_of(F.col("s"))) == [(512 << 20,), (2 << 30,), (64 << 10,), (7,), (None,)]
    assert values(spark, [("a.fa.gz",), ("b.fasta",), ("c.txt",)], "s string", B.file_sample(F.col("s"))) == [("a",), ("b",), ("c.txt",)]


def test_bases(spark):
    got = values(spark, [("a",), ("T",), ("N",), ("`",), ("e",)], "c string", B.base_code(F.col("c")), B.iupac_code(F.col("c")))
    assert got == [(0, 0), (3, 3), (None, 4), (None, 32), (None, 30)]
    assert values(spark, [("AC-gt\n1x",)], "s string", B.clean(F.col("s"))) == [("ACGTX",)]
    assert values(spark, [("ACGTN",)], "s string", B.reverse_complement(F.col("s"))) == [("NACGT",)]


def test_split_arithmetic(spark):
    got = values(spark, [(100,)], "p long", B.split_half_down(F.col("p"), 21), B.split_half_down(F.col("p"), 21) + 21, B.split_half_up(F.col("p"), 21))
    assert got == [(90, 111, 89)]
    assert values(spark, [(200,)], "p long", B.split_half_down(F.col("p"), 25)) == [(188,)]


def test_kmer_functions(spark):
    k = F.col("k")
    got = values(spark, [("ACGTT",)], "s string", B.kmer_of(F.col("s")).alias("k"))
    assert got == [(0b0001101111,)]
    got = values(spark, [(0b0001101111,)], "k long", B.word_of(k, 5), B.word_of(B.reverse_kmer(k, 5), 5), B.symbol_at(k, F.lit(1), 5))
    assert got == [("ACGTT", "AACGT", 1)]
    with pytest.raises(ValueError):
        B.check_k(32)
    top = (1 << 62) - 1
    assert values(spark, [(top,)], "k long", B.word_of(k, 31), B.reverse_kmer(k, 31)) == [("T" * 31, 0)]


def test_names(spark):
    n = F.col("n")
    got = values(spark, [(0,), (63,), (64,), (4095,), (4096,)], "n long", B.number_name(n), B.name_number(B.number_name(n)), B.stream_name(n, "ref"), B.stream_name(n, "delta", 2000))
    assert [g[1] for g in got] == [0, 63, 64, 4095, 4096]
    assert got[0] == ("0", 0, "x0r", "seg-0-delta") and got[2][0] == "01" and got[1][0] == "#"


def test_zigzag(spark):
    n = F.col("n")
    assert values(spark, [(0,), (5,), (-5,)], "n long", B.zigzag(n), B.unzigzag(B.zigzag(n))) == [(0, 0), (10, 5), (9, -5)]
    assert values(spark, [(3, 5), (7, 5), (10, 5)], "n long, p long", B.zigzag_against(n, F.col("p"))) == [(3,), (4,), (10,)]


def test_numbers():
    for x in [0, 1, 127, 128, 16511, 16512, 2113663, 2113664, 270549119, 270549120, 2**32 - 1]:
        coded = C.write_prefixed(x)
        assert C.read_prefixed(coded) == (x, len(coded))
        coded = C.write_number(x)
        assert C.read_number(coded) == (x, len(coded))
    assert [len(C.write_prefixed(x)) for x in (127, 128, 16512, 2113664, 270549120)] == [1, 2, 3, 4, 5]


def test_packing():
    rnd = random.Random(1)
    for _ in range(200):
        codes = np.array([rnd.randrange(rnd.choice([4, 6, 16, 31])) for _ in range(rnd.randint(0, 50))], np.uint8)
        assert (C.unpack_tuples(C.pack_tuples(codes)) == codes).all()
    assert C.unpack_two_bits(bytes([0b00011011]), 3).tolist() == [0, 1, 2]
    for text in ("ACGT" * 100, "ACGGTCATTNNA", ""):
        codes = C.to_codes(text)
        block, marker = C.compress_reference(codes)
        assert (C.decompress_marked(block, marker) == codes).all()


def test_hashes():
    assert C.murmur64(0) == 0 and C.murmur32(0) == 0
    many = np.array([1, 2, 1 << 63], np.uint64)
    assert C.murmur64_columns(many).tolist() == [C.murmur64(int(x)) for x in many]
    assert sum(C.kept_by_hash(k, 0.25) for k in range(4000)) == pytest.approx(1000, rel=0.15)


@pytest.mark.parametrize("min_match", [12, 18, 20])
def test_differences_round_trip(min_match):
    rnd = random.Random(min_match)
    for _ in range(150):
        ref = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 400)))
        seq = list(ref)
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randint(0, len(seq))
            act = rnd.randrange(4)
            if act == 0 and i < len(seq):
                seq[i] = rnd.choice("ACGTNRYX")
            elif act == 1:
                seq[i:i] = "N" * rnd.randint(1, 9)
            elif act == 2:
                del seq[i : i + rnd.randint(1, 60)]
            else:
                seq = seq[i:] + seq[:i]
        codes, differ = C.to_codes("".join(seq)), C.Differ(C.to_codes(ref), min_match)
        assert differ.decode(differ.encode(codes)).tolist() == codes.tolist()


def test_differences_text():
    ref = C.to_codes("ACGTACGTTGCAACGTTTGACCAGTCAGGATC")
    differ = C.Differ(ref, 12)
    assert differ.encode(ref) == b""
    assert b"\x1e1\x04" in differ.encode(C.to_codes("NNNNN"))
    assert differ.estimate(ref) == 0 and differ.estimate(C.to_codes("T" * 50), 10) == 10
    assert C.unpacked(C.packed([b"a", b"", b"c"]), 1) == b""


def test_split_choice():
    n, k = 100, 9
    left = np.zeros(n, np.int32)
    right = np.zeros(n, np.int32)
    left[60:] = 1
    right[:50] = 1
    kind, at = C.best_split(left, right, k)
    assert kind == "split" and 45 <= at <= 60
    assert C.best_split(left[::-1].copy(), np.zeros(n, np.int32), k)[0] == "right"
    a, b = C.split_at("ACGTACGTACGTACGTACGT", 10, 5)
    assert a[-5:] == b[:5] and a + b[5:] == "ACGTACGTACGTACGTACGT"


def test_repetitiveness(spark):
    got = values(spark, [("ACGT" * 20,), ("",), ("ACG",)], "s string", B.repetitiveness(F.col("s")))
    assert [round(g[0], 3) for g in got] == [1.0, 0.0, 0.0]
    assert C.lag_share(C.to_codes("ACGT" * 20)) == 1.0
