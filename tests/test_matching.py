"""Choices by coding costs, adaptive splitters, id codes and the container, against loops."""

import random

import numpy as np
import pytest

from helixframe.functions import codec
from helixframe.operators import grouping, kmers, matching, segments
from helixframe.operators.bloom import Bloom
from helixframe.plans import collection
from helixframe.sources import container

TURN = str.maketrans("ACGT", "TGCA")
K = 9


def turned(s):
    return s[::-1].translate(TURN)


def say(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def laid(spark):
    """A family whose members lack ends and splitters of the parent, so that one-sided
    segments and keys with a middle arise.
    """
    rnd = random.Random(8)
    parent = say(rnd, 3000)

    def child(cut):
        s = list(parent[cut : len(parent) - cut // 2])
        for _ in range(45):
            s[rnd.randrange(len(s))] = rnd.choice("ACGT")
        return "".join(s)

    rows = [("a#0", "c1", parent)] + [(f"{x}#0", f"c{i}", child(40 * i) if i % 2 else turned(child(40 * i))) for x in "bcde" for i in range(4)]
    df = spark.createDataFrame(rows, "sample string, contig string, seq string")
    split = segments.determine_splitters(segments.first_sample(df), K, 150)["splitters"]
    return collection.layout(df, split, K).cache()


def as_cut(m):
    return [(r, turned(r.seq) if r.is_rev_comp else r.seq) for r in m.collect()]


def test_one_sided_groups(spark, laid):
    groups = laid.filter("group_id >= 16").select("group_id", "key_front", "key_back").distinct()
    refs = {r.group_id: r.seq for r in grouping.references(laid).collect()}
    keys = [(r.group_id, r.key_front, r.key_back) for r in groups.collect() if r.key_front is not None and r.key_back is not None]
    want = set()
    for r, seq in as_cut(laid):
        if (r.front is None) == (r.back is None):
            continue
        front = r.front is not None
        kmer, direct, own = (r.front, r.front_is_dir, seq) if front else (r.back, not r.back_is_dir, turned(seq))
        found = []
        for g, f, b in keys:
            for end, flip in ((f, False), (b, True)):
                if end == kmer and (not flip or f != b):
                    cost = codec.Differ(codec.to_codes(refs[g]), 12).estimate(codec.to_codes(turned(own) if flip else own))
                    found.append((cost, f, b, flip, g))
        best = min(found, default=None)
        if best and best[0] <= (len(seq) - 16 if len(seq) >= 16 else len(seq)):
            cost, f, b, flip, g = best
            want.add((r["sample"], r.contig, r.part, f, b, flip if front else not flip, g, cost))
        else:
            want.add((r["sample"], r.contig, r.part, kmer if direct else None, None if direct else kmer, (not direct) if front else direct, None, None))
    got = matching.one_sided_groups(laid.withColumn("seq", grouping.oriented(laid["seq"])), groups, grouping.references(laid), 12)
    got = {(r["sample"], r.contig, r.part, r.key_front, r.key_back, r.is_rev_comp, r.group_id, r.estimate) for r in got.collect()}
    assert got == want and any(x[6] is not None for x in got)


def brute_split(left, right, n, k):
    if n < 2 * (k + 1):
        return "none", 0
    sums = [sum(left[: i + 1]) + sum(right[i:]) for i in range(n)]
    at = sums.index(min(sums))
    if at < k + 1:
        return "right", 0
    return ("left", n) if at + k + 1 > n else ("split", at)


def test_best_splits(spark):
    rnd = random.Random(3)
    a, b = say(rnd, 300), say(rnd, 300)
    segs, groups, refs, want = [], [], [], {}
    # Four ways in which front, middle and back lie to each other; references as groups keep them.
    for i, (front, middle, back) in enumerate([(1, 5, 9), (7, 5, 9), (1, 5, 3), (7, 5, 3), (10, 50, 90)]):
        base = 100 * i
        front, middle, back = base + front, base + middle, base + back
        left, right = (a if front < middle else turned(a)), (b if middle < back else turned(b))
        seq = a[:200] + b[100:] if i < 4 else "ACGTACGTACGT"
        segs.append(("s", f"c{i}", 0, front, back, seq))
        for g, (x, y), ref in ((20 + 2 * i, (front, middle), left), (21 + 2 * i, (middle, back), right)):
            groups.append((g, min(x, y), max(x, y)))
            refs.append((g, ref))
        cost = lambda ref, text, at: codec.Differ(codec.to_codes(ref), 12).costs(codec.to_codes(text), at).tolist()
        lc = cost(left, seq, True) if front < middle else cost(left, turned(seq), False)[::-1]
        rc = cost(right, seq, False) if middle < back else cost(right, turned(seq), True)[::-1]
        want[f"c{i}"] = (middle, 20 + 2 * i, 21 + 2 * i, *brute_split(lc, rc, len(seq), K))
    got = matching.best_splits(
        spark.createDataFrame(segs, "sample string, contig string, part long, front long, back long, seq string"), spark.createDataFrame(groups, "group_id long, key_front long, key_back long"), spark.createDataFrame(refs, "group_id long, seq string"), K, 12
    )
    got = {r.contig: (r.middle, r.left_group, r.right_group, r.decision, r.place) for r in got.collect()}
    assert got == want and got["c4"][3] == "none" and all(got[f"c{i}"][3] == "split" and 150 < got[f"c{i}"][4] < 250 for i in range(4))


def brute_adaptive(rows, k, size):
    from tests.test_sequences import brute_kmers

    first = min(s for s, _, _ in rows)
    own = {(s, c): list(brute_kmers(seq, k)) for s, c, seq in rows}

    def greedy(seq, found, good):
        out, last, end = set(), None, None
        brk = max((i + 1 for i, x in enumerate(seq) if x not in "ACGT"), default=0)
        for pos, kmer, _ in found:
            if kmer in good:
                if last is None or pos - last >= max(size, k):
                    out.add(kmer)
                    last = pos
                end = (pos, kmer)
        return out | ({end[1]} if end and end[0] - last >= k and end[0] > brk else set())

    count = {}
    for (s, _), found in own.items():
        if s == first:
            for _, kmer, _ in found:
                count[kmer] = count.get(kmer, 0) + 1
    have = set().union(*(greedy(seq, own[s, c], {x for x, n in count.items() if n == 1}) for s, c, seq in rows if s == first))
    for s, c, seq in sorted(rows):
        mine = [x for _, x, _ in own[s, c]]
        if len(seq) >= size and not have & set(mine):
            have |= greedy(seq, own[s, c], {x for x in mine if mine.count(x) == 1 and x not in count})
    return have


@pytest.mark.parametrize("seed", range(3))
def test_adaptive_splitters(spark, seed):
    rnd = random.Random(seed)
    strange = [say(rnd, 300) for _ in range(3)]
    rows = [("a", "c1", say(rnd, 800)), ("a", "c2", say(rnd, 30))]
    for x in "bcdef":
        for i in range(4):
            s = rnd.choice([*strange, rows[0][2]])
            at = rnd.randrange(0, 200)
            rows.append((x, f"c{i}", rnd.choice([s[at : at + 120], turned(s[at : at + 90]), say(rnd, 100), s[:80] + "N" + s[90:150], "ACG"])))
    df = spark.createDataFrame(rows, "sample string, contig string, seq string")
    got = segments.adaptive_splitters(df, 7, 40).collect()
    assert len(got) == len({r.kmer for r in got}) and {r.kmer for r in got} == brute_adaptive(rows, 7, 40)


def test_windows_over_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    seq = "".join(rnd.choice("ACGTACGTACGTN") for _ in range(500))
    df = spark.createDataFrame([("s", "c", seq)], "sample string, contig string, seq string")
    whole = {tuple(r) for r in kmers.enumerate_kmers(df, 31).collect()}
    code = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
    words = [(i + 1, seq[i : i + 31]) for i in range(470) if "N" not in seq[i : i + 31]]
    assert whole == {("s", "c", i, min(code(w), code(turned(w))), code(w) <= code(turned(w))) for i, w in words}
    pos, fwd, _ = kmers.windows(codec.to_codes(seq), 5)
    assert [(int(p), int(f)) for p, f in zip(pos, fwd, strict=True)] == [(i, code(seq[i : i + 5])) for i in range(496) if "N" not in seq[i : i + 5]]


def test_hash_sample(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([("s", "c", say(rnd, 20_000))], "sample string, contig string, seq string")
    every, some = kmers.enumerate_kmers(df, 15), kmers.enumerate_kmers(df, 15, fraction=0.2, salt=77)
    want = {r.kmer for r in every.collect() if codec.kept_by_hash(r.kmer, 0.2, 77)}
    assert {r.kmer for r in some.collect()} == want == {r.kmer for r in every.filter(kmers.sampled(every["kmer"], 0.2, 77)).collect()} and 3000 < len(want) < 5000


def test_id_codes():
    rnd = random.Random(2)
    for _ in range(300):
        last, code, back = -1, [], []
        ids = [rnd.choice([0, rnd.randint(0, 6), rnd.randint(0, 400)]) for _ in range(30)]
        for x in ids:
            code.append(codec.code_id(x, last))
            last = x if x > max(0, last) else last
        last = -1
        for c in code:
            x = codec.read_id(c, last)
            back.append(x)
            last = x if x > max(0, last) else last
        assert back == ids
    assert [codec.code_id(x, 4) for x in (5, 0, 4, 6, 1)] == [1, 0, 2, 3, 8]


def test_published_hashes():
    """Known values of the 128-bit hash; texts below a block are read lowest byte first."""
    assert codec.murmur_text("") == 0
    assert codec.murmur_text("hello") == 0xCBD8A7B341BD9B02 ^ 0x5B1E906A48AE1D19
    assert codec.murmur_pair(5, 7) == codec.murmur64(codec.murmur64(5) ^ 7)
    assert len({codec.murmur_text("x" * n) for n in range(64)}) == 64


def test_container(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(s, i, rnd.choice([0, 7, 300, 70_000]), rnd.randbytes(rnd.choice([0, 1, 40, 5000]))) for s in ("x1r", "x1d", "params", "collection-samples") for i in range(rnd.randint(1, 9))]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(s, i, m, bytearray(d)) for s, i, m, d in rows], "stream string, part_id long, metadata long, data binary")
    for n in (1, 2):
        container.write(df.repartition(n + 1), str(tmp_path / f"{n}.bin"))
    assert (tmp_path / "1.bin").read_bytes() == (tmp_path / "2.bin").read_bytes()
    listed = container.parts(spark, [str(tmp_path / "1.bin"), str(tmp_path / "2.bin")])
    got = [(r.path[-5:], r.stream, r.part_id, r.metadata, bytes(r.data)) for r in container.read(listed).collect()]
    assert sorted(got) == sorted((f"{n}.bin", s, i, m if d else 0, d) for n in (1, 2) for s, i, m, d in rows)
    one = container.read(container.parts(spark, str(tmp_path / "1.bin")).filter("stream = 'x1r' AND part_id = 0")).collect()
    assert [(r.stream, r.part_id) for r in one] == [("x1r", 0)]
    assert {r.stream: r.parts for r in container.statistics(container.parts(spark, str(tmp_path / "1.bin"))).collect()} == {s: sum(x[0] == s for x in rows) for s in {x[0] for x in rows}}
    # By hand: one stream "a" with a part of metadata 300 and the bytes "hey".
    (tmp_path / "hand").write_bytes(b"\x02\x01\x2chey" + b"\x01\x01" + b"a\0" + b"\x01\x01" + b"\x00" + b"\x00\x01\x03" + (10).to_bytes(8, "little"))
    hand = container.read(container.parts(spark, str(tmp_path / "hand"))).collect()
    assert [(r.stream, r.metadata, bytes(r.data)) for r in hand] == [("a", 300, b"hey")]
    (tmp_path / "bad").write_bytes(b"xxxxxxxxxxxx")
    with pytest.raises(ValueError):
        container.footer(str(tmp_path / "bad"))


def test_packs_hold_what_went_in(spark, laid):
    refs, deltas = grouping.references(laid), grouping.deltas(laid)
    assert {(r.group_id, r.seq) for r in collection.decode_refs(collection.encode_refs(refs)).collect()} == {(r.group_id, r.seq) for r in refs.collect()}
    packs = collection.with_packs(collection.encode_deltas(deltas, refs, 12)).cache()
    got = {(r.group_id, r.in_group_id, r.seq) for r in collection.decode_deltas(collection.from_packs(packs), refs, 12).collect()}
    assert got == {(r.group_id, r.in_group_id, r.seq) for r in deltas.collect()} and len(got) > 50
    big = spark.createDataFrame([(g, i, collection.grouping.PACK and ((i - 1) // 50 if g >= 16 else i // 50), bytearray(f"A{i}".encode())) for g in (3, 20) for i in range(1, 121)], "group_id long, in_group_id long, pack_id long, payload binary")
    rows = collection.with_packs(big)
    assert {(r.group_id, r.pack_id, r["items"]) for r in rows.collect()} == {(20, 0, 50), (20, 1, 50), (20, 2, 20), (3, 0, 49), (3, 1, 50), (3, 2, 21)}
    assert {(r.group_id, r.in_group_id, bytes(r.payload)) for r in collection.from_packs(rows).collect()} == {(g, i, f"A{i}".encode()) for g in (3, 20) for i in range(1, 121)}


def test_costs_of_a_split_meet_at_the_place():
    left, right = np.array([0] * 12 + [1] * 12), np.array([1] * 12 + [0] * 12)
    assert codec.best_split(left, right, 4) == ("split", 11) and codec.best_split(left[:8], right[:8], 4) == ("none", 0)


def test_bloom_filter(spark):
    rnd = np.random.default_rng(3)
    inside, outside = rnd.integers(-(2**62), 2**62, 3000), rnd.integers(-(2**62), 2**62, 20_000)
    values = spark.createDataFrame([(int(x),) for x in inside] + [(None,)], "kmer long")
    told, own = Bloom.of_column(values, "kmer"), Bloom.for_values(3001)
    own.insert(inside)
    assert (told.words == own.words).all() and told.check(inside).all() and not own.is_full()
    assert told.check(outside).mean() < 0.05
    small = Bloom()
    small.insert(inside[:100])
    assert small.is_full() and small.check(inside[:100]).all()
    assert not small.resized(inside[:100]).is_full() and len(Bloom().words) == 1
    small.clear()
    assert small.fill() == 0 and not small.check(inside).any()
    assert not Bloom.of_column(values.limit(0), "kmer").check(inside).any()


@pytest.mark.parametrize("seed", range(2))
def test_fallback_rows(spark, seed):
    """Against a scan that forgets its k-mer at each splitter."""
    from tests.test_sequences import brute_kmers

    rnd = random.Random(seed)
    k, size, share = 7, 40, 0.5
    rows = [("a", f"c{i}", "".join(rnd.choice("ACGTACGTACGTACGTACGTN") for _ in range(n))) for i, n in enumerate((400, 150, 30, 5, 0))]
    df = spark.createDataFrame(rows, "sample string, contig string, seq string")
    found = kmers.enumerate_kmers(df, k)
    chosen = segments.choose_splitters(kmers.members(found, kmers.singletons(found)), k, size)
    held = {(r.contig, r.pos): r.kmer for r in chosen.collect()}
    want = set()
    for _, c, seq in rows:
        at = sorted(p for x, p in held if x == c)
        prev, since, kept = None, 0, []
        for pos, kmer, direct in brute_kmers(seq, k):
            if pos < since:
                continue
            if codec.kept_by_hash(kmer, share, 3):
                kept.append((pos, kmer, direct))
            if pos in at and (pos == at[0] or pos - at[at.index(pos) - 1] >= max(size, k)):
                want |= {(c, prev, kmer, *x) for x in kept}
                prev, since, kept = kmer, pos + k, []
        if at and len(at) > 1 and at[-1] - at[-2] < max(size, k):
            want |= {(c, prev, held[c, at[-1]], *x) for x in kept}
    got = {(r.contig, r.prev_splitter, r.splitter, r.pos, r.kmer, r.is_dir) for r in segments.fallback_rows(df, chosen, k, size, share, 3).collect()}
    assert got == want and len(want) > 20


def test_sampled_index(spark, laid):
    from tests.test_sequences import brute_kmers

    want = set()
    for r, seq in as_cut(laid):
        if r.front is not None and r.back is not None:
            want |= {(kmer, *((r.front, r.back) if direct else (r.back, r.front))) for _, kmer, direct in brute_kmers(seq, K) if codec.kept_by_hash(kmer, 0.3, 5)}
    got = grouping.sampled_index(laid.withColumn("seq", grouping.oriented(laid["seq"])), K, 0.3, 5).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
