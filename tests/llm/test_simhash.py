import random
import re

import numpy as np
import pytest
import xxhash

from helixframe.llm import components as C
from helixframe.llm import simhash as S


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(prints, radius=4):
    found = list(range(len(prints)))

    def top(x):
        while found[x] != x:
            x = found[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                found[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def texts():
    rnd = random.Random(3)
    voc = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    out = [None, "", "  \n", "One", "one", "ONE two three", "a b c d", "a b c d", "Ünï cödé tëxt hérè ü"]
    for _ in range(12):
        base = [rnd.choice(voc) for _ in range(rnd.randint(60, 300))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            near = list(base)
            near[rnd.randrange(len(near))] = "x"
            out.append("\t".join(near))
    return [*out, "w " * 50_000]


@pytest.mark.parametrize(("shard_rows", "blocks"), [(1024, None), (2, None), (3, 6), (1024, 7)])
def test_components_equal_brute_force(spark, docs, shard_rows, blocks):
    rows = list(enumerate(texts()))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs(rows, ["fp", "root"]), shard_rows=shard_rows, blocks=blocks).collect()}
    prints = [brute_print(t) for _, t in rows]
    assert {i: f for i, (f, _) in got.items()} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    groups = brute_groups(prints)
    least = {g: min(i for i, x in enumerate(groups) if x == g) for g in groups}
    assert {i: c for i, (_, c) in got.items()} == {i: least[g] for i, g in enumerate(groups)}


def test_long_chains_and_hot_shards(spark):
    rnd = random.Random(1)
    chain = [rnd.getrandbits(64)]
    for _ in range(200):  # each is 3 bits from the last
        x = chain[-1]
        for b in rnd.sample(range(64), 3):
            x ^= 1 << b
        chain.append(x)
    near = [chain[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    prints = list(dict.fromkeys([*chain, *near, *[rnd.getrandbits(64) for _ in range(200)]]))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    for rows in (1024, 16):
        links = S.link_forest(df, shard_rows=rows)
        root = {r.node: r.root for r in C.components(links, "a", "b").collect()}
        groups = brute_groups(prints)
        mine = [root.get(int(np.uint64(p).astype(np.int64)), int(np.uint64(p).astype(np.int64))) for p in prints]
        assert len(set(zip(groups, mine, strict=True))) == len(set(groups)) == len(set(mine))


def test_one_of_each(spark, docs):
    rows = [(4, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (7, "other words stand here now"), (None, "a b c d e"), (None, "quite alone is this one text"), (9, None), (8, "")]
    kept = S.one_of_each(docs(rows, ["root", "fp"]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "A b c d e"), (7, "other words stand here now"), (None, "quite alone is this one text"), (8, "")], key=str)
    assert kept.columns == docs(rows, ["root", "fp"]).columns
    assert S.one_of_each(docs([])).count() == 0 and S.near_duplicates(docs([])).count() == 0


def test_components_of_nothing(spark):
    assert C.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    got = {(r.node, r.root) for r in C.components(spark.createDataFrame([(1, 1), (5, 4), (4, 3), (4, 5), (9, 8)], "a long, b long"), "a", "b").collect()}
    assert got == {(5, 3), (4, 3), (3, 3), (9, 8), (8, 8)}
