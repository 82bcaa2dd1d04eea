"""Exact top-k inner products by dual-tree cover-tree search.

Vectors are dealt into blocks of about ``block_values`` components by a hash of their
row, and every block is indexed by a cover tree: a node's children are centres more than
half its reach apart, up to ``FAN`` or one for each half leaf (so that a node of vectors
without clusters does not fall into single places at once); a member belongs to the nearest centre, down to
leaves of a few places, and a node reaches as far as its farthest member. The queries are
indexed in the same way, in smaller blocks. Every block of queries is sent to every block
of vectors (a stated query set against all rows, in blocks); blocks of vectors do not
move again once they are indexed. Pairs of nodes are visited together, and a pair is
pruned when the bound

    <q, r> + |q| radius(r) + radius(q) (|r| + radius(r))

on all its inner products, from the centres q and r, is below the worst k-th score of
the queries in the group. So that groups of many queries can be pruned as well, each
leaf of queries first descends to one small node of the vectors, whose scores give every
query a k-th score to begin with. Each task returns k rows for each query; a window ranks
them. Only the number of blocks reaches the driver.

Components are floor(scale * x) as whole numbers, so scores are exact (sums of products
are computed as doubles only where these hold them exactly, else as Python integers).

Defined results: vectors null, or with a null or non-finite component, and rows with a
null id take no part; vectors meet those of the same length only, and those of length
zero score 0; each row is a query and a candidate of its own, also where rows repeat an
id (only the query's very row is left out); ties go to the smaller id; a query with
fewer than k candidates gets all; components beyond the largest double that a long holds
count as that; scores beyond a long are ranked as they are and given as the nearest long;
empty tables give no rows. Only the
named columns are read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, stored, table

#: Components of a block of vectors and of one of queries, as a mean.
BLOCK_VALUES, QUERY_VALUES = 1 << 19, 1 << 16
#: Places of a leaf, queries that are searched together, and children of a node at most.
LEAF, FAN = 16, 16
#: Places that are scored at a time, more or less.
STEP = 1024


@dataclass
class CoverTree:
    """Nodes in breadth-first order; children of node i are first[i] .. last[i]. A node
    without children holds the places begin[i] .. end[i] of ``order``; so does a node
    with children, as the union of theirs.
    """

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> CoverTree:
        points = vectors.astype(np.float64)
        away = lambda members, centre: np.sqrt(((points[members] - points[centre]) ** 2).sum(axis=1))
        order = np.arange(len(ids))
        nodes: list[list] = [[0, 0.0, 0, 0, 0, len(ids)]]  # centre, radius, first, last, begin, end
        for node in nodes:  # grows while it is walked
            a, b = node[4], node[5]
            members = order[a:b].copy()
            near = away(members, node[0])
            reach = node[1] = float(near.max(initial=0.0))
            if b - a <= LEAF or reach == 0:
                continue
            centres, owner = [node[0]], np.zeros(b - a, np.int64)
            while len(centres) < min(FAN, max(2, 2 * (b - a) // LEAF)) and (far := near > reach / 2).any():
                centres.append(int(members[far.argmax()]))  # the first, not the farthest: no outlier
                d = away(members, centres[-1])
                closer = d < near
                owner[closer], near[closer] = len(centres) - 1, d[closer]
            order[a:b] = members[np.argsort(owner, kind="stable")]
            ends = a + np.cumsum(np.bincount(owner, minlength=len(centres)))
            node[2], node[3] = len(nodes), len(nodes) + len(centres)
            nodes += [[c, 0.0, 0, 0, int(y - n), int(y)] for c, n, y in zip(centres, np.bincount(owner, minlength=len(centres)), ends, strict=True)]
        columns = list(zip(*nodes, strict=True))
        whole = [np.array(columns[i], np.int64) for i in (0, 2, 3, 4, 5)]
        return cls(rows, ids, vectors, order, whole[0], np.array(columns[1]), *whole[1:])

    def dump(self) -> bytes:
        """As bytes; components take no more of them than the largest needs."""
        out, held = io.BytesIO(), dict(self.__dict__)
        most = int(np.abs(self.vectors.astype(np.float64)).max(initial=0))
        held["vectors"] = self.vectors.astype(next((t for t in (np.int16, np.int32) if most < np.iinfo(t).max), np.int64))
        np.savez(out, **held)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as x:
            return cls(**{k: x[k] for k in x.files})


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin .. end of each, one after another."""
    n = end - begin
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


class Search:
    """The k best of a tree's vectors for each query of another's. ``cut`` counts the
    pairs of nodes that were pruned for groups with children, and for leaves.
    """

    def __init__(self, queries: CoverTree, data: CoverTree, k: int) -> None:
        self.q, self.r, self.k, self.cut = queries, data, k, [0, 0]
        big = max(float(np.abs(t.vectors.astype(np.float64)).max(initial=0)) for t in (queries, data))
        exact = big * big * max(1, queries.vectors.shape[1]) < 2**52
        self.kind = np.float64 if exact else object
        self.qv, self.rv = (t.vectors.astype(np.int64).astype(self.kind) for t in (queries, data))
        self.qc, self.rc = (t.vectors[t.centre].astype(np.float64) for t in (queries, data))
        self.qn, self.rn = (np.sqrt((c**2).sum(axis=1)) for c in (self.qc, self.rc))
        n = len(queries.ids)
        self.scores, self.found = [np.zeros(0, self.kind)] * n, [np.zeros(0, np.int64)] * n  # found: places
        self.worst = np.full(n, -np.inf)
        if n and len(data.ids):
            for leaf in np.flatnonzero(queries.last == 0):
                self.begin(leaf)
            self.visit()

    def bounds(self, node: int, others: np.ndarray) -> np.ndarray:
        radius = self.r.radius[others]
        bound = self.rc[others] @ self.qc[node] + self.qn[node] * radius + self.q.radius[node] * (self.rn[others] + radius)
        # Never below, however doubles round.
        return bound + 1e-9 * (self.qn[node] + self.q.radius[node]) * (self.rn[others] + radius) + 1e-6

    def queries(self, node: int) -> np.ndarray:
        return self.q.order[self.q.begin[node] : self.q.end[node]]

    def below(self, others: np.ndarray) -> np.ndarray:
        """The children of nodes."""
        return ranges(self.r.first[others], self.r.last[others])

    def places(self, leaves: np.ndarray) -> np.ndarray:
        """The places of leaves."""
        return self.r.order[ranges(self.r.begin[leaves], self.r.end[leaves])]

    def known(self, score) -> float:
        """A k-th score as a threshold, rounded down."""
        return float(score) if self.kind is np.float64 else float(np.nextafter(float(score), -np.inf))

    def begin(self, leaf: int) -> None:
        """A first k-th score for the queries of a leaf."""
        r, at = self.r, 0
        while r.last[at]:
            inner = np.arange(r.first[at], r.last[at])
            best = int(inner[(self.rc[inner] @ self.qc[leaf]).argmax()])
            if r.end[best] - r.begin[best] <= self.k:
                break
            at = best
        places = r.order[r.begin[at] : r.end[at]]
        mine = self.queries(leaf)
        for i, row in zip(mine, self.qv[mine] @ self.rv[places].T, strict=True):
            row = np.sort(row[r.rows[places] != self.q.rows[i]])
            if len(row) >= self.k:
                self.worst[i] = self.known(row[-self.k])

    def visit(self) -> None:
        """Visits groups of queries together with nodes of the data, from both roots."""
        q, r, stack = self.q, self.r, [(0, np.zeros(1, np.int64))]
        while stack:
            node, others = stack.pop()
            mine = self.queries(node)
            if q.last[node]:
                inner = r.last[others] > 0
                others = np.concatenate([others[~inner], self.below(others[inner])])
                keep = self.bounds(node, others) >= self.worst[mine].min()
                self.cut[0] += int((~keep).sum())
                stack += [(child, others[keep]) for child in range(q.last[node] - 1, q.first[node] - 1, -1)]
                continue
            bound = self.bounds(node, others)
            while len(others):
                keep = bound >= self.worst[mine].min()
                self.cut[1] += int((~keep).sum())
                others, bound = others[keep], bound[keep]
                order = np.argsort(-bound, kind="stable")
                size = np.where(r.last[others[order]] > 0, 0, r.end[others[order]] - r.begin[others[order]])
                some = int(np.searchsorted(np.cumsum(size), STEP)) + 1
                now, others, bound = others[order[:some]], others[order[some:]], bound[order[some:]]
                leaves, inner = now[r.last[now] == 0], now[r.last[now] > 0]
                if len(leaves):
                    self.score(mine, self.places(leaves))
                if len(inner):
                    more = self.below(inner)
                    others, bound = np.concatenate([others, more]), np.concatenate([bound, self.bounds(node, more)])

    def score(self, mine: np.ndarray, places: np.ndarray) -> None:
        scores = self.qv[mine] @ self.rv[places].T
        good = (scores >= self.worst[mine][:, None]) & (self.r.rows[places][None, :] != self.q.rows[mine][:, None])
        for i, row, some in zip(mine, scores, good, strict=True):
            if not some.any():
                continue
            s, v = np.concatenate([self.scores[i], row[some]]), np.concatenate([self.found[i], places[some]])
            ids = self.r.ids[v]
            first = np.lexsort((ids, -s))[: self.k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], ids[j]))[: self.k])
            self.scores[i], self.found[i] = s[first], v[first]
            if len(first) == self.k:
                self.worst[i] = max(self.worst[i], self.known(self.scores[i][-1]))

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.found]
        scores = [int(x) for s in self.scores for x in s]
        columns = [
            pa.array(np.repeat(self.q.rows, n)),
            pa.array(np.repeat(self.q.ids, n)),
            pa.array(self.r.ids[np.concatenate(self.found or [np.zeros(0, np.int64)])]),
            pa.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores], pa.int64()),
            # Of scores beyond a long, digits that sort as they do.
            pa.array([ordered(x) if abs(x) >= (1 << 63) - 1 else None for x in scores], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "vec_id", "score", "exact"])


def ordered(x: int) -> str:
    """A whole number of less than 320 bits as text that sorts as numbers do."""
    return f"{x + (1 << 320):097d}"


def usable(vector: Column) -> Column:
    """No null and only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _index(block: pa.Table) -> pa.Table:
    dim, n = block.column("dim")[0].as_py(), block.num_rows
    flat = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    # In an order that does not depend on how the rows came.
    order = np.argsort(block.column("row").to_numpy(), kind="stable")
    tree = CoverTree.build(block.column("row").to_numpy()[order], block.column("id").to_numpy()[order], flat.astype(np.int64).reshape(n, dim)[order])
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": block.column("block")[:1].cast(pa.int32()), "times": block.column("times")[:1].cast(pa.int32()), "tree": pa.array([tree.dump()], pa.binary())})


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_values: int = BLOCK_VALUES, query_values: int = QUERY_VALUES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` rows with the highest
    inner products for every row of ``vectors`` where ``is_query`` holds.
    """
    most = F.lit(float((1 << 63) - 1024))  # the largest double that a long holds
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, most), -most))
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, whole).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # Written once, so that a row keeps its number whoever reads it.
    rows = stored(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    # D lengths take at least D*D/2 components, so their table is small beside the input.
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("m")).filter("m > 0")
    in_blocks = lambda n, values: F.ceil(F.col(n) * F.greatest("dim", F.lit(1)) / values).cast("int")
    sizes = counts.select("dim", in_blocks("n", block_values).alias("rs"), in_blocks("m", query_values).alias("qs"))
    blocks, asked_blocks = sizes.agg(F.coalesce(F.sum("rs"), F.lit(1)), F.coalesce(F.sum("qs"), F.lit(1))).first()
    rows = rows.join(F.broadcast(sizes), "dim")

    def indexed(some: DataFrame, in_: str, times: str, tasks: int) -> DataFrame:
        some = some.select("dim", F.pmod(F.xxhash64("row"), F.col(in_)).cast("int").alias("block"), F.col(times).alias("times"), "row", "id", "v")
        # Little data and much work: as many tasks as blocks, however small these are.
        return some.repartition(min(tasks, 4096), "dim", "block").groupBy("dim", "block").applyInArrow(_index, "dim int, block int, times int, tree binary")

    data = indexed(rows, "rs", "qs", blocks).select("dim", F.col("block").alias("r"), F.lit(-1).alias("q"), "tree")
    asked = indexed(rows.filter("asks"), "qs", "rs", asked_blocks)
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("r"), F.col("block").alias("q"), "tree")
    # In a task, a block of vectors comes before the queries that it is to meet.
    met = data.unionByName(asked).repartition(min(blocks, 4096), "dim", "r").sortWithinPartitions("dim", "r", "q")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree = None, None
        for batch in batches:
            for dim, r, q, dump in zip(*(batch.column(c) for c in range(4)), strict=True):
                if q.as_py() < 0:
                    here, tree = (dim.as_py(), r.as_py()), CoverTree.load(dump.as_py())
                elif here == (dim.as_py(), r.as_py()):  # else no row's hash fell into that block
                    yield Search(CoverTree.load(dump.as_py()), tree, k).rows()

    found = met.mapInArrow(meet, "query_row long, query_id long, vec_id long, score long, exact string")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("exact"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score: the ten best of all vectors for each query."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
