"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of unit vectors (`sample`).  So that leaves do not grow with the table, each is split again
where it lies, by a subtree fitted on a larger sample (1 in THIN rows, up to `numbers` numbers in all centres), one task a leaf; every
vector is then put into the leaf it descends to.  A query opens nodes in the order of a priority queue by cosine to their centres; the leaves it meets first
are its bins.  How many bins to visit is calibrated: for some vectors, drawn apart from the sample, the exact neighbours among all
vectors are found in blocks, and visits are widened until the asked share of them lies in visited bins.

Equal vectors are searched once, with their smallest k + 1 ids.  Neighbouring leaves are sent in bundles of up to CHUNK
vectors, a query once to each bundle with the leaves it opens there.  A larger leaf, or many queries, are cut into chunks
of bounded size, each pair of chunks one task group; each gives its k best for each query only.

Vectors of different lengths have no cosine: each length has a tree of its own, and shares the sample with the others.

Cases: vectors that are null, zero, or hold null or non-finite numbers take no part, nor do rows with a null id.  A
vector whose length no other has finds nothing.  Repeated rows count once.  Ties go to the
smaller id.  Fewer candidates than k: all found.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import small_batches, table

K, SAMPLE, BRANCH, LEAF, TARGET, CALIBRATE, CHUNK = 5, 20_000, 8, 50, 0.97, 200, 4096
THIN, NUMBERS, ROWS = 8, 1 << 23, 8  # a subtree has no more nodes than a node for ROWS rows of its sample
_SPAN = 1 << 40
FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")).where("vec_id is not null and embedding is not null")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.where(F.forall("embedding", good) & F.exists("embedding", lambda x: x != 0))


def distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """ids (the smallest `keep`, ascending), embedding of each different vector."""
    first = vectors.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = first.withColumn("r", F.row_number().over(Window.partitionBy("embedding", "salt").orderBy("vec_id"))).where(F.col("r") <= keep)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= keep)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "embedding")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column, in double precision."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [np.asarray(p.flatten().to_numpy(zero_copy_only=False), float).reshape(len(p), -1) for p in parts if len(p)]
    return np.concatenate(flat) if flat else np.zeros((0, 1))


def by_length(column: pa.ChunkedArray | pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows) of the vectors of each length in a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return [(int(d), at := np.flatnonzero(n == d), matrix(column.take(pa.array(at)))) for d in np.unique(n)]


def shares(counts: dict[int, int], total: int) -> dict[int, int]:
    """How many of each kind to take so that they are `total` at most, if there are no more kinds: all of the rare ones, the frequent ones alike."""
    out, left = {}, total
    for i, (kind, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[kind] = min(n, max(1, left // (len(counts) - i)))
        left -= out[kind]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, each from its own two vectors alone."""
    return np.einsum("ij,ij->i", q, v) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", v, v)))


class Tree:
    """Centres of all nodes; children of inner nodes; a node without children is a leaf."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7, nodes: int | None = None):
        """nodes: no more than so many, the largest split first."""
        rng = np.random.Generator(np.random.PCG64(seed))
        self.centres, self.children = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[]]
        todo = [(-len(x), 0, x)]
        while todo and (nodes is None or len(self.centres) + branch <= nodes):
            _, node, rows = heapq.heappop(todo)
            if len(rows) <= leaf:
                break
            label = self._split(rows, branch, rng)
            groups = [rows[label == g] for g in np.unique(label)]
            if len(groups) < 2:
                continue
            for g in groups:
                self.children[node].append(len(self.centres))
                self.centres.append(g.mean(axis=0))
                self.children.append([])
                heapq.heappush(todo, (-len(g), len(self.centres) - 1, g))
        c = np.stack(self.centres)
        self.centres = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

    def graft(self, subtrees: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Put a subtree at each of some leaves: centres and parents of its nodes, but for the root (0), which is the leaf."""
        centres = [self.centres]
        for leaf, (c, parent) in sorted(subtrees.items()):
            base = len(self.children) - 1
            self.children += [[] for _ in c]
            for i, p in enumerate(parent.tolist()):
                self.children[base + p if p else leaf].append(base + 1 + i)
            centres.append(c)
        self.centres = np.concatenate(centres)

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng, steps: int = 8) -> np.ndarray:
        c = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
        for _ in range(steps):
            label = (rows @ c.T).argmax(axis=1)
            c = np.stack([rows[label == g].mean(axis=0) if (label == g).any() else c[g] for g in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return (rows @ c.T).argmax(axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if len(x) else []
        while todo:
            node, here = todo.pop()
            if kids := self.children[node]:
                label = (x[here] @ self.centres[kids].T).argmax(axis=1)
                at[here] = np.array(kids)[label]
                todo += [(kids[g], here[label == g]) for g in np.unique(label)]
        return at

    def opened(self, x: np.ndarray, block: int = 64) -> Iterator[Iterator[int]]:
        """For each row the leaves that it opens, best bin first."""

        def walk(row: np.ndarray) -> Iterator[int]:
            queue = [(-1.0, 0)]
            while queue:
                node = heapq.heappop(queue)[1]
                if kids := self.children[node]:
                    for k in kids:
                        heapq.heappush(queue, (-row[k], k))
                else:
                    yield node

        for at in range(0, len(x), block):
            yield from map(walk, x[at : at + block] @ self.centres.T)

    def visits(self, x: np.ndarray, limit: int) -> list[list[int]]:
        """The first `limit` leaves that each row opens."""
        return [list(islice(leaves, limit)) for leaves in self.opened(x)]

    def in_order(self) -> list[int]:
        """Leaves, depth first."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if not self.children[node]:
                out.append(node)
            todo += reversed(self.children[node])
        return out

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)


class Forest:
    """A tree for each length of vectors; `first` is what a tree's nodes are numbered from."""

    def __init__(self, trees: dict[int, Tree]):
        self.trees = trees
        self.number()

    def number(self) -> None:
        self.first, at = {}, 0
        for d, t in self.trees.items():
            self.first[d] = at
            at += len(t.children)


def lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and values of each row of a list column of ids."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    count = pc.list_value_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(count) - count, count, flat.flatten().to_numpy(zero_copy_only=False)


def head(qid: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each query with the largest score, ties to the smaller id."""
    order = np.lexsort((ids, -score, qid))
    qid = qid[order]
    first = np.searchsorted(qid, qid)
    keep = np.arange(len(qid)) - first < k
    order = order[keep]
    return qid[keep], ids[order], score[order]


def best(qid: np.ndarray, q: np.ndarray, ids: tuple, v: np.ndarray, k: int, margin: int = 8, block: int = 256, pairs: int = 1 << 16):
    """(query, id, score) columns of the k best for each query: candidates by matrix product, scores and order pair by pair."""
    start, count, flat = ids
    if not len(qid) or not len(v):
        return _NONE
    uv, take, found = unit(v), min(len(v), k + 1 + margin), []
    for at in range(0, len(qid), block):
        near = unit(q[at : at + block]) @ uv.T
        floor = np.partition(near, len(v) - take, axis=1)[:, len(v) - take] - 1e-9
        r, c = np.nonzero(near >= floor[:, None])
        r += at
        s = np.concatenate([cosines(q[r[i : i + pairs]], v[c[i : i + pairs]]) for i in range(0, len(r), pairs)])
        n = count[c]
        r, s = np.repeat(r, n), np.repeat(s, n)
        i = flat[np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        other = i != qid[r]
        found.append(head(qid[r[other]], i[other], s[other], k))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))


def _batch(found: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, _FOUND, strict=True)], schema=_FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, qid: np.ndarray, q: np.ndarray, k: int = K) -> DataFrame:
    """Exact neighbours of a bounded set of queries of one length among all rows (ids, embedding), in blocks."""
    told = vectors.sparkSession.sparkContext.broadcast((qid, q))

    def run(batches):
        for b in batches:
            start, count, flat = lists(b.column("ids"))
            for length, at, v in by_length(b.column("embedding")):
                if length == told.value[1].shape[1]:
                    yield _batch(best(*told.value, (start[at], count[at], flat), v, k))

    return ranked(vectors.mapInArrow(run, FOUND), k)


def in_order(t: pa.Table) -> pa.Table:
    """By smallest id, so that a tree does not depend on how rows arrive."""
    return t.take(pa.array(np.argsort(np.array([i[0] for i in t.column("ids").to_pylist()], np.int64), kind="stable")))


def placed_by(every: DataFrame, told) -> DataFrame:
    """leaf, ids, embedding; told: a broadcast Forest."""

    def place(batches):
        for b in batches:
            leaf = np.zeros(b.num_rows, np.int64)
            for d, at, x in by_length(b.column("embedding")):
                leaf[at] = told.value.first[d] + told.value.trees[d].leaf_of(unit(x))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("ids"), b.column("embedding")], names=["leaf", "ids", "embedding"])

    return every.mapInArrow(place, f"leaf long, ids array<long>, embedding {dict(every.dtypes)['embedding']}")


def refine(forest: Forest, every: DataFrame, counts: dict[int, int], sample: int = SAMPLE, thin: int = THIN, numbers: int = NUMBERS) -> None:
    """Split again the leaves that hold many vectors, each by a tree of its own.

    Of every `thin` vectors one is drawn, fewer where all centres together would hold more than `numbers` numbers, and
    no more than `sample` a leaf; a leaf is split if more than LEAF of its vectors are drawn.
    """
    spark = every.sparkSession
    rate = min(1 / thin, ROWS * numbers / sum(d * n for d, n in counts.items()))
    here = lambda mark, share: F.pmod(F.xxhash64(F.lit(mark), "embedding"), F.lit(_SPAN)) < F.floor(F.lit(float(_SPAN)) * share)
    few = table(placed_by(every.where(here(2, F.lit(rate))), spark.sparkContext.broadcast(forest)), "drawn")
    big = [(r["leaf"], min(1.0, sample / r["n"])) for r in few.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > LEAF).collect()]  # no more than leaves
    if not big:
        return

    def fit(t: pa.Table) -> pa.Table:
        t = in_order(t)
        x = unit(matrix(t.column("embedding")))
        tree = Tree(x, nodes=max(1, len(x) // ROWS))
        parent = np.zeros(len(tree.children), np.int64)
        for node, kids in enumerate(tree.children):
            parent[kids] = node
        leaf = np.full(len(parent), t.column("leaf")[0].as_py(), np.int64)
        return pa.table({"leaf": leaf, "node": np.arange(len(parent)), "parent": parent, "centre": pa.array(list(tree.centres), pa.list_(pa.float64()))}).slice(1)

    large = spark.createDataFrame(big, "leaf long, share double")
    drawn = few.join(F.broadcast(large), "leaf").where(here(3, F.col("share"))).select("leaf", "ids", "embedding")
    got = drawn.groupBy("leaf").applyInArrow(fit, "leaf long, node long, parent long, centre array<double>").toArrow().sort_by([("leaf", "ascending"), ("node", "ascending")])
    leaf, parent = got.column("leaf").to_numpy(), got.column("parent").to_numpy()
    for d, first in forest.first.items():
        subtrees = {}
        lo, hi = np.searchsorted(leaf, [first, first + len(forest.trees[d].children)])
        for one in np.unique(leaf[lo:hi]):
            a, b = np.searchsorted(leaf, [one, one + 1])
            subtrees[int(one - first)] = (matrix(got.column("centre").slice(a, b - a)), parent[a:b])
        if subtrees:
            forest.trees[d].graft(subtrees)
    forest.number()


def search(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, target: float = TARGET, calibrate: int = CALIBRATE, chunk: int = CHUNK, thin: int = THIN) -> DataFrame:
    """query_id, rank, vec_id, score; both tables have vec_id and embedding and come from valid()."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    every = table(distinct(vectors, k + 1), "vectors")
    length = F.size("embedding")
    counts = {r["d"]: r["n"] for r in every.groupBy(length.alias("d")).agg(F.count("*").alias("n")).collect()}  # one row a length
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def drawn(total: int, mark: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """(smallest ids, vectors) by length: about `total` vectors, by hash."""
        rate = F.create_map(*(F.lit(x) for d, t in shares(counts, total).items() for x in (d, t * (_SPAN - 1) // counts[d])))
        few = in_order(every.where(F.pmod(F.xxhash64(F.lit(mark), "embedding"), F.lit(_SPAN)) <= F.element_at(rate, length)).toArrow())
        first = np.array([i[0] for i in few.column("ids").to_pylist()], np.int64)
        return {d: (first[at], x) for d, at, x in by_length(few.column("embedding"))}

    fitted = drawn(sample, 0)
    forest = Forest({d: Tree(unit(fitted[d][1]) if d in fitted else np.zeros((0, d))) for d in sorted(counts)})
    refine(forest, every, counts, sample, thin)
    told = spark.sparkContext.broadcast(forest)  # no more nodes than the sample has vectors, one a length, and NUMBERS numbers
    element = dict(every.dtypes)["embedding"]
    placed = table(placed_by(every, told), "placed")
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # as many as leaves
    # Drawn apart from the sample: the tree fits its own vectors better than others.
    tried = {d: x for d, x in drawn(calibrate, 1).items() if forest.trees[d].leaves > 1}
    exact = [brute_force(every, *x, k) for x in tried.values()]
    where = every_leaf(reduce(DataFrame.union, exact), placed).collect() if exact else []  # calibrate * k rows
    met: dict[int, dict[int, list[int]]] = {d: {int(i): [] for i in mine} for d, (mine, _) in tried.items()}
    of = {int(i): d for d, (mine, _) in tried.items() for i in mine}
    for r in where:
        met[of[r["query_id"]]][r["query_id"]].append(r["leaf"])
    visits = {d: t.leaves for d, t in forest.trees.items()}
    for d, (mine, x) in tried.items():
        tree = forest.trees[d]
        need = []
        for i, leaves in zip(mine, tree.opened(unit(x)), strict=True):
            wanted = Counter(met[d][int(i)])
            for r, leaf in enumerate(leaves):
                need += [r + 1] * wanted.pop(forest.first[d] + leaf, 0)
                if not wanted:
                    break
        if need:
            visits[d] = sorted(need)[min(len(need) - 1, int(np.ceil(target * len(need))))]

    bins, held = bundle(forest, sizes, chunk)
    where_to = spark.sparkContext.broadcast(bins)  # as many as leaves

    def probe(batches):
        for b in batches:
            at, to, leaves = [], [], []
            for d, places, x in by_length(b.column("embedding")):
                if d not in visits:
                    continue
                first = told.value.first[d]
                for i, row in zip(places.tolist(), told.value.trees[d].visits(unit(x), visits[d]), strict=True):
                    opened = {}
                    for leaf in row:
                        if first + leaf in where_to.value:
                            opened.setdefault(where_to.value[first + leaf], []).append(first + leaf)
                    at += [i] * len(opened)
                    to += opened
                    leaves += opened.values()
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), b.column("vec_id").take(at), b.column("embedding").take(at), pa.array(leaves, pa.list_(pa.int64()))], names=["bin", "query_id", "q", "leaves"])

    asked = table(queries.select("vec_id", "embedding").distinct().mapInArrow(probe, f"bin long, query_id long, q {element}, leaves array<long>"), "asked")
    nq = {r["bin"]: r["n"] for r in asked.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    cuts = spark.createDataFrame([(leaf, x, -(-held[x] // chunk), -(-nq[x] // (chunk // 4))) for leaf, x in bins.items() if x in nq], "leaf long, bin long, cv int, cq int")
    deal = lambda key, own, other: (F.pmod(F.xxhash64(key), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    a, b = deal("query_id", "cq", "cv")
    left = asked.join(F.broadcast(cuts.select("bin", "cv", "cq").distinct()), "bin").select("bin", a.alias("qc"), b.alias("vc"), "query_id", "q", "leaves")
    a, b = deal("ids", "cv", "cq")
    right = placed.join(F.broadcast(cuts), "leaf").select("bin", b.alias("qc"), a.alias("vc"), "leaf", "ids", "embedding")

    def meet(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        if not l.num_rows or not r.num_rows:
            return pa.Table.from_batches([], _FOUND)
        start, count, opened = lists(l.column("leaves"))
        asks = np.repeat(np.arange(l.num_rows), count)
        qid, q, v, leaf = l.column("query_id").to_numpy(), matrix(l.column("q")), matrix(r.column("embedding")), r.column("leaf").to_numpy()
        first, n, flat = lists(r.column("ids"))
        found = []
        for one in np.unique(leaf):
            rows, own = asks[opened == one], np.flatnonzero(leaf == one)
            found.append(best(qid[rows], q[rows], (first[own], n[own], flat), v[own], k))
        return pa.Table.from_batches([_batch(head(*(np.concatenate(x) for x in zip(*found, strict=True)), k))])

    key = ["bin", "qc", "vc"]
    return ranked(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, FOUND), k)


def bundle(forest: Forest, sizes: dict[int, int], chunk: int) -> tuple[dict[int, int], dict[int, int]]:
    """The bin of each leaf that holds vectors, and the vectors of each bin: neighbouring leaves of a tree of up to `chunk` together, a larger leaf alone."""
    bins, held = {}, {}
    for d, tree in forest.trees.items():
        new = True
        for leaf in tree.in_order():
            if n := sizes.get(forest.first[d] + leaf):
                if new or held[len(held) - 1] + n > chunk:
                    held[len(held)] = 0
                new = False
                bins[forest.first[d] + leaf] = len(held) - 1
                held[bins[forest.first[d] + leaf]] += n
    return bins, held


def every_leaf(found: DataFrame, placed: DataFrame) -> DataFrame:
    """found with the leaf that holds each neighbour."""
    return placed.select("leaf", F.explode("ids").alias("vec_id")).join(F.broadcast(found), "vec_id").select("query_id", "vec_id", "leaf")


def op7_ann(spark, sf_dir: str) -> DataFrame:
    vectors = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
