"""Nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is built and cut into equal parts: a balanced start by repeated median
cuts, then sweeps that move nodes to the part of most of their neighbours within a capacity. A small network learns
the share of a vector's neighbours in each part. It routes every row of the table to its most probable part and
each query to as many of its most probable parts as reach a probability mass, where candidates are ranked by their
exact inner product in double precision.

Where lengths differ, routing sees candidates with one more component, sqrt(longest^2 - length^2), and queries with 0
there: all candidates are then equally long and the largest inner product is the largest cosine. The network learns
from the sample in both roles. About one in ``LONG_SHARE`` candidates, the longest, form a further part that every query
visits; "longest" above is that of the others. Vectors of one length are routed as they are.

The sample bounds the model (a few MB, sent with the tasks); every row is indexed. It grows with the square root of the
table from ``FIT_ROWS`` to ``MOST_FIT_ROWS``, which the driver holds, and the number of parts with the table, as long as
the sample has ``SAMPLE_OF_PART`` rows for each. Routed rows and queries are written to the shared folder once. Small parts
stand together on shelves of about ``block_rows`` rows, and a query goes once to each shelf that holds a part it visits. A
part of more rows is split into blocks by a hash, so parts that hold many equal vectors spread over tasks. Each block
returns its best candidates and a last step merges them. A query's ``k``-th best score in the sample bounds
that among all rows from below, so blocks return only what reaches it: few rows for a query, however many parts it visits.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no part;
equal scores go to the smaller id; with fewer candidates than asked for, all are returned; repeated ids count as one
candidate each with their best score; empty tables give no rows; other columns are ignored. Inner products exist
between vectors of one length: those of another length than most in the sample are compared, all with all, with those
of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

FIT_ROWS = 10_000
MOST_FIT_ROWS = 40_000
PART_ROWS = 150
SAMPLE_OF_PART = 32
NEIGHBOURS = 16
HIDDEN = 192
EPOCHS = 30
#: A query visits its most probable parts until their probabilities add up to this.
MASS = 0.93
LEAST_PROBES = 4
LONG_SHARE = 16
#: Bytes of the sample that go with the tasks to bound scores.
BOUND_BYTES = 8 << 20
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer; probabilities over parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def width(self) -> int:
        return self.w1.shape[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        # rows one by one in effect: equal vectors must get equal parts wherever they stand in a block
        x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)
        h = np.maximum(np.round(x @ self.w1 + self.b1, 9), 0)
        z = h @ self.w2 + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return np.round(e / e.sum(axis=1, keepdims=True), 9)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Candidates with the component that makes all as long as the longest, whose square is given."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1, keepdims=True), 0))])


def neighbour_graph(x: np.ndarray, k: int, asks: np.ndarray | None = None) -> np.ndarray:
    """Indices of each row's ``k`` largest inner products (those of its form in ``asks``) among the others."""
    asks = x if asks is None else asks
    out = np.empty((len(x), k), np.int64)
    step = max(1, 8_000_000 // len(x))
    for a in range(0, len(x), step):
        s = asks[a : a + step] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + step] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part for each node: equal sizes within ``slack``, few graph edges between parts."""
    label = np.zeros(len(x), np.int64)

    def cut(rows: np.ndarray, first: int, n: int) -> None:
        label[rows] = first
        if n > 1:
            y = x[rows] - x[rows].mean(axis=0)
            v = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = rows[np.argsort(y @ v, kind="stable")]
            left = n // 2
            at = len(rows) * left // n
            cut(order[:at], first, left)
            cut(order[at:], first + left, n - left)

    cut(np.arange(len(x)), 0, parts)
    room = int(np.ceil(slack * len(x) / parts))
    src = np.repeat(np.arange(len(x)), graph.shape[1])
    dst = graph.ravel()
    for _ in range(sweeps):
        near = np.zeros((len(x), parts), np.int32)
        np.add.at(near, (src, label[dst]), 1)
        np.add.at(near, (dst, label[src]), 1)
        left = np.full(parts, room)
        new = np.full(len(x), -1)
        preference = np.argsort(-near, axis=1, kind="stable")[:, :8]
        for i in np.argsort(-near.max(axis=1), kind="stable"):
            for p in preference[i]:
                if left[p] > 0:
                    break
            else:
                p = int(left.argmax())
            new[i] = p
            left[p] -= 1
        if (new == label).all():
            break
        label = new
    return label


def train(x: np.ndarray, near: np.ndarray, m: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Router:
    """Fit the share of each of ``m`` parts among the parts in a row of ``near`` by cross entropy, with Adam on small batches."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, m)), np.zeros(m)]
    first, second = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    t = 0
    for epoch in range(epochs):
        rate = 4e-3 * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            a = x[rows]
            shares = np.zeros((len(rows), m))
            for place in near[rows].T:
                np.add.at(shares, (np.arange(len(rows)), place), 1 / near.shape[1])
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - shares) / len(rows)
            gh = (g @ p[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((a.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                first[i] += 0.1 * (grad - first[i])
                second[i] += 0.001 * (grad * grad - second[i])
                p[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def fit_router(sample: np.ndarray, rows: int, *, part_rows: int = PART_ROWS, longest: float | None = None) -> Router:
    """Graph, parts and network from a sample of a table of ``rows`` vectors, lifted where the ``longest`` square is given."""
    x = np.unique(sample, axis=0)  # equal vectors would only see each other
    asks = None
    if longest is not None:
        asks = np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30), np.zeros((len(x), 1))])
        x = lifted(x, longest)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    parts = max(1, min(-(-rows // part_rows), len(x) // SAMPLE_OF_PART))
    k = min(NEIGHBOURS, len(x) - 1)
    if parts < 2 or k < 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts)
    near = np.hstack([label[:, None], label[graph]])
    if asks is None:
        return train(x, near, parts)
    asked = label[neighbour_graph(x, k, asks)]
    return train(np.vstack([x, asks]), np.vstack([near, np.hstack([asked, asked[:, :1]])]), parts)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties by smaller id."""
    return np.lexsort((ids, -score))[:k]


def routed(spark: SparkSession, vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", fit_rows: int | None = None, mass: float = MASS, seed: int = 3, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """The index, ``id, v, part`` for every usable row, and the queries, ``id, v, parts, least``: those that each visits, and a
    score that its ``k``-th best neighbour reaches."""
    kind = dict(vectors.dtypes)[vec_id]
    good = lambda df: df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = good(vectors)
    n = rows.count()
    fit_rows = fit_rows or int(min(MOST_FIT_ROWS, max(FIT_ROWS, SAMPLE_OF_PART * n**0.5)))
    mark = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30))
    # a hash filter keeps about fit_rows rows; the limit holds the bound if ids repeat
    sample = rows.filter(mark < int(min(1.0, fit_rows / max(n, 1)) * (1 << 30)) + 1).limit(2 * fit_rows).collect()
    width = max((lengths := [len(r.v) for r in sample]), key=lengths.count, default=1)
    sample = [r for r in sample if len(r.v) == width]
    x = np.array([r.v for r in sample], np.float64).reshape(-1, width)
    # one row of an id: its best may be another, so a bound stays one
    known, first = np.unique(np.array([r.id for r in sample]), return_index=True) if sample else (np.empty(0, np.int64), np.empty(0, np.int64))
    known, held = known[: BOUND_BYTES // (8 * width)], x[first[: BOUND_BYTES // (8 * width)]]
    square = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    least, most = rows.filter(F.size("v") == width).select(F.min(square), F.max(square)).first()
    longest = None
    if len(x) and most - least > 1e-5 * most and np.isfinite(most):
        lengths = (x * x).sum(axis=1)
        longest = float(np.quantile(lengths, 1 - 1 / LONG_SHARE))
        x = x[lengths <= longest]
    router = fit_router(x, n, longest=longest) if len(x) else Router(np.zeros((width + (longest is not None), 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    parts = router.w2.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            m = _matrix(b.column(1), width)
            part = router.probabilities(m if longest is None else lifted(m, longest)).argmax(axis=1)
            if longest is not None:
                part = np.where((m**2).sum(axis=1) > longest, parts, part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], ["id", "v", "part"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            m = _matrix(b.column(1), width)
            p = router.probabilities(m if longest is None else np.hstack([m, np.zeros((len(m), 1))]))
            order = np.argsort(-p, axis=1, kind="stable")
            ranked = np.take_along_axis(p, order, 1)
            take = (np.cumsum(ranked, axis=1) - ranked < mass) | (np.arange(parts) < LEAST_PROBES)
            found = [o[t].tolist() + [parts] * (longest is not None) for o, t in zip(order, take, strict=True)]
            least = np.full(len(m), -np.inf)
            if len(known) > k:
                for a in range(0, len(m), 200):
                    s = m[a : a + 200] @ held.T
                    s[b.column(0).to_numpy(zero_copy_only=False)[a : a + 200, None] == known] = -np.inf
                    least[a : a + 200] = np.partition(s, len(known) - k, axis=1)[:, len(known) - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32())), pa.array(least)], ["id", "v", "parts", "least"])

    schema = f"id {kind}, v {rows.schema['v'].dataType.simpleString()}"
    usual = lambda df: df.filter(F.size("v") == width)
    # vectors of another length: a part for each length, below all others
    other = lambda df: df.filter(F.size("v") != width).withColumn("part", -F.size("v"))
    placed = usual(rows).mapInArrow(place, f"{schema}, part int").unionByName(other(rows))
    asked = usual(good(queries)).mapInArrow(ask, f"{schema}, parts array<int>, least double").unionByName(other(good(queries)).select("id", "v", F.array("part").alias("parts"), F.lit(float("-inf")).alias("least")))
    return written(spark, placed, "index"), written(spark, asked, "queries")


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, *, k: int = 20, vec_id: str = "vec_id", block_rows: int = BLOCK_ROWS, seed: int = 3, **how) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` nearest rows of ``vectors`` other than itself."""
    kind = dict(vectors.dtypes)[vec_id]
    placed, asked = routed(spark, vectors, queries, vec_id=vec_id, seed=seed, k=k, **how)
    # parts are as many as the sample carries, besides one for each other length
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    shelves = _shelves([sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)], block_rows)
    place = F.array(*[F.lit(x) for x in shelves]) if shelves else F.array().cast("array<int>")
    shelf = lambda part: F.when(part < 0, part).otherwise(F.get(place, part))
    placed = placed.withColumn("shelf", shelf(F.col("part")))
    asked = asked.withColumn("shelf", F.explode(F.array_distinct(F.filter(F.transform("parts", shelf), lambda x: x.isNotNull()))))

    def blocks(df: DataFrame) -> Column:
        """How many blocks a shelf needs; at most rows / ``block_rows`` need more than one."""
        need = {r.shelf: -(-r["count"] // block_rows) for r in df.groupBy("shelf").count().filter(F.col("count") > block_rows).collect()}
        return F.coalesce(F.element_at(F.create_map(*[F.lit(z) for p in need.items() for z in p]), F.col("shelf")), F.lit(1)) if need else F.lit(1)

    # a task meets one block of a shelf's rows and one block of its queries
    rows_in, asks_in = blocks(placed), blocks(asked)
    pick = lambda n, k: F.pmod(F.xxhash64(F.lit(seed + k), "id", "v"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    placed = placed.withColumn("block", pick(rows_in, 1)).withColumn("asks", every(asks_in))
    asked = asked.withColumn("asks", pick(asks_in, 2)).withColumn("block", every(rows_in))

    def rank(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in left if b.num_rows]  # one block of a shelf: about block_rows rows
        if not held:
            return
        ids = np.concatenate([b.column("id").to_numpy() for b in held])
        width = len(held[0].column("v")[0])
        m = np.concatenate([_matrix(b.column("v"), width) for b in held])
        order = np.argsort(ids, kind="stable")
        ids, m, part = ids[order], m[order], np.concatenate([b.column("part").to_numpy() for b in held])[order]
        names, starts = np.unique(ids, return_index=True)
        repeated = len(names) < len(ids)
        ends = np.append(starts[1:], len(ids))
        here = [(p, np.flatnonzero(part == p)) for p in np.unique(part)]
        for b in _batches(right, 128):
            q, qid, bound = _matrix(b.column("v"), width), b.column("id").to_numpy(), b.column("least").to_numpy()
            visits = [set(x) for x in b.column("parts").to_pylist()]
            near = np.full((len(q), len(m)), -np.inf)
            for p, rows in here:
                who = [i for i, x in enumerate(visits) if p in x]
                if who:
                    near[np.ix_(who, rows)] = q[who] @ m[rows].T
            if repeated:  # an id's best
                near = np.maximum.reduceat(near, starts, axis=1)
            out: tuple[list, list, list] = ([], [], [])
            for i in range(len(q)):
                s = near[i]
                s[names == qid[i]] = -np.inf
                # all that may be among the best: products of a matrix differ in the last digits by place
                low = max(np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf, bound[i])
                may = np.flatnonzero((s >= low - 1e-9 * max(1.0, abs(low))) & (s > -np.inf)) if low > -np.inf else np.flatnonzero(s > -np.inf)
                if not len(may):
                    continue
                if repeated:
                    exact = np.array([(m[starts[j] : ends[j]] * q[i]).sum(axis=1).max() for j in may])
                else:
                    exact = (m[may] * q[i]).sum(axis=1)
                best = _best(exact, names[may], k)
                out[0].extend([qid[i]] * len(best))
                out[1].append(names[may][best])
                out[2].append(exact[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out[0], ids.dtype)), pa.array(np.concatenate(out[1]) if out[1] else ids[:0]), pa.array(np.concatenate(out[2]) if out[2] else np.empty(0))], ["query_id", "vec_id", "score"])

    found = placed.groupBy("shelf", "block", "asks").cogroup(asked.groupBy("shelf", "block", "asks")).applyInArrow(_tables(rank), f"query_id {kind}, vec_id {kind}, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _shelves(sizes: list[int], most: int) -> list[int]:
    """A shelf for each part: neighbours together, as many as hold ``most`` rows; a larger part stands alone."""
    out, at, filled = [], 0, 0
    for n in sizes:
        if filled and filled + n > most:
            at, filled = at + 1, 0
        out.append(at)
        filled += n
    return out


def _tables(rank):
    """The form that a cogrouped function has: two tables in, one out."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(rank(iter(left.to_batches()), iter(right.to_batches())))
        if out:
            return pa.Table.from_batches(out)
        empty = left.schema.field("id").type if left.num_columns else pa.int64()
        return pa.table({"query_id": pa.array([], empty), "vec_id": pa.array([], empty), "score": pa.array([], pa.float64())})

    return run
