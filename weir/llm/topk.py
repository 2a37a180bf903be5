"""Exact top-k search (operator 6): a pivot-distance index.

Vectors become integers floor(scale * x), less a whole-numbered centre, which
moves all scores of a query alike. Each is keyed by its nearest pivot and the
distance to it; in that order the index is laid out in parts, each of them sorted
annuli of few vectors. An annulus holds the least and greatest distance of its
vectors to every pivot, and their greatest norm: a shell and sphere of its own.

A query q is scaled to t q, of the indexed vectors' usual length, which keeps its
order. With |t q - v| at least b by the triangle inequality over all pivots,
t q.v = (|t q|^2 + |v|^2 - |t q - v|^2) / 2 is at most (|t q|^2 + N^2 - b^2) / 2
for every v of an annulus of norms up to N. An annulus whose bound lies strictly
below a query's k-th best score is not compared, so ties are resolved by id as
asked. Products of integers are exact in float64, bounds have a margin for rounding.

Queries lie in slices of neighbours (packed, in the order of their pivots), parts
in chunks of bounded number. First each query is searched in its most promising
chunk, then in all chunks whose bound its k-th score does not close. A slice goes
once to a chunk that any of its queries wants; no row is a pair of a query and a
chunk, and the driver holds the pivots and the bounds of the chunks, at most some
`MAX_CHUNKS`. Where vectors have no structure (all distances alike, as of random
directions in many dimensions) no bound closes and all vectors are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.llm.common import materialise, table

SCALE = 256
K = 5
PIVOTS = 64
#: Vectors of one annulus and of one part of the index, queries of one slice.
ANNULUS, PART, SLICE = 64, 8192, 512
#: Chunks of which the driver and tasks hold bounds (a part each, until parts are more).
MAX_CHUNKS = 1 << 14
#: A score below all others: a query that has fewer than k candidates so far.
NOTHING = -1e18


def quantise(rows: pa.Array, scale: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Integer vectors, and the rows they come from.

    Null vectors, vectors with null or non-finite components and empty ones take
    no part.
    """
    out = []
    for i, v in enumerate(rows.to_pylist()):
        if v and None not in v:
            x = np.floor(scale * np.array(v, dtype=np.float64))
            if np.isfinite(x).all():
                out.append((i, x + 0.0))
    return [x for _, x in out], np.array([i for i, _ in out], np.int64)


def vectors_of(embeddings: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, packed float64 integer vector."""

    def run(batches):
        for batch in batches:
            x, rows = quantise(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "vector"])

    d = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    return d.mapInArrow(run, "vec_id bigint, vector binary")


def matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


class Space:
    """The centre and the pivots, and the usual norm of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.centre = np.floor(vectors.mean(axis=0) + 0.5)
        self.ids, self.pivots = ids, vectors - self.centre
        self.norms = (self.pivots**2).sum(axis=1)
        self.usual = float(np.sqrt(self.norms.mean())) or 1.0

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From centred vectors to all pivots."""
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + self.norms - 2 * (x @ self.pivots.T), 0))

    def scaled(self, q: np.ndarray) -> np.ndarray:
        """What each query is multiplied by; 1 for a query of zeros, whose scores are all 0."""
        norm = np.sqrt((q * q).sum(axis=1))
        return np.where(norm > 0, self.usual / np.maximum(norm, 1e-300), 1.0)

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Queries by regions: the greatest score against centred vectors that a region of distances [low, high] to each pivot and norms up to `norm` allows."""
        t = self.scaled(q)
        d = self.distances(q * t[:, None])
        gap = np.zeros((len(q), len(low)))
        for j in range(d.shape[1]):
            np.maximum(gap, np.maximum(d[:, j, None] - high[None, :, j], low[None, :, j] - d[:, j, None]), out=gap)
        size = t**2 * (q * q).sum(axis=1)
        best = (size[:, None] + (norm**2)[None, :] - gap**2) / (2 * t[:, None])
        # also q.v <= |q| |v|
        best = np.minimum(best, np.sqrt((q * q).sum(axis=1))[:, None] * norm[None, :])
        return best + 1e-9 * (np.abs(best) + (size[:, None] + norm[None, :] ** 2) / t[:, None]) + 1e-6


def build_index(vectors: DataFrame, space: Space, annulus: int, part: int, per_chunk: int) -> DataFrame:
    """chunk, n, ids, vectors, sizes, low, high, norm: parts of at most `part` vectors in annuli of at most `annulus`.

    Vectors are range-partitioned by (pivot, distance), so that a part is a run of
    one partition and a pivot with very many vectors spreads over tasks.
    """

    def key(batches):
        for batch in batches:
            x = matrix(batch.column("vector"))
            if len(x):
                d = space.distances(x - space.centre)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])], names=["vec_id", "vector", "pivot", "distance"])

    names = ["chunk", "n", "ids", "vectors", "sizes", "low", "high", "norm"]

    def row(number, ids, x, pivots):
        # an annulus ends with its pivot or when it is full
        new = np.flatnonzero(np.diff(pivots, prepend=-1))
        starts = np.concatenate([np.arange(a, b, annulus) for a, b in zip(new, np.append(new[1:], len(x)), strict=True)])
        d = space.distances(x)
        low, high = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
        norm = np.sqrt(np.maximum.reduceat((x * x).sum(axis=1), starts))
        values = [number // per_chunk, len(x), ids.tobytes(), x.tobytes(), np.diff(np.append(starts, len(x))).tobytes(), low.tobytes(), high.tobytes(), norm.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(values)], names=names)

    def lay(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, part - size)
                held.append(piece)
                at, size = at + piece.num_rows, size + piece.num_rows
                if size == part:
                    yield packed(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield packed(held, number)

    def packed(held, number):
        ids, pivots = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("vec_id", "pivot"))
        return row(number, ids, np.concatenate([matrix(h.column("vector")) for h in held]) - space.centre, pivots)

    keyed = vectors.mapInArrow(key, "vec_id bigint, vector binary, pivot int, distance double")
    # the id breaks up large sets of equal vectors
    ranged = keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return ranged.mapInArrow(lay, "chunk bigint, n bigint, ids binary, vectors binary, sizes binary, low binary, high binary, norm binary")


class Map:
    """What the driver and tasks know of each chunk: distances to all pivots and norms."""

    def __init__(self, index: DataFrame, pivots: int):
        def whole(t: pa.Table) -> pa.Table:
            low, high = (np.frombuffer(b"".join(t[c].to_pylist()), np.float64).reshape(-1, pivots) for c in ("low", "high"))
            norm = np.frombuffer(b"".join(t["norm"].to_pylist()), np.float64)
            return pa.table({"chunk": t["chunk"][:1], "low": pa.array([low.min(axis=0).tobytes()], pa.binary()), "high": pa.array([high.max(axis=0).tobytes()], pa.binary()), "norm": pa.array([norm.max()])})

        rows = index.select("chunk", "low", "high", "norm").groupBy("chunk").applyInArrow(whole, "chunk bigint, low binary, high binary, norm double").orderBy("chunk").toArrow()
        self.chunks = rows["chunk"].to_numpy()
        self.low, self.high = (np.frombuffer(b"".join(rows[c].to_pylist()), np.float64).reshape(-1, pivots) for c in ("low", "high"))
        self.norm = rows["norm"].to_numpy()


def slices_of(query: DataFrame, size: int) -> DataFrame:
    """slice, ids, vectors, kth, first: queries (vec_id, vector, pivot, kth, first) in packed runs of neighbours."""

    def lay(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                b = batch.slice(at, size)
                blobs = [b.column("vec_id").to_numpy().tobytes(), b"".join(b.column("vector").to_pylist()), b.column("kth").to_numpy().tobytes(), b.column("first").to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([x], pa.binary()) for x in blobs]], names=["slice", "ids", "vectors", "kth", "first"])
                number += 1

    ranged = query.repartitionByRange("pivot", "vec_id").sortWithinPartitions("pivot", "vec_id")
    return ranged.select("vec_id", "vector", "kth", "first").mapInArrow(lay, "slice bigint, ids binary, vectors binary, kth binary, first binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors, k-th scores and first chunks of a slice."""
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1), np.frombuffer(row["kth"], np.float64), np.frombuffer(row["first"], np.int64)


def with_first(asked: DataFrame, space: Space, chunks: Map, k: int) -> DataFrame:
    """vec_id, vector, pivot, kth (the k-th best score among the pivots other than the query), first (its most promising chunk)."""

    def run(batches):
        for batch in batches:
            ids, q = batch.column("vec_id").to_numpy(), matrix(batch.column("vector"))
            if not len(ids):
                continue
            score = q @ space.pivots.T
            own = np.where(space.ids[None, :] == ids[:, None], -np.inf, score)
            kth = np.sort(own, axis=1)[:, -k] if own.shape[1] >= k else np.full(len(ids), -np.inf)
            first = chunks.chunks[space.bounds(q, chunks.low, chunks.high, chunks.norm).argmax(axis=1)]
            near = space.distances(q * space.scaled(q)[:, None]).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(near), pa.array(np.where(np.isfinite(kth), kth, NOTHING)), pa.array(first)], names=["vec_id", "vector", "pivot", "kth", "first"])

    return asked.select("vec_id", "vector").mapInArrow(run, "vec_id bigint, vector binary, pivot int, kth double, first bigint")


def wanted(slices: DataFrame, space: Space, chunks: Map, only_first: bool) -> DataFrame:
    """slice, chunk: the chunks that a query of the slice has yet to be searched in."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, q, kth, first = unpacked(row)
                if only_first:
                    some = np.unique(first)
                else:
                    open_ = (space.bounds(q, chunks.low, chunks.high, chunks.norm) >= kth[:, None]) & (chunks.chunks[None, :] != first[:, None])
                    some = chunks.chunks[open_.any(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["slice"])), pa.array(some)], names=["slice", "chunk"])

    return slices.mapInArrow(run, "slice bigint, chunk bigint")


def search(row: dict, space: Space, k: int, only_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """query, vec_id, score of the k best of one part for one slice of queries, and how many pairs were compared."""
    ids, q, kth, first = unpacked(row)
    mine = np.flatnonzero((first == row["chunk"]) == only_first)
    ids, q, kth = ids[mine], q[mine], kth[mine]
    x_ids = np.frombuffer(row["x_ids"], np.int64)
    x = np.frombuffer(row["x"], np.float64).reshape(len(x_ids), -1)
    sizes = np.frombuffer(row["sizes"], np.int64)
    low, high = (np.frombuffer(row[c], np.float64).reshape(len(sizes), -1) for c in ("low", "high"))
    bounds = space.bounds(q, low, high, np.frombuffer(row["norm"], np.float64)) if len(q) else np.zeros((0, len(sizes)))
    ends = np.cumsum(sizes)
    best, who, compared = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max), 0
    for j in np.argsort(-bounds.sum(axis=0), kind="stable") if len(q) else ():
        active = np.flatnonzero(bounds[:, j] >= np.maximum(kth, best[:, -1]))
        if not len(active):
            continue
        a, b = ends[j] - sizes[j], ends[j]
        compared += len(active) * (b - a)
        score = q[active] @ x[a:b].T
        score[ids[active][:, None] == x_ids[None, a:b]] = -np.inf
        rows, cols = np.nonzero(score >= np.maximum(best[active][:, -1], kth[active])[:, None])
        if not len(rows):
            continue
        r = np.concatenate((np.repeat(np.arange(len(active)), k), rows))
        s = np.concatenate((best[active].ravel(), score[rows, cols]))
        i = np.concatenate((who[active].ravel(), x_ids[a:b][cols]))
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        top = np.arange(len(r)) - np.searchsorted(r, np.arange(len(active)))[r] < k
        best[active], who[active] = s[top].reshape(-1, k), i[top].reshape(-1, k)
    rows, cols = np.nonzero(np.isfinite(best))
    return ids[rows], who[rows, cols], best[rows, cols], compared


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    embeddings: DataFrame, queries: DataFrame | None = None, *, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, annulus: int = ANNULUS, chunk: int = PART, query_slice: int = SLICE, most_chunks: int = MAX_CHUNKS,
    id_col: str = "vec_id", vector_col: str = "embedding", compared: list | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product.

    `queries` (the embeddings themselves, if not given) has the same columns; a
    query's own id is never its candidate. Ties go to the smaller id. A query
    with fewer candidates returns all. Rows with a null id or an unusable vector
    take no part, nor do vectors of another length than most have (of equally
    common lengths the greatest counts); rows that share an id are candidates
    each, and of queries that share an id one is asked (the least vector by its
    bytes). Pivots are the vectors of the smallest hashed ids; any choice gives
    the same result. Extra columns are left alone. An empty table gives an empty
    table. `compared` gets the number of (query, vector) products of each round.
    """
    spark = embeddings.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    every = materialise(vectors_of(embeddings, scale, id_col, vector_col))
    length = every.groupBy(F.octet_length("vector").alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("b")).limit(1).collect()
    if not length:
        return spark.createDataFrame([], schema)
    usual = F.octet_length("vector") == length[0].b
    vectors = every.where(usual)
    asked = (every if queries is None else vectors_of(queries, scale, id_col, vector_col)).where(usual).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(pivots, k + 1)).collect()
    space = Space(np.array([r.vec_id for r in chosen], np.int64), np.stack([np.frombuffer(r.vector, np.float64) for r in chosen]))
    index = materialise(build_index(vectors, space, annulus, chunk, max(1, 2 * length[0].n // (chunk * most_chunks))))
    chunks = Map(index, len(space.pivots))
    query = materialise(with_first(asked, space, chunks, k))
    parts = index.select("chunk", F.col("ids").alias("x_ids"), F.col("vectors").alias("x"), "sizes", "low", "high", "norm")
    best = None
    for only_first in (True, False):
        slices = materialise(slices_of(query, query_slice))

        def run(batches, only_first=only_first):
            for batch in batches:
                for row in batch.to_pylist():
                    q, v, s, n = search(row, space, k, only_first)
                    columns = [*(pa.array([*c.astype(np.int64).tolist(), None], pa.int64()) for c in (q, v, s)), pa.array([0] * len(q) + [n], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "compared"])

        pairs = wanted(slices, space, chunks, only_first)
        met = pairs.join(slices, "slice").join(parts.hint("merge"), "chunk").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, compared bigint")
        if compared is not None:
            met = materialise(met)
            compared.append(met.agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0])
        # the row behind each search has only its count
        met = met.where("vec_id is not null").drop("compared")
        best = ranked(met if best is None else best.drop("rank").unionByName(met), k)
        if only_first:
            best = materialise(best)
            reached = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("reached"))
            query = materialise(query.join(reached, "vec_id", "left").withColumn("kth", F.greatest("kth", F.coalesce("reached", "kth"))).drop("reached"))
    # back from the centre
    centre = [float(c) for c in space.centre]

    def moved(batches):
        for batch in batches:
            q = matrix(batch.column("vector"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array((q @ np.array(centre)).astype(np.int64) if len(q) else np.zeros(0, np.int64))], names=["query_id", "_by"])

    by = query.select("vec_id", "vector").mapInArrow(moved, "query_id bigint, _by bigint")
    return best.join(by, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (F.col("score") + F.col("_by")).alias("score"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
