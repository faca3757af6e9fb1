"""Nearest neighbours by inner product over sharded, robust-pruned directed graphs.

Vectors are dealt to shards by a hash: few and large ones, but some for each core. Each shard's graph is built in batches:
greedy searches from the middle propose neighbours for the vectors of a batch, relaxed distance pruning keeps edges in
diverse directions (a candidate goes if a kept one is nearer to it by the factor alpha), and reverse edges are pruned
likewise. Points that no edge reaches get one from the nearest point that is reached. A beam search then runs each block
of queries on each shard. The beam is set for each shard by measurement: it is widened until the search finds enough of
what a full scan finds for some of the queries, and where no beam is worth it, the shard is scanned. Largest inner
products become nearest points through one more coordinate, the square root of what a vector's squared length lacks to the
largest. Exact copies are one point with its smallest ids. The beam proposes; scores are computed in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import matrix, usable

DEGREE, BUILD_BEAM, BEAM, ALPHA = 48, 96, 64, 1.1
#: Rows of a shard at most, and at least where there are fewer shards than cores have use for; queries of a block; neighbours.
SHARD_ROWS, LEAST_ROWS, BLOCK_ROWS, TOP = 1 << 15, 1 << 11, 1 << 15, 20
#: Queries by which a shard's beam is set, and the share of their neighbours that it must find.
PROBES, FOUND = 64, 0.98


def _distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return norms[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` best points met for each query (-1: none) and their distances less the query's squared length."""
    b, r = len(q), graph.shape[1]
    ids, dist = np.full((b, beam), -1, dtype=np.int64), np.full((b, beam), np.inf, dtype=np.float32)
    done = np.zeros((b, beam), dtype=bool)
    ids[:, 0] = start
    dist[:, :1] = _distances(x, norms, q, ids[:, :1])
    seen = np.zeros((b, len(x) + 1), dtype=bool)
    seen[:, start] = seen[:, -1] = True
    slot = np.zeros((b, len(x) + 1), dtype=np.int16)
    live = np.arange(b)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        some = open_.any(axis=1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        rank = np.cumsum(open_, axis=1)
        take = open_ & (rank <= expand)
        done[live] |= take
        row, col = np.nonzero(take)
        step = np.full((len(live), expand), -1, dtype=np.int64)
        step[row, rank[row, col] - 1] = ids[live[row], col]
        new = np.where(step[:, :, None] >= 0, graph[step], -1).reshape(len(live), expand * r)
        at = live[:, None]
        columns = np.arange(new.shape[1], dtype=np.int16)[None, :]
        slot[at, new] = columns
        new[(slot[at, new] != columns) | seen[at, new]] = -1  # met before, or twice in this step
        seen[at, new] = True
        near = np.where(new >= 0, _distances(x, norms, q[live], np.maximum(new, 0)), np.inf).astype(np.float32)
        all_ids, all_dist = np.concatenate([ids[live], new], axis=1), np.concatenate([dist[live], near], axis=1)
        all_done = np.concatenate([done[live], np.zeros_like(new, dtype=bool)], axis=1)
        order = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(all_dist, order, axis=1), axis=1, kind="stable"), axis=1)
        ids[live], dist[live], done[live] = (np.take_along_axis(z, order, axis=1) for z in (all_ids, all_dist, all_done))
    ids[np.isinf(dist)] = -1
    return ids, dist


def robust_prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """`degree` neighbours for each point out of its candidates (-1: none): the nearest first, each dropping those that
    it is nearer to, by alpha, than the point is."""
    own = points[:, None]
    cand = np.where(cand == own, -1, cand)
    dist = np.where(cand >= 0, norms[own] + _distances(x, norms, x[points], np.maximum(cand, 0)), np.inf)
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
    twice = np.zeros_like(cand, dtype=bool)
    twice[:, 1:] = (cand[:, 1:] == cand[:, :-1]) & (cand[:, 1:] >= 0)
    alive = np.isfinite(dist) & ~twice
    safe = np.maximum(cand, 0)
    vec = x[safe]
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, dtype=np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, k] = cand[rows, pick][some]
        alive &= ~((alpha * alpha * between[rows, pick] <= dist) & some[:, None])
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 512) -> tuple[np.ndarray, int]:
    """(graph: ids by point, -1 for none; start) of distinct points in float32."""
    n = len(x)
    norms = (x * x).sum(axis=1)
    graph = np.full((n, degree), -1, dtype=np.int64)
    start = int(np.argmin(norms - 2 * x @ x.mean(axis=0)))
    order = np.random.default_rng(n).permutation(n)
    order = np.r_[start, order[order != start]]
    at = 1
    while at < n:
        points = order[at : at + min(batch, max(1, at))]
        at += len(points)
        found, _ = beam_search(x, norms, graph, start, x[points], beam)
        graph[points] = robust_prune(x, norms, points, found, degree, alpha)
        src, col = np.nonzero(graph[points] >= 0)
        a, b = graph[points][src, col], points[src]  # a gains b, the nearest first
        by = np.lexsort((b, norms[b] - 2 * np.einsum("ij,ij->i", x[a], x[b]), a))
        a, b = a[by], b[by]
        gain, first, count = np.unique(a, return_index=True, return_counts=True)
        width = int(min(count.max(), 3 * degree))
        incoming = np.full((len(gain), width), -1, dtype=np.int64)
        rank = np.arange(len(a)) - np.repeat(first, count)
        fits = rank < width
        incoming[np.repeat(np.arange(len(gain)), count)[fits], rank[fits]] = b[fits]
        both = np.concatenate([graph[gain], incoming], axis=1)
        full = (both >= 0).sum(axis=1) > degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
        graph[gain[~full]] = packed[~full]
        for s in range(0, int(full.sum()), batch):
            g = np.flatnonzero(full)[s : s + batch]
            graph[gain[g]] = robust_prune(x, norms, gain[g], both[g], degree, alpha)
    return _reachable(x, norms, graph, start), start


def _reachable(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    """The graph, with one more edge a point where points can't be reached from the start: the nearest point that can be
    reached leads to the first of them, and that one to the next."""
    seen = np.zeros(len(x), dtype=bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        to = np.unique(graph[front])
        front = to[(to >= 0) & ~seen[to]]
        seen[front] = True
    lost = np.flatnonzero(~seen)
    if not len(lost):
        return graph
    known, more = np.flatnonzero(seen), np.full((len(x), 1), -1, dtype=np.int64)
    at = np.concatenate([known[np.argmin(norms[known] - 2 * x[lost[s : s + 256]] @ x[known].T, axis=1)] for s in range(0, len(lost), 256)])
    order = np.argsort(at, kind="stable")
    at, lost = at[order], lost[order]
    first = np.r_[True, at[1:] != at[:-1]]
    more[np.where(first, at, np.r_[0, lost[:-1]]), 0] = lost
    return np.concatenate([graph, more], axis=1)


def measured_beam(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, top: int, beam: int = BEAM, least: float = FOUND) -> int:
    """The first of beam, 2 * beam, .. that finds a share `least` of the `top` nearest points of the queries q, which a
    full scan tells; 0: none up to an eighth of the points, so that a full scan is the better search."""
    k = min(top, len(x))
    if not len(q) or not k:
        return max(beam, 2 * top)
    limit = np.partition(norms - 2 * q @ x.T, k - 1, axis=1)[:, k - 1]
    limit = limit + 1e-4 * np.abs(limit) + 1e-6
    beam = max(beam, 2 * top)
    while 8 * beam <= len(x):
        _, dist = beam_search(x, norms, graph, start, q, beam)
        if np.mean(np.minimum((dist[:, : 2 * top] <= limit[:, None]).sum(axis=1), k) / k) >= least:
            return beam
        beam *= 2
    return 0


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, beam: int = BEAM, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` largest inner products that are found for each row of `queries`.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a null id; a
    query meets vectors of its own length, and none of its own id. Equal scores rank by id. A query that is there twice
    is one query. Fewer candidates give fewer rows; an empty table none. Other columns are ignored. With `exact`, all
    shards are scanned and no neighbour is missed.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v")).withColumn("width", F.size("v"))

    # of exact copies, the ids that can be among the top of any query: the first ones, and one more for the query's own
    copies = Window.partitionBy("key", "v").orderBy("id")
    rows = clean(vectors).withColumn("key", F.xxhash64("v")).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= top + 1)
    rows = materialize(rows.select("id", "v", "width", "key"), "vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    asked = materialize(clean(queries).distinct(), "queries")
    blocks = max(1, -(-asked.count() // block_rows))
    # some queries by which each shard sets its beam
    probes: dict[int, list] = {}
    for r in [] if exact else asked.orderBy(F.xxhash64("id"), "id").limit(PROBES).select("width", "v").toArrow().to_pylist():
        probes.setdefault(r["width"], []).append([*r["v"], 0.0])

    def index(t: pa.Table) -> pa.Table:
        width = t.column("width")[0].as_py()
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        v, ids = matrix(t.column("v"), width)[order], t.column("id").to_numpy()[order]
        points, back = np.unique(v, axis=0, return_inverse=True)
        back = back.ravel()
        lengths = (points * points).sum(axis=1)
        x = np.concatenate([points, np.sqrt(np.maximum(lengths.max() - lengths, 0))[:, None]], axis=1).astype(np.float32)
        graph, start = (np.zeros((len(x), 0), dtype=np.int64), 0) if exact else build_graph(x)
        asked_ = np.array(probes.get(width, []), dtype=np.float32).reshape(-1, width + 1)
        width_ = 0 if exact else measured_beam(x, (x * x).sum(axis=1), graph, start, asked_, top, beam)
        by = np.lexsort((ids, back))
        blob = [x.tobytes(), points.tobytes(), graph.astype(np.int32).tobytes(), ids[by].tobytes(), np.bincount(back, minlength=len(points)).astype(np.int64).tobytes()]
        cols = [pa.array([width], type=pa.int32()), t.column("shard").slice(0, 1).combine_chunks(), pa.array([start], type=pa.int64()), pa.array([width_], type=pa.int64())]
        return pa.table([*cols, *(pa.array([z], type=pa.binary()) for z in blob)], names=["width", "shard", "start", "beam", "x", "points", "graph", "ids", "copies"])

    sharded = rows.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int"))
    graphs = materialize(sharded.groupBy("width", "shard").applyInArrow(index, "width int, shard int, start bigint, beam bigint, x binary, points binary, graph binary, ids binary, copies binary"), "graphs")

    def gather(t: pa.Table) -> pa.Table:
        width = t.column("width")[0].as_py()
        cols = [pa.array([width], type=pa.int32()), t.column("block").slice(0, 1).combine_chunks(), pa.array([matrix(t.column("v"), width).tobytes()], type=pa.binary()), pa.array([t.column("id").to_numpy().tobytes()], type=pa.binary())]
        return pa.table(cols, names=["width", "block", "q", "qids"])

    blocked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packs = materialize(blocked.groupBy("width", "block").applyInArrow(gather, "width int, block int, q binary, qids binary"), "blocks")
    # each shard meets each block of queries: a pair of them is one task's work and bounded in size
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = packs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(g: pa.Table, p: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        none = pa.table([pa.array([], type=pa.int64()), pa.array([], type=pa.int64()), pa.array([], type=pa.float64())], names=names)
        if not g.num_rows or not p.num_rows:
            return none
        width = g.column("width")[0].as_py()
        raw = {c: g.column(c)[0].as_py() for c in ("x", "points", "graph", "ids", "copies")}
        x, points = np.frombuffer(raw["x"], dtype=np.float32).reshape(-1, width + 1), np.frombuffer(raw["points"]).reshape(-1, width)
        graph, ids = np.frombuffer(raw["graph"], dtype=np.int32).reshape(len(x), -1).astype(np.int64), np.frombuffer(raw["ids"], dtype=np.int64)
        copies_ = np.frombuffer(raw["copies"], dtype=np.int64)
        first = np.cumsum(copies_) - copies_
        q, qids = np.frombuffer(p.column("q")[0].as_py()).reshape(-1, width), np.frombuffer(p.column("qids")[0].as_py(), dtype=np.int64)
        norms, start, beam_, out = (x * x).sum(axis=1), g.column("start")[0].as_py(), g.column("beam")[0].as_py(), []
        for at in range(0, len(q), 512):
            part, own = q[at : at + 512], qids[at : at + 512]
            if beam_:
                met, _ = beam_search(x, norms, graph, start, np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32), beam_)
            else:
                k = min(len(points), 2 * top + 8)
                met = np.argpartition(-(part @ points.T), k - 1, axis=1)[:, :k]
            row, col = np.nonzero(met >= 0)
            point = met[row, col]
            # summed from the first component to the last
            score = np.concatenate([np.cumsum(part[row[s : s + 65536]] * points[point[s : s + 65536]], axis=1)[:, -1] for s in range(0, len(row), 65536)])
            n = copies_[point]
            k = np.repeat(np.arange(len(row)), n)
            vec = ids[np.repeat(first[point] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            row, score = row[k], score[k]
            other = vec != own[row]
            row, vec, score = row[other], vec[other], score[other]
            by = np.lexsort((vec, -score, row))
            row, vec, score = row[by], vec[by], score[by]
            best = np.arange(len(row)) - np.searchsorted(row, row) < top
            out.append((own[row[best]], vec[best], score[best]))
        return pa.table([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], names=names)

    pairs = left.groupBy("width", "shard", "block").cogroup(right.groupBy("width", "shard", "block"))
    found = pairs.applyInArrow(search, "query_id bigint, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = materialize(found, "found").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score") if kind == "bigint" else ranked.select(F.col("query_id").cast(kind), "rank", F.col("id").cast(kind).alias("vec_id"), "score")


def op5_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each row whose id is divisible by 20; see nearest() for odd rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE = {
    "op5_pruned_graph": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
QUERIES = {"op5_pruned_graph": op5_pruned_graph}
