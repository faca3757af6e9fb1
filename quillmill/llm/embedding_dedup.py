"""Near-duplicate embeddings by random-hyperplane signs, exact cosines and distributed components.

Exact copies are one class with a size, so they never meet. Each of several tables gives a vector the signs of its
products with random hyperplanes; classes of one label and one sign code share a bucket. Buckets see codes alone: a
bucket links classes whose further signs differ in no more bits than those of a pair at the threshold do, and hands on a
spanning forest. What these links join is a cluster of candidates, and only there vectors meet: each vector goes to its
cluster once, every pair of a cluster is checked by its cosine in double precision, and a member hands on a number of
links and a root, so no pairs are written. A large cluster, and a bucket above a size, is cut into blocks, and each pair
of blocks is a group of its own, so no task holds all of it.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LocalForest, Notes, discard, group_slices, located, map_arrow, materialize, table, whole_groups
from .components import connected_components
from .vectors import matrix, usable

THRESHOLD, RECALL, BLOCK, SEED = 0.93, 0.9995, 512, 4242
#: Further signs by which a bucket proposes, deviations that a pair at the threshold may be off there, and codes that one
#: side of a group of a bucket holds.
CHECK, WIDE, BUCKET = 128, 4.5, 1 << 20


def plan(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): more bits for more classes, so that a chance meeting stays as rare, and enough tables that a
    pair just at the threshold shares a bucket with the probability `recall`."""
    bits = max(8, math.ceil(math.log2(max(2, classes))) - 8)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def proposed(threshold: float) -> int:
    """Differing signs out of CHECK that a pair at the threshold exceeds with next to no probability."""
    p = math.acos(threshold) / math.pi
    return int(CHECK * p + WIDE * math.sqrt(CHECK * p * (1 - p)))


def hyperplanes(width: int, signs: int, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, width])).normal(size=(width, signs))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _buckets(signs: np.ndarray, kind: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): a name of each bucket by its table, its code and the kind (label and length) of the vector. Two
    buckets that share a name only propose more."""
    codes = (signs[:, : bits * tables].reshape(-1, tables, bits) * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return _mixed(kind[:, None] + _mixed(codes + (np.arange(1, tables + 1, dtype=np.uint64) << np.uint64(56))))


def _near(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, parent) of the codes (rows, words) that differ in `limit` bits at most: each code found is
    compared with those not found yet, so a dense group costs little more than its size."""
    left, child, parent = np.arange(len(codes)), [], []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        root = todo[0]
        while todo and len(left):
            at = todo.pop()
            close = np.bitwise_count(codes[left] ^ codes[at]).sum(axis=1, dtype=np.int64) <= limit
            if close.any():
                new = left[close]
                child.append(new)
                parent.append(np.full(len(new), root))
                todo += new.tolist()
                left = left[~close]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(child), np.concatenate(parent)) if child else (none, none)


def cosine_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, bucket_rows: int = BUCKET) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine reaches the
    threshold. A vector that is null, zero, or holds a null or non-finite component has no link, and neither has one
    with a null label or id. A row is a vector of its own: rows that repeat one are further links of each other.
    component_id is the smallest id reachable. An empty table gives an empty result. Other columns are ignored.
    """
    read, path, row = located(vectors.select(id_col, label_col, vec_col))
    rows = read.select(F.col(path).alias("path"), F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    fit = usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull()
    bits, tables = plan(rows.where(fit).count(), threshold)
    limit, places = proposed(threshold), bits * tables + CHECK

    # a class is named by two hashes of label and vector
    keyed = rows.where(fit).select("path", "row", "id", F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(1), "v", "label").alias("k2"), F.xxhash64("label", F.size("v")).alias("kind"), F.size("v").alias("width"), "v")
    kind = rows.schema["id"].dataType.simpleString()

    def sign(batches):
        for b in batches:
            width, signs = b.column("width").to_numpy(), np.empty(b.num_rows, dtype=object)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                own = np.packbits(matrix(b.column("v").take(pa.array(at)), w) @ hyperplanes(w, places) > 0, axis=1)
                signs[at] = [x.tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "row", "id", "k1", "k2", "kind")), pa.array(signs.tolist(), type=pa.binary())], names=["path", "row", "id", "k1", "k2", "kind", "signs"])

    signed = materialize(map_arrow(keyed, sign, f"path bigint, row bigint, id {kind}, k1 bigint, k2 bigint, kind bigint, signs binary"), "signs")
    classes = signed.groupBy("k1", "k2", "kind", "signs").agg(F.min(F.struct("id", "path", "row")).alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def spread(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column("signs").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            signs = np.unpackbits(raw, axis=1)[:, :places]
            check = np.packbits(signs[:, bits * tables :], axis=1).view(np.int64)
            names = _buckets(signs, b.column("kind").to_numpy().view(np.uint64), bits, tables).view(np.int64)
            words = [pa.array(np.ascontiguousarray(check[:, k])) for k in range(CHECK // 64)]
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(names[:, t])), b.column("node"), *words], names=["bucket", "node", *(f"c{k}" for k in range(len(words)))])

    words = [f"c{k}" for k in range(CHECK // 64)]
    codes = classes.select("kind", "node", "signs").mapInArrow(spread, "bucket bigint, node bigint, " + ", ".join(f"{w} bigint" for w in words))

    def propose(batches):
        keys = [k for k in ("bucket", "p", "q") if k in names]
        for t in whole_groups(batches, keys, 100_000):
            node, check = t.column("node").to_numpy(), np.column_stack([t.column(w).to_numpy().view(np.uint64) for w in words])
            child, parent = [], []
            for lo, hi in itertools.pairwise(group_slices([t.column(k).to_numpy() for k in keys]).tolist()):
                if hi - lo > 1:
                    a, b = _near(check[lo:hi], limit)
                    child.append(node[lo + a])
                    parent.append(node[lo + b])
            if child:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(child)), pa.array(np.concatenate(parent))], names=["a", "b"])

    heavy = materialize(codes.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).cast("int").alias("blocks")), "heavy")
    names = ["bucket"]
    if not heavy.isEmpty():
        names = ["bucket", "p", "q"]
        cut = codes.join(heavy, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        codes = _paired(cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), "blocks").cast("int")), "bucket", "node", *words)
    links = codes.repartition(*names).sortWithinPartitions(*names).mapInArrow(propose, "a bigint, b bigint")
    near = connected_components(links)

    clusters = classes.join(near, "node").select("root", "node", "first", "kind", "n")
    large = clusters.groupBy("root").count().where(F.col("count") > block).select("root", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    members = clusters.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    member = F.struct("root", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int").alias("own"), "node", "n", "kind")
    notes = Notes(members.select("first.path", "first.row", member.alias("member")), "path", "row", "member", "members")
    met = rows.select("v", notes.of("path", "row").alias("member")).where("member is not null").select("member.*", "v")

    def check(batches):
        for t in whole_groups(batches, ["root", "p", "q"], 4 * block):
            yield from _check(t, threshold)

    keys = ["root", "p", "q"]
    ready = _paired(met, "root", "own", "node", "n", "kind", "v")
    found = materialize(map_arrow(ready.repartition(*keys).sortWithinPartitions(*keys), check, "node bigint, root bigint, links bigint"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select("k1", "k2", "node", "n", F.col("first.id").alias("least")).join(links, "node", "left").join(roots, "node", "left")
    known = materialize(known.select("k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    lowest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(known.join(lowest, "root").select("k1", "k2", "n_links", "component_id"), "named")
    for t in (classes, heavy, found, known):
        discard(t)
    linked = signed.join(named, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _paired(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with `blocks` and `own` for each pair of blocks (p, q) that a row's own block is in."""
    dealt = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*columns, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))


def _check(t: pa.Table, threshold: float):
    keys = [t.column(c).to_numpy() for c in ("root", "p", "q")]
    node, own, n, kind = (t.column(c).to_numpy() for c in ("node", "own", "n", "kind"))
    forest, links = LocalForest(len(node)), np.zeros(len(node), dtype=np.int64)
    vectors = t.column("v").combine_chunks()
    vectors = vectors if isinstance(vectors, pa.Array) else pa.concat_arrays(vectors.chunks)
    width = vectors.value_lengths().to_numpy()
    cuts = group_slices(keys).tolist()
    for lo, hi in itertools.pairwise(cuts):
        p, q = int(keys[1][lo]), int(keys[2][lo])
        for k in np.unique(kind[lo:hi]).tolist():  # as a rule a cluster is of one kind
            g = lo + np.flatnonzero(kind[lo:hi] == k)
            x = matrix(vectors.take(pa.array(g)), int(width[g[0]]))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            left, right = np.flatnonzero(own[g] == p), np.flatnonzero(own[g] == q)
            i, j = np.nonzero(x[left] @ x[right].T >= threshold - 1e-12)
            i, j = left[i], right[j]
            if p == q:
                i, j = i[i < j], j[i < j]
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = g[i[exact]], g[j[exact]]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            forest.link(i, j)
    some = links > 0
    if some.any():
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[forest.parent[some]]), pa.array(links[some])], names=["node", "root", "links"])


def op8_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component; see cosine_components() for odd rows."""
    return cosine_components(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op8_hyperplane_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id)
"""
}
QUERIES = {"op8_hyperplane_dedup": op8_hyperplane_dedup}
