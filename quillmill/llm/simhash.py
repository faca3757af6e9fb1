"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are joined as distinct values, so exact copies never meet each other. A pair within the error budget
agrees exactly on one of budget + 1 blocks of its bits; each view turns one block to the top of the code, rows are
dealt out by view and block, and inside a task a trie self-join accumulates differing bits and prunes by the budget.
Blocks are split again the same way (`depths`), so the codes of one task are bounded however skewed a block is.
Tasks hand on a spanning forest, never all pairs; components follow by alternating stars.

For near_copies() that join only proposes: plan() sets the bits and tables by the number of rows, and what it connects
is a cluster in which the sets of shingles themselves decide, block of members by block. Texts stay where they are but
for those of clusters: the places of members are noted, and a second scan picks their texts up.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import spread
from .common import LocalForest, Notes, discard, encoded, group_slices, located, map_arrow, materialize, table, whole_groups
from .components import connected_components
from .trie import trie_self_join

#: Codes that a task joins at once, at least.
ROWS = 150_000
#: Word types that a worker remembers at most.
REMEMBERED = 200_000
#: Shingles hashed at once, which bounds what a very long text needs.
PIECE = 1 << 15
#: Probability that a pair at the similarity shares a table; bits that may differ there; least bits, and bits beyond
#: log2 of the rows, which keep chance meetings of a row few.
RECALL, BUDGET, LEAST_BITS, SPARE_BITS = 0.99, 3, 24, 6
#: log2 of the codes of a bucket on average, at most.
LOG_BUCKET = 24
#: Words of a fingerprint at least, those that travel with a code, and standard deviations that a proposal may be off.
WORDS, CARRIED, WIDE = 3, 2, 4.0
#: How much oftener than by the angle a bit differs, at most: the projections of small sets aren't quite normal.
COARSE = 1.06
#: Members and bytes of texts of a cluster that one side of a task compares, and rows that a task holds at once, at least.
BLOCK, BLOCK_BYTES, HELD = 2048, 1 << 25, 200


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle of a lower-cased text, in pieces; fewer words: the whole sequence; none: nothing."""
    w = text.lower().split()
    if not w:
        return
    line = b" ".join(w)
    if len(w) < words:
        yield np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
        return
    size = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    last = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), PIECE):
        yield np.array([digest(line[s:e], 42) for s, e in zip(starts[at : at + PIECE], last[at : at + PIECE], strict=False)], dtype=np.uint64)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n).view(">u8").astype(np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits; a bit is set if over half of the shingles, repeats included, have it. No words: zero."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, words):
        ones += _bits(h)
        n += len(h)
    return int(_majority(ones, n)[0]) if n else 0


def _mixed(h: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """The k-th further 64-bit hash of each hash; several k: a column for each."""
    steps = np.array([(0x9E3779B97F4A7C15 * (int(x) + 1)) & (2**64 - 1) for x in np.atleast_1d(k)], dtype=np.uint64)
    x = h[:, None] + steps if isinstance(k, np.ndarray) else h + steps[0]
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Words(dict):
    """Hashes of the words met so far; long ones are hashed each time."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = h
        return h


_words_met = _Words()
#: A factor for each place of a word in a shingle.
_PLACES = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) | 1) for k in range(64)]
_LANES = np.uint64(0x00FF00FF00FF00FF)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted set of the shingles of a lower-cased text, as 64-bit hashes of the hashes of their words; fewer words:
    the whole sequence; none: nothing."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(_words_met.__getitem__, w), dtype=np.uint64, count=len(w))
    size = min(words, len(w))
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        h = own[:n] * _PLACES[0] + np.uint64(size)
        for k in range(1, size):
            h += own[k : n + k] * _PLACES[k]
    return np.unique(_mixed(h, 0))


def wide_fingerprint(text: bytes, words: int, n_words: int) -> np.ndarray:
    """`n_words` words of 64 bits, each bit by a hyperplane of its own: a shingle's part in it is a byte of its hash, and
    the bit is set if the sum over the set of shingles is above its mean. Bytes in place of signs make the bits of small
    sets differ as the angle has it."""
    h = shingle_set(text, words)
    if not len(h):
        return np.zeros(n_words, dtype=np.uint64)
    total = np.zeros(64 * n_words, dtype=np.int64)
    for at in range(0, len(h), PIECE // 4):
        piece = h[at : at + PIECE // 4]
        mixed = _mixed(piece, np.arange(1, 8 * n_words + 1))
        # sums of bytes in 16-bit lanes, which hold 257 of them
        starts = np.arange(0, len(piece), 256)
        for shift in (0, 8):
            lanes = np.add.reduceat((mixed >> np.uint64(shift)) & _LANES, starts, axis=0)
            total[shift // 8 :: 2] += lanes.view(np.uint16).reshape(len(starts), -1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > 255 * len(h)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp: long) for every row. A null text is an empty one; extra columns are not read."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in encoded(b, text_col)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp bigint")


def wide_fingerprints(rows: DataFrame, words: int, n_words: int) -> DataFrame:
    """Rows (path, row, id, hash, text) to (path, row, id, hash, bytes, fp: binary)."""

    def run(batches):
        for b in batches:
            texts = encoded(b)
            fp = [wide_fingerprint(t, words, n_words).astype(">u8").tobytes() for t in texts]
            cols = [*(b.column(c) for c in ("path", "row", "id", "hash")), pa.array(list(map(len, texts)), type=pa.int64()), pa.array(fp, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "row", "id", "hash", "bytes", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows.select("path", "row", "id", "text", "hash"), run, f"path bigint, row bigint, id {kind}, hash bigint, bytes bigint, fp binary")


def views(bits: int, budget: int, depths: int) -> list[tuple[np.ndarray, int]]:
    """Orders of the bits, and how many at the top agree exactly: one for each choice of a block at each depth."""
    found: list[tuple[list[int], list[int]]] = [([], list(range(bits)))]
    for _ in range(depths):
        new = []
        for top, rest in found:
            for block in np.array_split(np.array(rest), budget + 1):
                chosen = set(block.tolist())
                new.append((top + block.tolist(), [x for x in rest if x not in chosen]))
        found = new
    return [(np.array(top + rest), len(top)) for top, rest in found]


def _reorder(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bit i of a result is bit order[i] of the code; bits past the order are zero."""
    out = np.zeros(len(codes), dtype=np.uint64)
    runs = np.split(np.arange(len(order)), np.flatnonzero(np.diff(order) != 1) + 1)
    for run in runs:
        src, dst, n = int(order[run[0]]), int(run[0]), len(run)
        piece = (codes << np.uint64(src)) >> np.uint64(64 - n)
        out |= piece << np.uint64(64 - dst - n)
    return out


def _words(fp: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fp), dtype=">u8").astype(np.uint64).reshape(len(fp), -1)


def _slice(fp: np.ndarray, at: int, bits: int) -> np.ndarray:
    """Bits at .. at + bits of each row, at the top of a code."""
    w, shift = divmod(at, 64)
    code = fp[:, w] << np.uint64(shift)
    return code | fp[:, w + 1] >> np.uint64(64 - shift) if shift + bits > 64 else code


def _forest(table_: pa.Table, seen: list[tuple[np.ndarray, int]], bits: int, budget: int, limit: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links (node, smallest node) of the rows (bucket, code, node[, w0, w1, ..])."""
    bucket, node = table_.column("bucket").to_numpy(), table_.column("node").to_numpy()
    view = bucket >> VIEW_SHIFT
    codes = table_.column("code").to_numpy().view(np.uint64)
    wide = np.column_stack([table_.column(f"w{k}").to_numpy().view(np.uint64) for k in range(CARRIED)]) if limit is not None else None
    cuts = group_slices([view])
    for lo, hi in itertools.pairwise(cuts.tolist()):
        order = lo + np.argsort(codes[lo:hi], kind="stable")
        own, code = node[order], codes[order]
        forest = LocalForest(len(own))
        exact = seen[int(view[lo]) % len(seen)][1]
        for i, j in trie_self_join(code, exact, bits, budget):
            if wide is not None and len(i):
                apart = forest.roots(i) != forest.roots(j)
                i, j = i[apart], j[apart]
                near = np.bitwise_count(wide[order[i]] ^ wide[order[j]]).sum(axis=1, dtype=np.int64) <= limit
                i, j = i[near], j[near]
            forest.link(i, j)
        root = forest.parent
        linked = root != np.arange(len(root))
        yield own[linked], own[root[linked]]


#: A bucket is the number of a view above so many bits of a block.
VIEW_SHIFT = 48


def trie_links(codes: DataFrame, bits: int, budget: int, tables: int = 1, depths: int = 1, limit: int | None = None) -> DataFrame:
    """Rows (node: long, fp: binary of 8-byte words) to links (a, b) that connect all rows of which some table, the next
    `bits` bits of fp, differs in `budget` bits at most and, where `limit` is given, whose first CARRIED words differ in
    `limit` at most."""
    seen = views(bits, budget, depths)

    def spread(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fp = _words(b.column("fp").to_pylist())
            carried = [pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(CARRIED)] if limit is not None else []
            for t in range(tables):
                own = _slice(fp, t * bits, bits)
                for v, (order, exact) in enumerate(seen):
                    code = _reorder(own, order)
                    bucket = (code >> np.uint64(64 - exact)).view(np.int64) | ((t * len(seen) + v) << VIEW_SHIFT)
                    cols = [pa.array(bucket), pa.array(code.view(np.int64)), b.column("node"), *carried]
                    yield pa.RecordBatch.from_arrays(cols, names=["bucket", "code", "node", *(f"w{k}" for k in range(len(carried)))])

    def join(batches):
        for t in whole_groups(batches, ["bucket"], ROWS):
            for a, b in _forest(t, seen, bits, budget, limit):
                for at in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])

    schema = "bucket bigint, code bigint, node bigint" + "".join(f", w{k} bigint" for k in range(CARRIED)) * (limit is not None)
    rows = codes.mapInArrow(spread, schema)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(join, "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """(id_col, fp: long, component_id): documents whose fingerprints are linked by `budget` or fewer differing bits.

    component_id is the smallest id reachable, null if all of them are null. A null, empty or blank text has the
    fingerprint 0, which links like any other. Repeated rows stay and share their fingerprint. An empty table gives
    an empty result. Columns other than the two named are ignored, whatever their names.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words), "fps")
    least = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    codes = least.select(F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))
    roots = connected_components(trie_links(codes, 64, budget, depths=2))
    rooted = materialize(least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def differing(similarity: float) -> float:
    """The probability, at most, that a bit of the fingerprints of two sets at this similarity (Jaccard) differs: they
    meet at the cosine 2j / (1 + j) at least, which gives arccos / pi."""
    return COARSE * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def shared(similarity: float, bits: int, tables: int, budget: int = BUDGET) -> float:
    """The probability that a pair at this similarity differs in `budget` bits at most in one table or more."""
    p = differing(similarity)
    one = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(budget + 1))
    return 1 - (1 - one) ** tables


def plan(rows: int, similarity: float = 0.8, recall: float = RECALL, budget: int = BUDGET) -> tuple[int, int]:
    """(bits, tables): more bits for more rows, so that chance meetings of a row stay few and a block of the bits deals
    out so many buckets that one fits in a task, and enough tables that a pair at the similarity shares one with the
    probability `recall` whatever the number of rows."""
    log = math.log2(max(2, rows))
    bits = min(60, max(LEAST_BITS, math.ceil(log) + SPARE_BITS, math.ceil((budget + 1) * (log - LOG_BUCKET))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - shared(similarity, bits, 1, budget))))


def proposed(similarity: float, words: int) -> int:
    """Differing bits of so many words that a pair at the similarity exceeds with next to no probability."""
    n, p = 64 * words, differing(similarity)
    return int(n * p + WIDE * math.sqrt(n * p * (1 - p)))


def _decided(t: pa.Table, words: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links (node, smallest node) of the rows (root, p, q, own, node, fp, text) by the Jaccard of their sets."""
    root, p, q, own, node = (t.column(c).to_numpy() for c in ("root", "p", "q", "own", "node"))
    fp = _words(t.column("fp").to_pylist())
    texts = t.column("text").cast(pa.binary())
    limit = proposed(similarity, fp.shape[1])
    for lo, hi in itertools.pairwise(group_slices([root, p, q]).tolist()):
        at = lo + np.unique(node[lo:hi], return_index=True)[1]  # a repeated row comes twice
        sets = [shingle_set(texts[k].as_py(), words) for k in at.tolist()]
        size, left = np.array([len(x) for x in sets]), own[at] == p[lo]
        crossing, wide, forest = p[lo] != q[lo], fp[at], LocalForest(len(at))
        for i in range(len(at)):
            if crossing and not left[i]:
                continue
            j = np.flatnonzero(~left) if crossing else np.arange(i + 1, len(at))
            j = j[(forest.roots(j) != forest.parent[i]) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9) & (size[j] > 0)]
            j = j[np.bitwise_count(wide[j] ^ wide[i]).sum(axis=1, dtype=np.int64) <= limit]
            for s in range(0, len(j), 256):
                some = j[s : s + 256]
                every = np.concatenate([sets[k] for k in some])
                place = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
                both = np.add.reduceat((sets[i][place] == every).astype(np.int64), np.r_[0, np.cumsum(size[some])[:-1]])
                some = some[both >= similarity * (size[some] + size[i] - both) - 1e-9]
                forest.link(np.full(len(some), i), some)
        linked = forest.parent != np.arange(len(at))
        yield node[at[linked]], node[at[forest.parent[linked]]]


def set_links(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Members (root, blocks, node, fp, text, own) of clusters to links (a, b) that connect all of one cluster whose
    sets of shingles reach the similarity. Each pair of blocks is a task's group of its own."""
    keys = ["root", "p", "q"]

    def decide(batches):
        for t in whole_groups(batches, keys, HELD):
            for a, b in _decided(t, words, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "fp", "text")
    return map_arrow(dealt.repartition(*keys).sortWithinPartitions(*keys), decide, "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame, str, str]:
    """A row for each row of docs: (path, row, id, fp, first, kept), with docs and its columns of places (see located()).

    Rows are in one group if a chain of sets of shingles at a Jaccard of `similarity` or more joins them. `first` is the
    first row of its group, by id (nulls last), text and place, and kept is true for that row alone. A row is a
    document, whatever its id. Null, empty and blank texts are alike.
    """
    docs, path, row = located(docs)
    bits, tables = plan(docs.count(), similarity)
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(path).alias("path"), F.col(row).alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    fps = materialize(wide_fingerprints(read, words, max(WORDS, math.ceil(bits * tables / 64))), "wide")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "path", "row")
    # the text of a fingerprint is that of its first row
    least = fps.groupBy("fp").agg(F.min(own).alias("first"), F.max("bytes").alias("bytes"))
    least = materialize(least.withColumn("node", F.monotonically_increasing_id()), "distinct")
    near = connected_components(trie_links(least.select("node", "fp"), bits, BUDGET, tables, 1, proposed(similarity, CARRIED)))
    clusters = materialize(least.join(near, "node").select("root", "node", "fp", "first", "bytes"), "clusters")
    heavy = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    large = clusters.groupBy("root").agg(heavy.alias("blocks")).where("blocks > 1")
    members = clusters.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    member = F.struct("root", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int").alias("own"), "node", "fp")
    notes = Notes(members.select("first.path", "first.row", member.alias("member")), "path", "row", "member", "members")
    members = read.select("text", notes.of("path", "row").alias("member")).where("member is not null").select("member.*", "text")
    roots = connected_components(set_links(members, words, similarity))
    rooted = materialize(least.join(roots, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("lowest"))
    named = materialize(rooted.join(lowest, "root").select("fp", "lowest"), "named")
    for t in (least, clusters, rooted):
        discard(t)
    found = fps.join(named, "fp").select("path", "row", "id", "fp", F.col("lowest").alias("first"))
    same = (F.col("path") == F.col("first.path")) & (F.col("row") == F.col("first.row"))
    return found.withColumn("kept", same), docs, path, row


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, fp, component_id) of near_groups(): component_id is the smallest id of the group, null if all are null."""
    found = near_groups(docs.select(id_col, text_col), id_col, text_col, words, similarity)[0]
    return found.select(F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with the first row of each group of near_groups() alone; columns and their order stay, and no text is
    shuffled but those that near_groups() compares."""
    columns = docs.columns
    found, docs, path, row = near_groups(docs, id_col, text_col, words, similarity)
    gone = Notes(found.where("not kept").select("path", "row", F.lit(True).alias("gone")), "path", "row", "gone", "gone")
    return docs.where(gone.of(path, row).isNull()).select(*[docs[c] for c in columns])


def op1_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; see simhash_components() for odd rows."""
    found = simhash_components(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_trie": op1_simhash_trie}
