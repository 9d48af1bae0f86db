"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint has 64 majority bits of the XXH64 hashes of a text's 4-word shingles. Distinct fingerprints are linked at
4 or fewer differing bits: of six blocks of bits such a pair agrees on two at least, so each fingerprint goes to one
cell for each pair of blocks, keyed by the bits in them. In a cell the fingerprints lie in Gray order; runs of them are
leaves, whose shared bits are a masked pattern, runs of leaves are upper nodes with the bits that all of these share, and
a search adds up the differences from the root down and drops a whole group once they exceed 4. Groups that are wholly
of the searcher's own component are dropped too, so a cell gives a spanning forest and not all its pairs. Cells with
more than CELL fingerprints are parted, and each pair of parts is a cell of its own. Components grow by large and small
stars in Spark.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.joins import by_counted_key, hot_bound
from quire.llm.text import slices, whole
from quire.session import cut

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: Widths of the blocks, from the highest bit down; a pair within MOST_BITS agrees on two of six.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints in a cell, or in a part of one.
CELL = 2048
LEAF = 32
FANOUT = 8
#: Rows that a Python worker goes through at once; texts can be long.
BATCH_ROWS = 1000


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words, a null one too."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(ws) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()))
    return majority(hashes)


def majority(hashes: Iterable[int]) -> int:
    """The bits that over half of unsigned 64-bit hashes have, gone through 65,536 at a time."""
    total, n = np.zeros(64, np.int64), 0
    hashes = iter(hashes)
    while len(some := np.fromiter(itertools.islice(hashes, 1 << 16), np.uint64)):
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, BATCH_ROWS):
        fp = np.fromiter(map(fingerprint, batch.column("body").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "version": batch.column("version"), "fp": pa.array(fp.view(np.int64))})


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit word in Gray order."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp


def cell_keys(fp: Column) -> Column:
    """One key per pair of blocks: the pair's number and the bits of both."""
    shifts = [64 - sum(BLOCKS[: i + 1]) for i in range(len(BLOCKS))]
    bits = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in zip(shifts, BLOCKS)]
    return F.array(*(F.lit(t << 22).cast("long") + F.shiftleft(bits[i], BLOCKS[j]) + bits[j] for t, (i, j) in enumerate(itertools.combinations(range(len(BLOCKS)), 2))))


class Forest:
    """Components of the places 0 to n - 1 as one array of labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(np.stack((a[apart], b[apart]), axis=1), axis=0)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        moved = np.array(sorted(root), np.int64)
        to = np.arange(len(self.label))
        to[moved] = [find(x) for x in moved.tolist()]
        self.label = to[self.label]


def _nodes(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """AND and OR of each run of `width` entries."""
    at = np.arange(0, len(low), width)
    return np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)


def link_cell(fps: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Labels of the components of distinct fingerprints in Gray order, linked at `most` differing bits or fewer."""
    n, forest = len(fps), Forest(len(fps))
    for gap in range(1, min(LEAF, n) if n > LEAF else n):  # neighbours in Gray order first; all pairs of a single leaf
        near = np.flatnonzero(np.bitwise_count(fps[gap:] ^ fps[:-gap]) <= most)
        forest.link(near, near + gap)
        if n > LEAF and gap >= 4:
            break
    if n <= LEAF:
        return forest.label
    levels = [_nodes(fps, fps, LEAF)]  # leaves first
    while len(levels[-1][0]) > FANOUT:
        levels.append(_nodes(*levels[-1], FANOUT))
    same = [~(low ^ high) for low, high in levels]
    own = [s if k + 1 == len(levels) else s & ~np.repeat(same[k + 1], FANOUT)[: len(s)] for k, s in enumerate(same)]  # bits that no node above has
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        q, node = np.repeat(rows, len(levels[-1][0])), np.tile(np.arange(len(levels[-1][0])), len(rows))
        far = np.zeros(len(q), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            width = LEAF * FANOUT**k
            starts = np.arange(0, n, width)
            least, largest = np.minimum.reduceat(forest.label, starts), np.maximum.reduceat(forest.label, starts)
            far = far + np.bitwise_count((fps[q] ^ levels[k][0][node]) & own[k][node])
            stays = (far <= most) & ((node + 1) * width > q) & ((least[node] != largest[node]) | (least[node] != forest.label[q]))
            q, node, far = q[stays], node[stays], far[stays]
            if k:
                q, far = np.repeat(q, FANOUT), np.repeat(far, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < len(levels[k - 1][0])
                q, node, far = q[real], node[real], far[real]
        for some in range(0, len(q), 1 << 15):
            a, b = np.repeat(q[some : some + (1 << 15)], LEAF), (node[some : some + (1 << 15), None] * LEAF + np.arange(LEAF)).ravel()
            real = b < n
            a, b = a[real], b[real]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= most
            forest.link(a[near], b[near])
    return forest.label


def _stars(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
    """Links of whole cells: each linked fingerprint with the first of its component in the cell."""
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    sizes = np.diff(np.append(starts, len(keys)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = sizes <= LEAF
    cell = np.repeat(np.arange(len(starts)), sizes)
    few = np.flatnonzero(np.repeat(small & (sizes > 1), sizes))
    for gap in range(1, min(LEAF, len(few))):  # cells of a single leaf, all at once
        a, b = few[:-gap], few[gap:]
        near = (cell[a] == cell[b]) & (np.bitwise_count(fps[a] ^ fps[b]) <= MOST_BITS)
        if not (cell[a] == cell[b]).any():
            break
        found.append((fps[a[near]], fps[b[near]]))
    for s, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        own = np.unique(fps[s : s + size], return_index=True)[1]
        mine = fps[s + np.sort(own)]
        label = link_cell(mine)
        other = label != np.arange(len(mine))
        found.append((mine[label[other]], mine[other]))
    a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
    b = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.uint64)
    apart = a != b
    return pd.DataFrame({"a": a[apart].view(np.int64), "b": b[apart].view(np.int64)})


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell and Gray rank; cells that a batch may not end are kept for the next."""
    rest = pd.DataFrame({"cell": np.empty(0, np.int64), "part": np.empty(0, np.int64), "fp": np.empty(0, np.int64)})
    for batch in itertools.chain(batches, [None]):
        rows = rest if batch is None else pd.concat([rest, batch], ignore_index=True)
        keys = rows[["cell", "part"]].to_numpy()
        if batch is None:
            rest, ready = rows.iloc[:0], len(rows)
        else:
            last = np.flatnonzero((keys != keys[-1]).any(axis=1)) if len(keys) else np.empty(0, int)
            ready = int(last[-1]) + 1 if len(last) else 0
            if ready < 1 << 15 and len(rows) < 1 << 17:
                ready = 0
            rest = rows.iloc[ready:]
        if ready:
            yield _stars(keys[:ready], rows["fp"].to_numpy()[:ready].view(np.uint64))


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose components are those of all links."""
    dealt = distinct.select("fp", F.explode(cell_keys(F.col("fp"))).alias("cell"))
    hot = cut(dealt.groupBy("cell").count().where(F.col("count") > CELL).withColumn("parts", F.ceil(F.col("count") / CELL).cast("long")).drop("count"))
    if hot.isEmpty():
        parted = dealt.select("cell", F.lit(0).cast("long").alias("part"), "fp")
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = dealt.join(F.broadcast(hot) if hot.count() <= 1 << 16 else hot, "cell", "left")
        seat = F.when(F.col("mine").isNull(), F.lit(0).cast("long")).otherwise(F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other"))
        parted = met.select("cell", "fp", "parts", mine.alias("mine"), other.alias("other")).select("cell", seat.alias("part"), "fp")
    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = parted.repartition(width, "cell", "part").sortWithinPartitions("cell", "part", gray_rank(F.col("fp")))
    return cells.mapInPandas(_cells, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of an edge with the least node of its component, by large and small stars until nothing changes.

    Every round is written to the shared folder; only sums reach the driver. Hubs are found by their degrees and meet their
    neighbours by broadcast.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = by_counted_key(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct())  # a hub above its neighbours still has them all
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = by_counted_key(large, least, "u", "n").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where("u <> v").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, version (hash of the text), fp, and first_id and first_version: the least row of the component.

    Null texts count as empty; texts without words have fingerprint zero and link like any other; null ids come last;
    repeated rows share a component; an empty table gives no rows; other columns are not read. Long texts are hashed whole,
    65,536 shingles at a time.
    """
    body = whole(F.col(text))
    own = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("version"), body.alias("body"))
    marked = cut(rows.mapInArrow(_fingerprints, f"doc_id {own}, version long, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version"))
    distinct = cut(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("times"), first.alias("first")))
    roots = components(links(distinct.select("fp")))
    linked = cut(distinct.join(roots, distinct["fp"] == roots["node"]).select("root", "fp", "times", "first"))  # all but the roots
    sizes = linked.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("first").alias("least"))
    heads = cut(sizes.join(distinct.select(F.col("fp").alias("root"), "first"), "root").select("root", "size", F.least("least", "first").alias("head")))
    members = by_counted_key(linked, heads, "root", "size").select("fp", "times", "head")
    others = distinct.join(linked.select("fp"), "fp", "left_anti").join(heads.select(F.col("root").alias("fp"), "head"), "fp", "left").select("fp", "times", F.coalesce("head", "first").alias("head"))
    known = cut(members.unionByName(others))
    return by_counted_key(marked, known, "fp", "times").select("doc_id", "version", "fp", F.col("head.doc_id").alias("first_id"), F.col("head.version").alias("first_version"))


def only(docs: DataFrame, firsts: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs with an id and a hash of the text that firsts has (id, v); of rows that share both one.

    Such copies are counted first, without their texts. Where there are none, rows go as they are. Hot ones are brought down
    to one row in each task before they move, so none of them meet.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(whole(F.col(text))).alias("w"))
    copies = cut(rows.groupBy("k", "w").count().where("count > 1"))
    seen = copies.agg(F.sum("count").alias("total"), F.max("count").alias("most")).first()
    bound = hot_bound(seen["total"])

    def found(rs: DataFrame) -> DataFrame:
        return rs.join(firsts, F.col("k").eqNullSafe(F.col("id")) & (F.col("w") == F.col("v")), "left_semi")

    def one(rs: DataFrame) -> DataFrame:
        return rs.groupBy("k", "w").agg(F.first("row").alias("row"))

    if seen["most"] is None:
        kept = found(rows)
    elif seen["most"] < bound:
        kept = one(found(rows))
    else:
        firsts = cut(firsts)
        hot = F.broadcast(copies.where(F.col("count") >= bound).select(F.col("k").alias("hot_k"), F.col("w").alias("hot_w")))
        is_hot = F.col("k").eqNullSafe(F.col("hot_k")) & (F.col("w") == F.col("hot_w"))
        kept = one(found(rows.join(hot, is_hot, "left_anti"))).unionByName(found(one(rows.join(hot, is_hot, "left_semi"))))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, its least by id and text, with all columns of docs; of identical rows one stays.

    Null and empty texts are one component; null ids come last; an empty table gives no rows; clashing columns go along.
    """
    seen = classes(docs, key, text)
    firsts = seen.where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("version") == F.col("first_version"))).select(F.col("doc_id").alias("id"), F.col("version").alias("v")).distinct()
    return only(docs, firsts, key, text)
