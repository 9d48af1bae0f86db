"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, transitively.

Candidates come first from the SimHash index of simhash.py: fingerprints of the five-word shingles, in cells for pairs of
blocks of bits, searched in Gray order by a hierarchy of masked nodes. What it links meets as a list of two texts. No
result is estimated, and similar sets can have fingerprints further apart than the index links, so keys give the rest.
In any order that all texts share, two sets that similar share a shingle among the first fifth of
each (and one more), and that of the smaller set is among its first ninth (and one more). Rare shingles come first in the
order, so a licence before many texts is no key of theirs; which are frequent is learnt from one text in 32, and a wrong
guess costs time only. Texts with a key in common meet if it leads one of them, once for each list of texts that keys
have in common; where many have a key, only texts of near sizes do. A sketch of the parities of
as many classes of hashes as the set has members, or up to twice as many, differs in no more bits than the sets in
members, which rules out most pairs at once. What it
leaves forms components that hold all near copies; in each the sets themselves are compared. Pairs that are of one
component already are left out, so a group of n copies costs about n comparisons. Keys and components with many texts are
parted, and each pair of parts, one of which has leaders, is a cell of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.joins import by_counted_key
from quire.llm.simhash import BATCH_ROWS, SEED, Forest, components, links, majority, only
from quire.llm.text import slices, whole
from quire.session import cut

SHINGLE = 5
#: Least bits of a sketch.
SKETCH_BITS = 512
#: Texts in a cell, or in a part of one: where sketches are compared, and where sets are.
CELL = 1024
SETS = 256
#: One in so many texts tells which shingles are frequent: those in so many of them, of which the first so many are told from rare ones.
SAMPLED = 32
FREQUENT = 8
KNOWN = 1 << 17
#: Sizes in a band differ by less than this factor; it is over 5/4, so near copies are in one band or in two next to each other.
BAND = 1.26
#: Parts of a band are numbered from a multiple of this.
PARTS = 1 << 44
#: Cells of so few rows are compared all at once.
FEW = 32
#: Rows of whole cells that are worked on at a time.
READY = 1 << 15


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word runs; of fewer words that of the whole sequence, of none nothing."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.int64)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(ws) - SHINGLE + 1)
    hashes = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(SHINGLE, len(ws)) - 1 :].tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, n).view(np.int64))


def n_keys(n: int) -> int:
    """First members of a set of n, in any common order, of which a set at Jaccard 0.8 or more shares one at least."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def n_leaders(n: int) -> int:
    """First members of a set of n of which such a set of n or more members has one among its keys."""
    return n - (8 * n + 8) // 9 + 1 if n else 0


def rare_first(members: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Members by level and then by hash; known are sorted hashes with their levels, others have level 0."""
    if not len(known) or not len(members):
        return members
    at = np.minimum(np.searchsorted(known, members), len(known) - 1)
    return members[np.argsort(np.where(known[at] == members, level[at], 0), kind="stable")]


def sketch(members: np.ndarray) -> bytes:
    """The parities of the classes that the lowest bits of the members make; its halves' XOR is the sketch of half the bits."""
    bits = max(SKETCH_BITS, 1 << max(0, len(members) - 1).bit_length())
    return np.packbits(np.bincount(members & (bits - 1), minlength=bits) & 1).tobytes()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, BATCH_ROWS):
        yield pa.RecordBatch.from_pydict({"cell": np.concatenate([np.empty(0, np.int64), *map(shingles, batch.column("body").to_pylist())])})


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that are in the most texts of a sample by hash, each with the logarithm of its count.

    They settle the order of keys, on which no result depends. At most KNOWN numbers and their counts reach the driver.
    """
    some = rows.where(F.pmod("version", F.lit(SAMPLED)) == 0).select("version", "body").dropDuplicates(["version"])
    counted = some.mapInArrow(_members, "cell long").groupBy("cell").count().where(F.col("count") >= FREQUENT)
    top = counted.orderBy(F.desc("count"), "cell").limit(KNOWN).toPandas().sort_values("cell")
    return top["cell"].to_numpy(np.int64), np.log2(top["count"].to_numpy(np.float64)).astype(np.int64)


def _marks(order: Broadcast) -> Callable:
    """For mapInArrow: each text's node (a hash of its set), fingerprint, size, sketch and keys, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            sets = [shingles(t) for t in batch.column("body").to_pylist()]
            node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            fp = np.fromiter((majority(s.view(np.uint64)) for s in sets), np.uint64, len(sets)).view(np.int64)
            keys = pa.array([rare_first(s, *order.value)[: n_keys(len(s))] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "version": batch.column("version"), "node": pa.array(node), "fp": pa.array(fp), "n": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array(list(map(sketch, sets)), pa.binary()), "keys": keys})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, BATCH_ROWS):
        yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "seats": batch.column("seats"), "members": pa.array([shingles(t) for t in batch.column("body").to_pylist()], pa.list_(pa.int64()))})


def _starts(cell: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cells start in sorted rows, and their sizes."""
    starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
    return starts, np.diff(np.append(starts, len(cell)))


def _lists(rows: pd.DataFrame) -> pd.DataFrame:
    """Cells of two or more, one of which leads, named by a sum over their nodes, so that equal lists have one name."""
    node = rows["node"].to_numpy()
    starts, sizes = _starts(rows["cell"].to_numpy(), rows["part"].to_numpy())
    mixed = node.view(np.uint64)
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(by))) * np.uint64(times)
    name = np.repeat(np.add.reduceat(mixed, starts).view(np.int64), sizes)
    led = np.add.reduceat(rows["leads"].to_numpy().astype(np.int64), starts) > 0
    shared = np.repeat((sizes > 1) & led, sizes)
    return pd.DataFrame({"cell": name[shared], "node": node[shared]})


def _linked(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Labels of the components of 0 to n - 1; near says which of some places are linked to one."""
    forest = Forest(n)
    for i in range(n - 1):
        rest = np.flatnonzero(forest.label[i + 1 :] != forest.label[i]) + i + 1
        if len(rest) and len(hits := rest[near(i, rest)]):
            forest.link(np.full(len(hits), i), hits)
    return forest.label


def _stars(node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = label != np.arange(len(node))
    return node[label[other]], node[other]


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def _maybe(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of whole cells between nodes whose sizes and sketches allow a Jaccard similarity of 0.8."""
    node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
    sketches = rows["sketch"].to_numpy()
    width = np.fromiter(map(len, sketches), np.int64, len(rows))
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by width: sketches of this width and of twice it, and each row's place
    for w in np.unique(width).tolist():
        own, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        words = [np.frombuffer(b"".join(sketches[x]), np.uint64).reshape(len(x), -1, w // 8) for x in (own, twice) if len(x)]
        place = np.zeros(len(rows), np.int64)
        place[own], place[twice] = np.arange(len(own)), np.arange(len(twice)) + len(own)
        folded[w] = np.concatenate([np.bitwise_xor.reduce(x, axis=1) for x in words]), place

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = 9 * np.abs(n[a] - n[b]) <= n[a] + n[b]  # sizes so near that widths differ by a factor of two at most
        least = np.minimum(width[a], width[b])
        for w in np.unique(least[out]).tolist():
            some = np.flatnonzero(out & (least == w))
            bits, place = folded[w]
            x, y = a[some], b[some]
            out[some] = 9 * np.bitwise_count(bits[place[x]] ^ bits[place[y]]).sum(axis=1, dtype=np.int64) <= n[x] + n[y]
        return out

    cell = rows["cell"].to_numpy()
    starts, sizes = _starts(cell, cell)
    few = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    found = []
    for gap in range(1, FEW):
        a, b = few[:-gap], few[gap:]
        same = cell[a] == cell[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        close = near(a, b)
        found.append((node[a[close]], node[b[close]]))
    for s, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        found.append(_stars(node[s : s + size], _linked(size, lambda i, rest: near(np.full(len(rest), s + i), s + rest))))  # noqa: B023
    return _edges(found)


def link_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Labels of the components of sorted sets, linked at a Jaccard similarity of 0.8 or more."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        out = (5 * np.minimum(n[rest], n[i]) >= 4 * np.maximum(n[rest], n[i])) & (n[rest] > 0)
        if out.any():
            some = rest[out]
            held = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], held), n[i] - 1)
            both = np.add.reduceat((sets[i][at] == held).astype(np.int64), np.cumsum(n[some]) - n[some])
            out[out] = 5 * both >= 4 * (n[some] + n[i] - both)
        return out

    return _linked(len(sets), near)


def _surely(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of whole cells between sets at a Jaccard similarity of 0.8 or more."""
    node = rows["node"].to_numpy()
    starts, sizes = _starts(rows["cell"].to_numpy(), rows["part"].to_numpy())
    sets = [np.asarray(m, np.int64) for m in rows["members"]]
    return _edges([_stars(node[s : s + size], link_sets(sets[s : s + size])) for s, size in zip(starts.tolist(), sizes.tolist()) if size > 1])


def _whole_cells(on: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """For mapInArrow: work on rows that come sorted by cell; a cell that a batch may not end is kept for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                kept.append(batch)
            if not kept or (batch is not None and sum(b.num_rows for b in kept) < READY):
                continue
            rows = pa.Table.from_batches(kept).combine_chunks()
            ready = rows.num_rows
            if batch is not None:
                keys = [rows.column(c).to_numpy() for c in on]
                before = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
                ready = int(before[-1]) + 1 if len(before) else 0
            kept = rows.slice(ready).to_batches()
            if ready:
                yield pa.RecordBatch.from_pandas(work(rows.slice(0, ready).to_pandas()), preserve_index=False)

    return run


def _larger(dealt: DataFrame, on: list[str], most: int) -> tuple[DataFrame | None, int]:
    """Cells with more than `most` rows and how many lead there, to be joined; None if there are none."""
    hot = cut(dealt.groupBy(*on).agg(F.count(F.lit(1)).alias("all"), F.count_if("leads").alias("led")).where(F.col("all") > most))
    n = hot.count()
    return (None if n == 0 else F.broadcast(hot) if n <= 1 << 16 else hot), n


def _banded(dealt: DataFrame, most: int) -> DataFrame:
    """cell, band, node and leads: cells with more than `most` rows by bands of sizes n, each with the next band's rows as followers."""
    whole_cell = F.lit(-1)
    hot, n_hot = _larger(dealt, ["cell"], most)
    if n_hot == 0:
        return dealt.select("cell", whole_cell.alias("band"), "node", "leads")
    band = F.floor(F.log("n") / math.log(BAND)).cast("int")
    seat = lambda b, leads: F.struct(b.alias("band"), leads.alias("leads"))
    seats = F.when(F.col("all").isNull(), F.array(seat(whole_cell, F.col("leads")))).when(F.col("led") > 0, F.array(seat(band, F.col("leads")), seat(band - 1, F.lit(False))))
    return dealt.join(hot, "cell", "left").select("cell", "node", F.explode(seats).alias("seat")).select("cell", "seat.band", "node", "seat.leads")


def _parted(dealt: DataFrame, most: int) -> DataFrame:
    """cell, part, node and leads: of a cell's band with more than `most` nodes each pair of parts is one, if one of both has leaders."""
    zero = F.lit(0).cast("long")
    below = ((F.col("band") + 1).cast("long") * PARTS).alias("part")
    hot, n_hot = _larger(dealt, ["cell", "band"], most)
    if n_hot == 0:
        return dealt.select("cell", below, "node", "leads")
    met = dealt.join(hot, ["cell", "band"], "left").withColumn("heads", F.ceil(F.col("led") / most)).withColumn("parts", F.col("heads") + F.ceil((F.col("all") - F.col("led")) / most))
    dealt_to = lambda first, parts: first + F.pmod(F.xxhash64("node"), F.greatest(parts, F.lit(1)))
    mine = F.when(F.col("leads"), dealt_to(zero, F.col("heads"))).otherwise(dealt_to(F.col("heads"), F.col("parts") - F.col("heads")))
    others = F.sequence(zero, F.when(F.col("leads"), F.col("parts")).otherwise(F.col("heads")) - 1)
    other = F.explode(F.when(F.col("all").isNull(), F.array(zero)).when(F.col("led") > 0, others))
    seats = met.select("cell", "band", "node", "leads", "parts", mine.alias("mine"), other.alias("other"))
    pair = F.when(F.col("parts").isNull(), zero).otherwise(F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other"))
    return seats.select("cell", ((F.col("band") + 1).cast("long") * PARTS + pair).alias("part"), "node", "leads")


def seats_by_key(distinct: DataFrame) -> DataFrame:
    """cell, part, node and leads of the keys of distinct sets (node, n, keys)."""
    leading = F.expr("n - (8 * n + 8) div 9 + 1")  # n_leaders
    dealt = distinct.select("node", "n", F.posexplode("keys").alias("place", "cell")).select("cell", "node", "n", (F.col("place") < leading).alias("leads"))
    return _parted(_banded(dealt, CELL), CELL)


def meetings(distinct: DataFrame, width: int) -> DataFrame:
    """cell and node: the different lists of two or more sets that have a key in common."""
    shared = seats_by_key(distinct).repartition(width, "cell", "part").sortWithinPartitions("cell", "part", "node")
    return shared.mapInArrow(_whole_cells(["cell", "part"], _lists), "cell long, node long").distinct()


def indexed(distinct: DataFrame) -> DataFrame:
    """cell and node: the two sets of each link that the SimHash index finds between fingerprints, or of one fingerprint."""
    fps = cut(distinct.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("times")))
    head = lambda c: fps.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_"))
    between = links(fps.select("fp")).join(head("a"), "a").join(head("b"), "b").select("a_", "b_")
    of_one = by_counted_key(distinct.select("fp", "node"), fps.where("times > 1"), "fp", "times").where("node <> head").select(F.col("head").alias("a_"), F.col("node").alias("b_"))
    return between.unionByName(of_one).select(F.xxhash64("a_", "b_").alias("cell"), F.explode(F.array("a_", "b_")).alias("node"))


def marks(rows: DataFrame) -> DataFrame:
    """node, fp, n, sketch, keys and the first row of each distinct set; rows have doc_id, version and body."""
    order = rows.sparkSession.sparkContext.broadcast(frequent(rows))
    own = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.mapInArrow(_marks(order), f"doc_id {own}, version long, node long, fp long, n long, sketch binary, keys array<long>")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("first")
    return cut(marked.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")))


def firsts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id and v (hash of the text): the least row of each component. Null texts count as empty; null ids come last."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = whole(F.col(text))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("version"), body.alias("body"))
    distinct = marks(rows)
    lists = indexed(distinct).unionByName(meetings(distinct, width)).distinct()
    cells = lists.join(distinct.select("node", "n", "sketch"), "node").repartition(width, "cell").sortWithinPartitions("cell")
    maybe = components(cells.mapInArrow(_whole_cells(["cell"], _maybe), "a long, b long").distinct())

    maybe = cut(maybe.select(F.col("root").alias("cell"), "node").unionByName(maybe.select(F.col("root").alias("cell"), F.col("root").alias("node"))).distinct())
    seats = _parted(maybe.select("cell", F.lit(-1).alias("band"), "node", F.lit(True).alias("leads")), SETS).groupBy("node").agg(F.collect_list(F.struct("cell", "part")).alias("seats"))
    wanted = cut(seats.join(distinct.select("node", "first"), "node").select("node", "seats", F.col("first.doc_id").alias("id"), F.col("first.version").alias("v")))
    found = rows.join(F.broadcast(wanted) if wanted.count() <= 1 << 16 else wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("v")))
    sets = found.select("node", "seats", "body").mapInArrow(_sets, "node long, seats array<struct<cell: long, part: long>>, members array<long>")
    seated = sets.select(F.explode("seats").alias("seat"), "node", "members").select("seat.*", "node", "members")
    roots = components(seated.repartition(width, "cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_whole_cells(["cell", "part"], _surely), "a long, b long").distinct())
    placed = distinct.select("node", "first").join(roots, "node", "left")
    return placed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.version").alias("v"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, its least by id and text, with all columns of docs; of identical rows one stays.

    Texts without words are alike and one of them stays; null ids come last; texts of any length are compared whole; an
    empty table gives no rows; clashing columns go along.
    """
    return only(docs, firsts(docs, key, text), key, text)
