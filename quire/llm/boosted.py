"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are made in one pass over the corpus; trees are fitted on the driver from at most SAMPLE
labelled rows, and flattened into arrays that numpy walks for all rows and trees of a batch at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.rules import STOP_WORDS
from quire.llm.text import slices, whole
from quire.session import cut

#: Most labelled rows that the trees are fitted on, those with the least hash of their id.
SAMPLE = 20_000
LOTS = 1 << 40
BATCH_ROWS = 500
THRESHOLD = 0.7
BINS, DEPTH, TREES, RATE, RIDGE = 64, 4, 80, 0.15, 1.0

STATISTICS = (
    "log_words log_bytes mean_word upper digits symbols pipes bangs punctuation other spaces new_lines stop_words distinct_words same_as_last "
    "distinct_pairs mean_line distinct_lines entropy longest_word ends_line"
).split()
_STOP = frozenset(STOP_WORDS)
_CLASS = np.zeros((256, 8))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~", b"|", b"!", b".,;:?'\"()-")):
    _CLASS[list(_chars), _k] = 1
_CLASS[128:, 6] = 1
_CLASS[list(b" \t\r\x0b\x0c"), 7] = 1


def statistics(text: str) -> list[float]:
    """Ratios of a whole text; an empty one has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    ws = text.split()
    if not ws:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / len(raw)
    classes = counts @ _CLASS
    n, lines = len(ws), text.split("\n")
    return [
        math.log1p(n), math.log1p(len(raw)), len(raw) / n, *(classes[:6] / n), classes[6] / len(raw), classes[7] / len(raw), counts[10] / n,
        sum(map(_STOP.__contains__, ws)) / n, len(set(ws)) / math.sqrt(n), sum(map(eq, ws, ws[1:])) / n,
        len(set(zip(ws, ws[1:]))) / n, math.log1p(len(raw) / len(lines)), len(set(lines)) / len(lines), float(-(share @ np.log2(share))), math.log1p(max(map(len, ws))),
        sum(line[-1:] in ".!?" for line in lines) / len(lines),
    ]


@dataclass
class Trees:
    """Perfect binary trees: node i has children 2i+1 and 2i+2; values past a threshold go right."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        n, inner = len(x), self.feature.shape[1]
        trees, at = np.arange(len(self.feature)), np.zeros((n, len(self.feature)), np.int64)
        rows = np.arange(n)[:, None]
        for _ in range(int(math.log2(inner + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        raw = self.base + self.leaf[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for log loss. Rows are binned at quantiles once; each level sums gradients by node and bin.

    Without rows, or with one class only, the score is that class's smoothed share.
    """
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    base, inner = math.log(share / (1 - share)), 2**DEPTH - 1
    trees = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)), base)
    if n == 0 or y.min() == y.max():
        return trees
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(m)], axis=1)
    raw = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            local = at - first
            gain, where = np.zeros(width), np.zeros((width, 2), np.int64)
            for k in range(m):
                if not len(edges[k]):
                    continue
                cell = local * BINS + binned[:, k]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                better = gs**2 / (hs + RIDGE) + (total_g - gs) ** 2 / (total_h - hs + RIDGE) - total_g**2 / (total_h + RIDGE)
                better = better[:, : len(edges[k])]
                pick = better.argmax(axis=1)
                value = better[np.arange(width), pick]
                more = value > gain + 1e-9
                gain[more], where[more, 0], where[more, 1] = value[more], k, pick[more]
            for node in range(width):
                if gain[node] > 0:
                    trees.feature[t, first + node], trees.threshold[t, first + node] = where[node, 0], edges[where[node, 0]][where[node, 1]]
            at = 2 * at + 1 + (x[np.arange(n), trees.feature[t, at]] > trees.threshold[t, at])
        cell = at - inner
        trees.leaf[t] = RATE * np.bincount(cell, g, inner + 1) / (np.bincount(cell, h, inner + 1) + RIDGE)
        raw += trees.leaf[t, cell]
    return trees


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, BATCH_ROWS):
        found = [statistics(t) for t in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array(found, pa.list_(pa.float64()))})


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2, divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null texts count as empty, and empty texts are scored like any other; labels that are null, and null ids, teach
    nothing; repeated rows give repeated results, and an id is drawn for the sample once however often it repeats; of ids
    with one hash the lesser is drawn first. An empty table gives no rows; columns other than the key and the text are not
    read, so their names are free; texts of any length are measured whole. Only texts enter a score.
    """
    own = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), whole(F.col(text)).alias("body"))
    measured = cut(rows.mapInArrow(_measure, f"doc_id {own}, x array<double>"))
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    labelled = cut(measured.join(known, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("x", "y"), F.xxhash64("x")).alias("r")).select("doc_id", "r.*"))
    # the least hashes, cut off a tenth above the place where the sample ends, so that no more than that reaches the driver
    lot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(LOTS))
    ends = LOTS * 1.1 * sample / max(1, labelled.count())
    drawn = labelled.where(lot < int(min(LOTS, ends))).orderBy(lot, "doc_id").limit(sample).select("x", "y").toPandas()
    x = np.array(drawn["x"].tolist(), float).reshape(len(drawn), len(STATISTICS))
    trees = fit(x, (drawn["y"].to_numpy(float) > 0.5).astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            got = trees.score(values) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(got, pa.float64())})

    scored = measured.mapInArrow(run, f"doc_id {own}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
