"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range (1/SCALE), so its size follows the text, sketches
merge by union, and the containment of a short text in a very long one is estimated without bias. A text of at most KEEP_ALL
shingles, or with none below the threshold, has too few for that and keeps all of them, at scale 1. Two sketches are compared
at the coarser of their scales: what lies below the threshold that both have. A text that is empty at that scale has no
estimate of containment (null) rather than a wrong one. merge(sketch(a), sketch(b)) is the sketch of a's and b's shingles
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.llm.text import let, shingle_hashes, whole, words

SHINGLE_WORDS = 5
#: One hash in so many is kept, but all of a text with few.
SCALE = 8
KEEP_ALL = 64
#: Quantiles of doc_id that reach the driver. Each range between two is cut into equal parts of about PART_ROWS rows, MOST_PARTS at most.
RANGES = 256
PART_ROWS = 20_000
MOST_PARTS = 8192


def below(h: Column, scale: int) -> Column:
    return h < F.lit(-(1 << 63) + (1 << 64) // scale)


def scaled(hashes: Column, scale: int = SCALE) -> Column:
    """struct(scale, hashes): sorted distinct hashes below the threshold, or all, at scale 1, if they are few or none is below."""

    def of(hs: Column) -> Column:
        low = F.filter(hs, lambda h: below(h, scale))
        all_of_them = F.struct(F.lit(1).alias("scale"), F.sort_array(hs).alias("hashes"))
        return let(low, lambda lo: F.when((F.size(hs) <= KEEP_ALL) | (F.size(lo) == 0), all_of_them).otherwise(F.struct(F.lit(scale).alias("scale"), F.sort_array(lo).alias("hashes"))))

    return let(F.array_distinct(hashes), of)


def sketch(text: Column, n: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """The sketch of a whole text, however long: struct(scale, hashes array<bigint>), empty for a text without words, a null one too."""
    return let(words(text), lambda ws: scaled(shingle_hashes(ws, n), scale))


def _at(a: Column, coarse: Column, scale: int) -> Column:
    """The hashes of a sketch that a sketch at scale 1, or else at the common scale, would keep."""
    return F.when(coarse == a["scale"], a["hashes"]).otherwise(F.filter(a["hashes"], lambda h: below(h, scale)))


def _together(a: Column, b: Column, scale: int, use) -> Column:
    """use(hashes of a, hashes of b) at the coarser of two scales."""
    coarse = F.greatest(a["scale"], b["scale"])
    return let(F.struct(_at(a, coarse, scale).alias("a"), _at(b, coarse, scale).alias("b")), lambda z: use(z["a"], z["b"]))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    union = _together(a, b, scale, F.array_union)
    return F.when((a["scale"] == 1) & (b["scale"] == 1), scaled(union, scale)).otherwise(F.struct(F.lit(scale).alias("scale"), F.sort_array(union).alias("hashes")))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty texts are alike. Exact for two texts that keep all their shingles."""

    def share(x: Column, y: Column) -> Column:
        union = F.size(F.array_union(x, y))
        return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)

    return _together(a, b, scale, share)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is in every b; null where a has none at the common scale."""
    none = F.when(F.size(a["hashes"]) == 0, F.lit(1.0))
    return _together(a, b, scale, lambda x, y: F.when(F.size(x) == 0, none).otherwise(F.size(F.array_intersect(x, y)) / F.size(x)))


def as_string(a: Column) -> Column:
    """The scale, a colon, and the hashes as 16 hexadecimal digits each, ascending, joined by commas; empty for an empty sketch."""
    listed = F.concat_ws(",", F.transform(a["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))
    return F.when(F.size(a["hashes"]) == 0, F.lit("")).otherwise(F.concat_ws(":", a["scale"], listed))


def step(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key: a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def with_next(docs: DataFrame, columns: dict[str, Column], key: str = "doc_id") -> DataFrame:
    """doc_id, the columns, and for each of them next_<name> from the row that follows by key; the last is followed by the first.

    Rows are dealt to range buckets, bounded by quantiles of the key and equal parts between them, as many as the rows
    need; the first rows of a bucket also go to the bucket before it as guests, so each bucket finds its followers by
    itself. Null keys come first, and equal keys are ordered by the columns; rows with one key are in one bucket. Keys that
    are text go by their first bytes. The first two passes read the key only; the table of bucket edges has RANGES *
    MOST_PARTS rows at most (24 bytes each) and is broadcast.
    """
    head = F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(key).cast("string"), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    own = F.coalesce(head if isinstance(docs.schema[key].dataType, StringType) else F.col(key).cast("long"), F.lit(-(1 << 63)))
    keys = docs.select(own.alias("k"))
    seen = keys.agg(F.percentile_approx("k", [i / RANGES for i in range(1, RANGES)], 10000).alias("q"), F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    bounds = sorted(set(seen["q"] or []))
    parts = min(MOST_PARTS, max(1, -(-seen["n"] // (RANGES * PART_ROWS))))
    ends = [float(x) for x in (seen["lo"] or 0, *bounds, (seen["hi"] or 0) + 1)]
    low, wide = (F.lit(x) for x in (ends[:-1], [max(1.0, b - a) for a, b in zip(ends, ends[1:])]))

    def bucket(k: Column) -> Column:
        r = step(k, bounds)
        part = F.floor((k.cast("double") - F.get(low, r)) / F.get(wide, r) * parts)
        return (r * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))).cast("int")

    edges = keys.groupBy(bucket(F.col("k")).alias("b")).agg(F.min("k").alias("lowest"))
    line = Window.partitionBy().orderBy("b")
    edges = edges.select("b", "lowest", F.coalesce(F.lag("b").over(line), F.max("b").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("earlier"))
    names = list(columns)
    seat = lambda b, guest: F.struct(F.col(b).alias("b"), F.lit(guest).alias("guest"))
    rows = (
        docs.select(own.alias("k"), F.col(key).alias("doc_id"), *(c.alias(n) for n, c in columns.items()))
        .withColumn("b", bucket(F.col("k")))
        .join(F.broadcast(edges), "b")
        .withColumn("seat", F.explode(F.when(F.col("k") == F.col("lowest"), F.array(seat("b", 0), seat("earlier", 1))).otherwise(F.array(seat("b", 0)))))
        .select("seat.b", "seat.guest", "k", "doc_id", *names)
    )
    order = Window.partitionBy("b").orderBy("guest", "k", "doc_id", *names)
    return (
        rows.select("guest", "doc_id", *names, *(F.lead(n).over(order).alias(f"next_{n}") for n in names))
        .where("guest = 0")
        .drop("guest")
    )


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's sketch beside those of its edited text and of the next document.

    The edited text has the last quarter of its code points (rounded down) replaced by as many of the next document's
    first, or all of them. A null text counts as empty; a text without words has an empty sketch, like any such text;
    very long texts are sketched whole. Repeated rows follow each other; a table of one row is its own next; an empty table
    gives no rows. Other columns are not read. contained_in_edited is null where it has no estimate.
    """
    pairs = with_next(docs, {"text": whole(F.col(text)), "sketch": sketch(F.col(text))}, key)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    made = pairs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)).alias("edited"),
        "sketch",
        "next_sketch",
    ).withColumn("edited_sketch", sketch(F.col("edited")))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )
