"""Similar tags: candidate pairs by shared deletion neighbourhoods, edit distance, and clusters by connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

#: Texts in a block of a search.
BLOCK = 20_000


def normalize(tag: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(tag), "\\s+", " "))


def allowed(longest: Column) -> Column:
    """Edits at which two tags still count as one: none below 5 characters, 1 below 9, then 2."""
    return F.when(longest >= 9, 2).when(longest >= 5, 1).otherwise(0)


def _piece(text: Column, length: Column, k: int, of: int, shift: int = 0) -> Column:
    """Key of piece k of the pieces of a text of some length, as it stands in this text, so many places to the right; null if outside."""
    wide = F.floor(length / of).cast("int")
    start = wide * k + (1 + shift)
    size = wide if k < of - 1 else length - wide * (of - 1)
    return F.when((start > 0) & (start + size - 1 <= F.length(text)), F.concat_ws("|", length, F.lit(f"{of}.{k}"), F.substring(text, start, size)))


def _pieces(text: Column) -> Column:
    """own: keys of the text's two and three pieces. probe: what it holds of the pieces of a text no longer than itself.

    Of a text in one more piece than there are edits one piece is whole. It is shifted by the letters put in before it,
    less those taken out: with one edit by 0 or, where the lengths differ, up to 1; with two by -1 to 1, 0 to 1 or 0 to 2.
    """
    n = F.length(text)
    own = F.array_compact(F.array(*(F.when((n <= 8) if of == 2 else (n >= 7), _piece(text, n, k, of)) for of in (2, 3) for k in range(of))))
    one = F.array(*(_piece(text, n - d, k, 2, shift) for d in range(2) for k in range(2) for shift in range(d + 1)))
    two = F.array(*(_piece(text, n - d, k, 3, shift) for d in range(3) for k in range(3) for shift in range(-1 if d == 0 else 0, max(d, 1) + 1)))
    probe = F.when(n >= 9, two).when(n >= 5, one)
    return F.struct(own.alias("own"), F.array_distinct(F.array_compact(probe)).alias("probe"))


def pieces(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, piece and b, piece: pairs within the allowed edits have a piece in common, a being no longer than b."""
    cut_up = tags.select("norm", F.length("norm").alias("n"), _pieces(F.col("norm")).alias("p")).where("n >= 4")
    return cut_up.select(F.col("norm").alias("a"), F.explode("p.own").alias("piece")), cut_up.where("n >= 5").select(F.col("norm").alias("b"), F.explode("p.probe").alias("piece"))


def similar_pairs(tags: DataFrame) -> DataFrame:
    """a, b: distinct normalised tags (column norm) within the edits that the longer one allows, a the lesser.

    Only tags with a common piece are compared. Where one edit is allowed, pieces are halves, so short tags make small cells.
    Tags are written first: else the optimizer takes the pieces for a filter of whatever the tags were made of, and cuts up
    each row in place of each tag.
    """
    own, probe = pieces(cut(tags.select("norm").distinct()))
    met = own.join(probe, "piece").where("a <> b").select("a", "b").distinct()
    longest = F.greatest(F.length("a"), F.length("b"))
    close = met.where((F.levenshtein("a", "b", 2) >= 0) & (F.levenshtein("a", "b") <= allowed(longest)))
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(pairs: DataFrame) -> tuple[DataFrame, int]:
    """norm and root, its component's least member, of all members of pairs a, b; and the number of rounds.

    Each round links every member's greater neighbours to the least it knows, then its lesser ones, until nothing changes:
    stars halve the length of a chain, so rounds grow with the logarithm of the longest. Rounds are written to the shared
    folder; only a count and a checksum reach the driver.
    """
    linked = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, rounds = state(edges), 0
    while before[0]:
        rounds += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        greater = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = greater.groupBy("u").agg(F.min("v").alias("m"))
        seen = greater.join(least, "u").select(F.explode(F.array(linked(F.col("u"), F.col("m")), linked(F.col("v"), F.col("m")))).alias("e")).select("e.*")
        edges = cut(seen.where("u <> v").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("norm"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("norm"), F.col("v").alias("root")).distinct()), rounds


def clusters(counted: DataFrame) -> DataFrame:
    """tag, n, canonical and total of every tag in a cluster of two or more; counted has tag and n.

    Tags with one normal form are together; so are similar ones, transitively. The canonical tag is the most frequent,
    then the least by name.
    """
    named = cut(counted.withColumn("norm", normalize(F.col("tag"))))
    norms = named.select("norm").distinct()
    roots, _ = components(similar_pairs(norms))
    rooted = named.join(roots, "norm", "left").withColumn("root", F.coalesce("root", "norm"))
    heads = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("minus"), "tag")).alias("head")).where("size > 1")
    return rooted.join(heads, "root").select("tag", "n", F.col("head.tag").alias("canonical"), "total")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal normal forms, 0.9 where one holds the other, else 1 less the edit distance by the longer length."""
    x, y = normalize(a), normalize(b)
    longest = F.greatest(F.length(x), F.length(y))
    holds = (F.contains(x, y) | F.contains(y, x)) & (F.length(x) > 0) & (F.length(y) > 0)
    return F.when(x == y, 1.0).when(holds, 0.9).otherwise(1 - F.levenshtein(x, y) / longest)


def best_matches(candidates: DataFrame, folders: DataFrame, k: int = 5, least: float = 0.34) -> DataFrame:
    """candidate, folder, score and place of the k best folders of each candidate.

    candidates are a stated query set, each of which is scored against all folders. Both are dealt to blocks; a block of
    each makes a cell, and a cell's pairs are scored in one task, which ranks them first by itself.
    """
    from pyspark.sql import Window

    n_c, n_f = (max(1, -(-df.count() // BLOCK)) for df in (candidates, folders))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = candidates.select("candidate", F.pmod(F.xxhash64("candidate"), F.lit(n_c)).cast("int").alias("c_"), every(n_f).alias("f_"))
    held = folders.select("folder", F.pmod(F.xxhash64("folder"), F.lit(n_f)).cast("int").alias("f_"), every(n_c).alias("c_"))
    if n_f == 1:
        held = F.broadcast(held)
    scored = asked.join(held, ["c_", "f_"]).withColumn("score", similarity(F.col("candidate"), F.col("folder"))).where(F.col("score") >= least).drop("c_", "f_")
    place = F.row_number().over(Window.partitionBy("candidate").orderBy(F.col("score").desc(), "folder"))
    return scored.withColumn("place", place.cast("long")).where(F.col("place") <= k)
