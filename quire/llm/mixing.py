"""Mixing sources to target weights by temperature.

The weight of a source is its token share to the power alpha, normalised. alpha is bisected on a grid of 1/4096: the
smallest that keeps every source within a limit of repetitions, or the largest whose weights reach a target entropy.
The weights are realised as token budgets. A source's documents are dealt to blocks by a hash of the key; each pass
over the source orders its blocks, and the documents in them, by hashes of the pass, and the last, partial pass takes
whole blocks in that order and then documents of one cut block while they fit the budget. Where a source is cut is one
point in that order, found by sums over ever smaller parts of the hash's range, so no task holds a source or a block and
every document is taken or left by itself.

Without a total budget, budgets are the least at which every source is seen once: no document is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import words
from quire.session import cut

#: Steps of alpha from 0 to 1.
GRID = 4096
#: Hex digits of the hash that part a source into blocks.
BLOCK_DIGITS = 2
#: Further digits that part a cut block; only one such part of each source is ordered by rows.
PART_DIGITS = 3
#: Plans of so many blocks are broadcast (some 60 bytes each); larger ones meet the rows by shuffle.
MOST_BLOCKS = 1 << 17


def source_key(source: Column) -> Column:
    """Null sources are one source of their own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def block_of(key: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit("block|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, BLOCK_DIGITS)


def rank_hash(kind: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(kind), *(p.cast("string") for p in parts)))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def bisect_alpha(totals: DataFrame, max_repeats: float | None, target_entropy: float | None) -> int:
    """alpha * GRID. totals: source, tokens. Each step is one aggregate over the sources; only its sums reach the driver.

    Without any token, or with neither aim, alpha is 1 (the sources' own shares).
    """
    ends = totals.agg(F.max("tokens").alias("top"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least")).first()
    if not ends["top"] or (max_repeats is None and target_entropy is None):
        return GRID
    share = F.col("tokens") / F.lit(float(ends["top"]))

    def meets(k: int) -> bool:
        alpha = k / GRID
        if max_repeats is not None:
            return (ends["top"] / ends["least"]) ** (1 - alpha) <= max_repeats
        p = F.pow(share, F.lit(alpha))
        got = totals.where("tokens > 0").agg(F.sum(p).alias("z"), F.sum(p * F.log(p)).alias("plogp")).first()
        import math

        return math.log(got["z"]) - got["plogp"] / got["z"] < target_entropy

    lo, hi = 0, GRID  # the smallest k that meets, GRID if none below does
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if meets(mid) else (mid + 1, hi)
    return lo if max_repeats is not None or lo == 0 else lo - 1


def budgets(totals: DataFrame, alpha: float, budget_tokens: int | None) -> DataFrame:
    """totals with budget, passes (whole ones) and rest (tokens of the partial pass)."""
    ends = totals.agg(F.max("tokens").alias("top"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(alpha))).alias("z")).first()
    top, z = float(ends["top"] or 0), ends["z"] or 0.0
    if budget_tokens is None:
        scaled = F.floor(F.lit(top) * F.pow(F.col("tokens") / F.lit(top or 1.0), F.lit(alpha))).cast("long")
        budget = F.greatest(F.col("tokens"), scaled)
    else:
        budget = F.floor(F.pow(F.col("tokens").cast("double"), F.lit(alpha)) / F.lit(z or 1.0) * F.lit(float(budget_tokens))).cast("long")
    out = totals.withColumn("budget", F.when(F.col("tokens") > 0, budget).otherwise(F.lit(0).cast("long")))
    passes = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1).cast("long"))
    return out.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.when(F.col("tokens") > 0, F.col("passes") * F.col("tokens")).otherwise(0))


def plan(dealt: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """For each source and block: passes, take (all, none or cut of the partial pass) and left, the cut block's tokens.

    dealt: source, block, tokens, one row per document. Sources without tokens get one pass.
    """
    blocks = cut(dealt.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")))
    totals = blocks.groupBy("source").agg(F.sum("block_tokens").alias("tokens"))
    alpha = bisect_alpha(totals, max_repeats, target_entropy) / GRID
    known = blocks.join(budgets(totals, alpha, budget_tokens), "source")
    order = Window.partitionBy("source").orderBy("turn", "block")
    turned = known.withColumn("turn", rank_hash("turn", F.col("passes"), F.col("source"), F.col("block")))
    ends = turned.withColumn("end", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.col("block_tokens")
    take = F.when(F.col("end") <= F.col("rest"), "all").when(start < F.col("rest"), "cut").otherwise("none")
    return ends.select("source", "block", "passes", F.when(F.col("rest") <= 0, "none").otherwise(take).alias("take"), (F.col("rest") - start).alias("left"))


def cut_points(counted: DataFrame, steps: DataFrame) -> DataFrame:
    """source and upto: a point (hash, key, tokens) in the order of the cut block up to which its documents fit.

    counted: source, block, key, tokens. Equal keys of equal length go together. The sums of the parts of the hash's range
    say in which part the budget ends; the rows of that part alone are put in order.
    """
    cuts = steps.where("take = 'cut'").select("source", "block", "passes", "left")  # one row a source at most
    if cuts.count() <= MOST_BLOCKS:
        cuts = F.broadcast(cuts)
    rows = counted.join(cuts, ["source", "block"]).select("source", "left", "key", "tokens", rank_hash("row", F.col("passes"), F.col("key")).alias("h"))
    rows = rows.withColumn("part", F.substring("h", 1, PART_DIGITS))
    held = rows.groupBy("source", "left", "part").agg(F.sum("tokens").alias("held"))
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = held.withColumn("end", F.sum("held").over(order)).where("end > left")
    ending = ends.groupBy("source").agg(F.min_by(F.struct("part", (F.col("end") - F.col("held")).alias("start")), "part").alias("p")).select("source", "p.part", "p.start")
    alike = rows.join(ending, ["source", "part"]).groupBy("source", "part", "start", "left", "h", "key", "tokens").agg(F.sum("tokens").alias("held"))
    order = Window.partitionBy("source").orderBy("h", "key", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    fits = alike.withColumn("end", F.col("start") + F.sum("held").over(order)).where("end <= left")
    last = fits.groupBy("source").agg(F.max(F.struct("h", "key", "tokens")).alias("last"))
    none = F.struct(F.col("part").alias("h"), F.lit("").alias("key"), F.lit(0).cast("long").alias("tokens"))  # before every hash of the part
    return ending.join(last, "source", "left").select("source", F.coalesce("last", none).alias("upto"))


def mix(
    docs: DataFrame,
    max_repeats: float | None = 2.0,
    target_entropy: float | None = None,
    budget_tokens: int | None = None,
    key: str = "doc_id",
    source: str = "source",
    tokens: Column | None = None,
    text: str = "text",
) -> DataFrame:
    """The realised mixture: each row of docs as `row`, once per pass that takes it, with tokens, pass, block and order_key.

    Sorting by source, pass, block_turn and order_key gives the permutation. Null sources are one source; null keys one
    key; equal keys of equal length are taken or left together. Texts without words cost nothing and are taken in every
    pass of their block. An empty table gives an empty mixture. docs is read twice (keys and lengths, which are written
    to the shared folder, then rows) and must give the same rows both times; texts of any length are only counted and
    carried, and columns of any name go along inside `row`.
    """
    n = word_count(F.col(text)) if tokens is None else tokens
    known = [source_key(F.col(source)).alias("source"), block_of(F.col(key)).alias("block"), n.cast("long").alias("tokens"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key")]
    counted = cut(docs.select(*known))
    steps = cut(plan(counted, max_repeats, target_entropy, budget_tokens))
    upto = cut(cut_points(counted, steps))
    steps = steps.join(upto, "source", "left")
    if steps.count() <= MOST_BLOCKS:
        steps = F.broadcast(steps)
    met = docs.select(F.struct("*").alias("row"), *known).join(steps, ["source", "block"])
    fits = F.struct(rank_hash("row", F.col("passes"), F.col("key")).alias("h"), "key", "tokens") <= F.col("upto")
    once_more = (F.col("take") == "all") | ((F.col("take") == "cut") & F.coalesce(fits, F.lit(False)))
    every = met.withColumn("times", F.col("passes") + F.when(once_more, 1).otherwise(0)).where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return every.select(
        "row",
        "tokens",
        "pass",
        "block",
        rank_hash("turn", F.col("pass"), F.col("source"), F.col("block")).alias("block_turn"),
        rank_hash("row", F.col("pass"), F.col("key")).alias("order_key"),
    )
