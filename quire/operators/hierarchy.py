"""Folder forests: subtrees, counts over them and nearest ancestors, in tables of the order of the forest, however deep.

In a flat forest the pairs of folder and ancestor are few. In a deep one, of which they would be of the order of the square, intervals
stand for them.

Folders have folder_id and parent_id; a parent that does not exist makes its child a root. Pointers to ancestors double their reach
in each round, so a tree of depth d takes about log2(d) rounds of joins of one row per folder. From sizes and the places
of siblings each folder gets an interval of its tree's preorder: what is under it has its first number in there. Folders of
a cycle are all under each other, so they share one interval, and what hangs below them is under all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chunks
from quire.session import cut

#: Mean number of ancestors up to which pairs of folder and ancestor are used, in fewer rounds; of deeper forests, intervals.
WIDE = 16
#: Pairs of a folder and an item in a task.
TASK_ROWS = 1_000_000
#: Tables of so many folders meet others by broadcast.
MOST_BROADCAST = 100_000


def _side(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= MOST_BROADCAST else table


def _parents(folders: DataFrame) -> DataFrame:
    """folder_id and parent_id, which is null for roots."""
    ids = folders.select(F.col("folder_id").alias("parent_id"), F.lit(True).alias("is_"))
    met = folders.select("folder_id", "parent_id").join(ids, "parent_id", "left")
    return met.select("folder_id", F.when(F.col("is_") & (F.col("parent_id") != F.col("folder_id")), F.col("parent_id")).alias("parent_id"))


def _climbed(parents: DataFrame, n: int) -> DataFrame:
    """up: null if the way up ends, else a folder of a cycle; top: the root; low: the least folder of the cycle; size: folders at or under, unless in a cycle."""
    state = cut(parents.select("folder_id", "parent_id", F.col("parent_id").alias("up"), F.coalesce("parent_id", "folder_id").alias("top"), F.col("folder_id").alias("low"), F.lit(1).cast("long").alias("size")))
    before = None
    while True:
        now = state.agg(F.count("up").alias("a"), F.count_distinct("up").alias("b"), F.sum(F.xxhash64("low").cast("decimal(38,0)")).alias("c")).first()
        if now["a"] == 0 or now == before:
            return state
        above = state.select(F.col("folder_id").alias("up"), F.col("up").alias("next_"), F.col("top").alias("top_"), F.col("low").alias("low_"))
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("folder_id")).agg(F.sum("size").alias("more_"))
        met = state.join(_side(above, n), "up", "left").join(_side(below, n), "folder_id", "left")
        state = cut(met.select("folder_id", "parent_id", F.col("next_").alias("up"), F.coalesce("top_", "top").alias("top"), F.least("low", "low_").alias("low"), (F.col("size") + F.coalesce("more_", F.lit(0))).alias("size")))
        before = now


def intervals(folders: DataFrame) -> DataFrame:
    """folder_id, parent_id (null for roots and folders of a cycle), top, first, last and on_cycle, one row per folder.

    A folder is at or under another if both have one top and its first lies in the other's first to last.
    """
    n = folders.count()
    state, looped = _climbed(_parents(folders), n), None
    if not state.where("up IS NOT NULL").isEmpty():
        # a cycle becomes its least folder, a root
        on_cycle = state.where("up IS NOT NULL").select(F.col("up").alias("folder_id")).distinct()
        looped = cut(state.join(_side(on_cycle, n), "folder_id", "left_semi").select("folder_id", F.col("low").alias("least_")))
        as_parent = looped.select(F.col("folder_id").alias("parent_id"), "least_")
        rest = state.select("folder_id", "parent_id").join(_side(looped.select("folder_id"), n), "folder_id", "left_anti").join(_side(as_parent, n), "parent_id", "left").select("folder_id", F.coalesce("least_", "parent_id").alias("parent_id"))
        state = _climbed(rest.unionByName(looped.select(F.col("least_").alias("folder_id"), F.lit(None).cast(folders.schema["parent_id"].dataType).alias("parent_id")).distinct()), n)
    # siblings by id: each begins after its parent and the whole of the earlier ones
    placed = chunks.Ordered(state.select("folder_id", "parent_id", "top", "size"), "parent_id", "folder_id").with_folds(to_=chunks.running_sum(F.col("size"))).rows()
    step = F.when(F.col("parent_id").isNull(), F.lit(0)).otherwise(F.col("to_") - F.col("size") + 1)
    ways = cut(placed.select("folder_id", "parent_id", F.col("parent_id").alias("up"), "top", "size", step.cast("long").alias("first")))
    while not ways.where("up IS NOT NULL").isEmpty():
        above = ways.select(F.col("folder_id").alias("up"), F.col("up").alias("next_"), F.col("first").alias("first_"))
        ways = cut(ways.join(_side(above, n), "up", "left").select("folder_id", "parent_id", F.col("next_").alias("up"), "top", "size", (F.col("first") + F.coalesce("first_", F.lit(0))).alias("first")))
    found = ways.select("folder_id", "parent_id", "top", "first", (F.col("first") + F.col("size") - 1).alias("last"), F.lit(False).alias("on_cycle"))
    if looped is None:
        return found
    shared = looped.join(_side(found.withColumnRenamed("folder_id", "least_"), n), "least_").select("folder_id", F.lit(None).cast(folders.schema["parent_id"].dataType).alias("parent_id"), "top", "first", "last", F.lit(True).alias("on_cycle"))
    return cut(found.join(_side(looped.select("folder_id"), n), "folder_id", "left_anti").unionByName(shared))


def subtree(folders: DataFrame, root) -> DataFrame:
    """folder_id of everything at or under a folder."""
    pairs = _pairs(folders)
    if pairs is not None:
        return pairs.where(F.col("ancestor") == root).select("folder_id")
    known = cut(intervals(folders))
    own = known.where(F.col("folder_id") == root).select(F.col("top").alias("top_"), F.col("first").alias("first_"), F.col("last").alias("last_")).distinct()  # a row
    return known.join(F.broadcast(own), (F.col("top") == F.col("top_")) & F.col("first").between(F.col("first_"), F.col("last_")), "left_semi").select("folder_id")


def items_in_subtree(items: DataFrame, memberships: DataFrame, folders: DataFrame, root) -> DataFrame:
    inside = memberships.join(subtree(folders, root), "folder_id", "left_semi")
    return items.join(inside, "item_id", "left_semi")


def subtree_counts(folders: DataFrame, memberships: DataFrame) -> DataFrame:
    """Distinct items at or under each folder; an item may be in several.

    What pairs make of the memberships is counted first, and dealt to as many tasks as that needs.
    """
    pairs = _pairs(folders)
    if pairs is None:
        return _counts_by_intervals(folders, memberships)
    memberships = cut(memberships.select("item_id", "folder_id"))
    above = pairs.groupBy("folder_id").agg(F.count(F.lit(1)).alias("above_"))
    total = memberships.groupBy("folder_id").agg(F.count(F.lit(1)).alias("n_")).join(above, "folder_id").agg(F.coalesce(F.sum(F.col("n_") * F.col("above_")), F.lit(0)).alias("n")).first()["n"]
    width = max(1, -(-total // TASK_ROWS))
    dealt = memberships.repartition(width, "item_id", "folder_id")
    reach = pairs.select(F.col("ancestor").alias("top"), "folder_id").join(dealt, "folder_id").select("top", "item_id").repartition(width, "top", "item_id").distinct()
    counts = reach.groupBy(F.col("top").alias("folder_id")).agg(F.count(F.lit(1)).alias("n_items"))
    return folders.select("folder_id").join(counts, "folder_id", "left").select("folder_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def _counts_by_intervals(folders: DataFrame, memberships: DataFrame) -> DataFrame:
    """The same by sums over intervals.

    An item counts once for each of its places in a tree, in preorder, and is taken off where two neighbouring places meet:
    at their lowest common ancestor. So a subtree with m of its places takes off m - 1, and sums over intervals are counts
    of distinct items; no item is paired with its folders' ancestors.
    """
    known, n = cut(intervals(folders)), folders.count()
    at = memberships.join(_side(known.select("folder_id", "top", "first"), n), "folder_id").select("item_id", "top", "first").distinct()
    # items are many and have few places each; a hot one goes by chunks as any other group
    keyed = at.withColumn("of_", F.struct("item_id", "top"))
    paired = chunks.Ordered(keyed, "of_", "first").with_folds(before_=chunks.lag(F.col("first"))).rows().select("top", "first", F.col("before_.v").alias("before"))
    paired = cut(paired.groupBy("top", "first", "before").agg(F.count(F.lit(1)).alias("n")))
    met = _common_ancestors(known, paired.where("before IS NOT NULL"), n)
    gains = paired.groupBy("top", "first").agg(F.sum("n").alias("gain")).unionByName(met.groupBy("top", "first").agg((-F.sum("n")).alias("gain"))).groupBy("top", "first").agg(F.sum("gain").alias("gain"))
    places = known.select("top", "first").distinct().join(_side(gains, n), ["top", "first"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    summed = cut(chunks.Ordered(places, "top", "first").with_folds(to_=chunks.running_sum(F.col("gain"))).rows())
    ends = summed.select("top", F.col("first").alias("last"), F.col("to_").alias("end_"))
    begins = summed.select("top", "first", (F.col("to_") - F.col("gain")).alias("begin_"))
    totals = known.join(_side(ends, n), ["top", "last"]).join(_side(begins, n), ["top", "first"])
    return totals.select("folder_id", (F.col("end_") - F.col("begin_")).cast("long").alias("n_items"))


def _common_ancestors(known: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """pairs (top, first, before, n) with first replaced by the number of the lowest ancestor of both places.

    From the greater of two places, reach shrinks by halves: a step up is taken if it does not yet contain the other.
    """
    tree = known.where("parent_id IS NOT NULL OR NOT on_cycle").unionByName(known.where("parent_id IS NULL AND on_cycle").withColumn("parent_id", F.lit(None)).dropDuplicates(["top", "first"]))
    numbers = tree.select(F.col("folder_id").alias("parent_id"), F.col("first").alias("up"), F.col("first").alias("low_"), F.col("last").alias("high_"))
    cycle_numbers = known.where("on_cycle").select(F.col("folder_id").alias("parent_id"), F.col("first").alias("up"), F.col("first").alias("low_"), F.col("last").alias("high_"))
    numbers = numbers.unionByName(cycle_numbers).dropDuplicates(["parent_id"])
    one = cut(tree.join(_side(numbers, n), "parent_id", "left").select("top", "first", "last", "up", "high_"))
    reach = [one.select("top", "first", "up", "high_")]
    while not reach[-1].where("up IS NOT NULL").isEmpty():
        step = reach[-1].select("top", F.col("first").alias("up"), F.col("up").alias("next_"), F.col("high_").alias("next_high_"))
        reach.append(cut(reach[-1].join(_side(step, n), ["top", "up"], "left").select("top", "first", F.col("next_").alias("up"), F.col("next_high_").alias("high_"))))
    own = one.select("top", "first", "last")
    at = pairs.join(_side(own, n), ["top", "first"]).select("top", "first", "last", "before", "n")
    holds = lambda low, high: (low <= F.col("before")) & (F.col("before") <= high)
    for step in reversed(reach[:-1]):
        met = at.join(_side(step, n), ["top", "first"], "left")
        goes = F.col("up").isNotNull() & ~holds(F.col("up"), F.col("high_"))
        at = met.select("top", F.when(goes, F.col("up")).otherwise(F.col("first")).alias("first"), F.when(goes, F.col("high_")).otherwise(F.col("last")).alias("last"), "before", "n")
    last = at.join(_side(reach[0], n), ["top", "first"], "left")
    return cut(last.select("top", F.when(holds(F.col("first"), F.col("last")), F.col("first")).otherwise(F.col("up")).alias("first"), "n"))


def closure(folders: DataFrame, most: float = float("inf")) -> DataFrame | None:
    """ancestor, folder_id and depth of every pair, itself at depth 0; in a cycle each pair has its least depth.

    Paths double their reach in each round. None once there are more than most pairs.
    """
    live = folders.select(F.col("folder_id").alias("parent_id"))
    edges = folders.join(live, "parent_id", "left_semi").select(F.col("parent_id").alias("ancestor"), "folder_id", F.lit(1).alias("depth")).where("ancestor <> folder_id")
    own = folders.select(F.col("folder_id").alias("ancestor"), "folder_id", F.lit(0).alias("depth"))
    known = cut(own.unionByName(edges).distinct())
    size = known.count()
    while size <= most:
        step = known.select(F.col("folder_id").alias("middle"), F.col("ancestor").alias("top"), F.col("depth").alias("above"))
        longer = known.join(step, F.col("ancestor") == F.col("middle")).select(F.col("top").alias("ancestor"), "folder_id", (F.col("depth") + F.col("above")).alias("depth"))
        known = cut(known.unionByName(longer).groupBy("ancestor", "folder_id").agg(F.min("depth").alias("depth")))
        now = known.count()
        if now == size:
            return known
        size = now
    return None


def _pairs(folders: DataFrame) -> DataFrame | None:
    """The closure of a flat forest; None for one whose closure is not of the order of its folders."""
    return closure(folders, WIDE * folders.count())


def nearest_assignment(folders: DataFrame, assignments: DataFrame, templates: DataFrame) -> DataFrame:
    """template_id of the nearest ancestor whose assigned template exists, and how many nearer ones dangle. A folder has one assignment at most."""
    pairs = _pairs(folders)
    if pairs is None:
        return _nearest_by_pointers(folders, assignments, templates)
    live = assignments.join(templates.select("template_id", F.lit(True).alias("live")), "template_id", "left")
    met = pairs.join(live.withColumnRenamed("folder_id", "ancestor"), "ancestor")
    found = met.groupBy("folder_id").agg(
        F.min_by(F.when(F.col("live"), F.col("template_id")), F.when(F.col("live"), F.col("depth"))).alias("template_id"),
        F.min(F.when(F.col("live"), F.col("depth"))).alias("depth"),
        F.array_sort(F.collect_list(F.when(F.col("live").isNull(), F.col("depth")))).alias("dead"),
    )
    dangling = F.size(F.filter("dead", lambda d: F.col("depth").isNull() | (d < F.col("depth"))))
    return folders.select("folder_id").join(found, "folder_id", "left").select("folder_id", "template_id", F.coalesce(dangling, F.lit(0)).cast("long").alias("n_dangling"))


def _nearest_by_pointers(folders: DataFrame, assignments: DataFrame, templates: DataFrame) -> DataFrame:
    """The same as the reach of pointers doubles: a folder keeps what it found, else takes what its pointer found and adds up
    what dangles. A way that ends in a cycle goes round it once.
    """
    n = folders.count()
    live = assignments.join(templates.select("template_id", F.lit(True).alias("live")).distinct(), "template_id", "left")
    held = live.groupBy("folder_id").agg(F.min(F.when(F.col("live"), F.col("template_id"))).alias("template_id"), F.count_if(F.col("live").isNull()).alias("dead"))
    parents = _parents(folders)
    climbed = _climbed(parents, n)
    on_cycle = climbed.where("up IS NOT NULL").select(F.col("up").alias("folder_id"), F.lit(True).alias("loop_")).distinct()
    start = parents.join(_side(on_cycle, n), "folder_id", "left").join(_side(held, n), "folder_id", "left").select("folder_id", "parent_id", F.coalesce("loop_", F.lit(False)).alias("loop_"), "template_id", F.coalesce("dead", F.lit(0)).alias("dead"))
    start = cut(start)
    round_trip = _once_round(start.where("loop_"), n)
    inside = start.where("NOT loop_").select("folder_id", F.col("parent_id").alias("up"), "template_id", "dead")
    state = cut(inside.unionByName(round_trip.select("folder_id", F.lit(None).cast(folders.schema["parent_id"].dataType).alias("up"), "template_id", "dead")))
    while not state.where("up IS NOT NULL AND template_id IS NULL").isEmpty():
        above = state.select(F.col("folder_id").alias("up"), F.col("up").alias("next_"), F.col("template_id").alias("template_"), F.col("dead").alias("dead_"))
        met = state.join(_side(above, n), "up", "left")
        open_ = F.col("template_id").isNull()
        state = cut(met.select("folder_id", F.when(open_, F.col("next_")).alias("up"), F.coalesce("template_id", "template_").alias("template_id"), (F.col("dead") + F.when(open_, F.coalesce("dead_", F.lit(0))).otherwise(0)).alias("dead")))
    return state.select("folder_id", "template_id", F.col("dead").cast("long").alias("n_dangling"))


def _once_round(loops: DataFrame, n: int) -> DataFrame:
    """template_id and dead of folders of cycles: what each finds first on its way round, and what dangles until then."""
    if loops.isEmpty():
        return loops.select("folder_id", "template_id", "dead")
    # cut each cycle behind its least folder and write it twice in a row; then a way round is a stretch of a line
    ranked = _climbed(loops.select("folder_id", "parent_id"), n).select("folder_id", F.col("low").alias("loop"))
    line = loops.join(_side(ranked, n), "folder_id")
    line = line.withColumn("up", F.when(F.col("parent_id") != F.col("loop"), F.col("parent_id")))
    steps = cut(line.select("folder_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    while not steps.where("up IS NOT NULL").isEmpty():
        above = steps.select(F.col("folder_id").alias("up"), F.col("up").alias("next_"), F.col("steps").alias("steps_"))
        steps = cut(steps.join(_side(above, n), "up", "left").select("folder_id", F.col("next_").alias("up"), (F.col("steps") + F.coalesce("steps_", F.lit(0))).alias("steps")))
    size = F.count(F.lit(1)).alias("size")
    sizes = line.groupBy("loop").agg(size)
    placed = line.join(_side(steps.select("folder_id", "steps"), n), "folder_id").join(_side(sizes, n), "loop")
    # on the way up numbers fall: a folder's way is its own number and the size - 1 below it, read downwards from the second copy
    twice = placed.withColumn("copy_", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at_", -(F.col("steps") + F.col("copy_") * F.col("size")))
    folded = chunks.Ordered(twice.select("folder_id", "loop", "copy_", "size", "at_", "template_id", "dead"), "loop", "at_").with_folds(
        sum_=chunks.running_sum(F.col("dead")), next_=chunks.following(F.when(F.col("template_id").isNotNull(), F.struct("at_", "template_id")))
    )
    rows = cut(folded.rows())
    sums = rows.select(F.col("loop").alias("loop_"), F.col("at_").alias("end_"), F.col("sum_").alias("end_sum_"))
    near = rows.where("copy_ = 1").withColumn("hit_", F.when(F.col("template_id").isNotNull(), F.struct("at_", "template_id")).when(F.col("next_.at_") < F.col("at_") + F.col("size"), F.col("next_")))
    near = near.withColumn("stop_", F.coalesce(F.col("hit_.at_"), F.col("at_") + F.col("size") - 1))
    met = near.join(_side(sums, 2 * n), (F.col("loop") == F.col("loop_")) & (F.col("stop_") == F.col("end_")))
    return met.select("folder_id", F.col("hit_.template_id").alias("template_id"), (F.col("end_sum_") - F.col("sum_") + F.col("dead")).alias("dead"))


def would_cycle(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """For moves (folder_id, new_parent): whether the new parent is at or under the folder."""
    pairs = _pairs(folders)
    if pairs is not None:
        below = pairs.select(F.col("ancestor").alias("folder_id"), F.col("folder_id").alias("new_parent"), F.lit(True).alias("cycle"))
        return moves.join(below, ["folder_id", "new_parent"], "left").select("folder_id", "new_parent", F.coalesce("cycle", F.lit(False)).alias("cycle"))
    known, n = cut(intervals(folders)), folders.count()
    whole = known.select("folder_id", F.col("top").alias("top_"), F.col("first").alias("first_"), F.col("last").alias("last_"))
    inner = known.select(F.col("folder_id").alias("new_parent"), F.col("top").alias("in_top_"), F.col("first").alias("in_first_"))
    met = moves.join(_side(whole, n), "folder_id", "left").join(_side(inner, n), "new_parent", "left")
    under = (F.col("top_") == F.col("in_top_")) & F.col("in_first_").between(F.col("first_"), F.col("last_"))
    return met.select("folder_id", "new_parent", F.coalesce(under, F.lit(False)).alias("cycle"))


def next_sort_order(folders: DataFrame) -> DataFrame:
    return folders.groupBy("parent_id").agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).cast("long").alias("next_order"))
