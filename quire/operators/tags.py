"""Tag arrays as multisets: equality, difference, and edits that keep every other token where it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = ("read", "unread")


def _count(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y == x))


def is_state(token: Column) -> Column:
    return F.lower(token).isin(*STATES)


def same_token(a: Column, b: Column) -> Column:
    """Exact, but for read states, whose case does not count."""
    return (a == b) | (is_state(a) & (F.lower(a) == F.lower(b)))


def multiset_equal(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def multiset_difference(a: Column, b: Column) -> Column:
    """a without as many of each token as b has: the later occurrences stay, in their order."""
    nth = lambda x, i: _count(F.slice(a, F.lit(1), i + 1), x)
    return F.filter(a, lambda x, i: nth(x, i) > _count(b, x))


def inverse(before: Column, after: Column) -> tuple[Column, Column]:
    """What has been removed and what has been added, with multiplicity."""
    return multiset_difference(before, after), multiset_difference(after, before)


def apply_delta(tags: Column, remove: Column, add: Column) -> Column:
    """(tags - remove) + add; every occurrence of a removed token goes, and a present one is not added again. No change: null."""
    kept = F.filter(tags, lambda t: ~F.exists(remove, lambda r: same_token(t, r)))
    new = F.filter(F.array_distinct(add), lambda t: ~F.exists(kept, lambda k: same_token(k, t)))
    out = F.concat(kept, new)
    return F.when(out == tags, F.lit(None)).otherwise(out)


def apply_occurrences(tags: Column, remove: Column, add: Column) -> Column:
    """The first occurrences of each token go, as many as remove has of it; then all of add follows."""
    kept = F.filter(tags, lambda t, i: _count(F.slice(tags, F.lit(1), i + 1), t) > _count(remove, t))
    return F.concat(kept, add)


def set_read_state(tags: Column, state: str, add_if_missing: bool = False) -> Column:
    """Both state words go and the given one is appended, if there was one or it may be added; null for no change."""
    has = F.exists(tags, is_state)
    out = F.concat(F.filter(tags, lambda t: ~is_state(t)), F.array(F.lit(state)))
    changed = F.when(out == tags, F.lit(None)).otherwise(out)
    return changed if add_if_missing else F.when(has, changed)


def rename(tags: Column, old: str, new: str) -> Column:
    """The token under its new name, in place; merged where the new name is there already. Null without the old one."""
    put = F.when(F.array_contains(tags, F.lit(new)), F.filter(tags, lambda t: t != old)).otherwise(F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t)))
    return F.when(F.array_contains(tags, F.lit(old)), put)


def project_managed(tags: Column, previous: Column, desired: Column) -> Column:
    """Managed tokens that are no longer desired go, missing ones follow; all others stay as often as they were."""
    dropped = F.array_except(previous, desired)
    kept = F.filter(tags, lambda t: ~F.array_contains(dropped, t))
    return F.concat(kept, F.filter(F.array_distinct(desired), lambda t: ~F.array_contains(tags, t)))


def set_year(tags: Column, year: Column) -> tuple[Column, Column]:
    """(remove, add) for a new year: all year and decade tokens go."""
    date = lambda t: t.rlike("^[0-9]{3,4}$") | t.rlike("^[0-9]{2,3}0s$")
    return F.filter(tags, lambda t: date(F.trim(t))), F.array(year.cast("string"))


def subject_delta(before: Column, after: Column) -> tuple[Column, Column]:
    """(remove, add) between subject lists, keyed on trimmed text."""
    trimmed = lambda a: F.transform(a, lambda t: F.trim(t))
    return F.filter(before, lambda t: ~F.array_contains(trimmed(after), F.trim(t))), F.filter(after, lambda t: ~F.array_contains(trimmed(before), F.trim(t)))


def reclassified(tags: Column, color: Column, structure: Column) -> Column:
    """One colour word and one structure word go, and the new ones stand first."""
    first = lambda a, words: F.array_position(F.transform(a, lambda t: t.isin(*words)), F.lit(True))
    without = lambda a, words: F.filter(a, lambda _, i: i + 1 != first(a, words))
    rest = without(without(tags, ("Red", "Purple")), ("Box", "Folder"))
    return F.concat(F.array_compact(F.array(color, structure)), rest)


def ordered_for_file(tags: Column, color: Column) -> Column:
    """Colour first, blanks dropped, and Unread once, last."""
    rest = F.filter(tags, lambda t: (F.trim(t) != "") & (F.lower(F.trim(t)) != "unread") & ~F.coalesce(t == color, F.lit(False)))
    return F.concat(F.array_compact(F.array(color)), rest, F.array(F.lit("Unread")))
