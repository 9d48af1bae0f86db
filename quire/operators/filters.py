"""Filters as data: small specs compiled to predicates, combined, and read from tolerant JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def under(path: Column, folder: str) -> Column:
    """At or below a folder, at a component boundary; a literal prefix, never a pattern."""
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/") if folder else F.lit(True)


def contained(path: Column, folder: Column) -> Column:
    """Byte-wise containment of absolute paths without `.` or `..` components."""
    clean = lambda p: p.startswith("/") & ~F.exists(F.split(p, "/"), lambda c: c.isin(".", ".."))
    return clean(path) & clean(folder) & ((path == folder) | F.startswith(path, F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"))))


@dataclass(frozen=True)
class LibraryFilter:
    """AND of its facets; the default of each is no restriction."""

    folder: str = ""
    read_state: str = "all"  # all, read, unread or none
    priorities: tuple[int, ...] = ()
    subjects: tuple[str, ...] = ()
    match_all: bool = True
    name: str = ""
    needs_attention: bool = False

    def column(self) -> Column:
        out = under(F.col("path"), self.folder) if self.folder else F.lit(True)
        if self.read_state == "none":
            out &= F.col("read_state").isNull()
        elif self.read_state != "all":
            out &= F.coalesce(F.col("read_state") == self.read_state, F.lit(False))
        if self.priorities:
            out &= F.coalesce(F.col("priority").isin(*self.priorities), F.lit(False))
        if self.subjects:
            wanted = F.array(*map(F.lit, self.subjects))
            out &= F.size(F.array_except(wanted, F.col("subjects"))) == 0 if self.match_all else F.arrays_overlap(wanted, F.col("subjects"))
        if self.name.strip():
            out &= F.contains(F.lower("name"), F.lit(self.name.strip().lower()))
        if self.needs_attention:
            out &= ~F.col("readable") | ~F.col("has_text")
        return out

    def over(self, base: LibraryFilter) -> LibraryFilter:
        """This filter folded over a base: it wins where it says something; subjects unite, attention is either's."""
        return LibraryFilter(
            self.folder or base.folder,
            self.read_state if self.read_state != "all" else base.read_state,
            self.priorities or base.priorities,
            tuple(dict.fromkeys((*base.subjects, *self.subjects))),
            self.match_all if self.subjects else base.match_all,
            self.name or base.name,
            self.needs_attention or base.needs_attention,
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> LibraryFilter:
        """Missing and odd keys take their defaults."""
        try:
            found = json.loads(text)
        except ValueError:
            return cls()
        known = {f.name: f.default for f in fields(cls)}
        found = {k: v for k, v in found.items() if k in known and v is not None} if isinstance(found, dict) else {}
        return cls(**{k: tuple(v) if isinstance(known[k], tuple) else v for k, v in found.items()})

    def summary(self) -> str:
        """A short name for the filter."""
        said = [self.folder.rstrip("/").rsplit("/", 1)[-1], self.read_state if self.read_state != "all" else "", *(f"P{p}" for p in self.priorities), *self.subjects, f'"{self.name}"' if self.name else ""]
        return ", ".join(x for x in said if x) or "All files"


@dataclass(frozen=True)
class NotesFilter:
    """AND of kind, qualities, an inclusive range of sort dates (undated out once a bound is set), tags and title."""

    kind: str = ""
    qualities: tuple[int, ...] = ()
    date_from: int | None = None
    date_to: int | None = None
    tags: tuple[str, ...] = ()
    match_all: bool = True
    title: str = ""

    def column(self) -> Column:
        out = F.lit(True)
        if self.kind:
            out &= F.col("kind") == self.kind
        if self.qualities:
            out &= F.coalesce(F.col("quality").isin(*self.qualities), F.lit(False))
        if self.date_from is not None:
            out &= F.coalesce(F.col("sort_date") >= self.date_from, F.lit(False))
        if self.date_to is not None:
            out &= F.coalesce(F.col("sort_date") <= self.date_to, F.lit(False))
        if self.tags:
            wanted = F.array(*map(F.lit, self.tags))
            out &= F.size(F.array_except(wanted, F.col("tags"))) == 0 if self.match_all else F.arrays_overlap(wanted, F.col("tags"))
        if self.title.strip():
            out &= F.contains(F.lower("title"), F.lit(self.title.strip().lower()))
        return out


def in_folders(items: DataFrame, memberships: DataFrame, subtree: DataFrame) -> DataFrame:
    """Items with a membership in one of the folders of a subtree (column folder_id)."""
    return items.join(memberships.join(subtree, "folder_id", "left_semi"), "item_id", "left_semi")


def not_excluded(files: DataFrame, excluded: list[str]) -> DataFrame:
    """Files neither at nor under any excluded folder; excluded folders within others are dropped first."""
    tops = [f for f in excluded if not any(f != g and f.startswith(g.rstrip("/") + "/") for g in excluded)]
    keep = F.lit(True)
    for folder in dict.fromkeys(tops):
        keep &= ~under(F.col("path"), folder)
    return files.where(keep)


def format_status(readable: Column, has_text: Column) -> Column:
    return F.when(~readable, "unreadable").when(~has_text, "no_text_layer").otherwise("standard")


def is_safe_group(group: Column) -> Column:
    """At most 128 letters, digits, hyphens and underscores, which leaves no `..`."""
    return group.rlike("^[\\p{L}\\p{N}_-]{0,128}$")


def is_temporary_sibling(path: Column) -> Column:
    """The scratch file that an atomic save leaves beside its target."""
    return path.rlike("\\.sb-[0-9A-Fa-f]{8}-[A-Za-z0-9]{6}$")


def sanitized_scope(scope: Column, root: Column) -> Column:
    """A stored scope, dropped where it is outside the root."""
    return F.when((scope == root) | F.startswith(scope, F.concat(root, F.lit("/"))), scope)


def tracks_read_state(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: F.lower(t).isin("read", "unread")), F.lit(False))


def has_any_tag(tags: Column) -> Column:
    return F.coalesce(F.size(tags), F.lit(0)) > 0
