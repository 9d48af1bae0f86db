"""Relay objects: string maps with one canonical JSON, their kinds, names and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The escapes of canonical JSON that have a short form.
SHORT = {'"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def escape(text: Column) -> Column:
    """Backslash, quote and control characters escaped; everything else as it is."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in map(chr, range(0x20)):
        out = F.replace(out, F.lit(c), F.lit(SHORT.get(c, f"\\u{ord(c):04x}")))
    return F.replace(out, F.lit('"'), F.lit('\\"'))


def canonical_json(pairs: dict[str, Column]) -> Column:
    """Keys ascending, null values left out, no spaces."""
    each = [F.when(pairs[k].isNotNull(), F.concat(F.lit(f'"{k}":"'), escape(pairs[k].cast("string")), F.lit('"'))) for k in sorted(pairs)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*each)), ","), F.lit("}"))


def fingerprint(kind: Column, priority: Column, year: Column, month: Column, replaces: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of what matters to ingestion."""
    made = canonical_json({"type": kind, "priority": priority, "year": year, "month": month, "replaces": replaces})
    return F.left(F.sha2(F.encode(made, "UTF-8"), 256), F.lit(16))


def parse(body: Column) -> Column:
    """map<string,string>; bare numbers become strings; null for what is no object."""
    return F.from_json(body, "map<string,string>")


def classify(name: Column) -> Column:
    """The kind of an object by its name."""
    return (
        F.when(name == "_epoch.json", "epoch")
        .when(name == "_session.complete.json", "session-complete")
        .when(name.rlike("^.+\\.segment\\.json$"), "segment-complete")
        .when(name.rlike("^.+__[0-9]+\\.receipt\\.json$"), "receipt")
        .when(name.rlike("^.+__[0-9]+\\.json$"), "photo")
        .when(name.rlike("^.+__[0-9]+\\.(?i:jpe?g|png|heic|tiff?)$"), "media")
        .otherwise("other")
    )


def identity(name: Column) -> Column:
    """struct(group, seq) of a photo's or receipt's name."""
    found = "^(.+)__([0-9]+)\\.(?:receipt\\.)?[A-Za-z]+$"
    return F.when(name.rlike(found), F.struct(F.regexp_extract(name, found, 1).alias("group"), F.regexp_extract(name, found, 2).try_cast("int").alias("seq")))


def run_fingerprint(paths: Column, options: Column, ordered: bool = False) -> Column:
    """SHA-256 of a run's options and paths, sorted unless their order matters."""
    return F.sha2(F.concat_ws("\n", options, paths if ordered else F.array_sort(paths)), 256)
