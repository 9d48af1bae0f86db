"""Durable links and reference managers' records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes of links to files and to notes; parameters, as each installation has its own.
SCHEMES = ("reader", "notes")
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def reader_link(root: Column, rel: Column, page: Column, scheme: str = SCHEMES[0]) -> Column:
    base = F.concat(F.lit(f"{scheme}://reveal?root="), F.lower(root), F.lit("&rel="), F.replace(F.url_encode(rel), F.lit("+"), F.lit("%20")))
    return F.when(page.isNull(), base).otherwise(F.concat(base, F.lit("&page="), page.cast("string")))


def _argument(url: Column, name: str) -> Column:
    raw = F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1)
    return F.when(raw != "", F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def parse_link(url: Column, schemes: tuple[str, str] = SCHEMES) -> Column:
    """struct(kind, root, rel, page, id, block); null for anything malformed."""
    reader, notes = schemes
    root, rel, note = _argument(url, "root"), _argument(url, "rel"), _argument(url, "id")
    page = _argument(url, "page").try_cast("int")
    clean = rel.isNotNull() & ~rel.startswith("/") & ~F.exists(F.split(rel, "/"), lambda c: c.isin("", ".", ".."))
    block = F.nullif(F.regexp_extract(url, "#block-([0-9]+)$", 1), F.lit("")).try_cast("int")
    none = F.lit(None)
    made = lambda kind, **v: F.struct(F.lit(kind).alias("kind"), *(v.get(n, none).cast(t).alias(n) for n, t in (("root", "string"), ("rel", "string"), ("page", "int"), ("id", "string"), ("block", "int"))))
    is_reader = url.startswith(f"{reader}://reveal?") & F.coalesce(root.rlike(UUID), F.lit(False)) & clean
    is_note = url.startswith(f"{notes}://open?") & F.coalesce(note.rlike(UUID), F.lit(False))
    return F.when(is_reader, made("reader", root=F.lower(root), rel=rel, page=F.when(page > 0, page))).when(is_note, made("note", id=F.lower(note), block=block))


def parse_select_link(url: Column) -> Column:
    """struct(library, group, key) of a reference manager's select link; null for any other."""
    own, group = "^zotero://select/library/items/([A-Z0-9]{8})$", "^zotero://select/groups/([0-9]+)/items/([A-Z0-9]{8})$"
    made = lambda library, g, key: F.struct(F.lit(library).alias("library"), g.alias("group"), key.alias("key"))
    return F.when(url.rlike(own), made("user", F.lit(None).cast("string"), F.regexp_extract(url, own, 1))).when(url.rlike(group), made("group", F.regexp_extract(url, group, 1), F.regexp_extract(url, group, 2)))


def csl_date(record: Column) -> Column:
    """struct(date, precision) of a CSL record's JSON: the first date parts, else the first four digits of the raw date."""
    part = lambda i: F.get_json_object(record, f"$.issued.date-parts[0][{i}]").try_cast("int")
    year, month, day = part(0), part(1), part(2)
    raw = F.nullif(F.regexp_extract(F.get_json_object(record, "$.issued.raw"), "([0-9]{4})", 1), F.lit(""))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    made = lambda text, precision: F.struct(text.alias("date"), F.lit(precision).alias("precision"))
    return (
        F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), made(F.concat_ws("-", year.cast("string"), two(month), two(day)), "day"))
        .when(year.isNotNull() & month.isNotNull(), made(F.concat_ws("-", year.cast("string"), two(month)), "month"))
        .when(year.isNotNull(), made(year.cast("string"), "year"))
        .when(raw.isNotNull(), made(raw, "year"))
    )


def csl_authors(record: Column) -> Column:
    """`Family, Given` of each author, or its literal name."""
    people = F.from_json(F.get_json_object(record, "$.author"), "array<struct<family:string,given:string,literal:string>>")
    return F.array_compact(F.transform(people, lambda p: F.coalesce(p["literal"], F.nullif(F.concat_ws(", ", p["family"], p["given"]), F.lit("")))))
