"""Typed headers of notes: all fourteen keys of the header's subset of YAML, nested references, and what is unknown kept as it was.

A header is read in two steps: its lines into sections (a key, the value beside it and the indented lines below), and each
section by its key's type. Written again and read again, a header is the same.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = "select_link string, item_key string, library string, kind string, parent_key string, citation string, fetched_at timestamp, unknown array<string>"
HEADER = f"""schema int, id string, kind string, title string, authors array<string>, date string, date_precision string, date_uncertain boolean, quality int,
tags array<string>, roundup boolean, zotero array<struct<{REFERENCE}>>, created timestamp, modified timestamp, unknown array<string>, body string, error string"""
UTC = datetime.timezone.utc
# Names of a reference's fields in the file, by those of the table.
REFERENCE_KEYS = {"select_link": "selectLink", "item_key": "itemKey", "library": "library", "kind": "kind", "parent_key": "parentKey", "citation": "citation", "fetched_at": "fetchedAt"}


def scalar(text: str) -> str:
    """A plain or quoted value; double quotes may escape, single ones are doubled."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text, strict=False)
        except ValueError:
            return text[1:-1]
    return text[1:-1].replace("''", "'") if len(text) > 1 and text[0] == text[-1] == "'" else text


def elements(text: str) -> list[str]:
    """Values of a list in brackets, at commas outside of quotes."""
    found, held, quote, escaped = [], "", "", False
    for c in text.strip()[1:-1]:
        if quote:
            quote, escaped = ("" if c == quote and not escaped else quote), c == "\\" and quote == '"' and not escaped
        elif c in "\"'" and not held.strip():
            quote = c
        elif c == ",":
            found, held = [*found, held], ""
            continue
        held += c
    return [scalar(x) for x in [*found, held] if x.strip()]


def whole_number(text: str) -> int | None:
    try:
        return int(text)
    except ValueError:
        return None


def instant(text: str) -> datetime.datetime | None:
    """An ISO time; one without a zone is UTC, other texts are no time."""
    try:
        said = datetime.datetime.fromisoformat(scalar(text))
    except ValueError:
        return None
    return said.replace(tzinfo=UTC) if said.tzinfo is None else said.astimezone(UTC)


def truth(text: str) -> bool:
    return scalar(text).lower() in ("true", "yes")


def sections(lines: list[str]) -> Iterator[tuple[str, str, list[str]]]:
    """key, the value beside it and the indented lines below it; lines of no section are left out."""
    now: tuple[str, str, list[str]] | None = None
    for line in lines:
        if line[:1] in (" ", "\t"):
            if now and line.strip():
                now[2].append(line)
            continue
        key, colon, value = line.partition(":")
        if colon and key and " " not in key:
            if now:
                yield now
            now = (key, value.strip(), [])
    if now:
        yield now


def listed(value: str, below: list[str]) -> list[str]:
    if value.startswith("[") and value.endswith("]"):
        return elements(value)
    return [scalar(value)] if value else [scalar(x.strip()[1:]) for x in below if x.strip()[:1] == "-"]


def references(value: str, below: list[str]) -> list[dict]:
    """Items that begin with a dash, each of further keys; lines of other keys stay as they are."""
    names, found = {v: k for k, v in REFERENCE_KEYS.items()}, []
    for line in below:
        text = line.strip()
        if text[:2] == "- " or text == "-":
            found.append(dict.fromkeys(REFERENCE_KEYS) | {"unknown": []})
            text = text[1:].strip()
        key, colon, said = text.partition(":")
        if not found or not text:
            continue
        if colon and key in names:
            found[-1][names[key]] = instant(said) if key == "fetchedAt" else scalar(said)
        else:
            found[-1]["unknown"].append(text)
    return found


#: Each key's reader of (value, lines below), in the order in which keys are written.
READERS = {
    "schema": lambda v, _: whole_number(v) or 1, "id": lambda v, _: scalar(v) or None, "kind": lambda v, _: scalar(v), "title": lambda v, _: scalar(v), "authors": listed, "date": lambda v, _: scalar(v), "date_precision": lambda v, _: scalar(v),
    "date_uncertain": lambda v, _: truth(v), "quality": lambda v, _: whole_number(v), "tags": listed, "roundup": lambda v, _: truth(v), "zotero": references, "created": lambda v, _: instant(v), "modified": lambda v, _: instant(v),
}
BLANK = dict.fromkeys([*READERS, "body", "error"]) | {"schema": 1, "authors": [], "date_uncertain": False, "tags": [], "roundup": False, "zotero": [], "unknown": []}


def decode(text: str | None) -> dict:
    """The typed header and the body, verbatim; an error where there is no header, no end of one, or no id."""
    out = {k: list(v) if isinstance(v, list) else v for k, v in BLANK.items()}
    lines = (text or "").splitlines(keepends=True)
    fences = [i for i, line in enumerate(lines) if line.rstrip("\r\n") == "---"]
    if not fences or fences[0] != 0:
        return out | {"error": "no front matter", "body": text}
    if len(fences) < 2:
        return out | {"error": "unterminated front matter", "body": text}
    for key, value, below in sections([line.rstrip("\r\n") for line in lines[1 : fences[1]]]):
        if key in READERS:
            out[key] = READERS[key](value, below)
        else:
            out["unknown"].append("\n".join([f"{key}: {value}".rstrip(), *below]))
    return out | {"body": "".join(lines[fences[1] + 1 :]), "error": None if out["id"] else "missing id"}


def _written(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime.datetime):
        return value.astimezone(UTC).isoformat().replace("+00:00", "Z")
    return f"[{', '.join(map(_written, value))}]" if isinstance(value, list) else str(value) if isinstance(value, int) else json.dumps(value, ensure_ascii=False)


def encode(fields: dict) -> str:
    """The note as text: known keys in their order, what is null or an empty list left out, then unknown ones as they were."""
    lines = []
    for key in READERS:
        value = fields.get(key)
        if key == "zotero" and value:
            lines.append("zotero:")
            for item in value:
                said = [f"{name}: {_written(item[k])}" for k, name in REFERENCE_KEYS.items() if item.get(k) is not None] + list(item.get("unknown") or [])
                lines += [("  - " if i == 0 else "    ") + x for i, x in enumerate(said or [""])]
        elif value is not None and value != []:
            lines.append(f"{key}: {_written(value)}")
    return "\n".join(["---", *lines, *(fields.get("unknown") or []), "---"]) + "\n" + (fields.get("body") or "")


def header(text: Column | str) -> Column:
    """decode() as a struct of HEADER."""
    return F.pandas_udf(_header, HEADER)(text)


def again(text: Column | str) -> Column:
    """The note written anew from its header, null where it has none."""
    return F.pandas_udf(_again, "string")(text)


def _header(texts: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([decode(t) for t in texts], columns=[*READERS, "unknown", "body", "error"])
    for key in ("schema", "quality"):
        found[key] = found[key].astype("Int32")
    for key in ("created", "modified"):
        found[key] = pd.to_datetime(found[key], utc=True)
    return found


def _again(texts: pd.Series) -> pd.Series:
    read = (decode(t) for t in texts)
    return pd.Series([None if f["error"] else encode(f) for f in read], dtype=object)
