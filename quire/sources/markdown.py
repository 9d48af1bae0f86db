"""Notes as Markdown: front matter, blocks and headers, parsed in batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FRONT = "id string, kind string, title string, authors array<string>, date string, date_precision string, quality int, tags array<string>, unknown array<struct<key:string,value:string>>, body string, error string"
BLOCK = "array<struct<kind:string,link:string,display:string,page:int,unknown:array<struct<key:string,value:string>>,markdown:string>>"
KNOWN = ("id", "kind", "title", "authors", "date", "date_precision", "quality", "tags")
BLOCK_KEYS = ("link", "display", "page")
MARK = re.compile(r"^<!-- block:(\S+)(.*?)-->[ \t]*\n?", re.M | re.S)


def _scalar(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    return text[1:-1].replace("''", "'") if len(text) > 1 and text[0] == text[-1] == "'" else text


def _flow(text: str) -> list[str]:
    return [_scalar(x) for x in re.findall(r'\s*("(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|[^,\[\]]+)', text.strip()[1:-1]) if x.strip()]


def decode_front_matter(text: str) -> dict:
    """Fields of a note, its unknown keys verbatim and in order, and its body; an error instead where it has no header or id."""
    out = dict.fromkeys([*KNOWN, "unknown", "body", "error"])
    head = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)(.*)", text or "", re.S)
    if not head:
        return out | {"error": "no front matter", "body": text}
    found: dict[str, list[str]] = {}
    for line in head[1].split("\n"):
        key = re.match(r"([A-Za-z_][\w-]*):(.*)$", line)
        if key:
            found[key[1]] = [key[2]]
        elif found and line.strip():
            found[next(reversed(found))].append(line)
    unknown = []
    for key, (first, *rest) in found.items():
        if key not in KNOWN:
            unknown.append({"key": key, "value": "\n".join([first.strip(), *rest]).strip("\n")})
        elif key in ("authors", "tags"):
            items = [_scalar(x.strip()[1:]) for x in rest if x.strip().startswith("-")]
            out[key] = _flow(first) if first.strip().startswith("[") else items or ([_scalar(first)] if first.strip() else [])
        elif key == "quality":
            out[key] = int(first) if first.strip().lstrip("-").isdigit() else None
        else:
            out[key] = _scalar(first) or None
    return out | {"unknown": unknown, "body": head[2], "error": None if out["id"] else "missing id"}


def encode_front_matter(fields: dict) -> str:
    """The note as text again: known keys in their order, then unknown ones verbatim."""
    lines = []
    for key in KNOWN:
        value = fields.get(key)
        if value is None:
            continue
        lines.append(f"{key}: [{', '.join(json.dumps(x, ensure_ascii=False) for x in value)}]" if isinstance(value, (list, tuple)) else f"{key}: {value if key == 'quality' else json.dumps(value, ensure_ascii=False)}")
    lines += [f"{u['key']}: {u['value']}" for u in fields.get("unknown") or []]
    return "---\n" + "\n".join(lines) + "\n---\n" + (fields.get("body") or "")


def parse_blocks(body: str) -> list[dict]:
    """Blocks of a note's body; text before the first mark is a freeform block; unknown fields keep their order."""
    marks = list(MARK.finditer(body or ""))
    blocks = []
    lead = body[: marks[0].start()] if marks else body or ""
    if lead.strip() or not marks:
        blocks.append({"kind": "freeform", "link": None, "display": None, "page": None, "unknown": [], "markdown": lead})
    for i, m in enumerate(marks):
        pairs = [(k, _scalar(v)) for k, v in re.findall(r'([\w-]+)=("(?:[^"\\]|\\.)*"|\S+)', m[2])]
        known = dict(p for p in pairs if p[0] in BLOCK_KEYS)
        page = known.get("page", "")
        end = marks[i + 1].start() if i + 1 < len(marks) else len(body)
        blocks.append({"kind": m[1], "link": known.get("link"), "display": known.get("display"), "page": int(page) if page.isdigit() else None, "unknown": [{"key": k, "value": v} for k, v in pairs if k not in BLOCK_KEYS], "markdown": body[m.end() : end]})
    return blocks


def serialize_blocks(blocks: list[dict]) -> str:
    out = []
    for b in blocks:
        pairs = [(k, b[k]) for k in BLOCK_KEYS if b.get(k) is not None] + [(u["key"], u["value"]) for u in b["unknown"]]
        head = "" if b["kind"] == "freeform" and not pairs and not out else f"<!-- block:{b['kind']}" + "".join(f" {k}={v if k == 'page' else json.dumps(v, ensure_ascii=False)}" for k, v in pairs) + " -->\n"
        out.append(head + b["markdown"])
    return "".join(out)


HEADER = re.compile(
    r"Extracted text\.[^\n]*(?:\n|\Z)"  # the opening line
    r"(?:(?![ \t]*(?:\n|\Z))(?![^\n]* \u00b7 )(?![ \t]*Classification:)[^\n]+\n)*"  # a file name, before the line of the model
    r"(?:[^\n]* \u00b7 [^\n]*(?:\n|\Z))?(?:[ \t]*Classification:[^\n]*(?:\n|\Z))?"
)


def strip_header(page: str) -> str:
    """A text page without its header: the opening mark, a file name, the model's line and the classification."""
    found = HEADER.match(page or "")
    return page[found.end() :].strip() if found else page or ""


def _front_matter(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_front_matter(t) for t in text], columns=[*KNOWN, "unknown", "body", "error"])


def _blocks(body: pd.Series) -> pd.Series:
    return body.map(parse_blocks)


def front_matter(text: Column | str) -> Column:
    """The fields of a note."""
    return F.pandas_udf(_front_matter, FRONT)(text)


def blocks(body: Column | str) -> Column:
    """The blocks of a note's body."""
    return F.pandas_udf(_blocks, BLOCK)(body)


def stripped(page: Column | str) -> Column:
    """strip_header() by built-in functions."""
    body = F.coalesce(F.col(page) if isinstance(page, str) else page, F.lit(""))
    pattern = "^" + HEADER.pattern
    return F.when(body.rlike(pattern), F.regexp_replace(F.regexp_replace(body, pattern, ""), "^\\s+|\\s+$", "")).otherwise(body)
