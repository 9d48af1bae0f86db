"""Text scalars: names, copied text, model responses, links and comparisons of words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that titles keep in lower case, and the tags of model responses.
SMALL_WORDS = "of the and in for to a an on at by".split()
CLASSES = {"box": "box.label", "folder": "folder.label", "start": "document.start", "continuation": "document.continuation"}
TURNS = (0, 90, 180, 270)


def capitalize_first_letters(text: Column) -> Column:
    """The first letter of each word up, all others as they are, empty words kept."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def collection_name(name: Column) -> Column:
    """Signs as words, single spaces, and title case with small words low but for the first."""
    text = F.trim(name)
    for sign, word in (("&", "and"), ("/", "and"), ("#", "Number "), ("@", "at")):
        text = F.replace(text, F.lit(sign), F.lit(word))
    parts = F.split(F.regexp_replace(text, " {2,}", " "), " ")

    def case(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.when((i > 0) & low.isin(*SMALL_WORDS), low).otherwise(F.concat(F.upper(F.left(low, F.lit(1))), F.substring(low, 2, 1 << 30)))

    return F.trim(F.array_join(F.transform(parts, case), " "))


def candidate_name(label: Column, fallback: str = "Untitled") -> Column:
    """The first line of a box label with any text, at most 80 characters, safe as a file name."""
    lines = F.filter(F.transform(F.split(F.coalesce(label, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    safe = F.trim(F.translate(F.left(F.get(lines, F.lit(0)), F.lit(80)), "/:", "--"))
    return F.when(safe.isNull() | safe.rlike("^\\.*$"), F.lit(fallback)).otherwise(safe)


def clean_copied(text: Column, hyphens: bool = True, collapse: bool = True, paragraphs: bool = True) -> Column:
    """Copied text: lines trimmed, blank runs part paragraphs, split words rejoined, single breaks made spaces."""
    t = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "(?m)^[ \\t]+|[ \\t]+$", "")
    t = F.regexp_replace(t, "^\\n+|\\n+$", "")
    t = F.regexp_replace(t, "\\n{2,}", "\u0000")
    if hyphens:
        t = F.regexp_replace(t, "(?<=\\p{L})-\\n(?=\\p{L})", "")
    if collapse:
        t = F.replace(t, F.lit("\n"), F.lit(" "))
    return F.replace(t, F.lit("\u0000"), F.lit("\n\n" if paragraphs else " " if collapse else "\n"))


def parse_response(raw: Column) -> Column:
    """struct(classification, rotation, text) of a model's response: tags in its first five lines, the rest its text."""
    lines = F.split(F.regexp_replace(raw, "^\\s+|\\s+$", ""), "\\r\\n|[\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029]")
    kind = lambda x: _case([(F.lower(x).rlike("\\[" + p.replace(".", "[_ ]") + "\\]"), name) for name, p in CLASSES.items()])
    turn = lambda x: _case([(F.lower(x).rlike(f"\\[rotate[_ ]{t}\\]"), t) for t in TURNS])
    start = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("turn"), F.lit(0).alias("first"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        line, n = x["line"], x["i"] + 1
        found = F.when(s["kind"].isNull(), kind(line))
        rotated = F.when(found.isNull(), turn(line))
        stop = rotated.isNotNull() | (found.isNull() & s["kind"].isNotNull() & (F.trim(line) != ""))
        new = F.struct(F.coalesce(s["kind"], found).alias("kind"), F.coalesce(rotated, s["turn"]).alias("turn"), F.when(found.isNotNull() | rotated.isNotNull(), n).otherwise(s["first"]).alias("first"), stop.alias("done"))
        return F.when(s["done"], s).otherwise(new)

    head = F.transform(F.slice(lines, 1, 5), lambda x, i: F.struct(x.alias("line"), i.alias("i")))

    def finish(s: Column) -> Column:
        rest = F.regexp_replace(F.array_join(F.slice(lines, s["first"] + 1, F.greatest(F.size(lines) - s["first"], F.lit(0))), "\n"), "^\\s+|\\s+$", "")
        return F.struct(s["kind"].alias("classification"), s["turn"].alias("rotation"), F.when(rest != "", rest).alias("text"))

    return F.aggregate(head, start, step, finish)


def _case(pairs: list) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def response_json(raw: Column) -> Column:
    """The outermost braces of a response, without a code fence around them."""
    return F.regexp_extract(raw, "(?s)(\\{.*\\})", 1)


def parse_tag_response(raw: Column) -> Column:
    """struct of year, month, day, uncertainty, subjects and format from a response's JSON; undated and uncertain where it has none."""
    from quire.functions.dates import day_number, month_number, month_tag

    text = response_json(raw)
    fields = F.from_json(text, "map<string,string>")
    lists = F.from_json(text, "subject_tags array<string>")
    field = lambda name: F.nullif(F.trim(F.get_json_object(text, f"$.{name}")), F.lit(""))
    whole = lambda c: F.regexp_replace(c, "^(-?[0-9]+)\\.[0-9]+$", "$1")
    month, day = whole(field("month")), whole(field("day"))
    ok = fields.isNotNull() & (F.size(fields) > 0)
    return F.struct(
        whole(field("year")).alias("year"),
        F.coalesce(month_tag(month_number(month)), month).alias("month"),
        F.coalesce(F.concat(F.lit("Day "), day_number(day)), day).alias("day"),
        F.when(ok, F.coalesce(field("date_uncertain") == "true", F.lit(False))).otherwise(True).alias("date_uncertain"),
        F.slice(F.coalesce(lists["subject_tags"], F.array().cast("array<string>")), 1, 6).alias("subject_tags"),
        field("format").alias("format"),
    )


def all_tags(year: Column, month: Column, day: Column, uncertain: Column, subjects: Column, form: Column, failed: Column) -> Column:
    """A document's tags in their order; one mark only where the text could not be read."""
    made = F.concat(F.array_compact(F.array(year, month, day, F.when(uncertain, "Date Uncertain"))), subjects, F.array_compact(F.array(form)))
    return F.when(failed, F.array(F.lit("OCR Failed"))).otherwise(made)


def title_of(markdown: Column, most: int = 60) -> Column:
    """The first line with text, without Markdown marks, cut at a word where it is too long."""
    lines = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), _plain), lambda x: x != "")
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    short = F.regexp_replace(F.left(line, F.lit(most)), "\\s+\\S*$", "")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(short, F.lit("…")))


def _plain(line: Column) -> Column:
    t = F.regexp_replace(F.trim(line), "^(#{1,6}\\s+|>\\s*|[-*+]\\s+(\\[[ xX]\\]\\s+)?|[0-9]+[.)]\\s+)+", "")
    t = F.regexp_replace(t, "!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    return F.trim(F.regexp_replace(t, "(\\*\\*|__|~~|`|(?<![\\p{L}\\p{N}])[*_]|[*_](?![\\p{L}\\p{N}]))", ""))


def image_references(markdown: Column) -> Column:
    """structs (alt, target) of a Markdown text's images, escapes undone."""
    found = F.regexp_extract_all(markdown, F.lit("(!\\[(?:[^\\]\\\\]|\\\\.)*\\]\\((?:[^)\\\\]|\\\\.)*\\))"), F.lit(1))
    undo = lambda c: F.regexp_replace(c, "\\\\(.)", "$1")
    return F.transform(found, lambda m: F.struct(undo(F.regexp_extract(m, "^!\\[((?:[^\\]\\\\]|\\\\.)*)\\]", 1)).alias("alt"), undo(F.regexp_extract(m, "\\]\\(((?:[^)\\\\]|\\\\.)*)\\)$", 1)).alias("target")))


def image_reference(alt: Column, target: Column) -> Column:
    return F.concat(F.lit("!["), F.regexp_replace(alt, "([\\[\\]\\\\])", "\\\\$1"), F.lit("]("), F.regexp_replace(target, "([()\\\\])", "\\\\$1"), F.lit(")"))


def backoff(attempt: Column, jitter: Column | float = 0.0, retry_after: Column | None = None) -> Column:
    """Seconds before the next attempt: doubled from 1.5 up to 30, up to half more by jitter, at least what was asked for, 60 at most."""
    base = F.least(F.lit(30.0), F.lit(1.5) * F.pow(F.lit(2.0), attempt - 1)) * (1 + F.lit(0.5) * (jitter if isinstance(jitter, Column) else F.lit(jitter)))
    return F.least(F.lit(60.0), base if retry_after is None else F.greatest(base, F.coalesce(retry_after, F.lit(0.0))))


def classification_line(text: Column) -> Column:
    """The first `Classification:` value of a text, null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, "(?m)^[ \\t]*Classification:[ \\t]*(.*?)[ \\t]*$", 1)), F.lit(""))


def word_diff(baseline: Column | str, other: Column | str) -> Column:
    """struct(similarity, missing, added, changed): words aligned by a longest common subsequence without regard to case."""
    return F.pandas_udf(_word_diff, "similarity double, missing int, added int, changed int")(baseline, other)


def _word_diff(baseline: pd.Series, other: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_compare(a or "", b or "") for a, b in zip(baseline, other)], columns=["similarity", "missing", "added", "changed"])


#: Words of a text whose rows are kept at once, for the way back.
KEPT = 256


def _rows(u: list[int], v: list[int]) -> Iterator[int]:
    """After each word of u, a number with a bit for each word of v: 0 where the longest common subsequence with the first words of v grows.

    Each word takes three operations on the row, of 64 words of v at a time.
    """
    masks: dict[int, int] = {}
    wanted = set(u)
    for j, y in enumerate(v):
        if y in wanted:
            masks.setdefault(y, []).append(j)
    for y, places in masks.items():
        bits = bytearray(places[-1] // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        masks[y] = bytes(bits)
    full = row = (1 << len(v)) - 1
    for x in u:
        if x in masks:
            hits = row & int.from_bytes(masks[x], "little")
            row = ((row + hits) | (row - hits)) & full
        yield row


def _lengths(u: list[int], v: list[int]):
    """For each k, the longest common subsequence of u and the first k of v."""
    import numpy as np

    *_, row = _rows(u, v)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(v) // 8 + 1, "little"), np.uint8), bitorder="little", count=len(v))
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _pairs(u: list[int], v: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in space that is linear in the lengths: u is halved, and v where both halves match most, until u is short."""
    import numpy as np

    found, waiting = [], [(0, len(u), 0, len(v))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and u[a] == v[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and u[b - 1] == v[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        if b - a <= KEPT:
            rows = list(_rows(u[a:b], v[c:d]))
            i, j = b - a - 1, d - c - 1
            while i >= 0 and j >= 0:
                if rows[i] >> j & 1:
                    j -= 1
                elif i and not rows[i - 1] >> j & 1:
                    i -= 1
                else:
                    found.append((a + i, c + j))
                    i, j = i - 1, j - 1
            continue
        half = (a + b) // 2
        cut = c + int(np.argmax(_lengths(u[a:half], v[c:d]) + _lengths(u[half:b][::-1], v[c:d][::-1])[::-1]))
        waiting += [(a, half, c, cut), (half, b, cut, d)]
    return sorted(found)


def _compare(a: str, b: str) -> tuple[float, int, int, int]:
    x, y = a.split(), b.split()
    if not x:
        return 1.0, 0, len(y), 0
    ids: dict[str, int] = {}
    u, v = ([ids.setdefault(w.lower(), len(ids)) for w in words] for words in (x, y))
    pairs = _pairs(u, v)
    return len(pairs) / len(x), len(x) - len(pairs), len(y) - len(pairs), sum(x[i] != y[j] for i, j in pairs)
