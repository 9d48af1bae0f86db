"""Ranked full-text search: BM25 over weighted columns, phrases, prefixes and fragments in context.

A query's words must all occur, in any of the columns. search() reads the rows themselves: statistics of the whole table
come from one aggregate, and each row is scored by itself, so no posting is shuffled. For repeated queries
quire.operators.textindex answers the same from a written index.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ranking import with_place
from quire.session import cut

K1, B, FLOOR = 1.2, 0.75, 1e-6
TOKEN = "[\\p{L}\\p{N}]+"
SNIPPETS, FRAGMENT = 300, 12
OPEN, CLOSE = "\x02", "\x03"


#: The combining marks that are dropped within words.
MARKS = "[\\u0300-\\u0331]"


@functools.cache
def _accents() -> tuple[str, str]:
    """Lower-case letters of all of Unicode's first plane that are a Latin letter with marks, and their bases."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0x80, 0xD800) if unicodedata.decomposition(chr(c)) and chr(c).islower()]
    found = [(a, b[0]) for a, b in found if b[0].isascii() and b[0].isalpha() and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters, composed or not; a text of ASCII only is not gone through for marks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(F.regexp_replace(low, MARKS, ""), *_accents()))


def fold_word(word: str) -> str:
    """fold() of a query's word."""
    return re.sub(MARKS, "", word.lower()).translate(str.maketrans(*_accents()))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def token_text(text: Column) -> Column:
    """A text whose tokens are runs of ASCII letters, digits and whatever is not ASCII: fold() itself, or if it is not all ASCII, the tokens with spaces."""
    return F.element_at(F.transform(F.array(fold(text)), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.array_join(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), " "))), 1)


@dataclass(frozen=True)
class Term:
    """Consecutive tokens; the last may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


def parse(query: str) -> list[Term]:
    """White space parts terms; one with punctuation is a phrase; the last is a prefix if it is longer than two characters."""
    made, parts = [], query.split()
    for i, part in enumerate(parts):
        words = tuple(re.findall(r"[^\W_]+", fold_word(part)))
        if words:
            made.append(Term(words, i + 1 == len(parts) and len(part) > 2))
    return made


def match_text(query: str) -> str:
    """The query in the index's own syntax: quoted terms, quotes doubled, the prefix mark on the last."""
    parts = query.split()
    quoted = ['"' + p.replace('"', '""') + '"' for p in parts]
    return " ".join(quoted[:-1] + [quoted[-1] + ("*" if len(parts[-1]) > 2 else "")]) if parts else ""


def occurrences(ts: Column, term: Term) -> Column:
    """How often a term stands in an array of tokens."""
    *head, last = term.words
    fits = lambda t: t.startswith(last) if term.prefix else t == last
    if not head:
        return F.size(F.filter(ts, fits))
    n = len(head)

    def here(t: Column, i: Column) -> Column:
        ok = F.coalesce(fits(F.get(ts, i + n)), F.lit(False))
        for k, word in enumerate(head):
            ok &= F.get(ts, i + k) == word
        return ok

    return F.size(F.filter(ts, here))


def search(docs: DataFrame, weights: dict[str, float], query: str, tie: str, limit: int | None = None, keep: Iterable[str] | None = None) -> DataFrame:
    """Rows that have every term, with score (less is better) and rank by score, then tie. No term: no row.

    With keep, only these columns (and tie) are returned; then texts are read once, and what a row counts is written
    between statistics and scores. Otherwise rows are read twice, and none is written.
    """
    terms, names = parse(query), list(dict.fromkeys([*keep, tie])) if keep is not None else docs.columns
    if not terms:
        return docs.limit(0).select(*names).withColumns({"score": F.lit(0.0), "rank": F.lit(0).cast("long")})
    parts = F.array(*(tokens(F.col(c)) for c in weights))

    def measure(ts: Column) -> Column:
        length = sum((F.size(F.get(ts, F.lit(i))) for i in range(len(weights))), F.lit(0))
        weighted = [sum((F.lit(float(w)) * occurrences(F.get(ts, F.lit(i)), term) for i, w in enumerate(weights.values())), F.lit(0.0)) for term in terms]
        return F.struct(length.alias("length"), *(f.alias(f"f{k}") for k, f in enumerate(weighted)))

    # bound once per row: the tokens are not made again for each figure that is taken of them
    counted = docs.select(*names, F.element_at(F.transform(F.array(parts), measure), 1).alias("m_"))
    counted = cut(counted) if keep is not None else counted
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("m_.length").alias("mean"), *(F.count_if(F.col(f"m_.f{k}") > 0).alias(f"n_{k}") for k in range(len(terms)))).first()
    idf = [inverse_frequency(stats["n"], stats[f"n_{k}"]) for k in range(len(terms))]
    score, every = score_of([F.col(f"m_.f{k}") for k in range(len(terms))], idf, stats["mean"], F.col("m_.length"))
    return ranked(counted.where(every).withColumn("score", score).drop("m_"), tie, limit)


def inverse_frequency(n: int, held: int) -> float:
    """How much a term weighs that held of n rows have; terms of more than half of all rows weigh next to nothing."""
    idf = math.log((n - held + 0.5) / (held + 0.5)) if n else 0.0
    return idf if idf > 0 else FLOOR


def score_of(found: list[Column], idf: list[float], mean: float | None, length: Column) -> tuple[Column, Column]:
    """BM25 of weighted counts, less being better, and whether every term was found."""
    score, every = F.lit(0.0), F.lit(True)
    for f, weight in zip(found, idf, strict=True):
        score -= F.lit(weight) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(mean or 1.0)))
        every &= f > 0
    return score, every


def ranked(found: DataFrame, tie: str, limit: int | None) -> DataFrame:
    """found with rank by score, then tie; with a limit, the first ones of that order."""
    if limit is not None:
        found = found.orderBy("score", tie).limit(limit)
    return with_place(found, ["score", tie], "rank")


def changed_rows(indexed: DataFrame, current: DataFrame, key: str, mtime: str) -> DataFrame:
    """key and action: index rows whose time is new or other, remove those gone or whose content is not here, skip the rest."""
    old = indexed.select(key, F.col(mtime).alias("old_time"), F.lit(True).alias("was"))
    new = current.select(key, F.col(mtime).alias("new_time"), F.col("is_dataless"), F.lit(True).alias("is"))
    met = old.join(new, key, "full_outer")
    action = (
        F.when(F.col("is").isNull() | F.col("is_dataless"), F.when(F.col("was"), "remove").otherwise("ignore"))
        .when(F.col("was").isNull(), "index")
        .when(F.col("old_time") == F.col("new_time"), "skip")
        .otherwise("index")
    )
    return met.select(key, action.alias("action"))


def snippet(text: Column, terms: list[Term]) -> Column:
    """The fragment of at most 12 words with most different terms, the first of such, its hits marked; empty without a hit."""
    ws = F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")

    def fits(w: Column) -> Column:
        folded, out = fold(w), F.lit(False)
        for t in terms:
            for k, word in enumerate(t.words):
                whole = f"(^|[^\\p{{L}}\\p{{N}}]){word}"
                out |= folded.rlike(whole if t.prefix and k + 1 == len(t.words) else whole + "($|[^\\p{L}\\p{N}])")
        return out

    def build(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(fits(w), i)), lambda i: i.isNotNull())
        scored = F.transform(hits, lambda h: F.struct(F.size(F.array_distinct(F.transform(F.filter(F.slice(words, h + 1, FRAGMENT), fits), fold))).alias("n"), (-h).alias("minus")))
        start = F.greatest(F.lit(0), -F.array_max(scored)["minus"] - 1)
        chosen = F.transform(F.slice(words, start + 1, FRAGMENT), lambda w: F.when(fits(w), F.concat(F.lit(OPEN), w, F.lit(CLOSE))).otherwise(w))
        said = F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(chosen, " "), F.when(start + FRAGMENT < F.size(words), "…").otherwise(""))
        return F.when(F.size(hits) > 0, said).otherwise("")

    return F.element_at(F.transform(F.array(ws), build), 1)


def segments(marked: Column) -> Column:
    """A marked snippet as structs (text, hit); stray marks are dropped."""
    pieces = F.regexp_extract_all(marked, F.lit(f"({OPEN}[^{OPEN}{CLOSE}]*{CLOSE}|[^{OPEN}{CLOSE}]+)"), F.lit(1))
    return F.transform(pieces, lambda p: F.struct(F.translate(p, OPEN + CLOSE, "").alias("text"), p.startswith(OPEN).alias("hit")))
