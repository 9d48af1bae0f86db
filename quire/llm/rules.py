"""Quality rules: a table of thresholds compiled into one projection, with no user functions.

Figures of a text are lengths, symbols, stop words, lines and repeats; a rule is (figure, low, high), and a text is
kept if each figure lies within its bounds. A null text counts as empty, fails and is not kept. Texts of any length
are taken whole; the work per text is a sort of its windows at most.

The default table is for the four languages of STOP_WORDS: longer texts in another one have too few of them and are not
kept. Callers with other languages give their stop words, and leave out `mean_word_chars` for scripts without spaces:
tuple(r for r in RULES if r[0] not in ("mean_word_chars", "stop_word_ratio")).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import SPACE, WORD, let, whole, words

# Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to a in is it that for on with as was are be by this at from or an "
    "der die das und ist in zu den mit von für auf ein eine im dem nicht des sich als "
    "le la les de des et en un une est que qui dans pour par sur au pas du "
    "el los las y que en un una es por con para se del no su al lo"
).split()

SYMBOLS = "[#*$%&|<>]"

#: (figure, lowest, highest, least words): None is no bound; texts with fewer words than the last entry pass the rule.
RULES = (
    ("n_words", 10, None, 0),
    ("mean_word_chars", 2.0, 14.0, 0),
    ("symbol_ratio", None, 0.10, 0),
    ("stop_word_ratio", 0.02, None, 40),
    ("shout_ratio", None, 0.5, 0),
    ("bang_ratio", None, 0.3, 0),
    ("dup_line_ratio", None, 0.5, 0),
    ("repeat_word_ratio", None, 0.20, 0),
)


def repeated_positions(ws: Column, n: int = 5) -> Column:
    """How many words stand in windows of n words that the text has twice or more, the first occurrence included.

    Windows are compared by a chained 64-bit hash. Only a text with an equal pair is sorted: its (hash, start) pairs,
    then the starts of the repeated ones, whose gaps, n at most, add up to the covered positions.
    """
    hashes = F.transform(
        F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, n))),
    )

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            pairs,
            lambda ps: F.sort_array(
                F.transform(
                    F.filter(
                        ps,
                        lambda p, k: F.coalesce(p["h"] == F.get(ps, k + 1)["h"], F.lit(False)) | F.coalesce((k > 0) & (p["h"] == F.get(ps, F.greatest(k - 1, F.lit(0)))["h"]), F.lit(False)),
                    ),
                    lambda p: p["i"],
                )
            ),
        )
        return let(
            starts,
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n)))),
                F.lit(0).cast("long"),
                lambda total, gap: total + gap,
            ),
        )

    return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(covered(hs)))


def count_of(body: Column, pattern: str) -> Column:
    """How many matches of a pattern a text has."""
    return F.size(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))


def figures(text: Column, stop_words=STOP_WORDS) -> Column:
    """The figures of a text as one struct, each from built-in functions over the whole of it; it is parted into words once."""
    body = whole(text)
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))

    def of(ws: Column) -> Column:
        found = {
            "n_words": F.size(ws),
            "word_chars": F.length(F.array_join(ws, "")),
            "n_symbols": count_of(body, SYMBOLS),
            "n_dup_lines": let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))),
            "n_repeat_words": repeated_positions(ws),
            "n_lines": F.size(lines),
            "n_stop_words": F.size(F.filter(ws, lambda w: w.isin(list(stop_words)))),
            "n_shouted": count_of(body, "\\p{Lu}{2,}"),
            "n_bangs": count_of(body, "!"),
        }
        return F.struct(*(c.cast("long").alias(name) for name, c in found.items()))

    return let(words(text), lambda ws: of(ws))


def ratios() -> dict[str, Column]:
    """The figures that rules name, from columns of figures()."""
    per_word = lambda name: F.coalesce(F.col(name) / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "stop_word_ratio": per_word("n_stop_words"),
        "shout_ratio": per_word("n_shouted"),
        "bang_ratio": per_word("n_bangs"),
        "dup_line_ratio": F.coalesce(F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)), F.lit(0.0)),
        "repeat_word_ratio": per_word("n_repeat_words"),
    }


def verdict(rules=RULES) -> Column:
    """The table of thresholds as one boolean over the columns of figures()."""
    by_name, kept = ratios(), F.lit(True)
    for name, low, high, least in rules:
        few = (F.col("n_words") < least) if least else F.lit(False)
        if low is not None:
            kept &= few | (by_name[name] >= low)
        if high is not None:
            kept &= few | (by_name[name] <= high)
    return kept


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """One row per row of docs: its key as doc_id, the figures, base_failed and kept.

    An empty table gives no rows; repeated rows give repeated results; other columns are not read.
    """
    seen = docs.select(F.col(key).alias("doc_id"), figures(F.col(text), stop_words).alias("f")).select("doc_id", "f.*")
    return seen.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)})


def keep_good(docs: DataFrame, text: str = "text", rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """The rows of docs that every rule keeps, with all their columns whatever their names: a filter in place.

    Null, empty and blank texts have no words, so they go, as do all of under ten; repeated rows stay or go alike; long texts
    are measured whole; an empty table gives no rows.
    """
    seen = docs.select(F.struct("*").alias("row"), figures(F.col(text), stop_words).alias("f")).select("row", "f.*")
    return seen.where(~base_failed() & verdict(rules)).select(*(F.col("row")[c].alias(c) for c in docs.columns))
