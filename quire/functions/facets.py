"""Tag arrays parsed into typed facets: one ordered fold over the tokens, all of it built-in expressions.

A token is tried as read state, date uncertainty, rating, month, day, decade, year, colour of the file's own label, and
is a subject otherwise. The last token of a kind counts; an earlier rating or date token becomes a subject where its
successor stands. Decades are digits only. A null array (unreadable tags) gives null facets, an empty one empty facets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their abbreviations, the colours of labels, the kinds that an array can repeat.
MONTHS = "January February March April May June July August September October November December".split()
COLORS = {6: ("Red", "box"), 3: ("Purple", "folder")}
REPEATABLE = ("rating", "month", "day", "decade", "year")

_MONTH = "(?i)^0*([1-9]|1[0-2]) (" + "|".join(MONTHS) + ")$"


def kind_of(token: Column, label: Column) -> Column:
    """What a token is: read, uncertain, rating, month, day, decade, year, color, blank or subject."""
    t = F.trim(token)
    number = F.regexp_extract(t, "^0*([0-9]{1,2}) ", 1).try_cast("int")
    name = F.lower(F.substring_index(t, " ", -1))
    color = F.lit(False)
    for code, (word, _) in COLORS.items():
        color |= F.coalesce((label == code) & (t == word), F.lit(False))
    return (
        F.when(t == "", "blank")
        .when(F.lower(t).isin("read", "unread"), "read")
        .when(F.lower(t) == "date uncertain", "uncertain")
        .when(t.rlike("^(Q[1-3]|[Pp]([789]|10))$"), "rating")
        .when(t.rlike(_MONTH) & (name == F.element_at(F.lit([m.lower() for m in MONTHS]), F.coalesce(number, F.lit(1)))), "month")
        .when(t.rlike("(?i)^day 0*([1-9]|[12][0-9]|3[01])$"), "day")
        .when(t.rlike("^[0-9]{2,3}0s$"), "decade")
        .when(t.rlike("^[0-9]{3,4}$"), "year")
        .when(color, "color")
        .otherwise("subject")
    )


def fold(tags: Column, label: Column) -> Column:
    """The tokens that count, by kind, and the subjects in order."""
    state = F.struct(
        *(F.lit(None).cast("string").alias(k) for k in ("read", *REPEATABLE)),
        F.lit(False).alias("uncertain"),
        F.lit(None).cast("string").alias("color"),
        F.array().cast("array<string>").alias("subjects"),
    )

    def step(s: Column, x: Column) -> Column:
        kind, token = x["kind"], x["token"]
        demoted = F.array().cast("array<string>")
        for k in REPEATABLE:
            demoted = F.when((kind == k) & s[k].isNotNull(), F.array(s[k])).otherwise(demoted)
        return F.struct(
            *(F.when(kind == k, token).otherwise(s[k]).alias(k) for k in ("read", *REPEATABLE)),
            (s["uncertain"] | (kind == "uncertain")).alias("uncertain"),
            F.when(kind == "color", token).otherwise(s["color"]).alias("color"),
            F.concat(s["subjects"], F.when(kind == "subject", F.array(token)).otherwise(demoted)).alias("subjects"),
        )

    classed = F.transform(tags, lambda t: F.struct(kind_of(t, label).alias("kind"), t.alias("token")))
    return F.aggregate(classed, state, step)


def rating_priority(token: Column) -> Column:
    """Legacy P-number if the token has that form, else quality plus 7."""
    number = F.substring(F.trim(token), 2, 2).cast("int")
    return F.when(F.upper(F.trim(token)).startswith("P"), number).otherwise(number + 7)


def rating_quality(token: Column) -> Column:
    """1 to 3; P7 is a rating without a quality."""
    priority = rating_priority(token)
    return F.when(priority > 7, priority - 7)


def sort_date(year: Column, month: Column, day: Column, decade: Column) -> Column:
    """year * 10000 + month * 100 + day with 0 for what is missing; a decade alone stands for its first year."""
    return F.when(year.isNotNull(), year * 10000 + F.coalesce(month, F.lit(0)) * 100 + F.coalesce(day, F.lit(0))).otherwise(decade * 10000)


def display_date(year: Column, month: Column, day: Column, decade_token: Column) -> Column:
    short = F.element_at(F.lit([m[:3] for m in MONTHS]), month)
    text = F.when(month.isNull(), year.cast("string")).when(day.isNull(), F.concat_ws(" ", short, year)).otherwise(F.concat(short, F.lit(" "), day, F.lit(", "), year))
    return F.when(year.isNull(), F.trim(decade_token)).otherwise(text)


def facets(tags: Column, label: Column) -> Column:
    """The facet struct of a tag array."""
    f = fold(tags, label)
    number = lambda token, pattern: F.regexp_extract(F.trim(token), pattern, 1).try_cast("int")

    def finish(s: Column) -> Column:
        year, decade = F.trim(s["year"]).cast("int"), number(s["decade"], "^([0-9]+)s$")
        month, day = number(s["month"], "^([0-9]+) "), number(s["day"], "(?i)^day ([0-9]+)$")
        spent = F.array_compact(F.array(s["year"], s["month"], s["day"], s["decade"]))
        topical = F.filter(tags, lambda t: ~F.lower(F.trim(t)).isin("read", "unread", "date uncertain") & ~F.array_contains(spent, t))
        return F.struct(
            F.lower(F.trim(s["read"])).alias("read_state"),
            s["uncertain"].alias("date_uncertain"),
            rating_quality(s["rating"]).alias("quality"),
            rating_priority(s["rating"]).alias("priority"),
            year.alias("year"),
            month.alias("month"),
            day.alias("day"),
            decade.alias("decade"),
            F.when(s["color"].isNotNull(), F.when(label == 6, "box").otherwise("folder")).alias("color"),
            s["subjects"].alias("subjects"),
            sort_date(year, month, day, decade).alias("sort_date"),
            (s["uncertain"] | (year.isNull() & decade.isNotNull())).alias("date_is_speculative"),
            display_date(year, month, day, s["decade"]).alias("display_date"),
            topical.alias("topical_tags"),
        )

    return F.when(tags.isNotNull(), F.element_at(F.transform(F.array(f), finish), 1))
