"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

A run of at least LEAST_RUN letters, digits and + / = _ - is a candidate. Its score is the sum over neighbouring characters
of log P(next | last) under the model of random strings, less that under the model of identifiers. A sum of MIN_SCORE or
more that is MIN_MEAN or more for each pair is a span of kind `random`, unless a pattern's span overlaps it. Both models
are smoothed towards one background, so what neither has seen says nothing. They are trained from labelled samples: the
caller's, or by default ones made by rule, of which the identifiers are names, paths, slugs, file names with dates, numbers,
alphabets in order and repeated characters. A candidate that holds a UUID is an identifier too.
"""

from __future__ import annotations

import math
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.text import let, whole
from quire.session import cut

# The patterns of the three base kinds, and the least length of what each has to match.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more: a run holds no second match that is longer
HEX = "[0-9a-f]{24,}"
LEAST_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
LEAST_RUN = 16
CANDIDATE = f"(?<![\\p{{L}}\\p{{N}}+/=_-])[A-Za-z0-9+/=_-]{{{LEAST_RUN},}}(?![\\p{{L}}\\p{{N}}+/=_-])"
# A UUID, which is an identifier although its digits are random.
UUID = "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
MIN_SCORE, MIN_MEAN = 8.0, 1.05
#: Weight of the background in a model, in pairs for each last character.
SMOOTHING = 20.0
KINDS = ("assign", "access", "hex", "random")

# Words that identifiers are made of, in the training samples.
PARTS = (
    "get set user name id value list item count total index key file path time date order line page note text "
    "table column row data type class code state status start end first last next size length width height node "
    "tree map array string number result error message event handler request response server client config option "
    "version update create delete select insert buffer cache queue task worker thread process default parent child "
    "author title folder archive record document segment collection source target input output"
).split()
ONSETS = "b br c ch d dr f fl g gr h k l m n p ph pl pr qu r s sch sh sp st str t th tr v w z".split()
NUCLEI = "a e i o u ai au ea ee ei ie io ou".split()
CODAS = ["", "", "", "l", "m", "n", "nd", "ng", "r", "rt", "s", "st", "t", "tion"]
SAMPLES = 10_000


def samples(spark: SparkSession, seed: str = "train", count: int = SAMPLES) -> DataFrame:
    """Labelled samples by rule, twice count: label (random or identifier), shape and text. Another seed makes other ones."""
    lot = lambda k, size: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(size)).cast("int")
    pick = lambda k, values: F.element_at(F.lit(values), lot(k, len(values)) + 1)
    made = {f"part{k}": pick(f"part{k}", PARTS) for k in range(5)}
    made |= {f"syllable{k}": F.concat(pick(f"o{k}", ONSETS), pick(f"n{k}", NUCLEI), pick(f"c{k}", CODAS)) for k in range(10)}
    made |= {"digest": F.sha2(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")), 512), "decimal": F.concat(*(F.lpad(lot(f"d{k}", 10**6).cast("string"), 6, "0") for k in range(5)))}
    made |= {"many": F.expr(f"repeat(substring('{ALPHABET}', pmod(xxhash64(id, '{seed}', 'ch'), {len(ALPHABET)}) + 1, 1), pmod(xxhash64(id, '{seed}', 'rep'), 30) + 16)")}
    drawn = cut(spark.range(count).select("id", *(c.alias(name) for name, c in made.items())))

    word = lambda k: F.when(lot(f"kind{k}", 2) == 0, F.col(f"part{k}")).when(lot(f"kind{k}", 2) == lot(f"long{k}", 2), F.col(f"syllable{k}")).otherwise(F.concat(f"syllable{k}", f"syllable{k + 5}"))
    drawn = drawn.select("*", *(word(k).alias(f"w{k}") for k in range(5)), F.translate(F.base64(F.unhex("digest")), "\r\n", "").alias("base64"))
    w = [F.col(f"w{k}") for k in range(5)]
    number = lambda k, size: lot(k, size).cast("string")
    often = lambda k, c: F.when(lot(k, 2) == 0, c)
    cut_at = lambda text, lo, hi: F.substring(text, F.lit(1), lot("cut", hi - lo + 1) + lo)
    swapped = lambda old, new: F.translate("base64", old, new)
    date = lambda sep: F.concat_ws(sep, 1990 + lot("y", 40), F.lpad((lot("m", 12) + 1).cast("string"), 2, "0"), F.lpad((lot("d", 28) + 1).cast("string"), 2, "0"))
    joined = lambda sep: F.concat_ws(sep, w[0], w[1], w[2], often("four", w[3]), often("five", w[4]), often("num", number("nn", 10_000)))
    random = {
        "base64": cut_at(F.col("base64"), 20, 64),
        "urlsafe": cut_at(swapped("+/=", "-_"), 20, 64),
        "base62": cut_at(swapped("+/=", "xR"), 18, 44),
        "base32": cut_at(F.translate(F.upper("base64"), "0189+/=", "GXQZMK"), 20, 52),
        "base36": cut_at(F.lower(swapped("+/=", "q7")), 20, 44),
        "letters": cut_at(swapped("0123456789+/=", "kQzXvJwYpLGb"), 20, 44),
        "upper hex": cut_at(F.upper("digest"), 24, 64),
        "lower hex": cut_at(F.col("digest"), 16, 40),
    }
    identifier = {
        "snake": joined("_"),
        "kebab": joined("-"),
        "path": joined("/"),
        "camel": F.concat(w[0], *map(F.initcap, w[1:4]), F.coalesce(often("num", number("nn", 1000)), F.lit(""))),
        "title": F.concat(*map(F.initcap, w[:4])),
        "upper": F.upper(joined("_")),
        "word": F.concat(*(f"syllable{k}" for k in range(6))),
        "dated": F.concat_ws("_", F.upper(w[0]), date(""), F.lpad(number("t", 240_000), 6, "0"), often("s", F.upper(w[1])), often("s2", F.upper(w[2]))),
        "dated slug": F.concat_ws("-", date("-"), w[0], w[1], often("s", w[2]), often("v", F.concat(F.lit("v"), number("vv", 10)))),
        "number": F.substring(F.col("decimal"), F.lit(1), lot("cut", 14) + 16),
        "padded": F.concat(F.rpad(F.lit(""), lot("pad", 18) + 14, F.lit("0")), number("nn", 1000)),
        "repeated": F.concat("many", F.coalesce(often("tail", number("nn", 100)), F.lit(""))),
        "in order": F.substring(F.lit(ALPHABET * 2), lot("from", 64) + 1, lot("cut", 30) + 18),
        "assigned": F.concat(w[0], F.lit("="), w[1], F.lit("/"), w[2], F.lit("="), number("nn", 10_000)),
    }

    def labelled(label: str, shapes: dict[str, Column]) -> DataFrame:
        nth = F.pmod(F.col("id"), F.lit(len(shapes)))
        chosen = F.coalesce(*(F.when(nth == k, text) for k, text in enumerate(shapes.values())))
        return drawn.select(F.lit(label).alias("label"), F.element_at(F.lit(list(shapes)), (nth + 1).cast("int")).alias("shape"), chosen.alias("text"))

    return labelled("random", random).unionByName(labelled("identifier", identifier))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, by place in ALPHABET, last * 67 + next.

    Each model's rows are smoothed by SMOOTHING pairs of the background, the two labels' characters in equal parts. The
    table has a fixed size, 67 * 67, whatever the number of samples; characters outside the alphabet are skipped.
    """
    width = len(ALPHABET)
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = labelled.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.struct(place(F.substring(F.col("text"), i, F.lit(1))).alias("a"), place(F.substring(F.col("text"), i + 1, F.lit(1))).alias("b")))).alias("p"))
    counted = pairs.where("p.a >= 0 and p.b >= 0").groupBy("label", "p.a", "p.b").count().collect()  # at most 2 * 67 * 67 rows
    held = {label: [[0.0] * width for _ in range(width)] for label in ("random", "identifier")}
    for r in counted:
        held[r["label"]][r["a"]][r["b"]] = float(r["count"])
    background = [1.0 / width / 10] * width  # a tenth uniform
    for rows in held.values():
        total = sum(map(sum, rows)) or 1.0
        background = [x + 0.45 * sum(row[b] for row in rows) / total for b, x in enumerate(background)]
    scale = sum(background)
    log_p = {label: [[math.log((x + SMOOTHING * background[b] / scale) / (sum(row) + SMOOTHING)) for b, x in enumerate(row)] for row in rows] for label, rows in held.items()}
    return [log_p["random"][a][b] - log_p["identifier"][a][b] for a in range(width) for b in range(width)]


#: Models of the rule-made samples, by session.
_models: weakref.WeakKeyDictionary[SparkSession, list[float]] = weakref.WeakKeyDictionary()


def default_model(spark: SparkSession) -> list[float]:
    """The model of the rule-made samples, trained once per session."""
    if spark not in _models:
        _models[spark] = train(samples(spark))
    return _models[spark]


def score(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a candidate, summed over neighbouring characters."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folded into one literal
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(
        places,
        lambda ps: F.aggregate(
            F.slice(F.transform(ps, lambda p, i: F.coalesce(F.get(table, (p * len(ALPHABET) + F.get(ps, i + 1)).cast("int")), F.lit(0.0))), F.lit(1), F.size(ps) - 1),
            F.lit(0.0),
            lambda total, x: total + x,
        ),
    )


def is_random(token: Column, model: list[float]) -> Column:
    """Whether a candidate is likelier a random string than an identifier, by enough in all and on average, and holds no UUID."""
    return ~token.rlike(UUID) & let(score(token, model), lambda s: (s >= MIN_SCORE) & (s >= MIN_MEAN * (F.length(token) - 1)))


def spans(text: Column, pattern: str, order: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost, non-overlapping matches as structs (start, kind, end) in code points; those whose group is shorter than least are dropped.

    Places are running sums over the pieces between matches and the matches themselves, only for texts with a match.
    """
    kind = "struct<start:int,kind:int,end:int>"
    none = F.array().cast(f"array<{kind}>")
    grown = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def place(found: Column) -> Column:
        pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        sized = F.transform(F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g")), lambda z: F.struct(z["p"].alias("gap"), F.length(z["m"]).alias("size"), (F.length(z["g"]) >= least).alias("ok")))
        return F.aggregate(
            sized,
            grown,
            lambda s, z: F.struct(
                (s["at"] + z["gap"] + z["size"]).alias("at"),
                F.when(z["ok"], F.concat(s["found"], F.array(F.struct((s["at"] + z["gap"]).alias("start"), F.lit(order).alias("kind"), (s["at"] + z["gap"] + z["size"]).alias("end"))))).otherwise(s["found"]).alias("found"),
            ),
            lambda s: s["found"],
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(place(found)))


def as_string(found: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS, joined by commas."""
    name = F.lit(list(KINDS))
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: list[float] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random.

    A null text counts as empty; whole texts are scanned; repeated rows give repeated results; other columns are not
    read; an empty table gives no rows.
    """
    model = default_model(docs.sparkSession) if model is None else model
    body = F.col("body")
    base = docs.select(F.col(key).alias("doc_id"), whole(F.col(text)).alias("body")).select(
        "doc_id",
        "body",
        spans(body, ASSIGN, 0, 1, LEAST_VALUE).alias("assign"),
        spans(body, ACCESS, 1).alias("access"),
        spans(body, HEX, 2).alias("hex"),
        spans(body, CANDIDATE, 3).alias("candidates"),
    )
    token = lambda s: F.substring(body, s["start"] + 1, s["end"] - s["start"])
    known = F.concat("assign", "access", "hex")
    added = let(
        known,
        lambda ks: F.filter(
            "candidates",
            lambda s: ~F.exists(ks, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])) & is_random(token(s), model),
        ),
    )
    found = base.select("doc_id", "assign", "access", "hex", F.when(F.size("candidates") > 0, added).otherwise(F.col("candidates")).alias("random"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.encode(as_string(F.concat("assign", "access", "hex")), "UTF-8"), 256).alias("base_sha256"),
        as_string(F.concat(*KINDS)).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
