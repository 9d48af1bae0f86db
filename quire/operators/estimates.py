"""Cost and time of a processing run, as arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens per call (in, out), seconds to the first token, tokens a second, workers.
OCR, CLASSIFY, TAG, BOX, CLUSTER = (400, 850), (600, 10), (1500, 200), (500, 50), (800, 200)
FIRST_TOKEN, RATE, TAG_WORKERS = 0.45, 140.0, 6
FILES_PER_SEGMENT, FILES_PER_BOX = 3.0, 7.0
ROTATION_ASK = 3.0


def _price(calls: Column, tokens: tuple[float, float], price_in: Column, price_out: Column) -> Column:
    return calls * (F.lit(float(tokens[0])) * price_in + F.lit(float(tokens[1])) * price_out) / 1e6


def cost(n: Column, price_in: Column, price_out: Column, image_tokens: float, scale: float = 1.0, context: int = 0, previous: bool = False, tagging: bool = False, collections: bool = False, has_text: bool = False, discount: float = 0.5) -> dict[str, Column]:
    """Dollars by phase, prices being per million tokens; image_tokens is what the model counts for a full image, scale the share of one, 0.01 to 1."""
    n = n.cast("double")
    image = image_tokens * max(0.01, min(1.0, scale))
    asked = (OCR[0] + image * (2 if previous else 1) + context / 4.0, OCR[1])
    none = F.lit(0.0)
    ocr = none if has_text else _price(n, asked, price_in, price_out)
    boxes = F.greatest(F.lit(1.0), n / FILES_PER_BOX)
    made = {
        "ocr": ocr,
        "batch_ocr": ocr * discount,
        "classification": _price(n, CLASSIFY, price_in, price_out) if has_text and (tagging or collections) else none,
        "tagging": _price(F.greatest(F.lit(1.0), n / FILES_PER_SEGMENT), TAG, price_in, price_out) if tagging else none,
        "collection": _price(boxes, BOX, price_in, price_out) + _price(F.lit(1.0), CLUSTER, price_in, price_out) if collections else none,
    }
    return made | {"total": made["ocr"] + made["classification"] + made["tagging"] + made["collection"]}


def seconds(n: Column, workers: int = 4, speed: float = 1.0, orderings: int = 0, rotation_speed: float = 1.0, tagging: bool = False, collections: bool = False, has_text: bool = False) -> dict[str, Column]:
    """Seconds by phase: waves of calls, each a first token and then its output; reading and rotation overlap."""
    n = n.cast("double")
    call = lambda out: FIRST_TOKEN + out / RATE * speed
    waves = lambda calls, wide: F.ceil(calls / float(wide)).cast("double")
    none = F.lit(0.0)
    ocr = waves(n, workers) * call(CLASSIFY[1] if has_text else OCR[1]) if not has_text or tagging or collections else none
    rotation = waves(n, workers) * (orderings * ROTATION_ASK * rotation_speed) if orderings and not has_text else none
    tag = waves(F.greatest(F.lit(1.0), n / FILES_PER_SEGMENT), TAG_WORKERS) * call(TAG[1]) if tagging else none
    collection = waves(F.greatest(F.lit(1.0), n / FILES_PER_BOX), TAG_WORKERS) * call(BOX[1]) + call(CLUSTER[1]) if collections else none
    return {"ocr": ocr, "rotation": rotation, "tagging": tag, "collection": collection, "total": F.greatest(ocr, rotation) + tag + collection}


ORACLE = """WITH v AS (SELECT o_orderkey, (o_orderkey % 500)::DOUBLE AS n FROM orders), w AS (SELECT *, greatest(1.0, n / 3.0)::DOUBLE AS s, greatest(1.0, n / 7.0)::DOUBLE AS b FROM v),
c AS (SELECT o_orderkey, n * (6400 * 3.0 + 850 * 15.0) / 1e6 AS ocr, s * (1500 * 3.0 + 200 * 15.0) / 1e6 AS tag, b * (500 * 3.0 + 50 * 15.0) / 1e6 + (800 * 3.0 + 200 * 15.0) / 1e6 AS col,
ceil(n / 4.0) * (0.45::DOUBLE + 850 / 140.0::DOUBLE * 1.6) AS so, ceil(s / 6.0) * (0.45::DOUBLE + 200 / 140.0::DOUBLE * 1.6) AS st, ceil(b / 6.0) * (0.45::DOUBLE + 50 / 140.0::DOUBLE * 1.6) + (0.45::DOUBLE + 200 / 140.0::DOUBLE * 1.6) AS sc FROM w)
SELECT o_orderkey, round(ocr, 6)::DOUBLE AS ocr_cost, round(ocr * 0.5, 6)::DOUBLE AS batch_ocr_cost, 0.0::DOUBLE AS classification_cost, round(tag, 6)::DOUBLE AS tagging_cost, round(col, 6)::DOUBLE AS collection_cost, round(ocr + tag + col, 6)::DOUBLE AS total_cost,
round(so, 6)::DOUBLE AS ocr_seconds, 0.0::DOUBLE AS rotation_seconds, round(st, 6)::DOUBLE AS tagging_seconds, round(sc, 6)::DOUBLE AS collection_seconds, round(so + st + sc, 6)::DOUBLE AS total_seconds FROM c"""
