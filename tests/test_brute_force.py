"""Whole results of the queries that have no SQL, against plain Python."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest

from quire.operators import fulltext
from quire.plans import registry, search_queries

SF = "/root/testdata/sf0.001"


def rows(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet").collect()


def test_word_differences(spark):
    got = {(r.conv_id, r.turn): r for r in registry.QUERIES["fn13_word_diff"](spark, SF).collect()}
    said = rows(spark, "conversations")
    assert len(got) == len(said)
    outcomes = set()
    for r in said:
        a = (r.text or "").split()
        b = re.sub(r"(?i)\bth(\w)", r"TH\1", " ".join([*a[3:6], *a[:3], "more", "words", *a[8:]]), flags=re.A).split()
        x, y = ([w.lower() for w in ws] for ws in (a, b))
        row = np.zeros(len(y) + 1, np.int64)  # a full table, row by row
        for w in x:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + np.array([w == z for z in y])))
        found = got[r.conv_id, r.turn]
        assert (found.missing, found.added) == (len(x) - row[-1], len(y) - row[-1]) and found.similarity == pytest.approx(row[-1] / len(x) if x else 1.0)
        assert 0 <= found.changed <= row[-1]
        outcomes |= {("missing", found.missing > 0), ("added", found.added > 0), ("changed", found.changed > 0)}
    assert outcomes >= {("missing", True), ("added", True), ("changed", True)}


def test_copied_texts(spark):
    got = {r.doc_id: r.cleaned for r in registry.QUERIES["fn14_clean_copied"](spark, SF).collect()}
    docs = rows(spark, "documents")
    assert len(got) == len(docs)
    for r in docs:
        t = r.text
        raw = "  " + t[:40] + "-\n" + t[40:70] + " \r\n \r\n\t" + t[70:] + "\n"
        lines = [line.strip(" \t") for line in raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        parts = [p for p in re.split("\n{2,}", "\n".join(lines).strip("\n"))]
        joined = [re.sub(r"(?<=[^\W\d_])-\n(?=[^\W\d_])", "", p).replace("\n", " ") for p in parts]
        assert got[r.doc_id] == "\n\n".join(joined), r.doc_id


def test_titles(spark):
    got = {r.doc_id: r.title for r in registry.QUERIES["fn24_extract_title"](spark, SF).collect()}
    for r in rows(spark, "documents"):
        made = "\n\n## **" + r.text[:30] + "** [link](x) " + r.text[30:]
        line = next(x for x in made.split("\n") if x.strip())
        line = re.sub(r"^(#{1,6}\s+|>\s*|[-*+]\s+(\[[ xX]\]\s+)?|[0-9]+[.)]\s+)+", "", line.strip(" "))
        line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
        line = re.sub(r"(\*\*|__|~~|`|(?<![^\W_])[*_]|[*_](?![^\W_]))", "", line).strip(" ")
        assert got[r.doc_id] == (line if len(line) <= 60 else re.sub(r"\s+\S*$", "", line[:60]) + "…"), r.doc_id


def test_snippets(spark):
    """Ranks by a plain BM25, and each of the first 300 rows' fragment by trying every start."""
    found = {r.doc_id: r for r in registry.QUERIES["fts2_top2_snippets"](spark, SF).collect()}
    docs = {r.doc_id: {"body": r.text, "classification": r.source, "name": f"{r.lang} {r.doc_id}"} for r in rows(spark, "documents")}
    tokens = {d: {c: re.findall(r"[^\W_]+", fulltext.fold_word(t)) for c, t in cols.items()} for d, cols in docs.items()}
    fits = [lambda t: t == "the", lambda t: t.startswith("hea")]
    f = {d: [sum(search_queries.READER[c] * sum(map(fit, ts)) for c, ts in cols.items()) for fit in fits] for d, cols in tokens.items()}
    size = {d: sum(map(len, cols.values())) for d, cols in tokens.items()}
    mean, n = sum(size.values()) / len(size), len(size)
    idf = [max(math.log((n - h + 0.5) / (h + 0.5)), 0) or fulltext.FLOOR for h in (sum(x[k] > 0 for x in f.values()) for k in range(2))]
    score = {d: -sum(i * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[d] / mean)) for i, x in zip(idf, f[d])) for d in f if all(f[d])}
    assert set(found) == set(score)
    assert [round(score[d], 6) for d in sorted(found, key=lambda d: found[d]["rank"])] == [round(x, 6) for x in sorted(score.values())]
    for d, r in found.items():
        if r["rank"] > fulltext.SNIPPETS:
            assert r.snippet is None
            continue
        ws = docs[d]["body"].split()
        whole = [bool(re.search(r"(?<![^\W_])(the(?![^\W_])|hea)", fulltext.fold_word(w))) for w in ws]
        hits = [i for i, w in enumerate(whole) if w]
        if not hits:
            assert r.snippet == "" and r.n_hits == 0
            continue
        kinds = {h: len({fulltext.fold_word(ws[i]) for i in range(h, min(h + 12, len(ws))) if whole[i]}) for h in hits}
        start = max(0, min(h for h in hits if kinds[h] == max(kinds.values())) - 1)
        shown = " ".join(f"\x02{w}\x03" if whole[start + k] else w for k, w in enumerate(ws[start : start + 12]))
        assert r.snippet == ("…" if start else "") + shown + ("…" if start + 12 < len(ws) else "")
        assert r.n_hits == Counter(whole[start : start + 12])[True]


def test_scans(spark):
    got = {(r.name, r.size, r.accepted) for r in registry.QUERIES["src1_src2_scan"](spark, SF).collect()}
    assert got == {(name, os.path.getsize(f"{SF}/{name}"), False) for name in os.listdir(SF) if name.endswith(".parquet")}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_all_of_them_are_here(name):
    assert name in {"fn13_word_diff", "fn14_clean_copied", "fn24_extract_title", "fts2_top2_snippets", "src1_src2_scan"}
