"""The pipeline's near-dedup against brute-force Jaccard."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quire.llm import near

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_kept(rows):
    """Ids of the first text of each component at a Jaccard similarity of 0.8 or more."""
    rows = sorted(rows)
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if label[i] != label[j] and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {rows[i][0] for i in set(label)}


def varied():
    """Texts of 5 to 300 words with edits of a few words: similarities all around 0.8, chains, and one large group."""
    r = random.Random(3)
    rows = []
    for _ in range(60):
        ws = [f"w{r.randrange(5000)}" for _ in range(r.choice((5, 6, 12, 40, 120, 300)))]
        for _ in range(5):
            rows.append(" ".join(ws))
            for _ in range(r.randrange(1, 2 + len(ws) // 50)):
                ws[r.randrange(len(ws))] = f"w{r.randrange(5000)}"
    base = [f"g{k}" for k in range(100)]
    for k in range(90):
        rows.append(" ".join(base[: k % 80] + [f"x{k}"] + base[k % 80 + 1 :]))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_stage_equals_brute_force_jaccard(spark, monkeypatch, small):
    if small:  # keys and components are parted
        monkeypatch.setattr(near, "CELL", 16)
        monkeypatch.setattr(near, "SETS", 8)
        monkeypatch.setattr(near, "SAMPLED", 2)
        monkeypatch.setattr(near, "FREQUENT", 2)
    rows = varied()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = brute_kept(rows)
    assert 60 < len(kept) < 250
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == kept


def licensed(n, own=60, licence=60):
    """Texts of some words of their own behind one licence."""
    r, same = random.Random(7), " ".join(f"l{k}" for k in range(licence))
    return [(i, same + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(own))) for i in range(n)]


@pytest.mark.parametrize(("n", "own"), [(5_000, 60), (10_000, 60), (20_000, 60), (5_000, 12), (10_000, 12)])
def test_texts_behind_one_licence_hardly_meet(spark, n, own):
    """However many share the licence, a text has its keys as rows and none in common with another."""
    rows = spark.createDataFrame(licensed(n, own), "doc_id long, body string").withColumn("version", F.xxhash64("body"))
    distinct = near.marks(rows)
    assert distinct.count() == n
    assert near.seats_by_key(distinct).count() <= near.n_keys(own + 56) * n
    assert near.meetings(distinct, 8).count() < 4 * n


def test_copies_behind_a_licence_are_found(spark):
    """Three hundred texts have a near copy each behind the licence that all of them share."""
    rows = licensed(1_500)
    copies = [(10_000 + i, " ".join(w for k, w in enumerate(t.split()) if k != 80)) for i, t in rows[:300]]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    assert {r.doc_id for r in near.keep_first(docs).collect()} == {i for i, _ in rows}


def test_followers_meet_leaders_of_their_size_only(spark):
    """Every pair within a factor of 5/4, the smaller of which leads, is in one part at least, and no part is far over its share."""
    r = random.Random(1)
    rows = [(1 if k % 3 else k % 7, k, r.randrange(1, 400), r.random() < 0.3) for k in range(1_500)]
    dealt = spark.createDataFrame(rows, "cell long, node long, n long, leads boolean")
    met = {}
    for row in near._parted(near._banded(dealt, 64), 64).collect():
        met.setdefault((row.cell, row.part), set()).add(row.node)
    seats = {}
    for place, nodes in met.items():
        assert len(nodes) < 260
        for node in nodes:
            seats.setdefault(node, set()).add(place)
    for cell, a, n, leads in rows:
        for other, b, m, _ in rows if leads else ():
            if a != b and cell == other and n <= m <= 1.25 * n:
                assert seats[a] & seats[b]


def test_keys_in_any_order_meet():
    """Sets at a similarity of 0.8 or more share a key that leads the smaller one, whatever the common order."""
    import numpy as np

    r = random.Random(2)
    for _ in range(3_000):
        n = r.randrange(1, 60)
        a = r.sample(range(200), n)
        b = [x for x in a if r.random() > 0.1] + r.sample(range(200, 300), r.randrange(0, 1 + n // 6))
        known = np.array(sorted(r.sample(range(300), 40)), np.int64)
        level = np.array([r.randrange(1, 5) for _ in known], np.int64)
        x, y = (near.rare_first(np.array(sorted(s), np.int64), known, level) for s in sorted((a, b), key=len))
        both = len(set(a) & set(b))
        if len(b) and 5 * both >= 4 * len(set(a) | set(b)):
            assert set(x[: near.n_leaders(len(x))].tolist()) & set(y[: near.n_keys(len(y))].tolist())


def test_stage_on_documents_and_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in near.keep_first(docs).collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    kept = near.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 8] and near.keep_first(nothing).count() == 0


def test_pipeline_keeps_one_of_each_group(spark, duck):
    """Stages 1 and 2 by their SQL, near copies by brute-force Jaccard, tokens by the library."""
    from tokenizers import Tokenizer

    from quire.llm import oracles, queries

    duck.sql("CREATE OR REPLACE TABLE near1 AS WITH" + oracles.FIGURES.format(p="0", table="documents") + "SELECT doc_id, text, lang, source, n_chars FROM q0 WHERE kept")
    rows = duck.sql("WITH" + oracles.REST.format(p="0", table="near1") + "SELECT doc_id, rest FROM x0 WHERE n_removed = 0 OR regexp_matches(rest, '[^\\x20\\x09-\\x0D]')").fetchall()
    kept, texts = brute_kept(rows), dict(rows)
    assert len(kept) < len(rows)
    library = Tokenizer.from_file(queries.tokenizer_path())
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == kept
    assert all(list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in final)


def test_index_of_fingerprints_gives_candidates(spark, monkeypatch):
    """Without a key in common, near copies within the index's bits are still found, and no text that is not one goes."""
    r, rows = random.Random(11), []
    for k in range(200):
        ws = [f"w{r.randrange(10**6)}" for _ in range(400)]
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join([*ws[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "meetings", lambda distinct, width: distinct.limit(0).select(F.col("node").alias("cell"), "node"))
    kept = {row.doc_id for row in near.keep_first(docs).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept and len(kept) <= 205


def test_fingerprints_of_links_are_near(spark):
    """Links of the index join fingerprints within its bits through others, and sets of one fingerprint are linked."""
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, 7 ^ 0b1011), (4, ~7)], "node long, fp long")
    met = {}
    for row in near.indexed(rows).collect():
        met.setdefault(row.cell, set()).add(row.node)
    assert set(map(frozenset, met.values())) == {frozenset({1, 2}), frozenset({1, 3})}
