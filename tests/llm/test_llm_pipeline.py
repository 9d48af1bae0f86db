"""The pipeline's stages against brute force on the smallest documents, and on odd rows."""

import hashlib
import re

import corpus_pipeline
import numpy as np

from quire.llm import oracles, queries
from test_llm_near import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    duck.sql("CREATE OR REPLACE TABLE stage1 AS WITH" + oracles.FIGURES.format(p="0", table="documents") + "SELECT doc_id, text, lang, source, n_chars FROM q0 WHERE kept")
    duck.sql("CREATE OR REPLACE TABLE stage2 AS WITH" + oracles.REST.format(p="0", table="stage1") + "SELECT doc_id, rest AS text, lang, source FROM x0 WHERE n_removed = 0 OR regexp_matches(rest, '[^\\x20\\x09-\\x0D]')")
    rows = sorted(duck.sql("SELECT doc_id, text, lang, source FROM stage2").fetchall())
    firsts = brute_kept([(r[0], r[1]) for r in rows])
    kept = {r[0]: r for r in rows if r[0] in firsts}

    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns, k
    got = {r.doc_id: r for r in seen.collect()}
    assert got.keys() == kept.keys()
    assert all((got[d].text, got[d].lang, got[d].source, got[d].n_chars) == (*kept[d][1:], len(kept[d][1])) for d in got)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == set(kept)
    for r in final:
        ids = library.encode(kept[r.doc_id][1], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    tokens = {}
    for d in kept.values():
        tokens[d[3]] = tokens.get(d[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d[1]))
    seen_tokens = {}
    for r in final:
        seen_tokens[r.source] = seen_tokens.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", kept[r.doc_id][1]))
    assert all(1 <= seen_tokens[s] / tokens[s] <= 2 for s in tokens)


def test_stages_of_odd_rows_and_of_none(odd, nothing, spark, tmp_path):
    for rows in (odd, nothing):
        seen = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, seen, SF)
            assert k + 1 == len(corpus_pipeline.STAGES) or made.columns == rows.columns
            seen = made
        ids = {r.doc_id for r in seen.collect()}
        assert ids == ({1, 5, 6, None} if rows is odd else set())  # the others have too few words or only repeat themselves
