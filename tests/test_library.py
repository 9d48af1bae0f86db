"""Facets, filters, tags, sequences and search on small rows, with the cases that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from quire.functions import dates, facets, ordering, text
from quire.operators import filters, fulltext, hierarchy, library, merge, sequence, similarity, tags, textindex
from quire.sources import files, markdown, relay
from quire.streaming import changes, ingest


def one(spark, column, **values):
    row = spark.range(1).select(*(v.alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def tag_row(spark, tokens, label=None):
    df = spark.createDataFrame([(tokens, label)], "tags array<string>, label int")
    return df.select(facets.facets(F.col("tags"), F.col("label")).alias("f")).first()["f"]


@pytest.mark.parametrize(
    "tokens, label, want",
    [
        (["1980", "03 March", "Jerry Brown", "P9", "Read"], None, {"year": 1980, "month": 3, "quality": 2, "priority": 9, "read_state": "read", "subjects": ["Jerry Brown"]}),
        (["842", "Medieval Records", "P7", "Read"], None, {"year": 842, "quality": None, "priority": 7}),
        (["1970s", "P10"], None, {"decade": 1970, "sort_date": 19700000, "date_is_speculative": True, "display_date": "1970s"}),
        (["1981", "06 June", "Day 15"], None, {"sort_date": 19810615, "display_date": "Jun 15, 1981"}),
        (["1983", "1984", "Orwell"], None, {"year": 1984, "subjects": ["1983", "Orwell"]}),
        (["Box", "Red"], 6, {"color": "box", "subjects": ["Box"]}),
        (["Red"], None, {"color": None, "subjects": ["Red"]}),
        (["P3", "P07", "Q0", "3 April", "-10s", "  "], None, {"subjects": ["P3", "P07", "Q0", "3 April", "-10s"], "quality": None}),
        (["read", "UNREAD"], None, {"read_state": "unread", "subjects": []}),
        ([], None, {"year": None, "subjects": []}),
    ],
)
def test_facets(spark, tokens, label, want):
    found = tag_row(spark, tokens, label).asDict()
    assert {k: found[k] for k in want} == want


def test_unreadable_tags_have_no_facets(spark):
    assert tag_row(spark, None) is None


def test_natural_order_and_missing_last(spark):
    df = spark.createDataFrame([("Doc 10", 1), ("doc 2", None), ("Doc 1", 3)], "name string, q int")
    assert [r[0] for r in df.orderBy(ordering.natural_key(F.col("name"))).collect()] == ["Doc 1", "doc 2", "Doc 10"]
    for down, want in ((False, [1, 3, None]), (True, [3, 1, None])):
        assert [r[0] for r in df.select("q").orderBy(ordering.missing_last(F.col("q"), down)).collect()] == want


def test_filters_fold_and_survive_odd_json():
    base, user = filters.LibraryFilter(folder="/a", subjects=("x",), read_state="read"), filters.LibraryFilter(subjects=("y", "x"), read_state="unread", match_all=False)
    both = user.over(base)
    assert (both.folder, both.read_state, both.subjects, both.match_all) == ("/a", "unread", ("x", "y"), False)
    assert filters.LibraryFilter.from_json(both.to_json()) == both
    assert filters.LibraryFilter.from_json('{"folder": null, "other": 1}') == filters.LibraryFilter() == filters.LibraryFilter.from_json("nonsense")


def test_segments_and_runs_differ_after_a_marker(spark):
    rows = [(1, i, k) for i, k in enumerate(["Continuation", "Box", "Continuation", None, "Continuation", "Document Start", "Folder", "Box"])]
    df = spark.createDataFrame(rows, "g int, seq int, classification string")
    by = lambda d, c: [r[c] for r in d.orderBy("seq").collect()]
    assert by(sequence.segments(df, "g"), "segment") == [0, 1, 2, 3, 3, 4, 5, 6]
    assert by(sequence.runs(df, "g"), "run") == [0, 1, 1, 2, 2, 3, 4, 5]


def test_collections_backfill_but_as_of_does_not(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "B"), (1, 2, None), (2, 0, None)], "g int, seq int, box string")
    order = lambda d, c: [r[c] for r in d.orderBy("g", "seq").collect()]
    assert order(sequence.collections(df, "g", F.col("box")), "collection") == ["B", "B", "B", "Uncategorized"]
    assert order(sequence.as_of_box(df, "g", F.col("box"), F.lit("k")), "assigned") == ["k", "k", "B", "k"]


def test_unique_names_skip_literal_numbers(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a 2"), (3, "a"), (4, "A")], "i int, name string")
    assert [r.unique_name for r in sequence.unique_names(df, "name", "i").orderBy("i").collect()] == ["A", "a 2", "a 3", "A 4"]


def test_multisets(spark):
    a, b = F.array(*map(F.lit, "AABA")), F.array(*map(F.lit, "AC"))
    assert one(spark, tags.multiset_difference(a, b)) == ["A", "B", "A"]
    removed, added = tags.inverse(a, b)
    assert one(spark, tags.multiset_equal(tags.apply_occurrences(a, removed, added), b))
    assert one(spark, tags.rename(a, "A", "B")) == ["B"] and one(spark, tags.rename(b, "X", "B")) is None
    assert one(spark, tags.set_read_state(b, "Read")) is None and one(spark, tags.set_read_state(b, "Read", True)) == ["A", "C", "Read"]


def test_closure_is_cycle_safe(spark):
    folders = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 99), (5, 4)], "folder_id long, parent_id long")
    found = {(r.ancestor, r.folder_id): r.depth for r in hierarchy.closure(folders).collect()}
    assert found[(4, 5)] == 1 and (99, 4) not in found and len([k for k in found if k[0] in (1, 2, 3)]) == 9


@pytest.mark.parametrize("a, b, together", [("Environment", "Environtment", True), ("Sacramento", "Sacremernto", True), ("Congress", "Conquess", False), ("tax", "tab", False), ("1984", "1985", False), ("New York", "new  york", True), ("Economics", "Economics ", True), ("abcde", "bcde", True)])
def test_similar_tags(spark, a, b, together):
    df = spark.createDataFrame([(a, 5), (b, 1)], "tag string, n long")
    assert similarity.clusters(df).count() == (2 if together else 0)


def test_similar_tags_are_transitive_and_complete(spark):
    df = spark.createDataFrame([("aaaaa", 3), ("aaaab", 2), ("aaabb", 1)], "tag string, n long")
    rows = similarity.clusters(df).collect()
    assert {(r.canonical, r.total) for r in rows} == {("aaaaa", 6)} and len(rows) == 3


def test_pairs_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(150)}
    df = spark.createDataFrame([(w,) for w in words], "norm string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    allowed = lambda n: 2 if n >= 9 else 1 if n >= 5 else 0
    want = {tuple(sorted(p)) for p in itertools.combinations(words, 2) if distance(*p) <= allowed(max(map(len, p)))}
    assert {(r.a, r.b) for r in similarity.similar_pairs(df).collect()} == want


def test_search_matches_the_formula_of_sqlite(spark):
    import sqlite3

    rows = [(1, "cold war budget", "a"), (2, "cold weather report", "war"), (3, "wel-fare café budget cold cold", ""), (4, "nothing", "cold war"), (5, "budgets", "x"), (6, "other words here", "y"), (7, "more of them", "z")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(body, name)")
    con.executemany("INSERT INTO f(rowid, body, name) VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id int, body string, name string")
    for q in ("cold war", "budget", "cafe", "wel-fare", "cold war bud"):
        want = con.execute("SELECT rowid, bm25(f, 1, 10) FROM f WHERE f MATCH ? ORDER BY 2, 1", (fulltext.match_text(q),)).fetchall()
        got = [(r.id, r.score) for r in fulltext.search(df, {"body": 1.0, "name": 10.0}, q, "id").orderBy("rank").collect()]
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)
    assert fulltext.match_text('cold "x bud') == '"cold" """x" "bud"*'
    assert fulltext.search(df, {"body": 1.0}, "  ", "id").count() == 0


def test_snippets_mark_hits(spark):
    words = " ".join(f"w{i}" for i in range(30)) + " cold war end"
    df = spark.createDataFrame([(words,), ("none",), (None,)], "t string")
    marked = [r[0] for r in df.select(fulltext.snippet(F.col("t"), fulltext.parse("cold war"))).collect()]
    assert marked[1:] == ["", ""] and "\x02cold\x03 \x02war\x03" in marked[0] and len(marked[0].split()) <= 12


def test_partial_dates(spark):
    norm = lambda d, p: one(spark, dates.normalized_date(F.lit(d), F.lit(p)))
    assert tuple(norm("2026-02-31", "day")) == ("2026-02", "month") and tuple(norm("1985", "decade")) == ("1980", "decade")
    assert tuple(norm("1500-2-29", "day")) == ("1500-02-29", "day") and tuple(norm("1900-2-29", "day")) == ("1900-02", "month") and norm("x", "year") is None


def test_relay_goldens(spark):
    none = F.lit(None).cast("string")
    assert one(spark, relay.fingerprint(F.lit("document"), F.lit("P8"), F.lit("1968"), F.lit("3"), none)) == "0499653ca88947f9"
    assert one(spark, relay.fingerprint(F.lit("document"), none, none, none, none)) == "3569ca955db85c80"
    assert one(spark, relay.canonical_json({"b": F.lit('q"\\\n\x01/é'), "a": none})) == '{"b":"q\\"\\\\\\n\\u0001/é"}'


def test_text_scalars(spark):
    assert one(spark, text.clean_copied(F.lit("  a hy-\nphen\r\nnext \n\n\n two\n"))) == "a hyphen next\n\ntwo"
    assert one(spark, text.collection_name(F.lit(" the papers  OF smith & sons #4 "))) == "The Papers of Smith and Sons Number 4"
    assert one(spark, text.title_of(F.lit("\n# **Big** [news](x)\nrest"))) == "Big news"
    assert text._compare("The cold War", "the war ended") == (2 / 3, 1, 1, 2)
    assert text._compare("", "x") == (1.0, 0, 1, 0)


def test_notes_round_trip():
    note = '---\nid: 7\ntitle: "A: b"\nauthors:\n  - X\n  - "Y, Z"\ntags: [p, "q r"]\nquality: 4\nown: kept\n---\nlead\n<!-- block:reader-page link="a b" page=3 extra=1 -->\nquoted\n'
    found = markdown.decode_front_matter(note)
    assert (found["authors"], found["tags"], found["quality"], found["error"]) == (["X", "Y, Z"], ["p", "q r"], 4, None)
    assert markdown.decode_front_matter(markdown.encode_front_matter(found)) == found
    blocks = markdown.parse_blocks(found["body"])
    assert [b["kind"] for b in blocks] == ["freeform", "reader-page"] and blocks[1]["page"] == 3
    assert markdown.parse_blocks(markdown.serialize_blocks(blocks)) == blocks
    assert markdown.decode_front_matter("---\ntitle: x\n---\n")["error"] == "missing id"


def test_two_pass_deletes(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    seen = lambda *a: {r.k: r.state for r in merge.confirm_absent(*a, "k").collect()}
    assert seen(ids(1, 2, 3), ids(1), ids(3)) == {2: "pending", 3: "delete"}
    assert seen(ids(1, 2, 3), ids(), ids(3)) == {}


def test_change_feed_is_associative(spark):
    schema = "root string, kind string, path string, own boolean"
    a = [("r", "path", "/a/b/c", False), ("r", "subtree", "/a/b", False), ("s", "path", "/x.sb-0a1B2c3D-aZ09xY", False)]
    b = [("r", "subtree", "/a", False), ("r", "path", "/ab/c", False), ("r", "path", "/o", True), ("t", "full_rescan", None, False), ("t", "path", "/p", False)]
    df = lambda rows: spark.createDataFrame(rows, schema)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    once = rows(changes.reduce_changes(df(a + b)))
    assert once == sorted([("r", "subtree", "/a"), ("r", "path", "/ab/c"), ("t", "full_rescan", None)], key=str)
    halves = changes.reduce_changes(df(a)).unionByName(changes.reduce_changes(df(b))).withColumn("own", F.lit(False))
    assert rows(changes.reduce_changes(halves)) == once


def test_streamed_ingest_happens_once(spark, tmp_path):
    schema = "key string, `group` string, fp string, epoch string, token string, replaces string, media boolean, n long"
    feed, state, out = (str(tmp_path / x) for x in ("feed", "state", "out"))

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        ingest.start(spark, stream, state, out, str(tmp_path / "check"), "now", "t").awaitTermination()
        return sorted((r.key, r.fp) for r in spark.read.parquet(f"{out}/batch=*").collect())

    row = lambda key, fp, n, media=True, replaces=None, group="g", epoch="now": (key, group, fp, epoch, "t", replaces, media, n)
    assert send(row("g__1", "a", 1), row("g__2", "a", 2, media=False), row("g__9", "a", 3, group="g/.."), row("g__8", "a", 4, epoch="old")) == [("g__1", "a")]
    assert send(row("g__1", "a", 5), row("g__2", "a", 6)) == [("g__1", "a"), ("g__2", "a")]
    assert send(row("g__1", "b", 7), row("g__3", "c", 8, replaces="g__2")) == [("g__1", "a"), ("g__1", "b"), ("g__2", "a"), ("g__3", "c")]
    assert send(row("g__2", "z", 9))[-1] == ("g__3", "c")


def test_file_scans(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in (("a/x.pdf", b"1"), ("a/y.txt", b"22"), ("z.JPG", b"3")):
        (tmp_path / name).write_bytes(body)
    assert files.fingerprints(spark, str(tmp_path)).count() == 3
    (tmp_path / "a/empty.tif").write_bytes(b"")
    rows, problems, verdicts = files.scan(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in rows.collect()) == [("empty.tif", b""), ("x.pdf", b"1"), ("z.JPG", b"3")] and problems.count() == 0
    assert verdicts.first().asDict() == {"files_seen": 4, "unreadable": 0, "directory_errors": 0, "vanished": 0, "root_unreadable": False, "completed": True, "is_clean": True}
    assert not files.scan(spark, str(tmp_path), cancelled=True)[2].first()["is_clean"]


def test_jsonl_lines_are_in_the_order_of_files(spark, tmp_path):
    line = lambda key, *parts: '{"custom_id":"%s","result":{"message":{"content":[%s]}}}' % (key, ",".join('{"type":"text","text":"%s"}' % p for p in parts))
    (tmp_path / "01.jsonl").write_text(line("x", "old") + "\n" + line("y", "one", "two") + "\n{bad\n")
    (tmp_path / "02.jsonl").write_text('{"key":"z","response":{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}}\n' + "{}\n" * 20_000 + line("x", "new") + "\n" + '{"custom_id":"w","error":{"message":"bad"}}\n')
    got = {r.custom_id: (r.text, r.error) for r in files.read_jsonl(spark, str(tmp_path)).collect()}
    assert got == {"x": ("new", None), "y": ("one\ntwo", None), "z": ("a\nb", None), "w": (None, "bad")}


def test_folders_of_one_component_count_once(spark):
    df = spark.createDataFrame([("inbox",), ("/a/b",), ("c/d",), ("/",)], "folder string")
    assert {r.folder: r.n_files for r in library.folder_counts(df).collect()} == {"inbox": 1, "/a": 1, "/a/b": 1, "c": 1, "c/d": 1}


FTS_ROWS = [(1, "cold war budget", "a"), (2, "cold weather report", "war"), (3, "wel-fare café budget cold cold", ""), (4, "nothing", "cold war"), (5, "budgets", "x"), (6, "re\u0301sume\u0301 of \u1e24asan", "y"), (7, "more of them ấ", "z")]
FTS_QUERIES = ("cold war", "budget", "cafe", "wel-fare", "cold war bud", "resume", "hasan", "résumé", "Ḥas", "a", "of-hasan")


def test_written_index_and_folding_equal_sqlite(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(body, name, tokenize=\"unicode61 remove_diacritics 2\")")
    con.executemany("INSERT INTO f(rowid, body, name) VALUES (?, ?, ?)", FTS_ROWS)
    schema, weights = "id int, body string, name string", {"body": 1.0, "name": 10.0}
    df = spark.createDataFrame(FTS_ROWS, schema)
    # rows 1 and 6 come first with other texts, row 8 goes again
    textindex.write_segment(df.where("id <= 4").withColumn("body", F.when(F.col("id") == 1, "cold stale").otherwise(F.col("body"))).unionByName(spark.createDataFrame([(8, "cold war", "gone")], schema)), weights, "id", str(tmp_path / "i"), 0)
    textindex.write_segment(df.where("id IN (1, 5, 6, 7)"), weights, "id", str(tmp_path / "i"), 1, spark.createDataFrame([(8,)], "id int"))
    assert textindex.compact(spark, str(tmp_path / "i"), str(tmp_path / "c")) == 1
    for q in FTS_QUERIES:
        want = con.execute("SELECT rowid, bm25(f, 1, 10) FROM f WHERE f MATCH ? ORDER BY 2, 1", (fulltext.match_text(q),)).fetchall()
        for found in (fulltext.search(df, weights, q, "id"), textindex.search_index(spark, str(tmp_path / "i"), weights, q, "id"), textindex.search_index(spark, str(tmp_path / "c"), weights, q, "id")):
            got = [(r.id, r.score) for r in found.orderBy("rank").collect()]
            assert [i for i, _ in got] == [i for i, _ in want], q
            assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)
    assert textindex.search_index(spark, str(tmp_path / "c"), weights, "cold", "id", limit=2).count() == 2


def test_headers_go_by_builtin_functions_too(spark):
    pages = ["Extracted text.\nscan 1.jpg\nA · B · 2026\nClassification: x\n\n Body\nmore ", "Extracted text. x", "no header\nClassification: y", "", None, "Extracted text.\n\nonly body"]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").orderBy("i").select(markdown.stripped("p")).collect()]
    assert got == [markdown.strip_header(p) for p in pages] and got[0] == "Body\nmore"


def test_differences_of_words_equal_a_full_table(spark):
    import random

    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcdAB") for _ in range(r.randrange(25))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(max(last[j + 1], row[-1], last[j] + (x.lower() == y.lower())))
        got = text._compare(" ".join(a), " ".join(b))
        assert not a or (got[1], got[2]) == (len(a) - row[-1], len(b) - row[-1])


def test_best_matches_by_blocks(spark, monkeypatch):
    names = [f"{a} {b}" for a in ("north", "south", "papers", "letters") for b in ("box", "file", "folder")]
    df = lambda col, xs: spark.createDataFrame([(x,) for x in xs], f"{col} string")
    whole = sorted(map(tuple, similarity.best_matches(df("candidate", ["north bax", "paper box", "zzz"]), df("folder", names)).collect()))
    monkeypatch.setattr(similarity, "BLOCK", 2)
    assert sorted(map(tuple, similarity.best_matches(df("candidate", ["north bax", "paper box", "zzz"]), df("folder", names)).collect())) == whole and whole
