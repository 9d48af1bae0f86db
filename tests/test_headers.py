"""Typed headers: cases of each key, odd headers, and notes that read the same once written again."""

import datetime
import random

import pytest

from quire.sources import headers

UTC = datetime.timezone.utc


def note(*lines, body="body\n"):
    return "\n".join(["---", "id: x", *lines, "---"]) + "\n" + body


@pytest.mark.parametrize("lines, key, want", [
    (["schema: 3"], "schema", 3), (["schema: odd"], "schema", 1), ([], "schema", 1), (["title: 'it''s'"], "title", "it's"), (['title: "a \\"b\\" \\u00e9"'], "title", 'a "b" é'), (["title: a: b # c"], "title", "a: b # c"),
    (["authors: []"], "authors", []), (['authors: [A, "B, C", \'D\']'], "authors", ["A", "B, C", "D"]), (["authors:", "  - A", '  - "B, C"', "  -"], "authors", ["A", "B, C", ""]), (["authors: Only"], "authors", ["Only"]), (["tags: [it's, x]"], "tags", ["it's", "x"]),
    (["date_uncertain: True"], "date_uncertain", True), (["date_uncertain: 1"], "date_uncertain", False), ([], "roundup", False), (["roundup: yes"], "roundup", True), (["quality: 4"], "quality", 4), (["quality: high"], "quality", None),
    (["created: 2020-01-02T03:04:05.250Z"], "created", datetime.datetime(2020, 1, 2, 3, 4, 5, 250_000, UTC)), (["modified: 2020-01-02T03:04:05+02:00"], "modified", datetime.datetime(2020, 1, 2, 1, 4, 5, tzinfo=UTC)), (["created: soon"], "created", None),
    (["other: 1", "  deep:", "    - 2", "more: x"], "unknown", ["other: 1\n  deep:\n    - 2", "more: x"]), (["not a key", "no colon", ": none"], "unknown", []),
])
def test_keys(lines, key, want):
    found = headers.decode(note(*lines))
    assert found[key] == want and found["error"] is None and found["body"] == "body\n"
    assert headers.decode(headers.encode(found)) == found


def test_references():
    found = headers.decode(note("zotero:", "  - selectLink: \"z://a\"", "    itemKey: K", "    fetchedAt: 2024-01-02T03:04:05Z", "    own: 7", "  - kind: book", "    citation: 'a: b'", "tags: [t]"))
    first, second = found["zotero"]
    assert (first["select_link"], first["item_key"], first["fetched_at"], first["unknown"]) == ("z://a", "K", datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC), ["own: 7"])
    assert (second["kind"], second["citation"], second["item_key"]) == ("book", "a: b", None) and found["tags"] == ["t"]
    assert headers.decode(headers.encode(found)) == found


@pytest.mark.parametrize("text, error", [(None, "no front matter"), ("", "no front matter"), ("text\n---\n", "no front matter"), ("---", "unterminated front matter"), ("---\nid: x\n", "unterminated front matter"), ("---\ntitle: x\n---\n", "missing id"), ("---\n---\n", "missing id")])
def test_odd_texts(text, error):
    assert headers.decode(text)["error"] == error


def test_line_ends_of_the_body_stay():
    for end in ("\n", "\r\n", "\r"):
        found = headers.decode(f"---{end}id: x{end}tags:{end}  - a{end}---{end}one\r\n\rtwo\n")
        assert (found["id"], found["tags"], found["body"]) == ("x", ["a"], "one\r\n\rtwo\n")


def test_generated_headers_read_the_same_again():
    rng = random.Random(5)
    words = ["a", "b, c", 'q"q', "it's", "x: y", "[z]", "- d", "é", "#", "true", "007", "\\", "line\nbreak", ""]
    for _ in range(500):
        when = lambda: rng.choice([None, datetime.datetime(2000 + rng.randrange(30), 2, 3, 4, 5, 6, rng.choice([0, 123_000]), UTC)])
        fields = dict(headers.BLANK) | {"schema": rng.randrange(1, 4), "id": "i", "title": rng.choice(words), "authors": rng.choices(words[:-1], k=rng.randrange(3)), "date": rng.choice([None, "1968"]), "tags": rng.choices(words[:-1], k=rng.randrange(3)), "quality": rng.choice([None, 3]), "roundup": rng.random() < 0.5, "created": when(), "modified": when(), "unknown": rng.choice([[], ["k: v", "l: w\n  - x"]]), "body": rng.choice(["", "text\n---\nmore"])}
        fields["zotero"] = [dict.fromkeys(headers.REFERENCE_KEYS) | {"item_key": rng.choice(words), "fetched_at": when(), "unknown": rng.choice([[], ["o: 1"]])} for _ in range(rng.randrange(3))]
        assert headers.decode(headers.encode(fields)) == fields
