"""Conversation repair: layers over a trie give the cost and edits that a search over all of them gives."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from quire.llm import repair

SIGNS = "suaxSUAXd"


def cheapest(signature):
    """Least (cost, edits) by a best-first search over single edits; words of the grammar are tested by their expression."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, made = heapq.heappop(heap)
        if i == len(signature) and re.fullmatch("(s?(ua)+)?", made):
            return cost, edits
        if (i, made) in seen or not any(re.fullmatch("(s?(ua)+)?", made + rest) for rest in ("", "a", "ua")):
            continue
        seen.add((i, made))
        for role in "ua":
            heapq.heappush(heap, (cost + 3, edits + "I", i, made + role))
        if i < len(signature):
            sign = signature[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, made))
            if sign != "d":
                extra = 3 if sign.isupper() else 0
                heapq.heappush(heap, (cost + extra, edits + "K", i + 1, made + sign.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + 3 + extra, edits + "R", i + 1, made + role))


def test_every_short_signature():
    trie = repair.Trie()
    for signature in sorted("".join(s) for n in range(5) for s in itertools.product(SIGNS, repeat=n)):
        trie.go_to(signature)
        assert trie.answer() == cheapest(signature), signature


def test_longer_signatures_in_any_order():
    rng, trie = random.Random(4), repair.Trie()
    for _ in range(300):
        signature = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(5, 11)))
        trie.go_to(signature)
        assert trie.answer() == cheapest(signature), signature


def test_shared_prefixes_get_their_layers_once():
    signatures = sorted("".join(s) for s in itertools.product("ua", repeat=8))
    trie = repair.Trie()
    for s in signatures:
        trie.go_to(s)
    assert trie.layers_made == len({s[:i] for s in signatures for i in range(9)})


def test_a_very_long_signature():
    trie = repair.Trie()
    trie.go_to("s" + "ua" * 20_000 + "d")
    assert trie.answer() == (4, "K" * 40_001 + "D")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        role, text = say(role), say(text)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())) for c, own in out.items()}


def plain(rows):
    found = {}
    for conv, own in damaged(rows).items():
        seen, signature, faults = set(), "", [0, 0, 0, 0]
        for _, role, text in own:
            last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "d" if fault in (1, 2) else initial.upper() if fault == 3 else initial
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest(signature)
        said, at, made = [], iter(own), ""
        for edit in audit:
            row = next(at) if edit != "I" else (None, "", "")
            if edit == "D":
                continue
            role = row[1] if edit == "K" else "assistant" if made.endswith("u") else "user"
            made += role[:1]
            said.append(f"{role}:{row[2]}")
        found[conv] = (gaps, *faults[1:], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return found


SCHEMA = "conv_id long, turn long, role string, text string"


def ours(df):
    found = {}
    for r in repair.repair(df).collect():
        assert r["conv_id"] not in found
        found[r["conv_id"]] = tuple(r[n] for n in (*repair.FIGURES, "audit", "repaired_sha256"))
    return found


def test_generated_conversations(spark):
    rng, rows = random.Random(6), []
    for conv in range(150):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn * rng.choice((1, 1, 2)), rng.choice(("user", "assistant", "system", "tool", "user", "assistant")), rng.choice(("Yes.", "No", "Yes.", " \t\n", "Is it so? ", "a.b", "é!", "x. y"))))
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


ODD = [
    (None, None, None, None), (None, 0, "user", "a null key."), (1, None, "user", "no turn."), (1, None, "assistant", "nor here."), (2, 3, "", "empty role."), (2, 3, "", "empty role."),
    (3, 1, "user", ""), (3, 2, "assistant", None), (4, 5, "user", "word " * 200_000 + "end."), (4, 9, "assistant", "Done!"), (5, 1, "user", "𝄞."), (5, 1, "assistant", "tie."), (5, 1, "user", "𝄞."), (5, 2, None, "role?"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS key_", "2 AS n", "3 AS signature", "4 AS kind_", "5 AS copy_", "6 AS cost")
    assert ours(df) == plain(ODD)
    assert ours(df.limit(0)) == {}


def test_conversations_whose_rows_are_all_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert ours(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("a, b, n", [("", "", 0), ("abc", "abd", 2), ("abc", "abc", 3), ("ab", "abc", 2), ("x", "y", 0)])
def test_common_prefix(a, b, n):
    assert repair.common_prefix(a, b) == n
