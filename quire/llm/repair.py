"""Repair of conversations' structure at least cost, by dynamic programming over a trie of signatures.

A row's symbol says what an edit of it may be: its role's initial, whether it must go and whether it is cut off. A
conversation's symbols in order are its signature. Distinct signatures are dealt to ranges and sorted, so that a range's
signatures walk a prefix trie depth first: a stack holds one layer of costs for each node on the way to the present one,
and a signature adds layers only for what it does not share with the one before. At its end the layers are read
backwards for all cheapest edits, and forwards for the least string of them.

Edits: K keeps a row (0), R gives it another role (3), D deletes it (4), I inserts an empty turn (3); a row that is cut off
and not deleted costs 3 more. What is left must be an optional system turn and at least one exchange of user and
assistant, or nothing.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.joins import by_counted_key
from quire.llm.text import ordered_by_key, slices
from quire.session import cut

BATCH_ROWS = 500
#: What stands for a null, in damage and afterwards.
NULL = " "
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
END_MARKS = "[.!?]"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 3, 4, 3, 3

#: States of what is left so far: nothing, a system turn, a user turn last, an assistant turn last.
STATES = NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
FINAL = (NOTHING, ANSWERED)
#: By state: the role that a new or changed turn must have there, and the state after it.
NEXT = {NOTHING: ("user", ASKED), SYSTEM: ("user", ASKED), ASKED: ("assistant", ANSWERED), ANSWERED: ("user", ASKED)}
#: By state and initial: the state after a kept turn.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): ASKED, (SYSTEM, "u"): ASKED, (ANSWERED, "u"): ASKED, (ASKED, "a"): ANSWERED}
FAR = 1 << 60
#: Symbols: a row that must go, and by initial (others are x) whole and cut-off rows.
GONE, OTHER = "d", "x"


def symbol(initial: Column, gone: Column, cut_off: Column) -> Column:
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    return F.when(gone, GONE).when(cut_off, F.upper(known)).otherwise(known)


class Trie:
    """The layers from the root to the node of the present prefix; layer i holds the least cost of each state after i rows."""

    def __init__(self):
        self.prefix, self.costs, self.layers_made = "", array("q", self._inserted([0, FAR, FAR, FAR])), 1

    @staticmethod
    def _inserted(layer: list[int]) -> list[int]:
        """The layer, with turns inserted after its rows."""
        for state in (NOTHING, SYSTEM, ANSWERED, ASKED, ANSWERED):  # an insertion leads to ASKED or ANSWERED only
            after = NEXT[state][1]
            layer[after] = min(layer[after], layer[state] + INSERT_COST)
        return layer

    @staticmethod
    def edits(sign: str, state: int) -> Iterable[tuple[str, int, int]]:
        """Edit, cost and next state for a row with this symbol."""
        yield DELETE, DELETE_COST, state
        if sign != GONE:
            extra = CUT_COST if sign.isupper() else 0
            if (state, sign.lower()) in KEPT:
                yield KEEP, extra, KEPT[state, sign.lower()]
            yield REROLE, REROLE_COST + extra, NEXT[state][1]

    def go_to(self, signature: str) -> None:
        """Back to the last node shared with this signature, then down; each new node gets its layer once."""
        shared = common_prefix(self.prefix, signature)
        del self.costs[4 * (shared + 1) :]
        for sign in signature[shared:]:
            layer, last = [FAR] * 4, self.costs[-4:]
            for state in STATES:
                for _, cost, after in self.edits(sign, state):
                    layer[after] = min(layer[after], last[state] + cost)
            self.costs.extend(self._inserted(layer))
            self.layers_made += 1
        self.prefix = signature

    def answer(self) -> tuple[int, str]:
        """Least cost at this node, and the ASCII-least string of cheapest edits that gives it."""
        n, costs = len(self.prefix), self.costs
        least = min(costs[4 * n + state] for state in FINAL)
        # which states lie on a cheapest way, from the last layer to the first
        live = bytearray(4 * (n + 1))
        for state in FINAL:
            live[4 * n + state] = costs[4 * n + state] == least
        for i in range(n, -1, -1):
            if i < n:
                for state in STATES:
                    live[4 * i + state] = any(live[4 * (i + 1) + after] and costs[4 * i + state] + cost == costs[4 * (i + 1) + after] for _, cost, after in self.edits(self.prefix[i], state))
            for _ in range(2):
                for state in STATES:
                    after = NEXT[state][1]
                    if live[4 * i + after] and costs[4 * i + state] + INSERT_COST == costs[4 * i + after]:
                        live[4 * i + state] = 1
        said, i, state = [], 0, NOTHING
        while i < n or state not in FINAL or costs[4 * i + state] != least:
            spent = costs[4 * i + state]
            ways = [(INSERT, i, spent + INSERT_COST, NEXT[state][1])]
            if i < n:
                ways += [(edit, i + 1, spent + cost, after) for edit, cost, after in self.edits(self.prefix[i], state)]
            edit, i, _, state = min(w for w in ways if live[4 * w[1] + w[3]] and costs[4 * w[1] + w[3]] == w[2])
            said.append(edit)
        return least, "".join(said)


def common_prefix(a: str, b: str) -> int:
    """How many characters both begin with, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def answers(signatures: DataFrame) -> DataFrame:
    """signature, n, cost and audit of each distinct signature; n is how many rows have it."""
    distinct = signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in slices(batches, BATCH_ROWS):
            found = []
            for signature in batch.column("signature").to_pylist():
                trie.go_to(signature)
                found.append(trie.answer())
            yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("n"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["signature", "n", "cost", "audit"])

    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(walk, "signature string, n long, cost long, audit string")


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows key_, turn_, role_, text_ after damage by a checksum of key and turn: dropped (kept as dropped_), emptied, without end marks, doubled, or given to the user."""
    of = lambda c: F.coalesce(c.cast("string"), F.lit(NULL))
    kind = F.crc32(F.encode(F.concat(of(F.col(key)), F.lit(":"), of(F.col(turn))), "UTF-8")) % 20
    plain = rows.select(F.col(key).alias("key_"), F.col(turn).alias("turn_"), of(F.col(role)).alias("role_"), of(F.col(text)).alias("text_"), kind.alias("kind_"))
    text_now = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.regexp_replace("text_", END_MARKS, "")).otherwise(F.col("text_"))
    role_now = F.when(F.col("kind_") == 4, "user").otherwise(F.col("role_"))
    copies = F.when(F.col("kind_") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.select("key_", "turn_", role_now.alias("role_"), text_now.alias("text_"), (F.col("kind_") == 0).alias("dropped_"), F.explode(copies).alias("copy_"))


#: Order of a conversation's rows: by turn, nulls first; rows of one turn by role, then by a digest of the text.
ORDER = ["turn_", "role_", "mark_"]


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mark_", F.unhex(F.md5("text_")))


def _signatures(rows: DataFrame, kind: str) -> DataFrame:
    """One row per conversation: its signature and counts, from rows without their texts."""
    last = F.regexp_extract("text_", f"({NOT_SPACE})[\\x20\\x09-\\x0D]*\\z", 1)
    narrow = _marked(rows).select("key_", "turn_", "role_", "dropped_", "mark_", (last == "").alias("blank_"), (~last.rlike(END_MARKS)).alias("open_"))
    # the first row of a role and text within its conversation: one local order more, on the same deal of rows
    dealt = narrow.repartition("key_")
    same = Window.partitionBy("key_", "role_", "mark_", "dropped_").orderBy("turn_")
    seen = dealt.withColumn("again_", F.row_number().over(same) > 1)
    ordered = seen.select(
        "key_", "turn_", "dropped_", F.substring("role_", 1, 1).alias("initial_"), "role_", "mark_", F.when(F.col("blank_"), 1).when(F.col("again_"), 2).when(F.col("open_"), 3).otherwise(0).alias("fault_")
    ).sortWithinPartitions("key_", *ORDER)
    names = ["key_", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out(own: pa.DataType) -> pa.RecordBatch:
            made = [pa.array(c, t) for c, t in zip(zip(*done), [own, pa.string(), *[pa.int64()] * 5])]
            done.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            own = batch.schema.field("key_").type
            for key, turn, dropped, initial, fault, sign in zip(*(batch.column(n).to_pylist() for n in ("key_", "turn_", "dropped_", "initial_", "fault_", "sign_"))):
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = Folded(key)
                if not dropped:
                    now.add(turn, initial, fault, sign)
            if len(done) >= BATCH_ROWS:
                yield out(own)
        if now is not None:
            done.append(now.row())
            yield out(own)

    signed = ordered.select("key_", "turn_", "dropped_", "initial_", "fault_", symbol(F.col("initial_"), F.col("fault_").isin(1, 2), F.col("fault_") == 3).alias("sign_"))
    return signed.mapInArrow(fold, f"key_ {kind}, signature string, " + ", ".join(f"{n} long" for n in names[2:]))


class Folded:
    """Signature and counts of a conversation whose rows come in order."""

    LEGAL = frozenset(("su", "ua", "au"))

    def __init__(self, key):
        self.key, self.signs, self.first, self.last, self.turns, self.before, self.illegal, self.faults = key, [], None, None, 0, None, 0, [0, 0, 0, 0]

    def add(self, turn, initial: str, fault: int, sign: str) -> None:
        self.signs.append(sign)
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in self.LEGAL
        self.before = initial
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.key, "".join(self.signs), gaps, *self.faults[1:], self.illegal


#: Figures of a conversation, all long.
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def apply_edits(rows: DataFrame, plans: DataFrame, kind: str) -> DataFrame:
    """conv_id, the plan's figures, audit and repaired_sha256: a plan comes before its rows, which are edited and digested as they pass."""
    texts = _marked(rows.where("NOT dropped_")).select("key_", F.lit(1).alias("part_"), "turn_", "role_", "mark_", "text_")
    heads = plans.select("key_", F.lit(0).alias("part_"), *(F.lit(None).cast(texts.schema[n].dataType).alias(n) for n in ("turn_", "role_", "mark_")), F.col("audit").alias("text_"), F.array(*FIGURES).alias("figures_"))
    ordered = ordered_by_key(heads.unionByName(texts, allowMissingColumns=True), "key_", ["part_", *ORDER]).select("key_", "part_", "role_", "text_", "figures_")
    names = ["conv_id", *FIGURES, "audit", "repaired_sha256"]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out(own: pa.DataType) -> pa.RecordBatch:
            made = [pa.array(c, t) for c, t in zip(zip(*done), [own, *[pa.int64()] * len(FIGURES), pa.string(), pa.string()])]
            done.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for batch in slices(batches, BATCH_ROWS):
            own = batch.schema.field("key_").type
            for key, part, role, text, figures in zip(*(batch.column(n).to_pylist() for n in ("key_", "part_", "role_", "text_", "figures_"))):
                if part == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Edited(key, figures, text)
                else:
                    now.add(role, text)
            if len(done) >= BATCH_ROWS:
                yield out(own)
        if now is not None:
            done.append(now.row())
            yield out(own)

    return ordered.mapInArrow(edit, f"conv_id {kind}, {', '.join(f'{n} long' for n in FIGURES)}, audit string, repaired_sha256 string")


class Edited:
    """A conversation under repair: which edit is next, the state so far and the digest of what is left."""

    def __init__(self, key, figures: list[int], audit: str):
        self.key, self.figures, self.audit, self.at, self.state, self.digest, self.any = key, figures, audit, 0, NOTHING, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == INSERT:
            role, self.state = NEXT[self.state]
            self._say(role, "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = KEPT[self.state, role[:1]]
            self._say(role, text)
        elif edit == REROLE:
            new, self.state = NEXT[self.state]
            self._say(new, text)

    def row(self) -> tuple:
        self._insert()
        return self.key, *self.figures, self.audit, self.digest.hexdigest()


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damaged: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its cheapest repair, and a digest of the repaired turns.

    damaged, by default damage(rows), has the rows to repair. Null roles and texts are one space; null turns come first;
    rows of one turn go by role, then by a digest of the text, so copies are neighbours; a null key is a conversation;
    long texts stay whole; other columns are not read; an empty table gives no rows. Texts move once; rows of a
    conversation pass through a task as a stream, which holds its signature and edits, a character for each row.
    """
    kind = rows.schema[key].dataType.simpleString()
    damaged = damage(rows, key, turn, role, text) if damaged is None else damaged
    signed = cut(_signatures(damaged, kind))
    plans = by_counted_key(signed, cut(answers(signed)), "signature", "n")
    return apply_edits(damaged, plans, kind)
