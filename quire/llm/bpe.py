"""BPE encoding and decoding for a vocabulary with word ends, read from a tokenizer's JSON file.

A text is parted at the special tokens, normalised (NFC, white space to one space, lower case) and cut into words. A
word starts as one part per byte; an array holds the rank of each adjacent pair; the least rank, leftmost of ties, is
found by a scan, its boundary deleted and both neighbouring ranks refreshed, until no pair has a rank. Long words take
a heap over linked parts, which deletes the same boundaries in the same order without a scan for each.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import slices, whole

# White space, and the pattern that cuts words.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CUT = f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{WHITE}\\p{{L}}\\p{{N}}]+"
END = "</w>"
#: Bytes of a word up to which ranks are scanned, and entries of each generation of a worker's cache.
SCANNED = 96
CACHED = 300_000
BATCH_ROWS = 500
NO_RANK = 1 << 30


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where Latin-1 prints it, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Cache(dict):
    """String to its ids as little-endian bytes, computed when missing. Two generations bound it: full, it becomes the old one."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= SCANNED:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + END] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.chunks = Cache(self.encode_chunk)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.white, self.cut = re.compile(f"[{WHITE}]+"), regex.compile(CUT)

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        return self.scan(ids) if len(ids) <= SCANNED else self.heap(ids)

    def scan(self, ids: list[int]) -> list[int]:
        rank = self.ranks.get
        at = [rank(ids[i] << 20 | ids[i + 1], NO_RANK) for i in range(len(ids) - 1)]
        while at and (least := min(at)) < NO_RANK:
            i = at.index(least)
            ids[i] = self.made[least]
            del ids[i + 1], at[i]
            if i:
                at[i - 1] = rank(ids[i - 1] << 20 | ids[i], NO_RANK)
            if i < len(at):
                at[i] = rank(ids[i] << 20 | ids[i + 1], NO_RANK)
        return ids

    def heap(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1], NO_RANK)) < NO_RANK]
        heapq.heapify(waiting)
        while waiting:
            least, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[least], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank(ids[x] << 20 | ids[y], NO_RANK)) < NO_RANK:
                    heapq.heappush(waiting, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_chunk(self, chunk: str) -> bytes:
        """The ids of a stretch without white space, over which no word and no composition of characters reaches."""
        if not chunk.isascii() and not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = chunk.lower() if "Σ" not in chunk else "".join(c.lower() for c in chunk)  # no final form of sigma
        found = self.cut.findall(chunk)
        if found == [chunk]:
            return array("I", self.encode_word(chunk)).tobytes()
        return b"".join(map(self.chunks.__getitem__, found))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, little-endian, four bytes each; a null text is empty."""
        out = []
        for piece in self.parts.split(text or "") if self.parts else [text or ""]:
            if piece in self.special:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
            elif piece:
                out += map(self.chunks.__getitem__, self.white.split(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens joined by spaces, as the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, the columns in carry and, if asked for, the ids.

    The driver reads the tokenizer's file and broadcasts it, a fixed size. Null and empty texts have no token; texts of any length
    are encoded whole; repeated rows give repeated results; an empty table gives no rows; other columns are not read. A worker holds one batch of texts and a bounded word cache.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(content.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, BATCH_ROWS):
            ids = [vocab.encode(t) for t in batch.column("body").to_pylist()]
            decoded = [sha(vocab.decode(x).encode("utf-8", "surrogatepass")) for x in ids]
            made = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array(map(sha, ids), pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                made["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
            kept = {n: batch.column(n) for n in batch.schema.names if n != "body"}
            yield pa.RecordBatch.from_pydict(kept | made)

    kept = [F.col(key).alias("doc_id"), *(F.col(c) for c in carry)]
    rows = docs.select(*kept, whole(F.col(text)).alias("body"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body"])
    return rows.mapInArrow(run, schema + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
