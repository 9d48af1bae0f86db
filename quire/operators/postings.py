"""Postings as tasks hold them, in numpy and Arrow: made of documents' tokens, packed for the way to their file, merged and laid out there.

What moves is a packed piece for each file and some millions of tokens, not a row for each term of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that a task holds before it sends them to their files, and tokens of a batch of rows of a file.
HELD_TOKENS, BATCH_TOKENS = 2_000_000, 200_000
Places = tuple[np.ndarray, np.ndarray]


class Postings(NamedTuple):
    """Rows, each a term in a block or in a part of one, their entries one after the other, and the positions of these likewise."""

    terms: pa.Array
    block: np.ndarray
    entries: np.ndarray
    at: np.ndarray
    column: np.ndarray
    z: np.ndarray
    times: np.ndarray
    positions: np.ndarray


def _in_order(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different terms by their bytes, as Spark orders them, and the place of each."""
    order = pc.sort_indices(terms).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return terms.take(pa.array(order)), rank


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Whether each key differs from the one before."""
    return np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))


def _of_lists(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the elements of lists, one list after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _by_digits(x: np.ndarray, order: np.ndarray | None) -> np.ndarray:
    """The stable order of whole numbers from 0 on that stand in this order: 16 bits at a time, which numpy sorts by counting."""
    for shift in range(0, max(1, int(x.max(initial=0)).bit_length()), 16):
        digit = (x >> shift).astype(np.uint16)
        order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return order


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


#: Bytes of tokens: ASCII letters and digits, and whatever is not ASCII.
_OF_TOKENS = np.array([chr(i).isalnum() or i > 127 for i in range(256)])


def _token_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's bytes, which of them are of tokens, where tokens start, where texts do and the last one ends, and how many tokens each has."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    found = texts.buffers()[2]
    data = np.frombuffer(found, np.uint8)[ends[0] : ends[-1]] if found is not None and len(texts) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    of_tokens = _OF_TOKENS[data]
    starts = of_tokens.copy()
    starts[1:] &= ~of_tokens[:-1]
    inner = ends[:-1][ends[:-1] < len(data)]
    starts[inner] = of_tokens[inner]  # a text may begin where one ends
    starts = np.flatnonzero(starts)
    return data, of_tokens, starts, ends, np.diff(np.searchsorted(starts, ends))


def _spaced(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Each text as its tokens with a space between two, and their number."""
    data, keep, starts, ends, sizes = _token_bytes(texts)
    data = np.where(keep, data, np.uint8(32))
    later = np.ones(len(starts), bool)
    later[_starts(sizes)[sizes > 0]] = False
    keep[starts[later] - 1] = True
    offsets = np.append(0, np.cumsum(keep))[ends].astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data[keep])), sizes


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of texts, and their number by text."""
    data, of_tokens, starts, _, sizes = _token_bytes(texts)
    before = np.append(0, np.cumsum(of_tokens))
    offsets = before[np.append(starts, len(data))].astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[of_tokens])), sizes


def spaced(n_columns: int) -> Callable:
    """For mapInArrow: doc, key, n_tokens and texts t0, t1 ... as _spaced(), from such with any other ASCII characters between tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            made = [_spaced(batch.column(f"t{k}")) for k in range(n_columns)]
            n = np.sum([sizes for _, sizes in made], axis=0).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "key": batch.column("key"), "n_tokens": pa.array(n)} | {f"t{k}": texts for k, (texts, _) in enumerate(made)})

    return run


def inverted(doc: np.ndarray, texts: list[pa.Array], bits: int) -> Postings:
    """Of documents of one block, with a text for each column as spaced() makes it; some must have a token."""
    found = [_tokens(x) for x in texts]
    lists, sizes = [x for x, _ in found], [n for _, n in found]
    z = np.sum(sizes, axis=0)
    coded = pc.dictionary_encode(pa.concat_arrays(lists))
    terms, rank = _in_order(coded.dictionary)
    of_doc = np.concatenate([np.repeat(np.arange(len(doc)), n) for n in sizes])
    of_column = np.repeat(np.arange(len(lists)), [n.sum() for n in sizes])
    position = np.concatenate([np.arange(n.sum()) - np.repeat(_starts(n), n) for n in sizes])
    own, term = of_doc * len(lists) + of_column, rank[coded.indices.to_numpy()]
    order = _by_digits(term, _by_digits(own, None))  # positions stay in order
    named = (term * (len(doc) * len(lists)) + own)[order]
    entry = np.flatnonzero(_firsts(named))
    own, column = np.divmod(named[entry], len(lists))
    term, place = np.divmod(own, len(doc))
    row = np.flatnonzero(_firsts(term))
    return Postings(
        terms.take(pa.array(term[row])), np.full(len(row), doc[0] >> bits), np.diff(np.append(row, len(term))), doc[place] & ((1 << bits) - 1), column, z[place], np.diff(np.append(entry, len(named))), position[order]
    )


def _ordered(terms: pa.Array, term: np.ndarray, doc: np.ndarray, rest: tuple[np.ndarray, ...], bits: int, part_tokens: int) -> Postings:
    """Of entries (place of the term among terms in order, document, and column, z, times and positions) in any order.

    A term has one row for a block, and more where it has over part_tokens tokens there; a document is in one of these.
    """
    column, z, times, positions = rest
    block, at, width = doc >> bits, doc & ((1 << bits) - 1), int(column.max()) + 1
    near = block - block.min()
    if len(terms) * (int(near.max()) + 1) * (width << bits) >= 1 << 62:
        near = np.unique(block, return_inverse=True)[1]
    key = ((term * (int(near.max()) + 1) + near) << bits | at) * width + column
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        positions = positions[_of_lists(_starts(times)[order], times[order])]
        key, term, block, at, column, z, times = (x[order] for x in (key, term, block, at, column, z, times))
    begins = _firsts(key // (width << bits))
    before = np.cumsum(times) - times
    part = (before - before[begins][np.cumsum(begins) - 1]) // part_tokens
    if part.any():
        first = _firsts(key // width)
        part = part[first][np.cumsum(first) - 1]  # of a document's first entry
        begins |= _firsts(part)
    row = np.flatnonzero(begins)
    return Postings(terms.take(pa.array(term[row])), block[row], np.diff(np.append(row, len(key))), at, column, z, times, positions)


def _joined(pieces: list[Postings]) -> Postings:
    return Postings(pa.concat_arrays([p.terms for p in pieces]), *(np.concatenate(x) for x in list(zip(*pieces))[1:]))


def merged(pieces: list[Postings], bits: int, part_tokens: int) -> Postings:
    """All their entries, in order of term, block, document and column."""
    every = _joined(pieces)
    coded = pc.dictionary_encode(every.terms)
    terms, rank = _in_order(coded.dictionary)
    term = np.repeat(rank[coded.indices.to_numpy()], every.entries)
    doc = np.repeat(every.block << bits, every.entries) | every.at
    return _ordered(terms, term, doc, every[4:], bits, part_tokens)


def renumbered(batch: pa.RecordBatch, bits: int, part_tokens: int) -> Postings | None:
    """Of rows with term, held (at being a place from offset on) and offset, the document from which a block's documents go on."""
    held = batch.column("held")
    sizes = pc.list_value_length(held).to_numpy().astype(np.int64)
    entry = held.flatten()
    if not len(entry):
        return None
    positions = entry.field("positions")
    coded = pc.dictionary_encode(batch.column("term"))
    terms, rank = _in_order(coded.dictionary)
    whole = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(whole(batch.column("offset")), sizes) + whole(entry.field("at"))
    rest = (whole(entry.field("c")), whole(entry.field("z")), whole(pc.list_value_length(positions)), whole(positions.flatten()))
    return _ordered(terms, np.repeat(rank[coded.indices.to_numpy()], sizes), doc, rest, bits, part_tokens)


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers from 0 on: first their lowest bytes, then the next ones, as many as the greatest has."""
    n = (int(x.max(initial=0)).bit_length() + 7) // 8
    return n, np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def packed(p: Postings) -> bytes:
    terms = p.terms.take(pa.array(np.arange(len(p.terms))))  # without an offset
    sizes = pc.binary_length(terms).to_numpy()
    text = terms.buffers()[2].to_pybytes()[: sizes.sum()]
    planes = [_planes(x) for x in (sizes, *p[1:])]
    head = np.array([len(p.terms), len(p.at), len(p.positions), len(text), *(n for n, _ in planes)], "<i8").tobytes()
    body = head + b"".join(x for _, x in planes) + text
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def unpacked(piece: bytes) -> Postings:
    body = memoryview(pa.Codec("zstd").decompress(piece[8:], int.from_bytes(piece[:8], "little"), asbytes=True))
    rows, entries, positions, _, *widths = np.frombuffer(body[: 8 * 12], "<i8").tolist()
    at, found = 8 * 12, []
    for width, n in zip(widths, (rows, rows, rows, entries, entries, entries, entries, positions), strict=True):
        made = np.zeros((n, 8), np.uint8)
        made[:, :width] = np.frombuffer(body[at : at + width * n], np.uint8).reshape(width, n).T
        found.append(made.view("<i8").reshape(n))
        at += width * n
    offsets = np.append(0, np.cumsum(found[0])).astype(np.int32)
    return Postings(pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(body[at:])), *found[1:])


def file_of(terms: pa.Array, block: np.ndarray, part: int, places: Places, files: int) -> np.ndarray:
    """The file of each row, terms being in order: by the term's place, and if it fills much of a file or more, by its block and part."""
    known, begins = places
    names = terms.to_numpy(zero_copy_only=False)
    if len(known) < len(names):
        at = np.searchsorted(np.searchsorted(names, known, side="right"), np.arange(len(names)), side="right")
    else:
        at = np.searchsorted(known, names)
    place = begins[at]
    found = np.flatnonzero(at < len(known))
    found = found[known[at[found]] == names[found]]
    width = begins[at[found] + 1] - begins[at[found]]
    found, width = found[width > 0.5], width[width > 0.5]
    row = np.arange(len(found))
    parts = part + row - np.maximum.accumulate(np.where(_firsts(block[found]) | _firsts(names[found]), row, 0))
    place[found] += width * (((block[found] + (parts << 44)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) / float(1 << 64))
    return np.minimum(place.astype(np.int64), files - 1)


def _by_file(p: Postings, file: np.ndarray) -> Iterator[tuple[int, Postings]]:
    """The rows of each file."""
    if (file[1:] < file[:-1]).any():
        order = np.argsort(file, kind="stable")
        entry = _of_lists(_starts(p.entries)[order], p.entries[order])
        positions = p.positions[_of_lists(_starts(p.times)[entry], p.times[entry])]
        file, p = file[order], Postings(p.terms.take(pa.array(order)), p.block[order], p.entries[order], *(x[entry] for x in p[3:7]), positions)
    entry, position = np.append(0, np.cumsum(p.entries)), np.append(0, np.cumsum(p.times))
    firsts = np.flatnonzero(_firsts(file))
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(file)]):
        c, d = entry[a], entry[b]
        yield int(file[a]), Postings(p.terms.slice(a, b - a), p.block[a:b], p.entries[a:b], *(x[c:d] for x in p[3:7]), p.positions[position[c] : position[d]])


def dealt(made: Iterable[tuple[Postings, int]], places: Places | None, files: int) -> Iterator[pa.RecordBatch]:
    """file and piece of postings, each with the number of its part of a block, whose rows are in order of terms."""
    held: dict[int, list[Postings]] = {}
    n = 0

    def sent() -> pa.RecordBatch:
        found = sorted(held)
        return pa.RecordBatch.from_pydict({"file": pa.array(found, pa.int32()), "piece": pa.array([packed(_joined(held.pop(f))) for f in found], pa.binary())})

    for p, part in made:
        file = file_of(p.terms, p.block, part, places, files) if places is not None else np.zeros(len(p.block), np.int64)
        for f, own in _by_file(p, file):
            held.setdefault(f, []).append(own)
        n += len(p.positions)
        if n >= HELD_TOKENS:
            n = 0
            yield sent()
    if held:
        yield sent()


def from_tokens(n_columns: int, bits: int, part_tokens: int, places: Places | None, files: int) -> Callable:
    """For mapInArrow: pieces of documents, given as spaced() makes them, in order of doc."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Postings, int]]:
        waiting: list[pa.RecordBatch] = []  # of one block
        block, n, part = -1, 0, 0

        def made() -> Iterator[tuple[Postings, int]]:
            if n:
                whole = waiting[0] if len(waiting) == 1 else pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                yield inverted(whole.column("doc").to_numpy(), [whole.column(f"t{k}") for k in range(n_columns)], bits), part
            waiting.clear()

        for batch in batches:
            own, length = batch.column("doc").to_numpy() >> bits, batch.column("n_tokens").to_numpy()
            starts = np.flatnonzero(_firsts(own))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
                if own[a] != block:
                    yield from made()
                    block, n, part = own[a], 0, 0
                while a < b:
                    end = a + int(np.searchsorted(n + np.cumsum(length[a:b]), part_tokens)) + 1
                    end = min(end, b)
                    waiting.append(batch.slice(a, end - a))
                    n += int(length[a:end].sum())
                    if n >= part_tokens:
                        yield from made()
                        n, part = 0, part + 1
                    a = end
        yield from made()

    return lambda batches: dealt(blocks(batches), places, files)


def from_postings(bits: int, part_tokens: int, places: Places | None, files: int) -> Callable:
    """For mapInArrow: pieces of rows of postings, see renumbered()."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Postings, int]]:
        for batch in batches:
            if (p := renumbered(batch, bits, part_tokens)) is not None:
                yield p, 0

    return lambda batches: dealt(blocks(batches), places, files)


def schema(columns: list[str]) -> str:
    most = ", ".join(f"`{c}`: int" for c in columns)
    return f"term string, block long, n_docs int, n_tokens int, most struct<{most}>, least long, held array<struct<at: int, c: int, z: long, positions: array<int>>>"


def _rows(p: Postings, columns: list[str]) -> Iterator[pa.RecordBatch]:
    entry = np.append(0, np.cumsum(p.entries))
    position = np.append(0, np.cumsum(p.times))
    cuts = np.flatnonzero(_firsts(position[entry[:-1]] // BATCH_TOKENS))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(p.block)]):
        c, d = entry[a], entry[b]
        row, times, column, z, at = entry[a:b] - c, p.times[c:d], p.column[c:d], p.z[c:d], p.at[c:d]
        first = _firsts(at)
        first[row] = True
        places = p.positions[position[c] : position[d]].astype(np.int32)
        held = pa.StructArray.from_arrays(
            [
                pa.array(at.astype(np.int32)),
                pa.array(column.astype(np.int32)),
                pa.array(z),
                pa.ListArray.from_arrays(pa.array((position[c : d + 1] - position[c]).astype(np.int32)), pa.array(places)),
            ],
            ["at", "c", "z", "positions"],
        )
        most = [pa.array(np.maximum.reduceat(np.where(column == k, times, 0), row).astype(np.int32)) for k in range(len(columns))]
        yield pa.RecordBatch.from_pydict(
            {
                "term": p.terms.slice(a, b - a),
                "block": pa.array(p.block[a:b]),
                "n_docs": pa.array(np.add.reduceat(first.astype(np.int32), row).astype(np.int32)),
                "n_tokens": pa.array(np.add.reduceat(times, row).astype(np.int32)),
                "most": pa.StructArray.from_arrays(most, columns),
                "least": pa.array(np.minimum.reduceat(z, row)),
                "held": pa.ListArray.from_arrays(pa.array((entry[a : b + 1] - c).astype(np.int32)), held),
            }
        )


def laid_out(columns: list[str], bits: int, part_tokens: int) -> Callable:
    """For mapInArrow: the rows of a file, in order of term and block, from its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [unpacked(x.as_py()) for batch in batches for x in batch.column("piece")]
        if pieces:
            yield from _rows(merged(pieces, bits, part_tokens), columns)

    return run
