"""Hierarchical packing of token streams into training windows of several lengths.

Each document is routed by length to a tier of context sizes, each tier is packed, gaps of long windows are filled
from shorter tiers, and full windows are dealt into step groups of equal token counts. Everything happens where a
document is read: a task packs the documents of its partition, so nothing shuffles and no task sees more than a block
of documents at once.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from chunkyard.llm.common import slices, texts_of

#: Context sizes; the last is the window that short sequences are padded to.
TIERS = (256, 512, 1024, 2048)
#: Documents are packed in blocks of at most so many ids (16 MB).
BLOCK_IDS = 1 << 22
#: Sequences of a step group hold about so many tokens together, of whatever tiers.
STEP_TOKENS = 1 << 16
#: Ends every document.
END_ID = 1

SCHEMA = "{id} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def byte_bpe(vocabulary: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """Text to the ids that ``<vocabulary>.json`` gives without special tokens added; a special token's string in a text is that token.

    Between such strings it runs on the vocabulary's rank file, which gives the same ids in a quarter of the time; the
    tests hold both against each other.
    """
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{vocabulary} has added tokens that are not plain strings")
        special = {t["content"]: t["id"] for t in added}
        apart = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        plain = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(text: str) -> list[int]:
            if not any(t in text for t in special):
                return plain(text)
            ids, at = [], 0
            for m in apart.finditer(text):
                ids += plain(text[at : m.start()])
                ids.append(special[m[0]])
                at = m.end()
            return ids + plain(text[at:])

        _ENCODERS[vocabulary] = encode
    return _ENCODERS[vocabulary]


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """The group of each sequence: as few groups as hold ``step_tokens`` on average, the longest sequences first, each to the emptiest group."""
    open_groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, out[i] = open_groups[0]
        heapreplace(open_groups, (load + sizes[i], out[i]))
    return out


class Shelf:
    """Pieces of one tier by length; gives the longest that fits, or the shortest."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.stacks: dict[int, list] = {}

    def put(self, length: int, piece) -> None:
        stack = self.stacks.get(length)
        if stack is None:
            self.stacks[length] = [piece]
            self.lengths.insert(bisect_left(self.lengths, length), length)
        else:
            stack.append(piece)

    def _take(self, at: int):
        length = self.lengths[at]
        stack = self.stacks[length]
        piece = stack.pop()
        if not stack:
            del self.stacks[length], self.lengths[at]
        return length, piece

    def fitting(self, most: int):
        at = bisect_right(self.lengths, most)
        return self._take(at - 1) if at else None

    def shortest(self):
        return self._take(0) if self.lengths else None


class Packer:
    """Packs (document, start, length) pieces; ``emit(pieces, used)`` gets each finished sequence."""

    def __init__(self, tiers: tuple[int, ...], emit: Callable[[list, int], None]) -> None:
        self.tiers, self.emit = tiers, emit
        self.shelves = [Shelf() for _ in tiers]

    def _route(self, doc, start: int, length: int) -> None:
        self.shelves[bisect_left(self.tiers, length)].put(length, (doc, start))

    def add(self, doc, length: int) -> None:
        """A document: whole windows of the longest tier leave at once, the rest is routed to the tier that holds it."""
        top, start = self.tiers[-1], 0
        while length - start >= top:
            self.emit([(doc, start, top)], top)
            start += top
        if length > start:
            self._route(doc, start, length - start)

    def _fill(self, tier: int, gap: int, window: list) -> int:
        """Closes a gap: whole pieces of this and shorter tiers while any fits, then the head of one that doesn't."""
        while gap:
            for shelf in reversed(self.shelves[: tier + 1]):
                if found := shelf.fitting(gap):
                    length, (doc, start) = found
                    window.append((doc, start, length))
                    gap -= length
                    break
            else:
                cut = next((x for s in self.shelves if (x := s.shortest())), None)
                if cut is None:
                    return gap
                length, (doc, start) = cut
                window.append((doc, start, gap))
                self._route(doc, start + gap, length - gap)
                gap = 0
        return 0

    def pack(self) -> None:
        """Packs all that is held, longest tier first. What is left over at the end fills windows of falling powers of two."""
        for tier in reversed(range(len(self.tiers))):
            size, shelf = self.tiers[tier], self.shelves[tier]
            while found := shelf.fitting(size):
                length, (doc, start) = found
                window = [(doc, start, length)]
                gap = self._fill(tier, size - length, window)
                if gap:
                    self._tail(window, size - gap)
                else:
                    self.emit(window, size)

    def _tail(self, window: list, used: int) -> None:
        while used:
            size = 1 << used.bit_length() - 1
            room, taken = size, []
            while room:
                doc, start, length = window.pop(0)
                n = min(room, length)
                taken.append((doc, start, n))
                if n < length:
                    window.insert(0, (doc, start + n, length - n))
                room -= n
            self.emit(taken, size)
            used -= size


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    vocabulary: str = "byte_bpe_50k",
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece of a document: where it starts and how long it is, its ids' CRC-32, its sequence and offset there.

    Every id of a document lies in exactly one piece, and each document ends with id 1; a null or empty text is that id
    alone. Sequences of a tier are full; what a task has left over at the end of a block fills sequences of falling
    powers of two, so none needs padding. ``tier`` is a sequence's length. ``step_group`` deals the sequences of a block, of all
    tiers, into groups of about equal token counts near ``step_tokens`` (:func:`step_groups`). Null ids are
    carried; repeated rows are packed once each; texts longer than a block make a block of their own, in memory at once.
    Of pieces of one length the last read is taken first. No rows in, no rows out. Other columns are not read. Sequences are
    numbered within each partition from a base of its own: the numbers are unique and depend on how the input is split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary)
        base = TaskContext.get().partitionId() << 32
        schema = pa.schema([(n, pa.int64()) for n in (id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("tier", pa.int32()), ("step_group", pa.int64())])
        sequences, groups, held = 0, 0, {}
        sizes: list[int] = []
        out: list[tuple] = []

        def emit(pieces: list, used: int) -> None:
            offset = 0
            for doc, start, length in pieces:
                ident, ids = held[doc]
                out.append((ident, start, length, zlib.crc32(ids[start : start + length]), len(ids), len(sizes), offset, used))
                offset += length
            sizes.append(used)

        def flush() -> pa.RecordBatch:
            nonlocal sequences, groups
            dealt = step_groups(sizes, step_tokens)
            columns = [np.array(c) if i else c for i, c in enumerate(zip(*out, strict=True))]
            of = np.array(dealt, np.int64)[columns[5]] + (base + groups)
            columns[5] = columns[5] + (base + sequences)
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, of], schema, strict=True)], schema=schema)
            sequences, groups = sequences + len(sizes), groups + max(dealt) + 1
            sizes.clear()
            out.clear()
            return rows

        packer, waiting = Packer(tiers, emit), 0
        for batch in slices(batches, 1, 4 << 20):
            for ident, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = encode(text)
                ids.append(END_ID)
                doc = len(held)
                held[doc] = (ident, np.array(ids, dtype="<u4"))
                packer.add(doc, len(ids))
                waiting += len(ids)
                if waiting >= BLOCK_IDS:
                    packer.pack()
                    held.clear()
                    waiting = 0
                    yield flush()
        if waiting:
            packer.pack()
            yield flush()

    return df.select(id_col, text_col).mapInArrow(run, SCHEMA.format(id=f"`{id_col}`"))
