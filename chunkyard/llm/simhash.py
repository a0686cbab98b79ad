"""Near-duplicates by SimHash fingerprints, with pigeonhole blocks for the search of close pairs.

A fingerprint is cut into blocks; two that differ in at most d bits agree in all but d of them. Every choice of
blocks - d of them is a key, so each close pair meets under some key. Distinct fingerprints meet there, Hamming distances are
verified, and links become components. Copies with one fingerprint never meet one by one: they count as one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import hashed_words, mixed, rolled, slices, texts_of, written
from chunkyard.llm.components import components

SEED = 42
#: Fingerprints link at so many differing bits or fewer.
DISTANCE = 3
#: Blocks of a fingerprint; keys join BLOCKS - DISTANCE of them, here 20 keys of at least 31 bits.
BLOCKS = 6
#: Under one key, up to so many fingerprints are compared pair by pair; more are looked up by their neighbours.
PAIRWISE = 2048


#: Texts that share four fifths of their five-word shingles differ in 15 % of the bits of fingerprints of those shingles, too many
#: for blocks to find them. So candidates are found by fingerprints of two-word shingles, of which such texts differ in at
#: most 10 % where their differences are scattered: each of the six is cut into five blocks, and two are a key (60 keys of 25 bits).
SEARCH_SHINGLE, SEARCH_PRINTS, SEARCH_BLOCKS, SEARCH_SHARED = 2, 6, 5, 2
#: Candidates are verified by a fingerprint of 256 bits of their five-word shingles: at a similarity of 0.8 they differ in 39 bits on
#: average with a deviation of 6; texts of a similarity below 0.6 differ in 59 or more on average.
NEAR_SHINGLE, NEAR_WORDS, NEAR_DISTANCE = 5, 4, 48


def fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """The SimHash of a text: ASCII-lower-cased words between white space, shingles with repeats, XXH64, majority of bits."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    return int(_majority(hashes, np.zeros(1, np.int64))[0])


#: Byte j of entry i is bit j of i: adding entries counts eight bits at once, up to 255 times.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes that starts at one of ``first``, the bits set in over half of them."""
    cuts = np.unique(np.concatenate((first, np.arange(0, len(hashes), 255))))
    ends = np.append(cuts[1:], len(hashes))
    sums = np.empty((len(cuts), 8), np.uint64)
    for i in range(0, len(cuts), 1024):
        low, high = cuts[i], ends[min(i + 1024, len(cuts)) - 1]
        spread = _SPREAD[hashes[low:high].view(np.uint8).reshape(-1, 8)]
        sums[i : i + 1024] = np.add.reduceat(spread, cuts[i : i + 1024] - low, axis=0)
    counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64).astype(np.int64), np.searchsorted(cuts, first), axis=0)
    sizes = np.diff(np.append(first, len(hashes)))
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _many_prints(words: tuple[np.ndarray, ...], shingle: int, n_prints: int) -> np.ndarray:
    """``n_prints`` SimHashes of each text, from its words' hashes; texts shorter than a shingle count as one, empty texts have zeros."""
    hashes, starts, sizes, *_ = words
    out = np.zeros((len(sizes), n_prints), np.uint64)
    for k in range(1, shingle + 1):
        texts = np.nonzero(sizes == k if k < shingle else sizes >= k)[0]
        if not len(texts):
            continue
        own = sizes[texts] - k + 1
        first = np.cumsum(own) - own
        at = np.arange(own.sum()) + np.repeat(starts[texts] - first, own)
        shingles = mixed(rolled(hashes, k))[at]
        for i in range(n_prints):
            out[texts, i] = _majority(shingles, first)
            shingles = mixed(shingles + np.uint64(0x9E3779B97F4A7C15))
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed long. Null texts count as empty; an empty text's fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of the keys: every choice of blocks - distance of the blocks, signed."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Of rows sorted by their first ``keys`` columns: arrays of whole groups, where groups of two or more rows start, and where they end."""
    parts: list[list[np.ndarray]] = []

    def out():
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        new = np.zeros(max(0, len(columns[0]) - 1), bool)
        for c in columns[:keys]:
            new |= c[1:] != c[:-1]
        starts = np.concatenate(([0], np.nonzero(new)[0] + 1))
        ends = np.append(starts[1:], len(columns[0]))
        several = ends - starts > 1
        return columns, starts[several], ends[several]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        open_group = np.ones(len(new[0]), bool)  # rows of the group that the batch ends in
        for c in new[:keys]:
            open_group &= c == c[-1]
        rest = int(np.argmax(open_group))
        if rest or parts and any(parts[-1][j][-1] != new[j][0] for j in range(keys)):
            parts.append([c[:rest] for c in new])
            yield out()
            parts = []
        parts.append([c[rest:] for c in new])
    if parts:
        yield out()


def _least_linked(fps: np.ndarray, free: int, distance: int) -> np.ndarray:
    """For sorted distinct fingerprints that agree outside the bits ``free``: the smallest index each one reaches."""
    n = len(fps)
    if n > PAIRWISE and distance > DISTANCE:
        return _reached(fps[:, None], distance)
    if n <= PAIRWISE:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
        a, b = np.nonzero(near)
    else:  # look up every neighbour: linear in n, however many share the key
        bits = [1 << i for i in range(64) if free >> i & 1]
        found = []
        for k in range(1, distance + 1):
            for c in combinations(bits, k):
                at = np.searchsorted(fps, other := fps ^ np.uint64(sum(c)))
                hit = np.nonzero(fps[np.minimum(at, n - 1)] == other)[0]
                found.append((hit, at[hit]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    labels, before = np.arange(n), None
    while before is None or (labels != before).any():
        before = labels.copy()
        np.minimum.at(labels, a, before[b])
        labels = labels[labels]
    return labels


def _reached(prints: np.ndarray, distance: int) -> np.ndarray:
    """For rows of 64-bit words: the smallest row that each reaches. Each takes all it links to out of those not reached, so groups of copies soon run empty."""
    labels = np.full(len(prints), -1)
    left = np.arange(len(prints))
    while len(left):
        root, todo = left[0], [left[0]]
        left = left[1:]
        labels[root] = root
        while todo and len(left):
            near = np.bitwise_count(prints[left] ^ prints[todo.pop()]).sum(axis=1, dtype=np.int64) <= distance
            new, left = left[near], left[~near]
            labels[new] = root
            todo += new.tolist()
    return labels


def _pairs(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _keys(print_: Column, number: int, masks: list[int]) -> list[Column]:
    """The keys of a fingerprint: (t, k), t telling fingerprints and choices of blocks apart."""
    return [F.struct(F.lit(number * len(masks) + i).alias("t"), print_.bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]


def close_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(u, v) links that join exactly the distinct values of ``fp`` that chains of at most ``distance`` bits join.

    Under each key a fingerprint links to the smallest one that it reaches there, so links grow with fingerprints and
    not with pairs.
    """
    masks = block_masks(blocks, distance)
    spread = fps.select("fp", F.explode(F.array(*_keys(F.col("fp"), 0, masks))).alias("key")).select("key.t", "key.k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, _, fp), starts, ends in _whole_groups(batches, 2):
            us, vs = [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                group = np.sort(fp[a:b].view(np.uint64))
                least = _least_linked(group, ~masks[t[a]] & (1 << 64) - 1, distance)
                moved = np.nonzero(least != np.arange(len(group)))[0]
                us.append(group[moved])
                vs.append(group[least[moved]])
            yield _pairs(us, vs)

    dealt = spread.repartition("t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInArrow(run, "u long, v long")


def _verified_links(held: DataFrame, which: range) -> DataFrame:
    """(u, v) links of ``node`` by the search fingerprints ``which``: rows that meet under a key link if their 256-bit fingerprints are close."""
    masks = block_masks(SEARCH_BLOCKS, SEARCH_BLOCKS - SEARCH_SHARED)
    keys = F.explode(F.array(*[k for i in which for k in _keys(F.col("prints")[i], i, masks)]))
    spread = held.select(keys.alias("key"), "node", *[F.col("check")[j].alias(f"c{j}") for j in range(NEAR_WORDS)]).select("key.t", "key.k", "node", *[f"c{j}" for j in range(NEAR_WORDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, node, *words), starts, ends in _whole_groups(batches, 2):
            us, vs = [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                own = node[a:b]
                if (own == own[0]).all():
                    continue
                order = np.argsort(own, kind="stable")
                least = _reached(np.column_stack([w[a:b] for w in words])[order].view(np.uint64), NEAR_DISTANCE)
                u, v = own[order], own[order][least]
                us.append(u[u != v])
                vs.append(v[u != v])
            yield _pairs(us, vs)

    return spread.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(run, "u long, v long")


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = DISTANCE, blocks: int = BLOCKS
) -> DataFrame:
    """(id, fingerprint, component_id) for every row: components of fingerprints that differ in at most ``distance`` bits.

    ``fingerprint`` is 16 lower-case hexadecimal digits, ``component_id`` the smallest id that a row reaches, its own
    included. Null and empty texts have fingerprint zero and link like any other. Null ids reach others and never name a
    component unless all ids of it are null. Repeated rows get one row each. Whole texts count, however long. No rows in, no
    rows out. Other columns are not read.
    """
    rows = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    nodes = components(close_links(classes.select("fp"), distance, blocks))
    rooted = classes.join(nodes, classes.fp == nodes.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "classes")
    named = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    labels = written(rooted.join(named, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each group of near copies, with all their columns.

    Near copies are texts whose ASCII-lower-cased words share four fifths or more of their five-word shingles, as SimHash tells:
    texts that agree in two of five blocks of any of :data:`SEARCH_PRINTS` fingerprints link if they differ in at most
    :data:`NEAR_DISTANCE` of 256 bits, and groups are the components of links. It is an estimate: what it finds at each
    similarity is measured in the README and held by a test. The smallest id stays, null ids last, then an arbitrary but
    fixed one. Null and empty texts are copies of each other; texts of fewer than five words are near copies only of the
    same words. Whole texts count, however long. Rows repeated with id and text stay or go together. No rows in, no rows out.
    Texts shuffle only if the rows to drop are too many to be sent to every task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            words = hashed_words(pa.compute.ascii_lower(batch.column(1)))
            lists = []
            for shingle, n in ((SEARCH_SHINGLE, SEARCH_PRINTS), (NEAR_SHINGLE, NEAR_WORDS)):
                prints = _many_prints(words, shingle, n).view(np.int64)
                lists.append(pa.FixedSizeListArray.from_arrays(pa.array(prints.reshape(-1)), n).cast(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["who", "prints", "check"])

    mark = F.xxhash64(F.col(text_col))
    who = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), mark.alias("mark"))
    kind = df.select(who.alias("who")).schema["who"].dataType.simpleString()
    rows = written(df.select(who.alias("who"), F.col(text_col).alias("text")).mapInArrow(run, f"who {kind}, prints array<long>, check array<long>"), "fingerprints")
    classes = rows.groupBy("prints", "check").agg(F.min("who").alias("stays"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed once they are written
    held = classes.select("prints", "check", "stays", "node")
    for which in (range(1), range(1, SEARCH_PRINTS)):  # what the first joins is one node to the rest, so a large group is linked once
        roots = written(components(_verified_links(held, which)), "roots")
        moved = held.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
        held = written(moved.select("prints", "check", "stays", F.coalesce("root", "node").alias("node")), "nodes")
    named = held.groupBy("node").agg(F.min("stays").alias("kept"))
    of_print = held.join(named, "node").select("prints", "check", "kept")
    told = rows.join(of_print, ["prints", "check"]).where("NOT (who <=> kept)")
    dropped = written(told.select(F.col("who.id").alias("__id"), F.col("who.mark").alias("__mark")).distinct(), "dropped")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(id_col).alias("__own"), mark.alias("__key"))
    gone = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__mark"))
    return rows.join(dropped, gone, "left_anti").select("__row.*")
