"""Removal of passages that occur before, by repeated-phrase automata.

Every window of W words has one phrase of K words that its content alone picks (the one with the smallest hash), so two
equal windows pick equal phrases. Documents first state the phrases that their windows pick, word by word; those stated
more than once are confirmed as recurring. Confirmed phrases are sharded with the documents that state them: for each
shard of some megabytes an Aho-Corasick automaton is compiled from its phrases, and the shard's documents stream through
it, which locates every occurrence. The windows around them are compared, first within the shard and then, by phrase,
across all shards. What starts a second time is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import hashed_words, mixed, rolled, slices, texts_of, written

#: Words of a window and of a phrase. W - K + 1 is a power of two: windows find their phrase by doubling.
W, K = 20, 5
#: Text of a shard: what one automaton is compiled for.
SHARD_BYTES = 4 << 20

#: A phrase that more rows hold than this is common: its windows are compared in parts, by digest, so that no task
#: holds more than about the windows of so many rows for one phrase.
COMMON_ROWS = 20_000

_LAST = np.iinfo(np.int64).max


def words_of(text: str) -> list[bytes]:
    """The words between white space (space, tab, line feed, vertical tab, form feed, carriage return), in UTF-8."""
    return text.encode().split()


class Shard:
    """The words of some documents on one line, the phrases at each word, and the phrase that each window picks.

    On the line every word stands between spaces, and documents end with a line feed.
    """

    def __init__(self, texts: list[str]) -> None:
        own = [b" ".join(words_of(t)) for t in texts]
        self.shas = [hashlib.sha256(x).hexdigest() for x in own]
        own = [b" %b \n" % x for x in own]
        self.line = b"".join(own)
        self.hashes, self.starts, self.sizes, self.begin, self.end = hashed_words(pa.array(own, pa.large_binary()))
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        n = len(self.hashes) - W + 1
        self.windows = np.zeros(0, np.int64)
        self.picked = self.windows
        self.phrases = np.zeros(0, np.uint64)
        if n <= 0:
            return
        self.phrases = mixed(rolled(self.hashes, K))
        least, at, width = self.phrases, np.arange(len(self.phrases)), 1
        while width < W - K + 1:
            a, b = least[:-width], least[width:]
            left = a <= b
            least, at = np.where(left, a, b), np.where(left, at[:-width], at[width:])
            width *= 2
        inside = np.arange(n) + W <= (self.starts + self.sizes)[self.doc[:n]]
        self.windows = np.nonzero(inside)[0]
        self.picked = at[:n][inside]

    def digests(self, windows: np.ndarray) -> np.ndarray:
        """A 64-bit digest of each window, independent of the phrases' hashes."""
        return mixed(rolled(self.hashes, W) ^ np.uint64(0xA5A5A5A5A5A5A5A5))[windows]

    def spelt(self, places: np.ndarray) -> list[bytes]:
        """The words of the phrases at some words, between single spaces."""
        return [self.line[a:b] for a, b in zip(self.begin[places].tolist(), self.end[places + K - 1].tolist(), strict=True)]

    def located(self, phrases: list[bytes]) -> np.ndarray:
        """For every word, whether one of ``phrases`` starts there: an automaton of the phrases' bytes reads the line once."""
        import ahocorasick

        found = np.zeros(len(self.hashes), bool)
        if not phrases:
            return found
        automaton = ahocorasick.Automaton()
        for p in phrases:
            automaton.add_word(f" {p.decode('latin-1')} ", len(p))
        automaton.make_automaton()
        begins = np.fromiter((end - n for end, n in automaton.iter(self.line.decode("latin-1"))), np.int64)
        found[np.searchsorted(self.begin, begins)] = True
        return found


def _runs(starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive starts in one document begin, and their lengths. Starts are ordered within documents."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (docs[1:] != docs[:-1])))
    first = np.nonzero(cut)[0]
    return first, np.diff(np.concatenate((first, [len(starts)])))


def _stated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, id, row, phrase, words, known): phrases that windows pick, once a document.

    What a shard already sees twice is known to recur: its rows are dealt by row, and one row without a document
    speaks for the shard. So however common a phrase is, few rows meet under it.
    """
    for batch in slices(batches, 2, SHARD_BYTES):
        shard = Shard(texts_of(batch.column(2)))
        ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        at = np.unique(shard.picked)
        order = np.lexsort((shard.doc[at], shard.phrases[at]))
        at = at[order]
        phrase, doc = shard.phrases[at], shard.doc[at]
        _, first, count = np.unique(phrase, return_index=True, return_counts=True)
        spoken = at[first[count > 1]]
        distinct = np.concatenate(([True], (phrase[1:] != phrase[:-1]) | (doc[1:] != doc[:-1])))[: len(at)]
        known, at, doc = np.repeat(count > 1, count)[distinct], at[distinct], doc[distinct]
        every = np.concatenate((at, spoken))
        phrase, silent = shard.phrases[every].view(np.int64), np.arange(len(every)) >= len(at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((np.where(known, rows[doc], phrase[: len(at)]), phrase[len(at) :]))),
                pa.array(np.concatenate((ids[doc], np.zeros(len(spoken), np.int64)))),
                pa.array(np.concatenate((rows[doc], np.zeros(len(spoken), np.int64))), mask=silent),
                pa.array(phrase),
                pa.array(shard.spelt(every), pa.binary()),
                pa.array(np.concatenate((known, np.zeros(len(spoken), bool)))),
            ],
            names=["at", "id", "row", "phrase", "words", "known"],
        )


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by phrase and words, those whose phrase recurs: (id, row, phrase, words). One row is held back, no more."""

    def chosen(table: pa.Table, recurs: np.ndarray) -> Iterator[pa.RecordBatch]:
        gone = np.asarray(table.column("row").combine_chunks().is_null())
        yield from table.select(["id", "row", "phrase", "words"]).filter(pa.array(recurs & ~gone)).to_batches()

    held: pa.Table | None = None
    repeats = False  # whether the row held back equals the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        phrase, words = table.column("phrase").to_numpy(), table.column("words").combine_chunks()
        same = phrase[1:] == phrase[:-1]
        same[same] = np.asarray(pa.compute.equal(words.take(pa.array(np.nonzero(same)[0] + 1)), words.take(pa.array(np.nonzero(same)[0]))))
        recurs = table.column("known").to_numpy().copy()
        recurs[1:] |= same
        recurs[:-1] |= same
        recurs[0] |= repeats
        repeats = bool(same[-1]) if len(same) else False
        yield from chosen(table.slice(0, table.num_rows - 1), recurs[:-1])
        held = table.slice(table.num_rows - 1)
    if held is not None:
        yield from chosen(held, held.column("known").to_numpy() | repeats)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams shards through their automata. Rows without a phrase describe documents, or windows that a shard itself shows to be later copies."""
    names = ["id", "row", "phrase", "part", "start", "n", "windows", "sha"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]

    def made(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[n], k) if n in columns else pa.nulls(count, k) for n, k in zip(names, kinds, strict=True)], names=names)

    for batch in slices(batches, 2, SHARD_BYTES):
        ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        shard = Shard(texts_of(batch.column(2)))
        yield made(len(rows), id=ids, row=rows, n=shard.sizes, sha=shard.shas)
        confirmed = dict(zip(*(c.to_pylist() for c in batch.column(3).flatten().flatten()), strict=True))
        found = shard.located(list(confirmed))
        split = {p: n for p, n in confirmed.items() if n > 1}
        common, shares = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if split:
            common = mixed(rolled(hashed_words(pa.array([b" %b " % p for p in split], pa.large_binary()))[0], K)[::K])
            order = np.argsort(common)
            common, shares = common[order], np.fromiter(split.values(), np.uint64)[order]
        candidate = found[shard.picked]
        window, picked = shard.windows[candidate], shard.picked[candidate]
        if not len(window):
            continue
        phrase, digest = shard.phrases[picked], shard.digests(window)
        doc = shard.doc[window]
        start, ident = window - shard.starts[doc], ids[doc]
        order = np.lexsort((start, ident, digest, phrase))
        p, d, i, s = phrase[order], digest[order], ident[order], start[order]
        fresh = np.concatenate(([True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])))
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        later = np.zeros(len(order), bool)
        later[order] = ~fresh & ((i != i[lead]) | (s != s[lead]))  # a repeated row is no earlier place
        kept = np.zeros(len(order), bool)
        kept[order] = fresh
        first, length = _runs(start[later], doc[later])
        if len(first):
            yield made(len(first), id=ident[later][first], row=rows[doc[later]][first], start=start[later][first], n=length)
        # for the comparison across shards: the rest by phrase, with the windows that one place of a phrase picks in one row
        window, picked, phrase, digest, doc, start, ident = (x[kept] for x in (window, picked, phrase, digest, doc, start, ident))
        often, part = np.isin(phrase, common), np.zeros(len(phrase), np.int32)
        part[often] = digest[often] % shares[np.searchsorted(common, phrase[often])]
        cut = np.concatenate(([True], (picked[1:] != picked[:-1]) | (window[1:] != window[:-1] + 1) | often[1:]))
        first = np.nonzero(cut)[0]
        offsets = np.concatenate((first, [len(window)])).astype(np.int32)
        windows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(digest.view(np.int64)))
        yield made(len(first), id=ident[first], row=rows[doc[first]], phrase=phrase[first].view(np.int64), part=part[first], start=start[first], windows=windows)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by phrase, part and place, the windows that a smaller place has: (id, row, start, n) in runs."""
    opened, seen, where = None, np.zeros(0, np.int64), {}
    for batch in batches:
        if not batch.num_rows:
            continue
        phrase, part, ident, row, start = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        group = np.concatenate(([0], np.cumsum((phrase[1:] != phrase[:-1]) | (part[1:] != part[:-1]))))
        lists = batch.column(5)
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        digest = lists.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(row)), sizes)
        step = np.arange(len(digest)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place, own = start[of] + step, group[of]
        order = np.lexsort((place, ident[of], digest, own))
        fresh = np.concatenate(([True], (own[order][1:] != own[order][:-1]) | (digest[order][1:] != digest[order][:-1])))
        lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]
        later = np.zeros(len(digest), bool)
        later[order] = (ident[of][order] != ident[of][lead]) | (place[order] != place[lead])
        if opened == (phrase[0], part[0]):
            for j in np.nonzero((own == 0) & np.isin(digest, seen))[0].tolist():
                later[j] = where[digest[j]] != (ident[of[j]], place[j])
        closing = group[-1]
        if opened != (phrase[-1], part[-1]):
            opened, seen, where = (phrase[-1], part[-1]), np.zeros(0, np.int64), {}
        for j in np.nonzero(own == closing)[0].tolist():
            where.setdefault(digest[j], (ident[of[j]], place[j]))
        seen = np.fromiter(where, np.int64, len(where))
        first, length = _runs(place[later], of[later])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ident[of][later][first], row[of][later][first], place[later][first], length)], names=["id", "row", "start", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the words of the stated windows: (id, row, n_removed, kept_sha256)."""
    for batch in slices(batches, 2):
        removed, shas = [], []
        for text, starts, lengths in zip(texts_of(batch.column(2)), batch.column(3), batch.column(4), strict=True):
            words = words_of(text)
            s = starts.values.to_numpy(zero_copy_only=False)
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, s, 1)
            np.add.at(edges, s + lengths.values.to_numpy(zero_copy_only=False) + W - 1, -1)
            stays = np.cumsum(edges)[:-1] == 0
            kept = [words[j] for j in np.nonzero(stays)[0].tolist()]
            removed.append(len(words) - len(kept))
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["id", "row", "n_removed", "kept_sha256"])


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, kept_sha256.

    A word is removed if a window of :data:`W` consecutive words of its document covers it whose words also stand
    earlier: in a document with a smaller id, or earlier in the same one. ``kept_sha256`` is of the kept words joined by
    one space. Windows are compared by phrase, word for word, and by a 64-bit digest. Whole texts are read, however long: a
    text longer than a shard is a shard of its own. Null and empty texts have no words; texts of fewer than W words lose none. Null ids come last in the
    order, with the largest long, and share one place. Rows with the same id are one document to the order: equal places don't remove each
    other, so a row given twice keeps its words in both. No rows in, no rows out. Other columns are not read.
    """
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    stated = docs.mapInArrow(_stated, "at long, id long, row long, phrase long, words binary, known boolean")
    dealt = stated.repartition("at").sortWithinPartitions("phrase", "words").drop("at")
    recurring = written(dealt.mapInArrow(_recurring, "id long, row long, phrase long, words binary"), "phrases")
    held = recurring.groupBy("phrase").agg(F.ceil(F.count(F.lit(1)) / COMMON_ROWS).cast("long").alias("parts")).where("parts > 1")
    confirmed = recurring.join(written(held, "common"), "phrase", "left")
    lists = confirmed.groupBy("id", "row").agg(F.collect_list(F.struct("words", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("phrases"))
    shards = docs.join(lists, ["id", "row"], "left").select("id", "row", "text", F.coalesce("phrases", F.array().cast("array<struct<words:binary,parts:bigint>>")).alias("phrases"))
    compared = written(shards.mapInArrow(_compared, "id long, row long, phrase long, part int, start long, n long, windows array<long>, sha string"), "windows")
    across = compared.where("phrase IS NOT NULL").select("phrase", "part", "id", "row", "start", "windows")
    later = across.repartition("phrase", "part").sortWithinPartitions("phrase", "part", "id", "start").mapInArrow(_resolved, "id long, row long, start long, n long")
    within = compared.where("phrase IS NULL AND sha IS NULL").select("id", "row", "start", "n")
    runs = later.unionByName(within).groupBy("id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("lengths"))
    cut = docs.join(runs, ["id", "row"]).select("id", "row", "text", "starts", "lengths").mapInArrow(_cut, "id long, row long, n_removed long, kept_sha256 string")
    whole = compared.where("sha IS NOT NULL").select("id", "row", "n", "sha")
    out = whole.join(cut.dropDuplicates(["id", "row"]), ["id", "row"], "left")
    ident = F.when(F.col("id") != F.lit(int(_LAST)), F.col("id"))
    return out.select(ident.alias(id_col), F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
