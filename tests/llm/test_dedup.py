"""Exact, near and passage deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkyard.llm import simhash
from chunkyard.llm import substring_dedup as substring
from chunkyard.llm.components import components
from chunkyard.llm.exact_dedup import exact_dedup, exact_groups, possibly_repeated
from chunkyard.llm.substring_dedup import W, substring_dedup

SCHEMA = "doc_id long, text string, id int, row string, phrase string, `odd.name` string"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 1, "r", "p", "x") for i, t in rows], SCHEMA).repartition(parts)


def strip(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        g = groups[strip(t)]
        first = min(g)
        keep = None if first[1] else first[2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out, key=str)


EXACT = [(1, "a b"), (2, "ab"), (3, "a  b\n"), (4, None), (5, ""), (6, " \t"), (7, "é x"), (8, "éx"), (9, "e x"), (None, "ab"), (10, "z" * 100_000), (11, "z" * 100_000), (12, "once only"), (2, "ab")]


def test_exact_groups(spark):
    got = [tuple(r) for r in exact_groups(frame(spark, EXACT)).collect()]
    assert sorted(got, key=str) == brute_exact(EXACT)
    assert exact_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_exact_groups_with_a_crowded_filter(spark, bits):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(30_000)}" if i % 3 else "hot") for i in range(20_000)]
    got = [tuple(r) for r in exact_groups(frame(spark, rows), bits=bits).collect()]
    assert sorted(got, key=str) == brute_exact(rows)


@pytest.mark.parametrize("broadcast_bits", [1 << 27, 1 << 10])
def test_filters_of_any_size_give_the_same_rows(spark, monkeypatch, broadcast_bits):
    from chunkyard.llm import exact_dedup as module

    monkeypatch.setattr(module, "BROADCAST_BITS", broadcast_bits)
    assert module.filter_bits(1 << 40) == 1 << 44
    rows = EXACT + [(100 + i, f"text {i % 700}") for i in range(2000)]
    got = [tuple(r) for r in exact_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_exact(rows)
    kept = exact_dedup(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    want = {(i, k) for i, k, *_ in brute_exact(rows) if i == k}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in want)


def test_filter_clears_most_single_rows_and_no_repeated_one(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") < 2000, F.col("id") % 7).otherwise(F.col("id")).cast("string").alias("key"))
    marked = possibly_repeated(keys, "key", 1 << 20)
    again = {r["key"] for r in marked.where("__again").collect()}
    assert {str(i) for i in range(7)} <= again
    assert len(again) < 200


def test_exact_dedup_keeps_whole_rows(spark):
    kept = exact_dedup(frame(spark, EXACT))
    assert kept.columns == frame(spark, []).columns
    ids = sorted((r["doc_id"], len(r["text"] or "")) for r in kept.collect())
    assert ids == [(3, 5), (6, 2), (7, 3), (9, 3), (10, 100_000), (12, 9)]
    assert exact_dedup(frame(spark, [])).count() == 0


def brute_fingerprint(text, shingle=3):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[j : j + k]), seed=42) for j in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=3):
    names = sorted(set(fps))
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in names:
        for b in names:
            if a < b and (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in names}


NEAR_BASE = "the quick brown fox jumps over the lazy dog while seven wizards box five dozen jugs of liquor " * 12
NEAR = [(i, NEAR_BASE + extra) for i, extra in ((5, ""), (3, " "), (9, "tail"), (8, "TAIL"), (7, "other tail"))] + [(20, None), (21, ""), (22, " \n"), (30, "one"), (31, "One"), (32, "one two"), (None, NEAR_BASE), (40, "x " * 70_000), (41, "y z"), (5, NEAR_BASE)]


def test_near_groups(spark):
    got = [tuple(r) for r in simhash.near_groups(frame(spark, NEAR)).collect()]
    fps = {t: brute_fingerprint(t) for _, t in NEAR}
    root = brute_components(fps.values())
    least = {}
    for i, t in NEAR:
        if i is not None:
            least[root[fps[t]]] = min(i, least.get(root[fps[t]], i))
    want = [(i, f"{fps[t]:016x}", least[root[fps[t]]]) for i, t in NEAR]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("pairwise", [2048, 4])
def test_close_links_find_every_close_pair(spark, monkeypatch, pairwise):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for base in list(fps[:20]):
        for _ in range(6):
            x = base
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.append(x)
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    if pairwise < 10:  # the workers have their own module: call the linear way here
        group = np.unique(np.array([fps[0] ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(8)] + [fps[0]], np.uint64))
        free = (1 << 33) - 1
        got = simhash._least_linked(group, free, 3)
        want = brute_components([int(x) for x in group])
        assert [int(group[g]) for g in got] == [want[int(x)] for x in group]
        return
    links = simhash.close_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    root = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_components([x & (1 << 64) - 1 for x in signed])
    same = {}
    for x in signed:
        same.setdefault(want[x & (1 << 64) - 1], set()).add(root.get(x, x))
    assert all(len(v) == 1 for v in same.values())
    assert len({next(iter(v)) for v in same.values()}) == len(same)


def test_components_of_a_long_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_prints(text):
    """Six fingerprints of two-word shingles and 256 bits of five-word shingles, in whole numbers."""
    m, base = (1 << 64) - 1, 0xD6E8FEB86659FD93

    def scrambled(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    hashes = [scrambled(sum((c + 1) * pow(base, j, 1 << 64) for j, c in enumerate(w)) & m) for w in (text or "").encode().lower().split()]
    vote = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    found = []
    for shingle, prints in ((2, 6), (5, 4)):
        k = min(shingle, len(hashes))
        own = []
        for j in range(len(hashes) - k + 1 if k else 0):
            x = 0
            for h in hashes[j : j + k]:
                x = x * 0x9E3779B97F4A7C15 + h & m
            own.append(scrambled(x))
        one = []
        for _ in range(prints):
            one.append(vote(own))
            own = [scrambled(x + 0x9E3779B97F4A7C15 & m) for x in own]
        found.append(one)
    return found


def near_by(a, b):
    """Whether two texts of :func:`brute_prints` meet (two equal blocks of five in one fingerprint) and are close (48 of 256 bits)."""
    edges = [64 * i // 5 for i in range(6)]
    blocks = lambda x: [x >> e & (1 << f - e) - 1 for e, f in zip(edges, edges[1:])]  # noqa: E731, B905
    meet = any(sum(x == y for x, y in zip(blocks(p), blocks(q), strict=True)) >= 2 for p, q in zip(a[0], b[0], strict=True))
    return meet and sum((x ^ y).bit_count() for x, y in zip(a[1], b[1], strict=True)) <= 48


def brute_near(rows):
    """Group names of rows by chains of near copies."""
    known = {}
    prints = [known.get(t) or known.setdefault(t, brute_prints(t)) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if near_by(prints[a], prints[b]):
                group[find(a)] = find(b)
    return [find(i) for i in range(len(rows))]


def edited_copies():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(25):
        base = [rng.choice(words) for _ in range(150)]
        for c in range(5):
            own = list(base)
            for _ in range(c):
                own[rng.randrange(150)] = rng.choice(words)
            rows.append((rng.randrange(10**6), " ".join(own)))
    return rows


@pytest.mark.parametrize("rows", [NEAR, edited_copies()], ids=["odd", "edited"])
def test_near_dedup_keeps_one_of_each_group(spark, rows):
    kept = simhash.near_dedup(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    want = {}
    for (i, t), g in zip(rows, brute_near(rows), strict=True):
        want.setdefault(g, set()).add((i is None, i or 0, t))
    stays = {min(g, key=lambda x: x[:2])[:2] for g in want.values()}
    got = {(r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()}
    assert got == stays
    if rows is not NEAR:
        assert 25 <= len(got) <= 27  # copies with up to four of 150 words changed are found, no two originals meet


def edited(rng, words, base, similarity, kind):
    """``base`` with changes of one kind until it shares less than ``similarity`` of its five-word shingles; and the similarity before the last."""
    shingles = lambda x: {tuple(x[j : j + 5]) for j in range(len(x) - 4)}
    own, now, first = list(base), 1.0, shingles(base)
    while True:
        new, at = list(own), rng.randrange(len(own))
        if kind == "replace":
            new[at] = rng.choice(words)
        elif kind == "insert":
            new.insert(at, rng.choice(words))
        elif kind == "delete":
            del new[at]
        else:  # a mixture
            new[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
        second = shingles(new)
        then = len(first & second) / len(first | second)
        if then < similarity:
            return own, now
        own, now = new, then


def found_share(similarity, kind, pairs=120, seed=5):
    """The share of edited copies of at least a similarity that are found, each compared with its original alone."""
    import pyarrow as pa

    from chunkyard.llm.common import hashed_words

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(pairs):
        base = [rng.choice(words) for _ in range(rng.randrange(80, 500))]
        texts += [" ".join(base), " ".join(edited(rng, words, base, similarity, kind)[0])]
    own = hashed_words(pa.array(texts))
    search, check = (simhash._many_prints(own, k, n).tolist() for k, n in ((simhash.SEARCH_SHINGLE, simhash.SEARCH_PRINTS), (simhash.NEAR_SHINGLE, simhash.NEAR_WORDS)))
    prints = list(zip(search, check, strict=True))
    return sum(near_by(a, b) for a, b in zip(prints[::2], prints[1::2], strict=True)) / pairs


@pytest.mark.parametrize("similarity", [0.94, 0.88, 0.82, 0.8])
def test_near_copies_of_four_fifths_are_found(similarity):
    shares = {kind: found_share(similarity, kind) for kind in ("replace", "insert", "delete", "mixture")}
    assert min(shares.values()) >= 0.9, shares


def test_texts_that_share_less_are_left_alone():
    assert max(found_share(s, "mixture") for s in (0.5, 0.4)) <= 0.05


def test_groups_cut_by_batches_stay_whole():
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((rng.randrange(3), rng.randrange(12), i) for i in range(200))
    for size in (1, 2, 7, 64, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], names=["t", "k", "v"]) for i in range(0, 200, size)]
        got = [[tuple(int(c[j]) for c in columns) for j in range(a, b)] for columns, starts, ends in simhash._whole_groups(iter(batches), 2) for a, b in zip(starts, ends, strict=True)]
        want = {}
        for r in rows:
            want.setdefault(r[:2], []).append(r)
        assert got == [g for g in want.values() if len(g) > 1]


def test_reached_is_exact():
    rng = random.Random(3)
    group = sorted({rng.getrandbits(12) << 20 for _ in range(200)})
    got = simhash._reached(np.array(group, np.uint64)[:, None], 2)
    want = brute_components(group, 2)
    assert [group[g] for g in got] == [want[x] for x in group]


def brute_passages(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (t or "").encode().split()
        for s in range(len(words) - W + 1):
            place = ((i is None, i or 0), s)
            key = tuple(words[s : s + W])
            first[key] = min(first.get(key, place), place)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        stays = [True] * len(words)
        for s in range(len(words) - W + 1):
            if first[tuple(words[s : s + W])] < ((i is None, i or 0), s):
                stays[s : s + W] = [False] * W
        kept = b" ".join(w for w, ok in zip(words, stays, strict=True) if ok)
        out.append((i, len(words), stays.count(False), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += [word() for _ in range(rng.randrange(0, 40))]
            if rng.random() < 0.6:
                words += rng.choice(shared)
        rows.append((rng.randrange(10 * n) * n + i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("seed,vocabulary,common", [(1, 5000, 1000), (2, 40, 1000), (3, 3, 1000), (4, 5000, 2), (5, 40, 2)])
def test_substring_dedup(spark, monkeypatch, seed, vocabulary, common):
    monkeypatch.setattr(substring, "COMMON_ROWS", common)
    rows = passages(seed, 60, vocabulary)
    rows += [(-1, None), (-2, ""), (-3, "a"), (-4, "loop " * 3000), (-5, "é x " * 25), (None, rows[3][1]), rows[5], (10**12, rows[5][1])]
    got = [tuple(r) for r in substring_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_passages(rows)


def test_automaton_finds_phrases_word_for_word():
    shard = substring.Shard(["a b c d e f a b c d e", "xa b c d e", None or "", "b c d e\n f a", "b c d ef a", "d e f", "a b c"])
    found = shard.located([b"a b c d e", b"b c d e f", b"not in the text here"])
    words = [w for t in ("a b c d e f a b c d e", "xa b c d e", "b c d e f a", "b c d ef a", "d e f", "a b c") for w in [*t.split()]]
    assert len(found) == len(words)
    assert np.nonzero(found)[0].tolist() == [0, 1, 6, 16]
    assert shard.spelt(np.array([1])) == [b"b c d e f"]
    assert not substring.Shard(["a b c d e"]).located([]).any()


def test_recurring_phrases_over_batches():
    import pyarrow as pa

    rng = random.Random(11)
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("phrase", pa.int64()), ("words", pa.binary()), ("known", pa.bool_())])
    rows = sorted(((rng.randrange(9), rng.choice([i, None]) if i % 5 == 0 else i, rng.randrange(40), rng.choice([b"x", b"y"]), rng.random() < 0.1) for i in range(120)), key=lambda r: (r[2], r[3]))
    want = sorted((i, r, p, w) for i, r, p, w, known in rows if r is not None and (known or sum((p, w) == (q, v) for _, _, q, v, _ in rows) > 1))
    for size in (1, 2, 3, 50, 120):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[a : a + size]], schema) for a in range(0, 120, size)]
        got = [tuple(r.values()) for b in substring._recurring(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == want


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(frame(spark, [])).count() == 0
