"""Exact search, mixing, and the pipeline, against brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkyard.llm import topk_search as search
from chunkyard.llm.common import drop_scratch, written
from chunkyard.llm.mixing import leaf_budgets, mix_sources, shared_out

# --- search


def brute_topk(rows, asked, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(1024 * x) for x in v]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in asked if i is not None and ok(v)}:
        found = [(-sum(a * b for a, b in zip(whole(v), whole(qv), strict=True)), i is None, i or 0) for i, v in rows if ok(v) and i != q and len(v) == len(qv)]
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, id int").repartition(3)


@pytest.mark.parametrize("size", [11_600.0, 2e5, 3e6, 1e12, 1e300])
def test_large_components_are_scored_exactly(spark, size):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * (size if i % 3 else 1.0) for _ in range(64)]) for i in range(60)]
    asked = rows[:7]
    df = vectors(spark, rows, "double")
    got = [tuple(r) for r in search.topk_search(df, vectors(spark, asked, "double"), 5).collect()]
    nearest = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in rows}
    want = []
    for q, _ in asked:
        best = sorted((-nearest(sum(a * b for a, b in zip(whole[i], whole[q], strict=True))), i) for i, _ in rows if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n,dims,grid", [(400, 8, 0), (300, 3, 2), (5, 4, 0)])
def test_topk(spark, monkeypatch, n, dims, grid):
    rng = random.Random(n)
    draw = lambda: float(np.float32(rng.gauss(0, 0.3) if not grid else rng.randrange(-grid, grid + 1) / 4))
    rows = [(i, [draw() for _ in range(dims)]) for i in range(n)]
    rows += [(n + 1, None), (n + 2, [None] * dims), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] * dims), (n + 5, [0.5] * (dims + 1)), (None, [0.5] * dims), (100, [0.0] * dims), (3, rows[3][1]), (n + 200, [])]
    monkeypatch.setattr(search, "BLOCK_ROWS", 128)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 2)
    df = vectors(spark, rows)
    got = [tuple(r) for r in search.topk_search(df, df.where("vec_id % 50 = 0")).collect()]
    assert sorted(got, key=str) == brute_topk(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 10)


def test_topk_of_nothing(spark):
    df = vectors(spark, [(1, [1.0, 2.0])])
    assert search.topk_search(df.limit(0), df).count() == 0
    assert search.topk_search(df, df.limit(0)).count() == 0
    assert search.topk_search(df, df).count() == 0


def test_index_stops_early_and_stays_exact():
    rng = np.random.default_rng(7)
    rows = rng.integers(-300, 300, (3000, 16))
    rows[:40] *= 6
    index = search.ImpactIndex(rows)
    fewer = 0
    for q in rows[:60]:
        possible, scores = index.top(q, 10, np.zeros(len(rows), bool))
        assert (scores == rows[possible] @ q).all()
        best = np.sort(rows @ q)[-10:]
        assert (np.sort(scores)[-10:] == best).all()
        fewer += len(possible) < len(rows) // 10
    assert fewer >= 40


# --- mixing


def brute_budgets(tokens, weights, budget, max_epochs):
    """Tokens for every leaf (a tuple of names), down the tree by recursion."""

    def down(prefix, leaves, amount):
        if len(leaves) == 1 and leaves[0] == prefix:
            return {prefix: amount}
        families = {}
        for leaf in leaves:
            families.setdefault(leaf[: len(prefix) + 1], []).append(leaf)
        capacity = {c: max_epochs * sum(tokens[x] for x in own) for c, own in families.items()}
        shares = shared_out(amount, capacity, {c: weights.get(c, 1.0) for c in families})
        return {k: v for c, own in families.items() for k, v in down(c, own, shares[c]).items()}

    return down((), sorted(tokens), budget) if tokens else {}


def test_shared_out():
    assert shared_out(100, {"a": 1000, "b": 1000}, {"a": 3, "b": 1}) == {"a": 75, "b": 25}
    assert shared_out(100, {"a": 30, "b": 1000, "c": 1000}, {"a": 2, "b": 1, "c": 1}) == {"a": 30, "b": 35, "c": 35}
    assert shared_out(100, {"a": 30, "b": 20}, {"a": 1, "b": 1}) == {"a": 30, "b": 20}
    assert shared_out(10, {"a": 0, "b": 7, "c": 9}, {"a": 5, "b": 0, "c": 1}) == {"a": 0, "b": 1, "c": 9}
    assert shared_out(10, {"a": 99, "b": 99, "c": 99}, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    rng = random.Random(8)
    for _ in range(300):
        names = range(rng.randrange(1, 7))
        capacity = {c: rng.randrange(0, 50) for c in names}
        got = shared_out(budget := rng.randrange(0, 200), capacity, {c: rng.choice([0, 0.5, 1, 3]) for c in names})
        assert sum(got.values()) == min(budget, sum(capacity.values())) and all(0 <= got[c] <= capacity[c] for c in names)


def test_shortages_go_to_siblings_before_ancestors():
    tokens = {("web", "en", "a"): 10, ("web", "en", "b"): 1000, ("web", "de", "c"): 1000, ("books", "en", "d"): 1000}
    got = brute_budgets(tokens, {("web",): 1, ("books",): 1}, 400, 1)
    assert got == {("web", "en", "a"): 10, ("web", "en", "b"): 90, ("web", "de", "c"): 100, ("books", "en", "d"): 200}
    short = brute_budgets({**tokens, ("web", "en", "b"): 20}, {}, 400, 1)
    assert short == {("web", "en", "a"): 10, ("web", "en", "b"): 20, ("web", "de", "c"): 170, ("books", "en", "d"): 200}
    assert brute_budgets({}, {}, 5, 1) == {}


@pytest.mark.parametrize("leaves", [40, 120_000])
def test_budgets_level_by_level(spark, leaves):
    rng = random.Random(leaves)
    tokens = {(f"d{i % 3}", f"l{i % 5 % 2}", f"s{i}"): rng.choice([0, 1, 5, 40, 1000]) for i in range(leaves)}
    weights = {("d0",): 3.0, ("d1",): 0.0, ("d2", "l1"): 0.25, ("d0", "l0", "s0"): 50.0}
    budget = sum(tokens.values()) * 2 // 3
    stats = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "a string, b string, c string, n long").repartition(3)
    got = {(r["a"], r["b"], r["c"]): r["budget"] for r in leaf_budgets(stats, ["a", "b", "c"], weights, budget, 2).collect()}
    assert got == brute_budgets(tokens, weights, budget, 2)
    assert sum(got.values()) == budget
    assert leaf_budgets(stats.limit(0), ["a", "b", "c"], weights, 0, 2).count() == 0



def words(text):
    return len((text or "").encode().split())


MIX = [(i, f"t{i} " * (i % 9), ["en", "de", None][i % 3], "s0" if i % 3 == 0 else f"s{i % 5}") for i in range(4000)] + [(5000, None, "en", "s1"), (5001, "", None, None), (None, "x y", "en", "s2"), (7, "t7 " * 7, "de", "s2"), (6000, "big " * 50_000, "fr", "s9")]


@pytest.mark.parametrize("share,epochs,weights", [(0.5, 1, {}), (1.0, 4, {("en",): 5.0, ("en", "s1"): 3.0}), (2.0, 3, {("fr",): 0.01})])
def test_mix_sources(spark, share, epochs, weights):
    df = spark.createDataFrame([(*r, 1, "x") for r in MIX], "doc_id long, text string, lang string, source string, epoch int, n string").repartition(3)
    levels = {"language": F.col("lang"), "leaf": F.col("source")}
    got = mix_sources(df, levels, weights, share, epochs, seed=11).collect()
    tokens = {}
    for _, t, lang, source in MIX:
        leaf = (lang or "", source or "")
        tokens[leaf] = tokens.get(leaf, 0) + words(t)
    budgets = brute_budgets(tokens, weights, int(share * sum(tokens.values())), epochs)
    keys = {(r["i"], r["t"], r["e"]): r["k"] for e in range(epochs + 1) for r in df.select(F.col("doc_id").alias("i"), F.col("text").alias("t"), F.lit(e).alias("e"), F.xxhash64(F.lit(11), F.lit(e).cast("long"), F.xxhash64("doc_id", "text")).alias("k")).collect()}
    want = []
    for leaf, budget in budgets.items():
        own = [r for r in MIX if (r[2] or "", r[3] or "") == leaf]
        full, rest = divmod(budget, tokens[leaf]) if tokens[leaf] else (0, 0)
        by_key = {}
        for r in own:
            by_key.setdefault(keys[r[0], r[1], full], []).append(r)
        taken, prefix = 0, set()
        for k in sorted(by_key):
            if taken >= rest:
                break
            prefix.add(k)
            taken += sum(words(r[1]) for r in by_key[k])
        for r in own:
            copies = full + (keys[r[0], r[1], full] in prefix)
            want += [(r[0], words(r[1]), e) for e in range(copies)]
    assert sorted([(r["doc_id"], r["n_tokens"], r["epoch"]) for r in got], key=str) == sorted(want, key=str)
    assert mix_sources(df.limit(0), levels, weights).count() == 0


# --- pipeline


def brute_pipeline_dedup(rows):
    from tests.llm.test_dedup import brute_near, strip

    best = {}
    for r in rows:
        key = strip(r["text"])
        if key not in best or (-len(r["text"]), r["doc_id"]) < (-len(best[key]["text"]), best[key]["doc_id"]):
            best[key] = r
    exact = list(best.values())
    least = {}
    for r, g in zip(exact, brute_near([(r["doc_id"], r["text"]) for r in exact]), strict=True):
        least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    return {r["doc_id"] for r in exact}, set(least.values())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = {x: [f"{x}{rng.randrange(300)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(60)] for x in ("en", "fr")}
    texts = [(" ".join(rng.choice(vocabulary[x]) for _ in range(rng.randrange(20, 90))), x) for x in ["en", "fr"] * 60]
    rows = [(i, t, x, f"src{i % 7}", len(t)) for i, (t, x) in enumerate(texts)]
    rows += [(200 + i, rows[i][1] + " \n", rows[i][2], "src1", 1) for i in range(15)] + [(300, "", "en", "src1", 0), (301, "12 34", "en", "src2", 5), (302, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mixture", "packing"]
    docs = written(stages["language_id"](spark, df, str(tmp_path)), "test")
    assert docs.columns == df.columns
    kept = docs.collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows} - {300, 301, 302}
    exact, near = brute_pipeline_dedup(kept)
    docs = written(stages["exact_dedup"](spark, docs, str(tmp_path)), "test")
    assert docs.columns == df.columns and {r["doc_id"] for r in docs.collect()} == exact and docs.count() == len(exact)
    docs = written(stages["simhash_near_dedup"](spark, docs, str(tmp_path)), "test")
    assert docs.columns == df.columns and {r["doc_id"] for r in docs.collect()} == near
    mixed = written(stages["source_mixture"](spark, docs, str(tmp_path)), "test")
    assert mixed.columns == df.columns and {r["doc_id"] for r in mixed.collect()} <= near
    pieces = stages["packing"](spark, mixed, str(tmp_path))
    held = pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {r["doc_id"] for r in held} == set(copies)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == sum(r["n"] for r in held)
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    drop_scratch(spark)


CLASHING = ["id", "mark", "__row", "__key", "__own", "__id", "__mark", "prior", "kept", "keep_id", "component_id", "sequence_id", "n_tokens", "epoch", "domain", "leaf_source", "who", "node", "prints", "host", "language", "accepted", "confidence", "__c4", "a.b"]


def test_stages_with_clashing_columns_nulls_and_long_texts(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    vocabulary = {x: [f"{x}{rng.randrange(300)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(60)] for x in ("en", "fr")}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    rows = [(i, text(x, 40), x, f"src{i % 3}") for i, x in enumerate(["en", "fr"] * 30)]
    rows += [(100, text("en", 60_000), "en", "src1"), (101, rows[0][1], "en", "src2"), (None, text("fr", 50), "fr", None), (102, text("en", 30), None, ""), (103, None, None, None), (104, "", "en", "src1"), rows[5]]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    crowded = plain.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.substring("text", 1, 9), F.lit("?"))).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES:
        want, got = (stage(spark, df, str(tmp_path)) for df in (plain, crowded))
        if name == "packing":
            assert got.columns == want.columns
            held = [sorted((tuple(r) for r in df.groupBy("doc_id").agg(F.sum("length")).collect()), key=str) for df in (got, want)]
            assert held[0] == held[1]
            continue
        assert got.columns == crowded.columns
        held = [sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str) for df in (got, want)]
        assert held[0] == held[1], name
        assert got.where(" OR ".join(f"`{c}` <> concat('{c} ', coalesce(substring(text, 1, 9), '?'))" for c in CLASHING)).count() == 0, name
    drop_scratch(spark)
