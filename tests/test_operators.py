"""Operators against small twins: metrics, ranking, cleaning, chunking, validation, profiles, stores, streams."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkyard import config, schemas
from chunkyard.operators import answering, best, chunking, cleaning, dense, fusion, lexical, metrics, models, profile, retrieval, validation
from chunkyard.plans import fixtures
from chunkyard.scratch import written
from chunkyard.sources import collections, files, reports
from chunkyard.streaming import ingest

HOME, AWAY = "rules/north_building.pdf", "rules/south_building.pdf"
QUOTE, OTHER = "isolamento dell'edificio da umidità", "penetrazione di animali"
GOLDEN = "id string, question string, expected_answer string, source string, page int, gold_quotes array<string>, type string, difficulty string"


def golden(spark, *rows):
    return spark.createDataFrame([(i, "q", "a", s, None, q, "in_corpus" if q else "out_of_corpus", d) for i, s, q, d in rows], GOLDEN)


def ranked(spark, *rows):
    """(query, text, source) in rank order."""
    seen, out = Counter(), []
    for q, t, s in rows:
        seen[q] += 1
        out.append((q, seen[q], f"c{len(out)}", s, t, 0.5))
    return spark.createDataFrame(out, schemas.RANKED)


def scored(spark, results, quotes=(QUOTE,), ks=(1, 2, 3, 5)):
    return metrics.per_question(ranked(spark, *results), golden(spark, ("q", HOME, list(quotes), "lexical")), ks).first()


def test_source_must_match(spark):
    assert scored(spark, [("q", QUOTE, AWAY)])["hit@1"] == 0.0
    assert scored(spark, [("q", QUOTE, HOME)])["hit@1"] == 1.0


def test_quotes_are_normalized(spark):
    assert scored(spark, [("q", "x isolamento\n dell’edificio   da\numidità y", HOME)])["hit@1"] == 1.0


def test_reciprocal_rank_and_misses(spark):
    assert scored(spark, [("q", "no", HOME), ("q", QUOTE, HOME), ("q", QUOTE, HOME)])["rr"] == 0.5
    row = scored(spark, [("q", "no", HOME)])
    assert row["rr"] == 0.0 and row["hit@2"] == 0.0 and row["recall@5"] == 0.0
    assert scored(spark, [("other", "no", HOME)])["rr"] == 0.0


def test_cut_off(spark):
    row = scored(spark, [("q", "no", HOME)] * 4 + [("q", QUOTE, HOME)])
    assert (row["hit@3"], row["hit@5"]) == (0.0, 1.0)


def test_partial_recall(spark):
    row = scored(spark, [("q", QUOTE, HOME), ("q", "no", HOME)], (QUOTE, OTHER))
    assert (row["recall@2"], row["hit@2"]) == (0.5, 1.0)
    assert scored(spark, [("q", f"{QUOTE} {OTHER}", AWAY)], (QUOTE, OTHER))["recall@2"] == 0.0


def test_scores_by_difficulty_misses_and_separability(spark):
    gold = golden(spark, ("a", HOME, [QUOTE], "lexical"), ("b", HOME, [OTHER], "lexical"), ("c", AWAY, [QUOTE], "paraphrased"), ("o", "", [], "lexical"))
    found = ranked(spark, ("a", QUOTE, HOME), ("b", "no", AWAY), ("b", OTHER, HOME), ("c", "x", HOME), ("o", "x", HOME))
    rows = {r["difficulty"]: r for r in metrics.scores(metrics.per_question(found, gold)).collect()}
    assert (rows[None]["n"], rows["lexical"]["mrr"], rows["paraphrased"]["hit@20"]) == (3, 0.75, 0.0)
    missed = metrics.misses(found, gold).collect()
    assert [(r["id"], r["top"]) for r in missed] == [("c", ["north"])]
    spread = metrics.score_distribution(found, gold)
    assert sorted((r["type"], r["id"], r["score"]) for r in spread.collect()) == [("in_corpus", "a", 0.5), ("in_corpus", "b", 0.5), ("out_of_corpus", "o", 0.5)]
    assert metrics.separability(spread).first()["separable"] is False
    record = reports.payload(metrics.scores(metrics.per_question(found, gold)), spread, "c", "dense", 4)
    assert record["n_in_corpus"] == 3 and record["score_distributions"]["out_of_corpus"] == [[0.5, "o"]] and list(record["by_difficulty"]) == ["lexical", "paraphrased"]
    text = reports.report(metrics.scores(metrics.per_question(found, gold)), "c", "dense")
    assert "| @1 | 0.333 | 0.333 |" in text and "one is 33.3 points" in text


def test_refusals(spark):
    rows = [("out_of_corpus", config.NO_CONTEXT), ("out_of_corpus", "Yes"), ("in_corpus", "it COULD not find any\nrelevant information"), ("in_corpus", "yes")]
    df = spark.createDataFrame(rows, "type string, answer string")
    assert metrics.checked_refusal_rates(df) == {"refusal_rate": 0.5, "false_refusal_rate": 0.5}
    with pytest.raises(ValueError):
        metrics.checked_refusal_rates(df.where("type = 'in_corpus'"))


# --- ranking


def brute_bm25(docs, query, k):
    from chunkyard.functions import text as t

    split = lambda x: re.findall(t.TOKEN.replace(r"\p{Nd}", r"\d").replace(r"[\p{L}\p{N}_]", r"\w"), x.lower())
    tokens = {i: split(x) for i, x in docs}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(x for own in tokens.values() for x in set(own))
    raw = {x: math.log(n - c + 0.5) - math.log(c + 0.5) for x, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {x: floor if v < 0 else v for x, v in raw.items()}
    scores = []
    for i, own in tokens.items():
        tf = Counter(own)
        s = sum(idf.get(x, 0) * tf[x] * 2.5 / (tf[x] + 1.5 * (0.25 + 0.75 * len(own) / avg)) for x in split(query))
        scores.append((-round(s, 5), i))
    return [(i, -s) for s, i in sorted(scores)[:k] if -s > 0]


def test_bm25(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("the the the a b c d e f 3,00 380/2001".split()) for _ in range(rng.randrange(1, 30)))) for i in range(40)]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string")
    queries = {"q1": "a b b", "q2": "the", "q3": "nothing here", "q4": "3,00 380/2001 e", "q5": "a"}
    got = lexical.top_k(lexical.build(chunks), spark.createDataFrame(list(queries.items()), "query_id string, text string"), 5).collect()
    for q, query in queries.items():
        own = sorted((r["rank"], r["chunk_id"], r["score"]) for r in got if r["query_id"] == q)
        want = brute_bm25(docs, query, 5)
        assert [x[1] for x in own] == [x[0] for x in want]
        assert all(abs(a[2] - b[1]) < 2e-5 for a, b in zip(own, want, strict=True))


def test_bm25_passes_on_the_best_of_each_task_alone(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(f"d{i % 7}-{i}", " ".join(rng.choice("the a b c d e f".split()) for _ in range(rng.randrange(1, 12)))) for i in range(300)] + [("empty", "")]
    chunks = spark.createDataFrame(docs, "chunk_id string, text string").repartition(3)
    queries = [(i, " ".join(rng.choice("the a b c d e f".split()) for _ in range(4))) for i in range(9)] + [(9, None)]
    seen = []
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "written", lambda d, name: seen.append((name, kept := written(d, name))) or kept)
    index = lexical.build(chunks)
    got = lexical.top_k(index, spark.createDataFrame(queries, "query_id int, text string"), 4).collect()
    held = [d for name, d in seen if name == "nearest"]
    assert len(held) > 1 and sum(d.count() for d in held) <= 9 * 4 * index.tokens.rdd.getNumPartitions()
    for q, query in queries[:9]:
        own = sorted((r["rank"], r["chunk_id"], r["score"]) for r in got if r["query_id"] == q)
        want = brute_bm25(docs, query, 4)
        assert [x[1] for x in own] == [x[0] for x in want]
        assert all(abs(a[2] - b[1]) < 2e-5 for a, b in zip(own, want, strict=True))
    assert 9 not in {r["query_id"] for r in got}
    monkeypatch.undo()
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "c"), (5, "d"), (None, "e f")], "chunk_id long, text string")
    asked = spark.createDataFrame([(None, "a"), ("e", "e")], "query_id string, text string")
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in lexical.top_k(lexical.build(texts), asked, 2).collect()} == {(None, 1, 3), ("e", 1, None)}
    assert lexical.top_k(lexical.build(texts.limit(0)), asked, 2).count() == 0


def test_bm25_keeps_the_tokens_of_a_chunk_as_one_string(spark):
    docs = [(1, "Roof roof, 3abc"), (2, ""), (3, " ?! "), (4, "3,00.1  380/2001/x_y\n\u00a0ÀÈ ² ①"), (5, None), (6, "abc"), (7, "sky"), (8, "sea air")]
    index = lexical.build(spark.createDataFrame(docs, "chunk_id long, text string").repartition(2))
    assert "array" not in " ".join(kind for _, kind in index.tokens.dtypes)
    assert {r["token"]: r["df"] for r in index.vocabulary.collect()} == {"roof": 1, "3": 1, "abc": 2, "3,00.1": 1, "380/2001": 1, "x_y": 1, "àè": 1, "²": 1, "①": 1, "sky": 1, "sea": 1, "air": 1}
    assert {r["chunk_id"]: r["dl"] for r in index.tokens.where("chunk_id <> 5").collect()} == {1: 4, 2: 0, 3: 0, 4: 6, 6: 1, 7: 1, 8: 2}
    asked = spark.createDataFrame([(1, "abc ÀÈ"), (2, "① 3,00.1"), (3, " "), (4, "")], "query_id int, text string")
    assert {(r["query_id"], r["chunk_id"]) for r in lexical.top_k(index, asked, 5).collect()} == {(1, 6), (1, 1), (1, 4), (2, 4)}


def test_best_rows_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(best, "CELLS", 64)
    rng = np.random.default_rng(4)
    scores = rng.integers(-3, 4, (400, 5)) / 10 + rng.uniform(-4e-4, 4e-4, (400, 5))
    scores[7] = np.nan
    ids = pa.array([None if i == 11 else f"{i * 37 % 400:03}" for i in range(400)])
    for least in (-np.inf, 0.1):
        own = best.Best(3, 5, 2, least)
        for start in range(0, 400, own.rows()):
            own.add(scores[start : start + own.rows()], ids.slice(start, own.rows()))
            assert own.size <= 4 * 3 * 5 + own.rows() * 5
        query, score, name = own.taken()
        for q in range(5):
            rows = [(-round(x, 2) + 0.0, i or "") for x, i in zip(scores[:, q].tolist(), ids.to_pylist(), strict=True) if x == x]
            want = sorted(r for r in rows if -r[0] >= least)[:3]
            assert [(-s, i or "") for s, i, w in zip(score.tolist(), name.to_pylist(), query.tolist(), strict=True) if w == q] == want


def test_rrf(spark):
    lists = [[("q", 1, "a", 0.9), ("q", 2, "b", 0.8)], [("q", 1, "b", 12.0), ("q", 2, "c", 5.0)]]
    frames = [spark.createDataFrame(x, "query_id string, rank int, chunk_id string, score double") for x in lists]
    got = fusion.rrf(frames).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c"]
    assert [round(r["score"], 9) for r in got] == [round(1 / 62 + 1 / 61, 9), round(1 / 61, 9), round(1 / 62, 9)]
    same = fusion.rrf(frames[::-1]).collect()
    assert {r["chunk_id"]: r["score"] for r in same} == {r["chunk_id"]: r["score"] for r in got}
    assert [r["chunk_id"] for r in fusion.rrf(frames, weights=[1.0]).orderBy("rank").collect()] == ["a", "b"]
    tie = spark.createDataFrame([("q", 1, "z", 1.0)], "query_id string, rank int, chunk_id string, score double")
    other = spark.createDataFrame([("q", 1, "y", 1.0)], "query_id string, rank int, chunk_id string, score double")
    assert [r["chunk_id"] for r in fusion.rrf([tie, other]).orderBy("rank").collect()] == ["z", "y"]


def test_dense(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, None), (61, [0.0] * 5), (62, [None] * 5), (63, [1.0])]
    monkeypatch.setattr(dense, "BLOCK", 2)
    df = spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(3)
    got = dense.top_k(df, df.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id"), 4).collect()
    vectors = {r["chunk_id"]: r["vector"] for r in df.where("chunk_id < 60").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for q in range(5):
        want = sorted((-round(cos(vectors[q], v), 6), i) for i, v in vectors.items())[:4]
        assert sorted((r["rank"], r["chunk_id"]) for r in got if r["query_id"] == q) == [(n + 1, i) for n, (_, i) in enumerate(want)]
    assert dense.top_k(df, df.limit(0).withColumnRenamed("chunk_id", "query_id"), 4).count() == 0


def test_dense_passes_on_the_best_of_each_task_alone(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)], "chunk_id long, vector array<float>").coalesce(1)
    seen = []
    monkeypatch.setattr(dense, "BLOCK", 4)
    monkeypatch.setattr(dense, "written", lambda d, name: seen.append((name, kept := written(d, name))) or kept)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = dense.top_k(df, df.where("chunk_id < 6").withColumnRenamed("chunk_id", "query_id"), 3).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = [d for name, d in seen if name == "nearest"]
    assert got == 18 and len(held) == 2 and sum(d.count() for d in held) == 18


def test_modes_and_threshold(spark):
    words = ["roof height limits", "parking spaces", "roof materials", "noise limits at night"]
    embed = models.hashed_embedder(32)
    chunks = spark.createDataFrame([(i, f"s{i % 2}", w) for i, w in enumerate(words * 7)], "chunk_id long, source string, text string").withColumn("vector", embed(F.col("text")))
    queries = spark.createDataFrame([("q", "roof limits")], "query_id string, text string").withColumn("vector", embed(F.col("text")))
    for mode in config.MODES:
        rows = retrieval.retrieve(chunks, queries, 25, mode, apply_threshold=False).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert len(rows) <= (20 if mode == "rerank" else 25)
    hybrid = {r["chunk_id"] for r in retrieval.retrieve(chunks, queries, 20, "hybrid").collect()}
    assert hybrid == {r["chunk_id"] for r in retrieval.retrieve(chunks, queries, 25, "rerank").collect()}
    kept = retrieval.retrieve(chunks, queries, 28, "dense").collect()
    assert kept and all(r["score"] >= 0.3 for r in kept)
    assert {r["sources"][0] for r in retrieval.distinct_sources(retrieval.retrieve(chunks, queries, 3)).collect()} == {"s0"}
    with pytest.raises(ValueError):
        retrieval.retrieve(chunks, queries, mode="guess")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_do_not_shuffle_to_meet_few_rows(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("chunk_id"), F.lit("s").alias("source"), F.lit("x y").alias("text")).write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    few = spark.range(5_000_000).where("id % 2500000 = 7").select(F.lit("q").alias("query_id"), F.col("id").cast("int").alias("rank"), F.col("id").alias("chunk_id"), F.lit(1.0).alias("score"))
    asked = spark.range(5_000_000).where("id = 7").select(F.lit("q").alias("query_id"), F.lit("x").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")  # less than 5,000,000 rows are taken to be, more than what is left of them
    try:
        plan = planned(fusion.rerank(few, asked, texts, models.shared_words_scorer, 3))
        assert re.search(r"BroadcastHashJoin \[chunk_id", plan) and not re.search(r"SortMergeJoin \[chunk_id", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_of_one_file_are_not_dealt_out_to_meet_few_rows(spark, monkeypatch):
    from chunkyard.plans import surrogates

    folder, seen = "/root/testdata/sf0.001", []
    monkeypatch.setattr(surrogates, "written", lambda d, name: seen.append((name, planned(d))) or written(d, name))
    assert "RoundRobinPartitioning" in planned(surrogates.chunks(spark, folder))  # one small file
    rows = surrogates.ranked(spark, folder, 3).collect()
    plan = dict(seen)["ranked"]
    assert "BroadcastHashJoin" in plan and "Exchange RoundRobinPartitioning" not in plan and "Exchange hashpartitioning" not in plan
    texts = {r["chunk_id"]: (r["source"], r["text"]) for r in surrogates.chunks(spark, folder).collect()}
    assert rows and all((r["source"], r["text"]) == texts[r["chunk_id"]] for r in rows)


def test_texts_are_folded_once(spark):
    pages = written(spark.createDataFrame([("a", 1, "one two three"), ("b", 2, None), ("c", None, "ONE\ntwo  three four")], "source string, page int, text string"), "pages")
    quotes = spark.createDataFrame([("q", 0, "one two three", "a", None, "one two three")], "id string, position int, quote string, source string, page int, needle string")
    found = validation.holding(pages, quotes, None)
    assert planned(found).count("regexp_replace") == 1
    assert {(r["source"], r["page"]) for r in found.collect()} == {("a", 1), ("c", None)}


def test_rerank_of_nothing(spark):
    none = spark.createDataFrame([], "query_id string, rank int, chunk_id long, score double")
    texts = spark.createDataFrame([(1, "x")], "chunk_id long, text string")
    assert fusion.rerank(none, spark.createDataFrame([("q", "x")], "query_id string, text string"), texts, models.shared_words_scorer, 3).count() == 0


# --- cleaning and chunking


def test_furniture(spark):
    pages = [("a", i, f"{'Header of three pages' if i < 3 else 'other'}\nbody {'abcde'[i]}\n" + (f"Pagina {i}0/120" if i < 4 else "Pagina 1/9")) for i in range(5)] + [("b", 0, "a line that is long\nshort")]
    df = spark.createDataFrame(pages, schemas.PAGES)
    got = {(r["source"], r["page"]): r["text"] for r in cleaning.strip_furniture(df).collect()}
    assert got["a", 0] == "Header of three pages\nbody a" and got["a", 4] == "other\nbody e" and got["b", 0] == "short"
    kept = {(r["source"], r["page"]): r["text"] for r in cleaning.strip_furniture(df, min_pages=2).collect()}
    assert kept["b", 0] == "a line that is long\nshort"


def test_repair(spark):
    got = cleaning.repair(spark.createDataFrame([("a", 0, "perchÃ©"), ("a", 1, "ok"), ("a", 2, None)], schemas.PAGES)).orderBy("page").collect()
    assert [(r["text"], r["repaired"]) for r in got] == [("perché", True), ("ok", False), (None, False)]


def test_chunk_ids_and_strategies(spark):
    pages = spark.createDataFrame([("a", 1, "same"), ("a", 0, "same"), ("b", 0, "x " * 900)], schemas.PAGES)
    rows = chunking.split(pages, "base").collect()
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    assert sorted((r["source"], r["page"], r["chunk_index"]) for r in rows) == [("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("b", 0, 1)]
    again = chunking.split(pages.repartition(7), "base").collect()
    assert {r["chunk_id"] for r in again} == {r["chunk_id"] for r in rows}
    with pytest.raises(ValueError):
        chunking.split(pages, "magic")
    with pytest.raises(ValueError):
        chunking.split(fixtures.pages(spark), "article")
    article = chunking.split(fixtures.pages(spark).where("source <> 'c.txt'"), "article").orderBy("source", "chunk_index").collect()
    assert [r["article"] for r in article] == ["preambolo", "1", "2 bis", "allegato a", "5", "12ter"] and article[0]["page"] is None
    with pytest.raises(ValueError):
        chunking.split(pages, "semantic_p95")


def test_semantic_chunks(spark):
    body = "Roof height is ten. Roof slope is low. Roof tiles are red, cfr. art. 5 here. Noise is bad. Noise at night is worse. Noise by day is fine."
    pages = spark.createDataFrame([("a", 0, body)], schemas.PAGES)
    rows = chunking.split(pages, "semantic_p95", embed=models.hashed_embedder(16)).orderBy("chunk_index").collect()
    assert len(rows) == 2 and " ".join(r["text"] for r in rows) == body


# --- validation


def test_schema_errors(spark):
    got = validation.schema_errors(fixtures.golden_lines(spark)).orderBy("line").collect()
    assert ["; ".join(r["errors"]) for r in got] == fixtures.GOLDEN_ERRORS
    assert validation.exit_code(validation.schema_errors(fixtures.golden_lines(spark))) == 1


def test_quote_report(spark):
    pages = spark.createDataFrame([("d/a", 0, "the first rule stands here and ends"), ("d/a", 1, "a second rule\nover lines"), ("d/b", 0, "other: the first rule stands here too")], schemas.PAGES)
    chunks = spark.createDataFrame([("d/a", 0, "the first rule stands here and ends"), ("d/a", 1, "a second"), ("d/a", 1, "rule over lines"), ("d/b", 0, "x")], schemas.PAGES)
    rows = [("q1", "d/a", 0, ["first RULE  stands"]), ("q2", "d/a", 0, ["second rule over"]), ("q3", "d/a", None, ["absent", "ends"]), ("q4", "d/x", 0, ["rule"]), ("q5", "d/a", 0, [" ".join(["w"] * 21)])]
    gold = spark.createDataFrame([(i, "q", "a", s, p, q, "in_corpus", "lexical") for i, s, p, q in rows], GOLDEN)
    got = {r["id"]: r for r in validation.quote_report(gold, pages, chunks).collect()}
    assert got["q1"]["errors"] == ["quote is ambiguous, also in b: 'first RULE  stands'"] and got["q1"]["warnings"] == []
    assert got["q2"]["errors"] == ["quote straddles a chunk boundary, unretrievable: 'second rule over'"]
    assert got["q2"]["warnings"] == ["page 0 declared but quote is on page(s) [1]!"]
    assert got["q3"]["errors"] == ["quote not found in a: 'absent'"]
    assert got["q4"]["errors"] == ["source 'd/x' is not in the ingested corpus"]
    assert len(got["q5"]["warnings"]) == 1 and got["q5"]["errors"][0].startswith("quote not found in a: 'w w")


def test_profile(spark):
    table = "\n".join(f"{i} {i + 1} 3,00" for i in range(20))
    pages = spark.createDataFrame([("scan", 0, "x"), ("glued", 0, "parolelunghissimeattaccate " * 30), ("table", 0, table), ("good", 0, "Art. 1 che non sono della comma\n" * 12)], schemas.PAGES)
    got = {r["source"]: r for r in profile.corpus_profile(pages).collect()}
    assert got["scan"]["problems"] == [profile.PROBLEMS[0], profile.PROBLEMS[2]]
    assert profile.PROBLEMS[1] in got["glued"]["problems"]
    assert got["table"]["table_pages"] == 1 and got["table"]["table_pct"] == 100.0
    assert got["good"]["problems"] == [] and got["good"]["art_n"] == 12 and got["good"]["main_family"] == "art_n"
    assert profile.totals(profile.corpus_profile(pages)).first()["sources"] == 4


# --- answers, stores, files, streams


def test_answers_history_and_judge(spark, tmp_path):
    gold = golden(spark, ("a", HOME, [QUOTE], "lexical"), ("o", "", [], "lexical"))
    found = ranked(spark, ("a", "second " + QUOTE, HOME), ("a", "more", AWAY))
    rows = {r["id"]: r for r in answering.answer_rows(gold, found).collect()}
    assert rows["a"]["contexts"] == ["second " + QUOTE, "more"] and QUOTE in rows["a"]["answer"]
    assert rows["o"]["answer"] == config.NO_CONTEXT and rows["o"]["contexts"] == []
    judged = answering.judge(answering.answer_rows(gold, found)).collect()
    assert [r["id"] for r in judged] == ["a"] and 0 <= judged[0]["faithfulness"] <= 1
    messages = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(12)], "conv_id long, turn long, role string, text string")
    last = answering.history_window(messages).where("turn = 11").first()["history"]
    assert [m["text"] for m in last] == [f"m{i}" for i in range(3, 11)]
    asked = spark.createDataFrame([("q", "it?", [("user", "roof")]), ("r", "x", [])], "query_id string, text string, history array<struct<role string, text string>>")
    out = {r["query_id"]: r["search"] for r in answering.rewrite_queries(asked, lambda t, h: F.concat(h[0]["text"], F.lit(" "), t)).collect()}
    assert out == {"q": "roof it?", "r": "x"}
    seen = []

    def search(rows):
        seen.extend(r["text"] for r in rows.orderBy("query_id").collect())
        return ranked(spark, ("q", "a height", HOME))

    long = [("user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(8)]
    asked = spark.createDataFrame([("q", "it?", long), ("r", "x", [])], asked.schema)
    turns = {r["query_id"]: r for r in answering.converse(asked, search).collect()}
    assert seen == ["m6 it?", "x"] and turns["q"]["sources"] == [HOME] and turns["r"]["answer"] == config.NO_CONTEXT and turns["r"]["sources"] == []
    assert [m["text"] for m in turns["q"]["history"]] == [f"m{i}" for i in range(2, 8)] + ["it?", turns["q"]["answer"]]
    assert [tuple(m) for m in turns["r"]["history"]] == [("user", "x"), ("assistant", config.NO_CONTEXT)]
    path = str(tmp_path / "x" / "answers.json")
    first = reports.stored_answers(path, {"k": 3}, lambda: answering.answer_rows(gold, found))
    assert reports.stored_answers(path, {"k": 3}, lambda: None) == first
    assert len(reports.stored_answers(path, {"k": 4}, lambda: answering.answer_rows(gold, found))) == 2


def test_collections(spark, tmp_path):
    root = str(tmp_path)
    pages = spark.createDataFrame([("a", 0, "one"), ("b", 0, "two")], schemas.PAGES)
    chunks = chunking.split(pages, "base")
    collections.write(chunks, root, "c")
    collections.write(chunks, root, "c", replace=False)
    assert collections.read(spark, root, "c").count() == 2
    collections.write(chunking.split(spark.createDataFrame([("z", 0, "three")], schemas.PAGES), "base"), root, "c", replace=False)
    assert collections.read(spark, root, "c").count() == 3
    assert collections.stats(collections.read(spark, root, "c")).first()["mean_chars"] == 4
    assert [(x["name"], x["count"]) for x in collections.inspect(spark, root)] == [("c", 3)]
    with pytest.raises(ValueError):
        collections.read(spark, root, "none")


def test_upserts_write_their_own_rows_and_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collections, "MAX_PARTS", 3)
    root, folder = str(tmp_path), tmp_path / "c"
    row = lambda i, text: spark.createDataFrame([(i, "s", text)], "chunk_id string, source string, text string")
    for i, (key, text) in enumerate([("a", "1"), ("b", "2"), ("a", "3"), ("c", "4"), ("b", "5")]):
        opened = collections.read(spark, root, "c") if i else None
        collections.write(row(key, text), root, "c", replace=False)
        assert opened is None or opened.count() in (1, 2, 3)  # what a reader opened stays readable after the next write
        assert len((folder / "_PARTS").read_text().split()) == (1, 2, 3, 1, 2)[i]
    assert {(r["chunk_id"], r["text"]) for r in collections.read(spark, root, "c").collect()} == {("a", "3"), ("b", "5"), ("c", "4")}
    (folder / "part-unfinished").mkdir()  # what a failed run left is not read, and goes with the next write
    assert collections.read(spark, root, "c").count() == 3
    collections.write(row("z", "9"), root, "c")
    assert [tuple(r) for r in collections.read(spark, root, "c").collect()] == [("z", "s", "9")]
    assert not (folder / "part-unfinished").exists()
    collections.write(spark.createDataFrame([], "chunk_id string, source string, text string"), root, "c")
    with pytest.raises(ValueError):
        collections.read(spark, root, "c")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("uno\ndue")
    (tmp_path / "b.txt").write_text("tre")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("no")
    folder = str(tmp_path)
    assert files.detect_extension(spark, folder) == "txt"
    files.check_extension(spark, folder, "txt")
    with pytest.raises(ValueError):
        files.check_extension(spark, folder, "pdf")
    rows = files.load_documents(spark, folder, "txt", root=folder).orderBy("source").collect()
    assert [(r["source"], r["page"], r["text"]) for r in rows] == [("a.txt", None, "uno\ndue"), ("b.txt", None, "tre")]
    for error, args in ((ValueError, ("doc",)), (FileNotFoundError, ("md",)), (FileNotFoundError, ("pdf",))):
        with pytest.raises(error):
            files.load_documents(spark, folder, *args)
    with pytest.raises(FileNotFoundError):
        files.load_documents(spark, folder + "/none", "txt")
    (tmp_path / "p.pdf").write_bytes(b"page one\x0cpage two")
    with pytest.raises(ValueError):
        files.detect_extension(spark, folder)
    pdf = files.load_documents(spark, folder, "pdf", parse_pdf=lambda b: b.decode().split("\x0c")).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in pdf] == [(0, "page one"), (1, "page two")]


def test_golden_and_results(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text("\n".join([fixtures.GOLDEN[0], "", "  ", fixtures.GOLDEN[4]]) + "\n")
    rows = files.load_golden(spark, str(path)).collect()
    assert [r["id"] for r in rows] == ["q1", "q3"] and rows[0]["gold_quotes"] == ["q"] and rows[0]["page"] is None
    path.write_text(fixtures.GOLDEN[0] + "\n\n{broken\n")
    with pytest.raises(ValueError, match="line 3"):
        files.load_golden(spark, str(path))
    with pytest.raises(ValueError, match="line 2"):
        files.load_golden(spark, str(path), strict=True)
    path.write_text(fixtures.GOLDEN[0] + "\n" + fixtures.GOLDEN[4] + "\n")
    assert files.load_golden(spark, str(path), strict=True).count() == 2
    path.write_text("")
    assert files.load_golden(spark, str(path), strict=True).count() == 0
    for mode, mrr in (("dense", 0.25), ("bm25", 0.5)):
        reports.save_results(str(tmp_path / "r"), {"collection": "c", "mode": mode, "n_in_corpus": 3, "scores": {"mrr": mrr}}, "# x")
    assert json.loads((tmp_path / "r" / "c__dense.json").read_text())["scores"] == {"mrr": 0.25}
    stored = files.load_results(spark, str(tmp_path / "r"))
    assert {(r["mode"], r["scores"]["mrr"], r["n_in_corpus"]) for r in stored.collect()} == {("dense", 0.25, 3), ("bm25", 0.5, 3)}
    table = metrics.comparison(stored.select("mode", F.explode("scores").alias("metric", "value"))).collect()
    assert {r["mode"]: r["mrr"] for r in table} == {"dense": "0.250", "bm25": "0.500", "hybrid": "not built", "rerank": "not built"}


def test_stream_follows_pages(spark, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "db")
    spark.createDataFrame([("a", 0, "one")], schemas.PAGES).write.parquet(inbox)
    for _ in range(2):
        ingest.follow(ingest.page_stream(spark, inbox), root, "c", str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([("b", 0, "two")], schemas.PAGES).write.mode("append").parquet(inbox)
    ingest.follow(ingest.page_stream(spark, inbox), root, "c", str(tmp_path / "ck")).awaitTermination()
    assert {r["text"] for r in collections.read(spark, root, "c").collect()} == {"one", "two"}


def test_small_single_files_are_dealt_to_all_cores(spark, tmp_path):
    from chunkyard.sources import tables

    rows = spark.range(1000).withColumn("other", F.col("id") * 2)
    rows.coalesce(1).write.parquet(str(tmp_path / "folder"))
    file = next((tmp_path / "folder").glob("*.parquet"))
    whole, one = tables.read_table(spark, str(tmp_path / "folder")), tables.read_table(spark, str(file))
    assert "Exchange" not in whole._jdf.queryExecution().toString()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, whole.collect()))
    dealt = one.select("id", F.spark_partition_id().alias("task")).where("id < 900")
    assert dealt.select("task").distinct().count() == spark.sparkContext.defaultParallelism
    assert "ReadSchema: struct<id:bigint>" in dealt._jdf.queryExecution().toString()
