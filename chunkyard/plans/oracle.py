"""DuckDB SQL that says what each query of :mod:`chunkyard.plans.queries` returns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from chunkyard import config
from chunkyard.functions import splitters
from chunkyard.functions import text as t
from chunkyard.operators import profile
from chunkyard.plans import fixtures

KS = config.EVAL_KS


def _text(x: str) -> str:
    """A string literal."""
    return "'" + x.replace("'", "''") + "'"


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace(replace(replace({x}, chr(8217), chr(39)), chr(173), ''), '{t.WS}', ' ', 'g')))"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower(replace({x}, chr(8217), chr(39))), '{t.TOKEN}')"


def _key(x: str) -> str:
    return f"substring(lower(trim(regexp_replace(regexp_replace({x}, '{t.WS}', ' ', 'g'), '\\p{{Nd}}+', '#', 'g'))), 1, {config.KEY_CHARS})"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^{t.WS}|{t.WS}$', '', 'g')"


def _values(rows: Sequence[tuple], columns: str) -> str:
    cell = lambda v: _text(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns})"


#: Documents as pages with their lines.
LINED = f"""
    split AS (SELECT source, doc_id AS page, text, string_split_regex(text, '{t.LINE_END}') AS parts FROM documents),
    lined AS (SELECT source, page, text, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM split)"""

#: BM25: the 20 best documents for the first tokens of each benchmark passage.
RANKED = f"""
    chunk AS (SELECT doc_id AS chunk_id, source, text, {_tokens('text')} AS toks FROM documents),
    total AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM chunk),
    posting AS (SELECT token, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS token FROM chunk) GROUP BY ALL),
    raw AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posting, total GROUP BY token),
    vocabulary AS (SELECT token, df, CASE WHEN raw < 0 THEN {config.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    question AS (SELECT item_id AS query_id, {_tokens('text')} AS toks FROM benchmark),
    asked AS (SELECT query_id, unnest(toks) AS token FROM question),
    scored AS (
        SELECT query_id, chunk_id, round(sum(idf * tf * {config.K1 + 1} / (tf + {config.K1} * (1 - {config.B} + {config.B} * len(toks) / avgdl))), 5) AS score
        FROM asked JOIN vocabulary USING (token) JOIN posting USING (token) JOIN chunk USING (chunk_id), total GROUP BY query_id, chunk_id
    ),
    ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= {config.CANDIDATES}
    )"""

#: Benchmark passages as golden rows, with the normalized passage.
GOLDEN = f"""
    folded AS (SELECT doc_id, source, {_norm('text')} AS folded FROM documents),
    item AS (SELECT item_id AS id, text AS quote, {_norm('text')} AS needle FROM benchmark),
    held AS (SELECT id, doc_id, source FROM item JOIN folded ON contains(folded, needle)),
    golden AS (
        SELECT id, quote, needle, coalesce((SELECT min(source) FROM held h WHERE h.id = i.id), '') AS source,
               CASE WHEN id IN (SELECT id FROM held) THEN 'in_corpus' ELSE 'out_of_corpus' END AS type,
               ['lexical', 'paraphrased', 'tabular'][id % 3 + 1] AS difficulty
        FROM item i
    )"""

HITS = f"""{RANKED}, {GOLDEN},
    hit AS (
        SELECT g.id, r.rank, r.score, r.chunk_id FROM golden g JOIN ranked r ON r.query_id = g.id JOIN folded f ON f.doc_id = r.chunk_id
        WHERE g.type = 'in_corpus' AND f.source = g.source AND contains(f.folded, g.needle)
    ),
    question_score AS (
        SELECT g.id, g.difficulty, {', '.join(f'CAST(coalesce(max(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 0) AS DOUBLE) AS hit_{k}' for k in KS)},
               {', '.join(f'CAST(coalesce(max(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 0) AS DOUBLE) AS recall_{k}' for k in KS)},
               coalesce(round(1.0::DOUBLE / min(rank), 6), 0.0) AS rr
        FROM golden g LEFT JOIN hit USING (id) WHERE g.type = 'in_corpus' GROUP BY g.id, g.difficulty
    )"""

DISTRIBUTION = f"""{HITS},
    distribution AS (
        SELECT 'in_corpus' AS type, id, round(arg_min(score, rank), 3) AS score FROM hit GROUP BY id
        UNION ALL SELECT 'out_of_corpus', id, round(score, 3) FROM golden JOIN ranked ON query_id = id WHERE type = 'out_of_corpus' AND rank = 1
    )"""

NEAR = """
    near AS (
        SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
        FROM embeddings q, embeddings c WHERE {which}
    ),
    nearest AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM near QUALIFY rank <= {k}
    )"""

FUSED = f"""{RANKED}, {NEAR.format(which='q.vec_id IN (SELECT item_id FROM benchmark)', k=config.CANDIDATES)},
    both_lists AS (SELECT *, 0 AS list FROM nearest UNION ALL SELECT *, 1 FROM ranked),
    summed AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / ({config.RRF_K} + rank)), 9) AS score, min(list * 1000 + rank) AS seen FROM both_lists GROUP BY ALL),
    fused AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INTEGER) AS rank, chunk_id, score
        FROM summed QUALIFY rank <= {config.CANDIDATES}
    )"""

TABLES = f"""{LINED},
    bare AS (SELECT source, page, text, list_filter(list_transform(lines, lambda x: {_bare('x')}), lambda x: x <> '') AS held, regexp_replace(text, '{t.MIXED_WORD}', 'x', 'g') AS alone FROM lined),
    rest AS (SELECT *, regexp_replace(regexp_replace(alone, '\\p{{Nd}}+[.,]\\p{{Nd}}+', 'y', 'g'), '\\p{{Nd}}{{5,}}', 'z', 'g') AS rest FROM bare),
    judged AS (
        SELECT source, page, length(text) AS n_chars, round(len(list_filter(held, lambda x: length(x) < {profile.SHORT_LINE}))::DOUBLE / nullif(len(held), 0), 6) AS short_ratio,
               len(regexp_extract_all(alone, '\\p{{Nd}}+[.,]\\p{{Nd}}+')) + len(regexp_extract_all(rest, '\\p{{Nd}}+')) AS numbers
        FROM rest
    ),
    judged_pages AS (SELECT *, coalesce(short_ratio > {profile.SHORT_SHARE} AND numbers > {profile.MIN_NUMBERS}, false) AS is_table FROM judged)"""

_ASCII = "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\P{L}]', 'x', 'g'), '[^\\x00-\\x7F\\P{N}]', 'x', 'g')"
_MOST = f"greatest({', '.join(t.HEADING_FAMILIES)})"
PROFILE = f"""{TABLES},
    counted AS (
        SELECT source, length(text) AS n, regexp_extract_all(text, '[^\\t-\\r\\x{{1C}}-\\x{{20}}\\x{{85}}\\p{{Z}}]+') AS words,
               len(list_filter(regexp_extract_all(lower(text), '{t.WORD}'), lambda x: x IN ({', '.join(map(_text, t.FREQUENT_WORDS))}))) AS frequent,
               len(regexp_extract_all({_ASCII}, {_text(t.LEGAL_REFERENCE)})) AS refs,
               {', '.join(f'len(regexp_extract_all(text, {_text(x)})) AS {n}' for n, x in t.HEADING_FAMILIES.items())}
        FROM lined
    ),
    summed AS (
        SELECT source, count(*) AS pages, sum(n)::BIGINT + count(*) - 1 AS chars, sum(list_sum(list_transform(words, lambda x: length(x))))::DOUBLE / greatest(sum(len(words)), 1) AS avg_word_len,
               sum(frequent)::DOUBLE / count(*) AS frequent_per_page, {', '.join(f'sum({n})::BIGINT AS {n}' for n in t.HEADING_FAMILIES)}, sum(refs)::BIGINT AS legal_refs
        FROM counted GROUP BY source
    ),
    tabled AS (SELECT source, count(*) FILTER (is_table) AS table_pages, coalesce(round(100 * (sum(n_chars) FILTER (is_table))::DOUBLE / nullif(sum(n_chars), 0), 6), 0.0) AS table_pct FROM judged_pages GROUP BY source),
    profile AS (
        SELECT source, pages, chars, chars // pages AS chars_per_page, round(avg_word_len, 6) AS avg_word_len, round(frequent_per_page, 6) AS frequent_per_page, {', '.join(t.HEADING_FAMILIES)},
               CASE {' '.join(f"WHEN {n} = {_MOST} THEN '{n}'" for n in t.HEADING_FAMILIES)} END AS main_family, legal_refs, table_pages, table_pct,
               concat_ws('; ', CASE WHEN chars // pages < {profile.MIN_CHARS} THEN {_text(profile.PROBLEMS[0])} END,
                   CASE WHEN avg_word_len > {profile.MAX_WORD_CHARS} AND frequent_per_page < {profile.MIN_FREQUENT} THEN {_text(profile.PROBLEMS[1])} END,
                   CASE WHEN {_MOST} = 0 THEN {_text(profile.PROBLEMS[2])} END) AS problems
        FROM summed JOIN tabled USING (source)
    )"""


def _furniture(share: float) -> str:
    return f"""{LINED},
    keyed AS (SELECT source, unnest(list_distinct(list_transform(list_filter(lines, lambda x: length({_bare('x')}) >= {config.FURNITURE_CHARS}), lambda x: {_key('x')}))) AS key FROM lined),
    counted AS (SELECT source, key, count(*) AS cnt FROM keyed GROUP BY ALL),
    paged AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
    furniture AS (SELECT source, key, cnt, n_pages FROM counted JOIN paged USING (source) WHERE cnt >= {share} * n_pages)"""


def _history(size: int) -> str:
    return f"""
    SELECT conv_id, turn, coalesce(len(h), 0) AS n, sha256(coalesce(array_to_string(h, chr(10)), '')) AS sha FROM (
        SELECT conv_id, turn, list(concat_ws(':', role, text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) AS h FROM conversations)"""


def _chunked(pages: str, sizes: Mapping[str, int], separators: Sequence[str]) -> str:
    """Recursive splitting, level by level: ``pages`` gives source, page and text; ``separators`` are regular expressions, coarse to fine.

    Every level cuts before its separator and passes long pieces on; neighbours that stay form runs, which are filled to
    chunks one after the other.
    """
    size, overlap = sizes["chunk_size"], sizes["chunk_overlap"]
    levels = [f"item_0 AS (SELECT source, page, 0::BIGINT AS origin, text FROM ({pages}) WHERE text <> '')"]
    for i, separator in enumerate(separators):
        cut = f"string_split(regexp_replace(text, '({separator})', chr(1) || '\\1', 'g'), chr(1))" if separator else "regexp_extract_all(text, '(?s).')"
        long = f"length(piece) >= {size} OR n = 1" if i + 1 < len(separators) else "false"  # a text without the separator passes whole
        levels.append(f"""parts_{i} AS (SELECT source, page, origin, list_filter({cut}, lambda x: x <> '') AS parts FROM item_{i}),
            piece_{i} AS (
                SELECT source, page, origin, piece, no, origin + coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, {long} AS passed
                FROM (SELECT source, page, origin, len(parts) AS n, unnest(parts) AS piece, generate_subscripts(parts, 1) AS no FROM parts_{i}) WINDOW w AS (PARTITION BY source, page, origin ORDER BY no)
            ),
            stay_{i} AS (SELECT *, count(*) FILTER (passed) OVER (PARTITION BY source, page, origin ORDER BY no) AS run FROM piece_{i}),
            item_{i + 1} AS (SELECT source, page, start AS origin, piece AS text FROM piece_{i} WHERE passed)""")
    stay = " UNION ALL ".join(f"SELECT source, page, {i} AS level, origin, run, start, length(piece) AS n FROM stay_{i} WHERE NOT passed" for i in range(len(separators)))
    return f"""WITH RECURSIVE {', '.join(levels)},
        run AS (
            SELECT source, page, min(start) AS opens, [0] || list(done ORDER BY start) AS ends, count(*) AS n
            FROM (SELECT *, sum(n) OVER (PARTITION BY source, page, level, origin, run ORDER BY start)::BIGINT AS done FROM ({stay})) GROUP BY source, page, level, origin, run
        ),
        chunk AS (
            SELECT *, 0::BIGINT AS head, greatest(1, len(list_filter(ends, lambda x: x <= {size})) - 1)::BIGINT AS tail FROM run
            UNION ALL
            SELECT source, page, opens, ends, n, next, greatest(next + 1, len(list_filter(ends, lambda x: x <= ends[next + 1] + {size})) - 1) FROM (
                SELECT *, least(tail, len(list_filter(ends, lambda x: x < greatest(ends[tail + 1] - {overlap}, ends[tail + 2] - {size})))) AS next FROM chunk WHERE tail < n
            )
        ),
        cut AS (SELECT c.source, c.page, opens + ends[head + 1] AS start, {_bare('substring(text, opens + ends[head + 1] + 1, ends[tail + 1] - ends[head + 1])')} AS text FROM chunk c JOIN item_0 USING (source, page)),
        numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY page, start) - 1 AS INTEGER) AS chunk_index FROM cut WHERE text <> '')
        SELECT substring(sha256(concat_ws('|', source, chunk_index, text)), 1, 16) AS chunk_id, source, CAST(page AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS article, chunk_index, text FROM numbered"""


PLAIN_PAGES = "SELECT source, doc_id AS page, text FROM documents"
#: Conversations as Markdown: a heading and a rule for each turn.
MARKDOWN_PAGES = "SELECT 'conversations' AS source, conv_id AS page, string_agg(chr(10) || '## ' || role || chr(10) || '---' || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id"

SECTIONS = [("a.pdf", 0, "preambolo", "Foreword"), ("a.pdf", 1, "1", "Art. 1 - Scope\nfirst body\ncontinued"), ("a.pdf", 2, "2 bis", "Articolo 2 bis Terms\nArt.19 Requests ........ 20\nbody of two"), ("a.pdf", 3, "allegato a", "ALLEGATO 'A'\nannex"), ("b.txt", 1, "5", "art. 5 opens\ntext"), ("b.txt", 2, "12ter", "Art.12ter x\nend"), ("c.txt", 0, "preambolo", "no heading here\nat all")]

ORACLE_SQL = {
    "hit_recall_mrr": f"WITH {HITS} SELECT * FROM question_score",
    "normalize_text": f"SELECT doc_id, sha256(n) AS sha, length(n) AS n FROM (SELECT doc_id, {_norm('text')} AS n FROM documents)",
    "tokenize": f"SELECT doc_id, len(x) AS n, sha256(array_to_string(x, ' ')) AS sha FROM (SELECT doc_id, {_tokens('text')} AS x FROM documents)",
    "line_keys": f"WITH {LINED} SELECT source, {_key('line')} AS key, count(*) AS n FROM (SELECT source, unnest(lines) AS line FROM lined) GROUP BY ALL",
    "page_furniture_08": f"WITH {_furniture(0.8)} SELECT * FROM furniture",
    "page_furniture_01": f"WITH {_furniture(0.1)} SELECT * FROM furniture",
    "furniture_stripped": f"""WITH {_furniture(0.1)},
        own AS (SELECT source, list(key) AS keys FROM furniture GROUP BY source),
        kept AS (SELECT l.source, page, array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(keys, []), {_key('x')})), chr(10)) AS text FROM lined l LEFT JOIN own USING (source))
        SELECT source, page, length(text) AS n, sha256(text) AS sha FROM kept""",
    "join_pages": "SELECT source, count(*) AS n_pages, sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS sha FROM documents GROUP BY source",
    "chunk_ids": """
        SELECT substring(sha256(concat_ws('|', source, i, text)), 1, 16) AS chunk_id, source, doc_id AS page, i AS chunk_index
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS i FROM documents)""",
    "recursive_chunks": _chunked(PLAIN_PAGES, config.STRATEGIES["base"], splitters.PLAIN),
    "overlap_chunks": _chunked(PLAIN_PAGES, config.STRATEGIES["overlap"], splitters.PLAIN),
    "markdown_chunks": _chunked(MARKDOWN_PAGES, config.STRATEGIES["base"], splitters.MARKDOWN),
    "mojibake_fix": "SELECT source, doc_id AS page, regexp_matches(text, '[^\\x00-\\x7F]') AS repaired, sha256(nfc_normalize(text)) AS sha FROM documents",
    "article_sections": f"SELECT source, CAST(section AS BIGINT) AS section, article, text FROM {_values(SECTIONS, 'source, section, article, text')}",
    "toc_filter": f"SELECT id, label, regexp_matches(line, {_text(t.CONTENTS_LINE)}) AS contents FROM {_values([(i, x, y) for i, (x, y) in enumerate(zip(fixtures.HEADINGS, fixtures.LABELS, strict=True))], 'id, line, label')}",
    "abbreviations": f"SELECT id, marked, replace(marked, '<DOT>', '.') AS restored FROM {_values(list(enumerate(fixtures.MARKED)), 'id, marked')}",
    "semantic_breaks": f"""
        WITH far AS (
            SELECT label AS source, vec_id AS position, round(1 - list_cosine_similarity(embedding::DOUBLE[], lag(embedding) OVER w::DOUBLE[]), 9) AS distance
            FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)
        ), cut AS (SELECT source, quantile_cont(distance, {config.PERCENTILE}) AS cut FROM far GROUP BY source)
        SELECT source, position, round(distance, 6) AS distance,
               CAST(sum(CASE WHEN distance > cut + 1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY position) AS BIGINT) AS group_no
        FROM far JOIN cut USING (source)""",
    "corpus_profile": f"WITH {PROFILE} SELECT * FROM profile",
    "corpus_totals": f"WITH {PROFILE} SELECT count(*) AS sources, sum(pages)::BIGINT AS pages, sum(chars)::BIGINT AS chars, round(sum(chars) / 4 * 0.02 / 1e6, 6) AS cost FROM profile",
    "table_pages": f"WITH {TABLES} SELECT * FROM judged_pages",
    "bm25_stats": f"""
        WITH chunk AS (SELECT {_tokens('text')} AS toks FROM documents),
        total AS MATERIALIZED (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM chunk),
        counted AS MATERIALIZED (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS token FROM chunk) GROUP BY token),
        raw AS MATERIALIZED (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM counted, total),
        low AS MATERIALIZED (SELECT {config.EPSILON} * avg(raw) AS floor FROM raw)
        SELECT token, df, round(CASE WHEN raw < 0 THEN floor ELSE raw END, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM raw, total, low""",
    "bm25_topk": f"WITH {RANKED} SELECT * FROM ranked WHERE rank <= 10",
    "dense_topk": f"WITH {NEAR.format(which='q.vec_id % 50 = 0', k=10)} SELECT * FROM nearest",
    "dense_threshold": f"WITH {NEAR.format(which='q.vec_id % 50 = 0', k=10)} SELECT * FROM nearest WHERE score >= {config.THRESHOLDS['dense']}",
    "rrf_hybrid": f"WITH {FUSED} SELECT * FROM fused",
    "rerank_stub": f"""WITH {FUSED},
        pair AS (
            SELECT f.query_id, f.chunk_id, f.rank AS before, round(len(list_intersect(list_distinct(q.toks), c.toks))::DOUBLE / greatest(len(list_distinct(q.toks)), 1), 6) AS score
            FROM fused f JOIN question q USING (query_id) JOIN chunk c USING (chunk_id)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS INTEGER) AS rank, chunk_id, score FROM pair QUALIFY rank <= 10""",
    "hits": f"WITH {HITS} SELECT id, rank, chunk_id, 1::BIGINT AS n_found FROM hit",
    "by_tier_rollup": f"""WITH {HITS}
        SELECT coalesce(difficulty, 'all') AS difficulty, count(*) AS n, {', '.join(f'round(avg({m}_{k}), 6) AS {m}_{k}' for m in ('hit', 'recall') for k in KS)}, round(avg(r), 6) AS mrr
        FROM (SELECT q.*, coalesce((SELECT 1.0::DOUBLE / min(rank) FROM hit h WHERE h.id = q.id), 0.0) AS r FROM question_score q) GROUP BY ROLLUP (difficulty)""",
    "misses": f"""WITH {HITS}
        SELECT id, difficulty, substring(quote, 1, 80) AS question,
               coalesce((SELECT string_agg(c.source, ',' ORDER BY r.rank) FROM ranked r JOIN chunk c USING (chunk_id) WHERE r.query_id = g.id AND r.rank <= 3), '') AS top
        FROM golden g WHERE type = 'in_corpus' AND id NOT IN (SELECT id FROM hit WHERE rank <= 5)""",
    "score_distribution": f"WITH {DISTRIBUTION} SELECT * FROM distribution",
    "separability": f"""WITH {DISTRIBUTION}, side AS (
            SELECT min(score) FILTER (type = 'in_corpus') AS lowest_in, max(score) FILTER (type = 'out_of_corpus') AS highest_out FROM distribution)
        SELECT *, highest_out < lowest_in AS separable FROM side""",
    "refusal_rates": f"""WITH {GOLDEN},
        said AS (SELECT type, CASE WHEN contains({_norm("CASE WHEN id % 3 = 0 THEN 'Sorry: I COULD  NOT find' || chr(10) || 'any relevant information.' ELSE quote END")}, '{config.REFUSAL}') THEN 1.0::DOUBLE ELSE 0.0 END AS refused FROM golden)
        SELECT round(avg(refused) FILTER (type = 'out_of_corpus'), 6) AS refusal_rate, round(avg(refused) FILTER (type = 'in_corpus'), 6) AS false_refusal_rate FROM said""",
    "chat_history_window": _history(config.HISTORY_MESSAGES),
    "chat_history_window_4": _history(4),
    "context_build": f"WITH {RANKED} SELECT query_id, count(*) AS n, sha256(string_agg(text, chr(10) || chr(10) || '=====' || chr(10) || chr(10) ORDER BY rank)) AS sha FROM ranked JOIN chunk USING (chunk_id) WHERE rank <= 3 GROUP BY query_id",
    "distinct_sources": f"WITH {RANKED} SELECT query_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM ranked JOIN chunk USING (chunk_id) GROUP BY query_id",
    "quote_found_pages": f"WITH {GOLDEN} SELECT g.id, coalesce(string_agg(h.doc_id::VARCHAR, ',' ORDER BY h.doc_id), '') AS pages FROM golden g LEFT JOIN held h ON h.id = g.id AND h.source = g.source WHERE type = 'in_corpus' GROUP BY g.id",
    "quote_straddles": f"""WITH {GOLDEN}, {LINED},
        line AS (SELECT source, unnest(lines) AS line FROM lined)
        SELECT id FROM golden g WHERE type = 'in_corpus' AND NOT EXISTS (SELECT 1 FROM line l WHERE l.source = g.source AND contains({_norm('l.line')}, g.needle))""",
    "quote_ambiguous": f"WITH {GOLDEN} SELECT g.id, array_to_string(list_sort(list_distinct(list(h.source))), ',') AS others FROM golden g JOIN held h ON h.id = g.id AND h.source <> g.source WHERE type = 'in_corpus' GROUP BY g.id",
    "golden_schema_errors": f"SELECT line, errors FROM {_values(list(enumerate(fixtures.GOLDEN_ERRORS)), 'line, errors')}",
    "collection_stats": "SELECT count(*) AS chunks, CAST(round_even(avg(length(text)), 0) AS BIGINT) AS mean_chars FROM documents",
    "mode_table_pivot": f"""
        SELECT m.mode, {', '.join(f"coalesce(printf('%.3f', max(value) FILTER (metric = '{x}')), 'not built') AS {x.replace('@', '_')}" for x in ('hit@1', 'hit@3', 'hit@5', 'hit@20', 'mrr'))}
        FROM (SELECT unnest({list(config.MODES)}) AS mode) m LEFT JOIN (SELECT * FROM {_values(fixtures.RESULTS, 'mode, metric, value')}) r USING (mode) GROUP BY m.mode""",
}
