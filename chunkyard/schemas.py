"""Schemas of the tables that operators exchange, as DDL."""

PAGES = "source string, page int, text string"
CHUNKS = "chunk_id string, source string, page int, article string, chunk_index int, text string"
RANKED = "query_id string, rank int, chunk_id string, source string, text string, score double"
GOLDEN = "id string, question string, expected_answer string, source string, page int, gold_quotes array<string>, type string, difficulty string"
ANSWERS = "id string, type string, question string, reference string, contexts array<string>, answer string"
