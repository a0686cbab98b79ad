"""The command line, end to end on a small folder."""

import io
import json

import pytest

from chunkyard.__main__ import main


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    (root / "data").mkdir()
    for name, body in (("north_x.txt", "Art. 1\nroof\nheight ten\nof the\nhouse"), ("south_x.txt", "Art. 2\nnoise\nat night is\nnot ok"), ("east_x.txt", "Art. 3\nparking")):
        (root / "data" / name).write_text(body)
    return root


def run(spark, place, *argv):
    return main([*argv, "--data", str(place / "data"), "--db", str(place / "db"), "--collection", "base_1000_0_txt_e3s", "--results", str(place / "results"), "--golden", str(place / "golden.jsonl")], spark)


def test_commands(spark, place, capsys, monkeypatch):
    assert run(spark, place, "ingest") == 0
    assert "base_1000_0_txt_e3s: 3 chunks" in capsys.readouterr().out
    assert run(spark, place, "ask", "--question", "roof height", "--mode", "bm25") == 0
    assert "north_x.txt" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("\nnoise\nheight?\n!q\nroof\n"))
    assert run(spark, place, "chat", "--mode", "bm25") == 0
    said = capsys.readouterr().out
    # the second question is searched with the first before it
    assert said.count("Sources") == 2 and "south_x.txt" in said.splitlines()[-1] and "north_x.txt" in said.splitlines()[-1]
    from chunkyard.sources import collections

    source = next(r["source"] for r in collections.read(spark, str(place / "db"), "base_1000_0_txt_e3s").collect() if "north" in r["source"])
    rows = [{"id": "q1", "question": "roof height", "expected_answer": "ten", "source": source, "gold_quotes": ["height"], "type": "in_corpus", "difficulty": "lexical"}, {"id": "q2", "question": "parking", "expected_answer": "", "source": "", "gold_quotes": [], "type": "out_of_corpus", "difficulty": "lexical"}]
    (place / "golden.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert run(spark, place, "evaluate", "--mode", "dense") == 0
    assert "## By difficulty" in (said := capsys.readouterr().out) and "first correct scores" in said
    for _ in range(2):
        assert run(spark, place, "generate") == 0
        assert "false_refusal_rate" in capsys.readouterr().out
    assert json.loads((place / "results/answers/base_1000_0_txt_e3s_dense_answers.json").read_text())["config"]["k"] == 3
    assert run(spark, place, "judge", "--judge", "shared-words") == 0
    judged = json.loads((place / "results/judged/base_1000_0_txt_e3s_dense_shared_words_judged.json").read_text())
    assert [r["user_input"] for r in judged] == ["roof height"] and set(judged[0]) == {"user_input", "retrieved_contexts", "response", "reference", "faithfulness", "relevancy", "context_recall"}
    assert run(spark, place, "tables") == 0
    assert "| bm25 | not built |" in (said := capsys.readouterr().out) and "| base_1000_0_txt_e3s |" in said and said.rstrip().endswith("|")
    with pytest.raises(ValueError, match="configured"):
        run(spark, place, "ingest", "--ext", "md")
    assert run(spark, place, "inspect") == 0
    assert run(spark, place, "validate") in (0, 1)
    assert run(spark, place, "probe") == 1
    assert main(["probe", "--data", str(place / "none")], spark) == 2
    capsys.readouterr()
