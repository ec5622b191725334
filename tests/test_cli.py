import json

import pytest

from lodestrata import cli

BODY = "The travel expense limit is one hundred per day for every trip. " * 8


@pytest.fixture
def corpus_folder(tmp_path):
    for name, text in {"finance/expenses.md": "# Travel\n\n" + BODY, "legal/contracts.md": "# Contracts\n\nContracts are signed by legal counsel only. " * 6, "sales/deals.md": "# Deals\n\nDiscounts need approval from the sales lead. " * 6}.items():
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True)
        path.write_text(text)
    return tmp_path


def test_commands(spark, corpus_folder, capsys):
    store, root = ["--store", str(corpus_folder / "store")], str(corpus_folder / "corpus")
    cli.main([*store, "ingest", root, "--min-tokens", "10", "--max-tokens", "100"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["added"] == 3
    cli.main([*store, "stats", root, "--max-tokens", "100", "--show-skipped"])
    assert "finance" in capsys.readouterr().out
    cli.main([*store, "retrieve", "travel expense limit", "--role", "finance_analyst", "--role", "engineer"])
    out = capsys.readouterr().out
    assert "finance" in out and "legal" not in out
    cli.main([*store, "ask", "travel expense limit", "--email", "finance@example.com"])
    assert "[1]" in capsys.readouterr().out
    cli.main([*store, "ask", "travel expense limit", "--role", "legal_counsel"])
    assert "No answer" in capsys.readouterr().out
    with pytest.raises(SystemExit, match="unknown user"):
        cli.main([*store, "ask", "x", "--email", "nobody@example.com"])
    golden = corpus_folder / "golden.yaml"
    golden.write_text(
        "- {question: travel expense limit, ask_as_role: finance_analyst, category: single-doc, expect_refusal: false, expected_doc_paths: [content/handbook/finance], expected_answer: one hundred}\n"
        "- {question: travel expense limit, ask_as_role: legal_counsel, category: acl, expect_refusal: true}\n- {question: nobody asks, category: acl, expect_refusal: true}\n"
    )
    cli.main([*store, "eval", "load", str(golden)])
    assert "3 inserted, 0 updated" in capsys.readouterr().out
    cli.main([*store, "eval", "load", str(golden)])
    assert "0 inserted, 3 updated" in capsys.readouterr().out
    cli.main([*store, "eval", "run"])
    got = json.loads(next(x for x in capsys.readouterr().out.splitlines() if x.startswith("{")))
    assert got["n"] == 2 and got["refusal_correct"] == 1.0 and got["acl_clean"] == 1.0 and got["recall_final"] == 1.0 and got["skipped"] == 1
    cli.main([*store, "eval", "run", "--retrieval-only", "--category", "acl"])
    assert cli.Session(spark, store[1]).store.read("eval_runs").count() == 2
