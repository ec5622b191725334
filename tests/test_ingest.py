import os

import pytest

from lodestrata.config import Allowlist, Settings
from lodestrata.operators.ingest import Ingest
from lodestrata.sources import corpus, schemas
from lodestrata.sources.store import ConstraintError, Store, safe_name
from lodestrata.streaming import trigger

LONG = "This is a sentence about money and travel. " * 12


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus"
    files = {
        "finance/a.md": "---\ntitle: Costs\n---\n# One\n\n" + LONG + '\n\n{{< yes >}} {{% include "x.md" %}}\n\n## Two\n\n' + LONG, "finance/sub/_index.md": "# Stub\n- [a](b)\n- c\n", "finance/_drafts/no.md": LONG, "finance/.x.md": LONG,
        "total-rewards/on-call_3rd.md": LONG, "legal/empty.md": "{{< only >}}", "ceo/a.md": LONG, "top.md": LONG, "legal/bad.md": None,
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"ok \xff\xfe" if text is None else text.encode())
    return root


def ingest(spark, tmp_path, tree):
    inc = tmp_path / "inc"
    inc.mkdir(exist_ok=True)
    (inc / "x.md").write_text("INCLUDED")
    return Ingest(spark, Store(spark, str(tmp_path / "store")), str(tree), str(inc), settings=Settings(min_tokens=20, max_tokens=120))


def test_listing_sees_hidden_names(spark, tree):
    got = {r[0] for r in corpus.read_tree(spark, str(tree)).select("relative_path").collect()}
    want = {os.path.relpath(os.path.join(d, f), tree) for d, _, fs in os.walk(tree) for f in fs if f.endswith(".md")}
    assert got == want and "finance/sub/_index.md" in got
    walked = {r[0]: r[1] for r in corpus.walked(corpus.read_tree(spark, str(tree))).select("relative_path", "department").collect()}
    assert walked == {"finance/a.md": "finance", "finance/sub/_index.md": "finance", "finance/.x.md": "finance", "total-rewards/on-call_3rd.md": "people-group", "legal/empty.md": "legal", "legal/bad.md": "legal"}


def test_missing_root_and_unknown_department(spark, tree, tmp_path):
    with pytest.raises(Exception, match="no corpus"):
        corpus.read_tree(spark, str(tmp_path / "nowhere")).count()
    with pytest.raises(ValueError, match="unknown departments"):
        corpus.walked(corpus.read_tree(spark, str(tree)), Allowlist(), ["nope"])


def test_lifecycle(spark, tmp_path, tree):
    run = ingest(spark, tmp_path, tree)
    dry = run.run(dry_run=True)
    assert dry.version is None and not run.store.snapshot()
    first = run.run()
    assert {k: first.stats[k] for k in ("walked", "added", "skipped_stub", "skipped_empty", "errored")} == {"walked": 6, "added": 3, "skipped_stub": 1, "skipped_empty": 1, "errored": 1}
    docs = {r["source_path"]: r for r in run.store.read("documents").collect()}
    assert docs["content/handbook/finance/a.md"]["title"] == "Costs" and docs["content/handbook/total-rewards/on-call_3rd.md"]["title"] == "On Call 3Rd"
    chunks = run.store.read("chunks").collect()
    assert len(chunks) == first.stats["chunks_written"] == run.store.read("chunk_embeddings").count()
    assert run.store.read("chunk_terms").where("term = 'money'").count() == len([c for c in chunks if "money" in c["content"]])
    text = " ".join(c["content"] for c in chunks if c["document_id"] == docs["content/handbook/finance/a.md"]["id"])
    assert "INCLUDED" in text and "Yes" in text and "{{" not in text and text.startswith("Costs > One")
    assert run.store.read("ingestion_errors").count() == 1 and run.store.read("ingestion_runs").collect()[0]["status"] == "succeeded"

    again = run.run()
    assert again.stats["unchanged"] == 3 and again.stats["added"] == again.stats["updated"] == again.stats["tombstoned"] == 0
    assert {r["id"] for r in run.store.read("chunks").collect()} == {c["id"] for c in chunks}

    a = tree / "finance/a.md"
    before, parts = a.read_bytes(), run.store.snapshot()
    a.write_bytes(before + b"\n\nOne more sentence here.")
    assert run.run().stats["updated"] == 1
    now = run.store.snapshot()
    for table in ("documents", "chunks", "chunk_embeddings"):  # one document's bucket is new, the others are the same files
        assert len(set(now[table]) - set(parts[table])) == 1 == len(set(parts[table]) - set(now[table]))
    forced = run.run(force=True)
    assert forced.stats["updated"] == 3

    a.unlink()
    assert run.run(departments=["legal"]).tombstoned == 0
    assert run.run().tombstoned == 1
    doc = docs["content/handbook/finance/a.md"]["id"]
    assert run.store.read("documents").where(f"id = '{doc}'").collect()[0]["status"] == "tombstoned"
    live = run.store.read("chunks").where("status = 'active'").count()
    assert run.store.read("chunk_embeddings").count() == live

    a.write_bytes(before + b"\n\nOne more sentence here.")
    back = run.run()
    assert back.stats["updated"] == 1 and run.store.read("documents").where(f"id = '{doc}'").collect()[0]["status"] == "active"
    assert run.store.read("chunk_embeddings").count() == run.store.read("chunks").where("status = 'active'").count()


def test_errored_file_is_not_tombstoned(spark, tmp_path, tree):
    run = ingest(spark, tmp_path, tree)
    run.run()
    (tree / "finance/a.md").write_bytes(b"\xff\xff")
    got = run.run()
    assert got.stats["errored"] == 2 and got.tombstoned == 0


def test_store_checks(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    model = spark.createDataFrame([("m", 4, "chunk_embeddings", True, None)], schemas.schema("embedding_models"))
    with pytest.raises(ConstraintError):
        s.active_model()
    s.commit({"embedding_models": model})
    assert s.active_model()["model_name"] == "m"
    assert s.upsert("embedding_models", model) == (0, 1)
    before = s.snapshot()
    two = spark.createDataFrame([("a", 4, "t", True, None), ("b", 4, "t", True, None)], schemas.schema("embedding_models"))
    with pytest.raises(ConstraintError):
        s.commit({"embedding_models": two})
    bad = spark.createDataFrame([("d", "s", "p", None, "x", None, "h", None, None, None, "odd")], schemas.schema("documents"))
    with pytest.raises(ConstraintError):
        s.commit({"documents": bad})
    orphan = spark.createDataFrame([("c", [1.0], "x")], schemas.schema("chunk_embeddings"))
    with pytest.raises(ConstraintError):
        s.commit({"chunk_embeddings": orphan})
    assert s.snapshot() == before
    with pytest.raises(ValueError, match="not a table name"):
        safe_name("x; drop")


def test_appends_add_parts_and_compact(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    row = lambda k: spark.createDataFrame([(str(k), f"p{k}", "e")], "run_id string, source_path string, error string")
    for k in range(3):
        s.append("ingestion_errors", row(k))
    assert len(s.snapshot()["ingestion_errors"]) == 3 and sorted(r["run_id"] for r in s.read("ingestion_errors").collect()) == ["0", "1", "2"]
    with pytest.raises(ConstraintError):
        s.append("ingestion_errors", row(3), compact_at=4)  # compacting checks references, and there are no runs


def test_stream_of_notices_runs_ingest_once(spark, tmp_path, tree):
    folder, reports = tmp_path / "notices", []
    folder.mkdir()
    run = ingest(spark, tmp_path, tree)
    for k in range(3):
        (folder / f"{k}.json").write_text('{"path": "finance/a.md", "changed_at": "2024-01-01T00:00:00"}\n')
    trigger.start(spark, run, str(folder), str(tmp_path / "cp"), reports).awaitTermination()
    trigger.start(spark, run, str(folder), str(tmp_path / "cp"), reports).awaitTermination()
    assert len(reports) == 1 and reports[0].stats["added"] == 3


def test_settings_and_allowlist():
    assert Settings.from_env({"LODESTRATA_FINAL_K": "3", "LODESTRATA_RERANK_FLOOR": "0.5"}) == Settings(final_k=3, rerank_floor=0.5)
    with pytest.raises(ValueError, match="min_tokens"):
        Settings(min_tokens=9, max_tokens=3)
    with pytest.raises(ValueError, match="more than once"):
        Allowlist(("a", "a"), {})
    with pytest.raises(ValueError, match="unknown departments"):
        Allowlist(("a",), {"f": "b"})


def test_front_matter():
    assert corpus.front_title("title: A b ") == "A b" and corpus.front_title("title: 5") is None and corpus.front_title("- x") is None and corpus.front_title("") is None


FILES = [
    ("---\ntitle: T\n---\nbody", "T", "body", None), ("---\n---\nbody", None, "body", None), ("---\r\ntitle: T\r\n---\r\nbody", "T", "body", None), ("no front\n---\nx", None, "no front\n---\nx", None),
    ("---\ntitle: T\nsummary: x---\nowner: me\n---\nbody\n---\nmore", "T", "body\n---\nmore", None), ("---\ntitle: [\n---\nbody", None, "body", "ParserError"), ("---\ntitle: T\nnever closed", None, "---\ntitle: T\nnever closed", None),
]


def test_front_matter_of_files(spark):
    """Only a line of three dashes closes the block, and broken YAML is the file's error."""
    rows = spark.createDataFrame([(k, bytearray(f[0].encode())) for k, f in enumerate(FILES)], "k int, content binary")
    got = {r["k"]: r for r in corpus.parsed(rows).collect()}
    for k, (_, title, body, error) in enumerate(FILES):
        assert (got[k]["front_title"], got[k]["body"]) == (title, body), k
        assert got[k]["error"].startswith(error) if error else got[k]["error"] is None, k


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from lodestrata.sources import shared

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_folder(far)
    far.conf.get = lambda *_: "hdfs://somewhere"
    assert shared.shared_folder(far) == "hdfs://somewhere"


def test_broadcast_is_measured(spark):
    from lodestrata.sources.shared import bounded, small

    rows = spark.createDataFrame([("x" * 1000,)] * 50, "t string")
    assert bounded(rows) and not bounded(rows, 10_000)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(spark.range(3).crossJoin(small(rows))) and "broadcast" not in plan(spark.range(3).crossJoin(small(rows, 10_000)))


def test_listing_by_folders(spark, tmp_path):
    """Deep and wide trees, hidden names, other suffixes, an empty folder: as a plain walk gives them, with contents."""
    for path in ("a.md", "_x/.y/z/_index.md", "w/1.md", "w/2.md", "w/.3.md", "w/no.txt", "é ü/ö.md", "w/deep/er/still/4.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    (tmp_path / "empty" / "more").mkdir(parents=True)
    want = {os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".md")}
    sizes = {r["path"]: r["size"] for r in corpus.listed(spark, str(tmp_path)).collect()}
    assert sizes.keys() == want and all(n == len(p.encode()) for p, n in sizes.items())
    got = {r["relative_path"]: bytes(r["content"]).decode() for r in corpus.read_tree(spark, f"file://{tmp_path}", slice_bytes=8192).collect()}
    assert got == {p: p for p in want}
    assert corpus.read_tree(spark, str(tmp_path / "empty")).count() == 0


def test_checks_are_counted_in_the_write(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s._write("documents", spark.createDataFrame([("d", "s", "p", "x", "h", "odd"), (None, "s", "q", "x", None, "active")], "id string, source string, source_path string, department string, content_hash string, status string"), "n")
    got = s.counted["documents", "n"]
    assert got["rows"] == 2 and sorted(v for k, v in got.items() if k != "rows") == [0, 0, 0, 0, 1, 1, 1]
    with pytest.raises(ConstraintError, match="id is null"):
        s.commit({"roles": spark.createDataFrame([(None, "a")], "id string, name string")})
    assert s.version() == 0 and os.listdir(tmp_path / "s" / "roles") == []
