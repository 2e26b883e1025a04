import hashlib
import json

import pytest
from edgewright.functions import verdict_text
from edgewright.operators import pipeline
from edgewright.sources import files, ledger
from pyspark.sql import functions as F

GRAPH = {
    "lattice": {"groups": [{"family": "F", "items": [{"kind": "model", "formal_name": "a", "identity": {"family": "F", "size": 7}, "aliases": ["x"]}, {"formal_name": "b"}]}, {"family": "G", "items": []}]},
    "relations": [{"subject": {"formal_name": "a"}, "relation": "trained_on", "object": {"name": "b"}, "anchor_list": [{"source": "s", "explanation": "e"}, "faulty", None]}, {"subject": "plain", "relation": "r", "object": "q"}],
}


def test_graph_documents(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    items = files.read_graph_items(spark, str(tmp_path / "g.json")).orderBy("item_ord").collect()
    assert [(r.family, r.formal_name) for r in items] == [("F", "a"), ("F", "b")] and [(e.k, e.v) for e in items[0].identity] == [("family", "F"), ("size", "7")]
    e = files.read_graph_edges(spark, str(tmp_path / "g.json")).orderBy("ord").collect()
    assert [(r.subject, r.object) for r in e] == [("a", "b"), ("plain", "q")] and [a.source for a in e[0].anchor_list] == ["s"]


def test_events_and_bad_line(spark, tmp_path):
    good = tmp_path / "ok.jsonl"
    good.write_text(json.dumps({"description": "d", "edges": [{"subject": "a", "relation": "r", "object": "b"}, {"subject": "c", "relation": "r", "object": "d"}]}) + "\n\n" + json.dumps({"edges": [{"subject": "e"}]}) + "\n")
    rows = files.read_events(spark, str(good)).orderBy("line_no", "edge_ord").collect()
    assert [(r.line_no, r.edge_ord, r.subject) for r in rows] == [(1, 0, "a"), (1, 1, "c"), (3, 0, "e")]
    (tmp_path / "bad.jsonl").write_text('{"edges": []}\n[1]\n')
    with pytest.raises(Exception, match="line 2"):
        files.read_events(spark, str(tmp_path / "bad.jsonl")).collect()


def test_verdict_log(spark, tmp_path):
    path = str(tmp_path / "v")
    for k in ("a", "b"):
        files.append_verdicts(spark.createDataFrame([(k, "verified")], "cluster_key string, verdict string"), path)
    assert sorted(r.cluster_key for r in files.read_verdicts(spark, path).collect()) == ["a", "b"]


def test_hashes_and_fingerprint(spark, tmp_path):
    d = tmp_path / "tree"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("x")
    (d / "sub/b.txt").write_text("y")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {r.sha256 for r in files.file_hashes(spark, str(d)).collect()} == {sha("x"), sha("y")}
    assert files.folder_fingerprint(spark, str(d)).first().fingerprint == sha(f"a.txt\0{sha('x')}\0sub/b.txt\0{sha('y')}\0")


def test_ledger(spark):
    s = spark.createDataFrame([("1", 0, "h", "u", "2"), ("1", 0, "h", "u", "1"), ("2", 0, None, None, None)], "id string, load_no int, content_hash string, canonical_url string, fetched_at string")
    assert [tuple(r) for r in ledger.url_ledger(s).collect()] == [("1", "u", "1", "2")]
    assert ledger.batch_fingerprints(s).first().fingerprint == hashlib.sha256(b"1:h|2:").hexdigest()
    assert spark.createDataFrame([("a.PDF",), ("b",)], "n string").select(ledger.content_type(F.col("n"))).collect()[0][0] == "application/pdf"


def test_verdict_texts(spark):
    t = spark.createDataFrame([("b1", [1, 2], "DROP 1 :: NOISE :: too vague\nDROP 9 :: X :: y\nother\nKEEP 2\nDROP 2")], "batch string, ids array<int>, text string")
    assert [tuple(r) for r in verdict_text.drop_lines(t).collect()] == [("b1", 1, "NOISE", "too vague")]
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert {tuple(r) for r in verdict_text.keep_lines(nodes, t).collect()} == {(1, "DROP"), (2, "DROP"), (3, "KEEP")}
    v = spark.createDataFrame([("ALL_SAME 1 2\nx",), ("partial: 1",), ("?",), ("so: {\"a\": 1} ok",), (None,)], "t string")
    assert [r[0] for r in v.select(verdict_text.cluster_verdict(F.col("t"))).collect()][:3] == ["ALL_SAME", "PARTIAL", "UNPARSED"]
    assert [r[0] for r in v.select(verdict_text.first_json(F.col("t"))).collect()] == [None, None, None, '{"a": 1}', None]


def test_heuristic_dedup(spark):
    from tests.test_graph import table

    e = table(spark, [("org/Foo-7B", "r", "org/Bar-7B"), ("ORG/foo-7b", "r", "org/Bar-7B"), ("org/Foo-7B", "r", "/scratch/x"), ("org/Foo-7B", "r", "stuff"), ("org/Foo-7B", "q", "ORG/foo-7b")])
    got = {(r.subject, r.object, r.merged) for r in pipeline.heuristic_dedup(e).collect()}
    assert got == {("org/Foo-7B", "org/Bar-7B", 2)}


def test_stream_log(spark, tmp_path):
    from edgewright.sources import files

    say = lambda *parts: json.dumps({"type": "assistant", "message": {"content": list(parts)}})
    lines = [say({"type": "text", "text": "first"}, {"type": "tool_use", "name": "Read"}), "", "no json", say({"type": "tool_use"}), say({"type": "text", "text": "last"}), json.dumps({"type": "result", "total_cost_usd": 0.5, "usage": {"input_tokens": 7, "output_tokens": 3}}), json.dumps({"type": "user"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("Usage LIMIT reached\n" + say({"type": "text", "text": ""}))
    got = {r.file.rsplit("/", 1)[1]: r for r in files.stream_log(spark, str(tmp_path)).collect()}
    a, b = got["a.jsonl"], got["b.jsonl"]
    assert (a.turns, a.tool_calls, a.tools, a.final_text, a.cost_usd, a.input_tokens, a.output_tokens) == (3, 2, ["Read", "tool_use"], "last", 0.5, 7, 3)
    assert (b.turns, b.tool_calls, b.final_text, b.cost_usd) == (1, 0, None, 0.0)
    assert files.rate_limited(spark, str(tmp_path), ("usage limit",)) and not files.rate_limited(spark, str(tmp_path), ("too many",))
