import json

from edgewright.streaming import verdicts


def test_verdicts_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"cluster_id": "a", "target": "t", "verdict": "verified", "judged_at": "2025-01-01T00:00:00"}, {"cluster_id": "a", "target": "t", "verdict": "refuted", "judged_at": "2025-01-01T01:00:00"}, {"cluster_id": "b", "target": "t", "verdict": "error", "judged_at": "2025-01-01T02:00:00"}, {"target": "x"}]
    (tmp_path / "in/one.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    out = verdicts.drain(verdicts.verdict_stream(spark, str(tmp_path / "in")), "verdicts_once", str(tmp_path / "ck"))
    assert sorted(r.cluster_id for r in out.collect()) == ["a", "b"]
