import os

import pytest
from edgewright.llm import language as L

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_labels():
    assert [L.label_code(x) for x in ("en", "EN", "eng", "English", "en-US", "es_MX", "zh-Hans", "ja-JP", " de ", "Français")] == ["en", "en", "en", "en", "en", "es", "zh", "ja", "de", "fr"]
    assert [L.label_code(x) for x in (None, "", " ", "und", "n/a", "??", "unknown", "mul", "xx")] == [None] * 9


def test_sentences_leave_out_what_has_no_language():
    text = "---\nlanguage: fr\ntitle: Le chat\n---\n# Usage\nThis works with org/Name-Other-3.2B-Chat. It is fast! See https://a.example/b.\n\n```python\nx = 'nicht das'\n```\n| eins | zwei |\n|---|---|\n- Das ist gut."
    got = [(L.words(s), h) for s, h in L.sentences(text) if L.words(s)]
    assert got == [("Usage", True), ("This works with", False), ("It is fast", False), ("See", False), ("Das ist gut", False)]
    assert L.sentences("") == [] and [L.words(s) for s, _ in L.sentences("0.1 0.2\nhttps://x.example/a")] in ([], [""] * 2)


def test_windows_cover_everything():
    for n in (0, 1, 64, 65, 200):
        b = bytes(range(200))[:n]
        ws = L.windows_of(b)
        assert set(b) == {x for w in ws for x in w} and all(len(w) <= L.WINDOW for w in ws)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_held_out_accuracy_and_segments(spark):
    docs = spark.read.parquet(DATA)
    rows = docs.where("text is not null").collect()
    fit = [(r.text, c) for r in rows if r.doc_id % 2 and (c := L.label_code(r.lang))]
    lab = L.Labeller(L.fit(fit))
    held = [r for r in rows if not r.doc_id % 2 and L.label_code(r.lang) and len(r.text) > 60]
    found = lab.label([r.text for r in held])
    one = [(L.label_code(r.lang), f[0][0]) for r, f in zip(held, found) if len(f) == 1]
    assert sum(a == b for a, b in one) / len(one) > 0.85  # a tenth of the labels is wrong
    sure = [(f[0][1], L.label_code(r.lang) == f[0][0]) for r, f in zip(held, found) if len(f) == 1]
    share = lambda rows: sum(ok for _, ok in rows) / max(1, len(rows))
    firm, weak = [x for x in sure if x[0] > 0.99], [x for x in sure if x[0] < 0.9]
    assert share(firm) > 0.85 and (len(weak) < 5 or share(weak) < share(firm))  # the confidence tells right from wrong
    en, de = "Short answers are often better than long ones, but this is not true for mathematics.", "Die Verweise werden vor dem nächsten Hochladen berichtigt, danke für den Hinweis!"
    got = lab.label([f"{en} {en} {de}", f"{de}\n\n{en}\n\n{de}", "", None, "  \n", "```\ncode\n```", en * 400])
    assert [[c for c, _ in g] for g in got] == [["en", "de"], ["de", "en", "de"], [], [], [], [], ["en"]]


def test_frame_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "1 2 3", None), (None, "text", "en")], "doc_id long, text string, lang string").selectExpr("*", "1 as segment_no")
    assert L.segments(df).count() == 0 and L.found(df.limit(0)).count() == 0


def test_a_stored_network_is_read_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([("This is a short text about the models.", "en"), ("Dies ist ein kurzer Text über Modelle.", "de")] * 6)], "doc_id long, text string, lang string")
    one = L.fit_on(df, folder=f"file://{tmp_path}/nets")
    monkeypatch.setattr(L, "fit", None)  # a second fit would fail
    two = L.fit_on(df, folder=f"file://{tmp_path}/nets")
    assert one.p.keys() == two.p.keys() and all((one.p[k] == two.p[k]).all() for k in one.p)


def test_front_matter_after_many_blanks():
    assert [L.words(s) for s, _ in L.sentences("\n" * 400 + "---\nlanguage: fr le chat\n---\nThis is it.") if L.words(s)] == ["This is it"]


def test_script_check():
    import numpy as np

    even = np.zeros(len(L.CODES), np.float32)
    best = lambda w: {c for c, v in zip(L.CODES, L.script_check(w, even)) if v == 0}
    assert best("すべて Chat") == {"ja"} and best("这个模型") == {"zh", "ja"} and best("модель Chat") == {"ru"}
    assert best("ein Modell") == set(L.CODES) - {"ru", "zh", "ja"} and best("...") == set(L.CODES)
