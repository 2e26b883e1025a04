from edgewright.llm import entries as E

ORGS = {"opalforge": "opalforge", "thornfieldml": "thornfield-ml"}


def test_parse():
    stages = E.Stages(["chat", "reward", "pairs", "preview", "base", "mix"], ["mixobaru"])
    p = lambda s: E.parse_artifact(s, ORGS, stages)
    want = ("chat|8b", "thornfield-ml", "fokakizufiqanu")
    for s in ("thornfield-ml/Fokakizu-Fiqanu-8B-Chat", "THORNFIELD-ML: fokakizu fiqanu - 8 billion - chat version ?", "the Chat Thornfield-ml Fokakizu_Fiqanu_8bn (see card)"):
        assert p(s) == want
    assert p("Fokakizu [stage=Reward, size=1.5B]") == ("reward|1.5b", "", "fokakizu")
    assert p("kovupokucefone0.5bpairs")[0] == "pairs|0.5b"
    assert p("15 B Wzeokate Hibuwu prev.") == ("preview|15b", "", "wzeokatehibuwu")
    assert p("Mixobaru Lewasovi 8B basemodel")[0] == "base|8b" and p("Mixobaru Lewasovi 8B") == ("|8b", "", "mixobarulewasovi")
    assert p("")[2] == "" and E.grams("") == []
    assert E.parse_label("has been Trained-On (?)")[2] == "trainedon"


REL = "rel_id string, relation string, object string, origin string"
ITEM = "item_id long, formal_name string, origin string"
REF = "ref_id string, formal_name string, aliases array<string>"
LAB = "ref_id string, label string, aliases array<string>"


def run(spark, rel, items):
    arts = spark.createDataFrame([("A1", "opalforge/Fokakizu-Fiqanu-8B-Chat", ["Fokakizu Fiqanu 8B Chat"]), ("A2", "opalforge/Fokakizu-Fiqanu-3B-Chat", None), ("A3", "thornfield-ml/Lewasovi-Hoxiwe-8B-Chat", []), ("A4", None, None)], REF)
    labels = spark.createDataFrame([("L1", "trained_on", ["learned from corpus"]), ("L2", "trained_from", None)], LAB)
    return {tuple(r) for r in E.found(spark.createDataFrame(rel, REL).selectExpr("*", "1 as kind"), spark.createDataFrame(items, ITEM), arts, labels).collect()}


def test_found(spark):
    rel = [
        ("r1", "TrainedOn", "FOKAKZU - fiqanuu 8 billion chat", "manual"), ("r2", "is trained form", "Fokakizu Fiqanu 13B Chat", "manual"), ("r3", "cites", None, "manual"), ("r4", None, "", "manual"), ("r5", "trained_on", "opalforge/Fokakizu-Fiqanu-8B-Chat", "pipeline"),
        ("r1", "TrainedOn", "FOKAKZU - fiqanuu 8 billion chat", "manual"), ("r6", "learned  FROM corpus.", "thornfield-ml/Fokakizu Fiqanu 3B Chat", "manual"), (None, "x", "y", "manual"),
    ]
    items = [(1, "the Lewsovi_Hoxiwe_8B_chat", "manual"), (2, None, "manual"), (3, "n/a", "manual"), (1, "the Lewsovi_Hoxiwe_8B_chat", "manual")]
    assert run(spark, rel, items) == {
        ("relation", "r1", "L1"), ("object", "r1", "A1"), ("relation", "r2", "L2"), ("object", "r2", ""), ("relation", "r3", ""), ("object", "r4", ""), ("relation", "r6", "L1"), ("object", "r6", ""), ("formal_name", "1", "A3"), ("formal_name", "3", ""),
    }


def test_stages_come_from_the_list(spark):
    """Stage words no code knows: a list's own last words, met in typed values in full, cut short, drawn out, misspelt."""
    bodies = ["Fokakizu Fiqanu", "Lewasovi Hoxiwe", "Distibu Qevoma"]
    arts = [(f"A{i}{k}", f"opalforge/{b.replace(' ', '-')}-8B-{s}", [f"{b} 8B {s}"]) for i, b in enumerate(bodies) for k, s in enumerate(["Distill", "Verifier", "Router"])]
    ref = spark.createDataFrame(arts, REF)
    entries = E.list_entries(ref, spark.createDataFrame([], LAB))
    stages = E.learn_stages(entries)
    assert stages.words == ["distill", "router", "verifier"] and stages.names == {"distibu"}
    typed = {"fokakizu fiqanu 8b distilled": "A00", "8B_Lewasovi-Hoxiwe VERIF": "A11", "Distibu Qevoma routr 8 billion": "A22", "distibu qevoma 8b": "", "Lewasovi Hoxiwe verifiers 3B": "", "opalforge distill distibu-qevoma 8b": "A20"}
    values = spark.createDataFrame([("artifact", v) for v in typed], "kind string, value string")
    assert {r.value: r.ref_id for r in E.match(values, entries).collect()} == typed


def test_hot_value_and_empty(spark):
    rel = [(f"h{i:04d}", "trained on", "Fokakizu Fiqanu 8B Chat", "manual") for i in range(300)]
    got = run(spark, rel, [])
    assert len(got) == 600 and {r[2] for r in got} == {"L1", "A1"}
    assert run(spark, [], []) == set()
