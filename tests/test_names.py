from edgewright.plans import edge_queries


def test_forms_of_names_outside_ascii(spark, tmp_path):
    want = {
        "Foo\u00a07B": ("foo7b", "foo-7b", "foo-7b"), "Foo\u20137B": ("foo7b", "foo-7b", "foo7b"), "\uff26oo": ("oo", "oo", "oo"),
        "\u00a0Org/Foo": ("orgfoo", "org/foo", "orgfoo"), "Org/Foo\t": ("orgfoo", "org/foo", "orgfoo"),
        "Foo\t7B": ("foo7b", "foo-7b", "foo-7b"), "Foo\n7B": ("foo7b", "foo-7b", "foo-7b"), "Foo 7B": ("foo7b", "foo-7b", "foo-7b"),
    }
    spark.createDataFrame([(n, "Foo 7B") for n in want] + [(None, "")], "subject string, object string").write.parquet(f"{tmp_path}/merge_relations.parquet")
    rows = edge_queries.QUERIES["all_name_forms"](spark, str(tmp_path)).collect()
    assert {r.name: (r.lex, r.canonical, r.slug) for r in rows} == want
