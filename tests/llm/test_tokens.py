import os
import random
import string

import pytest
from edgewright.llm import packing, tokens
from hypothesis import given, settings
from hypothesis import strategies as st

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
ENC = tokens.Encoder(tokens.read_vocabulary(tokens.VOCABULARY)) if os.path.exists(tokens.VOCABULARY) else None


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library(library):
    rng = random.Random(2)
    alphabet = string.ascii_letters + string.digits + "  \n\t'.,!?éüß中文日本語Привет😀‍ 　’“"
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "it's we'll I'D", "a" * 5000, "日本" * 700, " " * 300] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ENC.encode(t) == want.ids and ENC.count(t) == len(want.ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn")), max_size=60))
def test_round_trip(text):
    assert ENC.decode(ENC.encode(text)) == text


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (1, "hello world"), (None, "x")], "doc_id long, text string").selectExpr("*", "'q' as ids")
    got = sorted(((r.doc_id, r.ids) for r in tokens.encoded(df).collect()), key=str)
    assert got == sorted([(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, None), (None, [87])], key=str)
    back = {(r.doc_id, r.text) for r in tokens.decoded(tokens.encoded(df)).collect()}
    assert back == {(1, "hello world"), (2, ""), (3, None), (None, "x")}
    assert tokens.encoded(df.limit(0)).count() == 0


def best_fit(sizes, cap):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= s
        else:
            room.append(cap - s)
    return len(room)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_pack_is_whole_and_tight(sizes):
    where = packing.pack(sizes, 100)
    loads = {}
    for s, w in zip(sizes, where):
        loads[w] = loads.get(w, 0) + s
    assert len(where) == len(sizes) and all(v <= 100 for v in loads.values())
    if sizes:
        assert packing.least_windows(sizes, 100) <= len(loads) <= best_fit(sizes, 100) * 1.15 + 1


def test_packed_frame(spark):
    items = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, None), (5, 7), (6, 3), (None, 4), (7, 20)], "doc_id long, n_tokens int")
    kinds = spark.createDataFrame([("small", 10), ("big", 100), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    got = packing.packed(items, kinds).collect()
    for kind, cap in (("small", 10), ("big", 100)):
        loads, docs = {}, {}
        for r in got:
            if r.container_kind == kind:
                loads[r.container_id] = loads.get(r.container_id, 0) + r.n_tokens
                docs.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
        assert max(loads.values()) <= cap
        assert {d: sum(n for _, n in p) for d, p in docs.items()} == {1: 25, 2: 10, 3: 0, 4: 0, 5: 7, 6: 3, 7: 20}
        assert all(len(p) == (1 if sum(n for _, n in p) <= cap else -(-sum(n for _, n in p) // cap)) for p in docs.values())
    assert packing.packed(items.limit(0), kinds).count() == 0 and packing.packed(items, kinds.limit(0)).count() == 0
