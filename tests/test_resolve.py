import random
import re

from edgewright.operators import evaluate

ITEM = "item_id long, formal_name string, aliases array<string>, subsets array<string>"


def form(s):
    return "".join(c for c in s.lower() if c.isalnum())


def tokens(s):
    return {t for t in re.split(r"[/_\-. ]+", s.lower()) if t}


def subset_of(mention, items):
    for i, _, _, subsets in items:
        slug = {form(x): x for x in subsets if x.strip()}.get(form(mention))
        if slug:
            return i, slug
    low = mention.lower().strip()
    for x in evaluate.SUBCORPUS_SUFFIXES:
        prefix = low[: -len(x)].rstrip("-_ ")
        if low.endswith(x) and len(low) > len(x) + 2 and form(prefix):
            for i, name, aliases, _ in items:
                if form(prefix) in {form(s) for s in (name, *aliases)}:
                    return i, low[len(prefix) :].lstrip("-_ ")
    return None


def test_candidates_against_brute_force(spark):
    rng = random.Random(8)
    words = ["Foo", "Bar", "7B", "Base", "web", "pro"]
    name = lambda: rng.choice("-_ ").join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    entries = sorted({(f"e{rng.randrange(8)}", name()) for _ in range(16)})
    items = [(i, f"Corp-{i % 4}", [f"corp {i}"], rng.sample(["web-pro", "Base", "part-7B"], rng.randrange(3))) for i in range(6)]
    mentions = sorted({name() for _ in range(25)} | {"Corp-1-web", "corp 5_edu", "CORP-2-web-pro", "Part 7B", "x-web", "zzz", " ", "corp3-pool"})
    want = set()
    for m in mentions:
        best = {}
        for e, s in entries:
            both = len(tokens(m) & tokens(s))
            if tokens(m) and (both or form(m) == form(s)):
                score = 100 * (form(m) == form(s)) + 10 * both / len(tokens(m)) + 5 * both / len(tokens(s))
                best[e] = max(best.get(e, 0), score)
        rows = sorted((-score, "direct", e, None) for e, score in best.items())[:3]
        if tokens(m) and (hit := subset_of(m, items)):
            rows.append((-70, "subset", str(hit[0]), hit[1]))
        want |= {(m, k, c, slug, round(-score, 9), i + 1) for i, (score, k, c, slug) in enumerate(sorted(rows, key=lambda r: r[:3])[:3])}
    got = evaluate.resolved_with_subsets(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame(entries, "entry_id string, surface string"), spark.createDataFrame(items, ITEM))
    assert {(r.mention, r.form, r.candidate, r.slug, round(r.score, 9), r.place) for r in got.collect()} == want
    assert {"direct", "subset"} == {r[1] for r in want}
