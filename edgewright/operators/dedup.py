"""Name deduplication: signatures, candidate pairs and clusters, conflict-guarded unions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.functions import names

#: Suffixes of which the first that fits is taken off.
SUFFIXES = ("-turbo", "-Turbo", "-Instruct", "-instruct", "-Base", "-base", "-Chat", "-chat", "-it", "-IT", "-hf", "-HF", "-preview", "-Preview")
POSTING = 200


def node_table(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("subject", "object")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


_WIKI = r"(?U)^(.+?)\s*\[([^\]]+)\]\s*$"
_TAIL = r"(?U)\s+\d+(?:\.\d+)?\s*$"


def _attributes(inside: Column) -> Column:
    """The ``k=v`` pieces of a bracket, ends blank-free."""
    pieces = F.filter(F.split(inside, ","), lambda p: p.contains("="))
    return F.transform(pieces, lambda p: F.struct(names.strip(F.substring_index(p, "=", 1)).alias("k"), names.strip(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))


def _unbracketed(n: Column) -> Column:
    """``Family 3 [size=7B, stage=Base, version=3.1]`` as ``Family-3.1-7B-Base``; other names as they are."""
    family, found = F.regexp_extract(n, _WIKI, 1), _attributes(F.regexp_extract(n, _WIKI, 2))
    value = lambda k: F.coalesce(F.try_element_at(F.filter(found, lambda a: a["k"] == k), F.lit(-1))["v"], F.lit(""))
    named = F.when((value("version") != "") & family.rlike(_TAIL), F.concat(F.regexp_replace(family, _TAIL, ""), F.lit(" "), value("version"))).otherwise(family)
    more = F.filter(F.array(*(value(k) for k in ("size", "variant", "stage", "track"))), lambda v: v != "")
    return F.when(n.rlike(_WIKI), F.replace(F.array_join(F.concat(F.array(names.strip(named)), more), "-"), F.lit(" "), F.lit("-"))).otherwise(n)


def signature_columns(n: Column) -> dict[str, Column]:
    """The parts of a name's signature; all comparable, arrays sorted and joined."""
    core = names.strip(F.regexp_replace(F.regexp_replace(_unbracketed(n), r"(?U)\s*\([^)]*\)\s*", ""), r"(?U)\s*\[[^\]]*\]\s*", ""))
    norm = F.regexp_replace(F.regexp_replace(F.regexp_replace(names.strip(F.lower(names.bare(core))), r"(?U)[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")
    paren = F.lower(names.strip(F.regexp_extract(n, r"(?U)\(([^)]+)\)\s*$", 1)))
    alias = paren.contains("/") & ~paren.rlike("split|subset|variant|ablation|config|version|diamond")
    attributes = F.transform(_attributes(F.lower(F.regexp_extract(n, r"\[([^\]]+)\]", 1))), lambda a: F.when(~a["k"].isin("size", "version", "stage", "track"), F.concat(a["k"], F.lit("="), a["v"])))
    days = F.filter(names.dates(n), lambda d: d.cast("int").between(1001, 2029))
    return {
        "org": names.org(core), "bare_norm": norm, "bare_collapsed": F.regexp_replace(norm, "[-.]", ""),
        "versions": F.array_join(names.versions(n), ","), "sizes": F.array_join(names.sizes(n), ","), "stages": F.array_join(names.stage_substrings(n), ","),
        "dates": F.array_join(F.array_except(days, F.concat(names.versions(n), names.sizes(n))), ","),
        "paren": F.when(n.rlike(r"(?U)\([^)]+\)\s*$") & ~alias, F.concat(F.lit("("), paren)).otherwise(""), "bracket": F.array_join(F.array_sort(F.array_distinct(attributes)), ","),
    }


def can_merge(a: str, b: str) -> Column:
    """Whether the signatures in the struct columns ``a`` and ``b`` agree: equal collapsed names, parentheses and bracket,
    and no organisation, version, size, stage or date given on both sides that differs."""
    x, y = (lambda k: F.col(f"{a}.{k}")), (lambda k: F.col(f"{b}.{k}"))
    out = (x("bare_collapsed") == y("bare_collapsed")) & (x("paren") == y("paren")) & (x("bracket") == y("bracket"))
    for k in ("org", "versions", "sizes", "stages", "dates"):
        out = out & ((x(k) == "") | (y(k) == "") | (x(k) == y(k)))
    return out


def signature_buckets(nodes: DataFrame) -> DataFrame:
    """``canonical, members, degree`` of names with one exact signature, names that name no artifact left
    out; canonical: with an organisation first, then by degree, length and name."""
    sig = nodes.where(~names.categorical_drop(F.col("name"))).select("name", "degree", *(c.alias(k) for k, c in signature_columns(F.col("name")).items()))
    keys = [k for k in signature_columns(F.col("name"))]
    best = F.max_by("name", F.struct((F.col("org") != "").alias("p"), "degree", F.length("name").alias("l"), "name"))
    return sig.groupBy(*keys).agg(best.alias("canonical"), F.count("*").alias("members"), F.sum("degree").alias("degree")).select("canonical", "members", "degree")


def affix_pairs(nodes: DataFrame, least: int = 4) -> DataFrame:
    """``bare_name, full_name``: names without an organisation whose lex form equals, begins or ends that of
    one with an organisation.  The long form's beginnings and ends are matched by equality."""
    lex = nodes.select("name", names.lex_collapse(names.bare(F.col("name"))).alias("lex"), (names.org(F.col("name")) != "").alias("full"))
    short = lex.where(~F.col("full") & (F.length("lex") >= least)).select(F.col("name").alias("bare_name"), F.col("lex").alias("part"))
    sizes = F.sequence(F.lit(least), F.length("lex"))
    ends = F.array_distinct(F.concat(F.transform(sizes, lambda n: F.substring(F.col("lex"), F.lit(1), n)), F.transform(sizes, lambda n: F.substring(F.col("lex"), F.length("lex") - n + 1, n))))
    long = lex.where(F.col("full") & (F.length("lex") >= least)).select(F.col("name").alias("full_name"), F.explode(ends).alias("part"))
    return short.join(long, "part").select("bare_name", "full_name").distinct()


def suffix_pairs(nodes: DataFrame) -> DataFrame:
    """``name, stripped``: pairs of nodes of which one is the other without the first fitting suffix."""
    n = F.col("name")
    stripped = F.lit(None).cast("string")
    for s in reversed(SUFFIXES):
        stripped = F.when(n.endswith(s), F.substring(n, F.lit(1), F.length(n) - len(s))).otherwise(stripped)
    cut = nodes.select("name", stripped.alias("stripped")).where("stripped <> ''")
    return cut.join(nodes.select(F.col("name").alias("stripped")), "stripped", "left_semi").select("name", "stripped")


def cross_org_names(nodes: DataFrame) -> DataFrame:
    """``lex, n_names, n_orgs, n_bare``: one bare name under two organisations, or one and none, 2 to 6 names."""
    x = nodes.select("name", names.lex_collapse(names.bare(F.col("name"))).alias("lex"), names.org(F.col("name")).alias("org")).where("lex <> ''")
    g = x.groupBy("lex").agg(F.count("*").alias("n_names"), F.countDistinct(F.nullif("org", F.lit(""))).alias("n_orgs"), F.sum((F.col("org") == "").cast("long")).alias("n_bare"))
    return g.where("n_names between 2 and 6 and (n_orgs >= 2 or (n_orgs >= 1 and n_bare >= 1))")


def token_pairs(nodes: DataFrame, threshold: float = 0.6, posting: int = POSTING, shared: int = 2) -> DataFrame:
    """``a, b, n_shared, n_union``: name pairs that share ``shared`` tokens of no more than ``posting`` names
    and whose token sets are alike by Jaccard.  The posting limit is the operator's definition of a
    telling token, it bounds every list that is paired."""
    t = nodes.select("name", names.tokens(F.col("name")).alias("ts")).where("size(ts) > 0")
    long = t.select("name", F.explode("ts").alias("token"))
    rare = long.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n").between(2, posting)).select("token")
    few = long.join(rare, "token", "left_semi")
    pairs = few.join(few.withColumnRenamed("name", "b"), "token").where("name < b").groupBy(F.col("name").alias("a"), "b").agg(F.count("*").alias("n")).where(F.col("n") >= shared)
    full = pairs.join(t.select(F.col("name").alias("a"), F.col("ts").alias("ta")), "a").join(t.select(F.col("name").alias("b"), F.col("ts").alias("tb")), "b")
    both, either = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    return full.select("a", "b", both.alias("n_shared"), either.alias("n_union")).where(F.col("n_shared") >= threshold * F.col("n_union"))


def specs_conflict(a: dict, b: dict) -> bool:
    """Whether any kind of specifier is given on both sides and differs."""
    return any(a[k] and b[k] and a[k] != b[k] for k in a)


def guarded_unions(proposals: DataFrame, specs: DataFrame) -> DataFrame:
    """``name, component, refused``: greedy unions of ``proposals(component, ord, a, b)`` in order, refused
    where the specifiers of the two components so far (``specs(name, sizes, versions, dates, stages)``) conflict.

    ``component`` is a connected component of the proposals; the fold is sequential within one.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {}
        spec: dict[str, dict] = {}
        for name, *parts in pdf[["a", "sa", "va", "da", "ta"]].drop_duplicates("a").values.tolist() + pdf[["b", "sb", "vb", "db", "tb"]].drop_duplicates("b").values.tolist():
            root.setdefault(name, name)
            spec.setdefault(name, dict(zip("svdt", parts)))

        def find(x: str) -> str:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        refused = 0
        for _, a, b in sorted(pdf[["ord", "a", "b"]].values.tolist()):
            ra, rb = find(a), find(b)
            if ra == rb:
                continue
            if specs_conflict(spec[ra], spec[rb]):
                refused += 1
                continue
            low, high = min(ra, rb), max(ra, rb)
            root[high] = low
            spec[low] = {k: spec[low][k] or spec[high][k] for k in spec[low]}
        return pd.DataFrame([(n, find(n), refused) for n in sorted(root)], columns=["name", "component", "refused"])

    text = lambda c: F.array_join(c, ",")
    side = lambda x: specs.select(F.col("name").alias(x), text("sizes").alias(f"s{x}"), text("versions").alias(f"v{x}"), text("dates").alias(f"d{x}"), text("stages").alias(f"t{x}"))
    full = proposals.join(side("a"), "a", "left").join(side("b"), "b", "left").fillna("")
    return full.groupBy(F.col("component").alias("group")).applyInPandas(lambda pdf: fold(pdf), "name string, component string, refused int")


def name_specs(nodes: DataFrame) -> DataFrame:
    n = F.col("name")
    return nodes.select("name", names.sizes(n).alias("sizes"), F.filter(names.versions(n), lambda v: v.contains(".")).alias("versions"), names.dates(n).alias("dates"), names.stage_tokens(n).alias("stages"))
