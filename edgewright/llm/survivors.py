"""Best representative of each group of duplicate records, built from whole bundles.

Dependent fields stand and fall together and are taken whole from one record.  The bundles of a group are

* text: the description;
* evidence: the anchor list with its sources and explanations;
* label: the dependency kind (of a cluster: the relation);
* maker: the origin of the record (of a cluster: the system);
* names: subject and object as written.

Functional dependencies join them: the relation determines the dependency kind (label table), and
the maker determines the writing of the names, so names are only taken from a record whose maker is
of the class of the chosen maker.  Of all consistent combinations the one with the greatest total trust is
chosen by branch-and-bound: bundles are fixed in turn, best candidate first, and a branch is left as
soon as what it has plus the best of each open bundle cannot beat the incumbent.

Trust of a candidate is its place among the candidates of its bundle (the worst has 1), by
completeness, then recency, then smallest key: a record delivered twice changes nothing.  For text
and evidence, which no dependency touches, only the best can stand in an optimum; for the others
only the best of each class of the determinant.  So the state of a group is eleven candidates,
however many records it has, built by native aggregates with map-side combining.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from edgewright.llm import canon, copies

#: Texts that only stand in for a description, without outer punctuation, lower case.
STAND_INS = (
    r"n ?/ ?a|n\.a|na|tbd|tba|tbc|todo|to do|fixme|wip|xxx+|none|null|nil|nan|undefined|unknown|unspecified|empty|blank|missing|pending|placeholder|coming soon|work in progress|test"
    r"|(see|cf) (above|below|link|links|card|report|paper|repo|repository|readme|docs|documentation)"
    r"|(there is )?(no|not|without) (a |any )?(description|text|summary|details?|information|info|data)( (is |was )?(available|provided|given|yet|found|known|set|added|specified))*"
    r"|not (yet )?(available|provided|given|known|specified|stated|described|documented|applicable|set)"
    r"|(the )?(description|text|summary|details?)( is| was)?( still)? (pending|missing|unavailable|empty|tbd|todo|unknown|needed|goes here|here|to follow|follows|coming soon|not available|not provided)"
    r"|to be (added|announced|confirmed|completed|decided|defined|determined|described|done|filled|provided|written)\b.*"
    r"|(a |the )?(description|text|summary|details?) (will|to) (be|follow)\b.*"
    r"|(this |the )?(text|page|field|section|description|space)( (was|is|has been))?( (intentionally|deliberately|purposely))? left (blank|empty)\b.*"
    r"|(this |the )?(text|page|field|section|description)( (was|is))? (intentionally|deliberately) (blank|empty)\b.*"
    r"|lorem ipsum\b.*|placeholder\b.*|(insert|add|write) (a |the |your )?(description|text|summary)\b.*"
)


def collapsed_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?U)[\\s\\x{200B}\\x{FEFF}]+", " "))


def description_length(c: Column) -> Column:
    """Characters with white space collapsed; 0 for null, blank, punctuation only or a stand-in."""
    text = collapsed_text(c)
    bare = F.regexp_replace(F.lower(text), "(?U)^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")
    stands_in = (bare == "") | bare.rlike(f"^(?:{STAND_INS})$")
    return F.when(text.isNull() | stands_in, 0).otherwise(F.length(text))


def anchor_count(c: Column) -> Column:
    """Distinct anchors with both a source and an explanation; 0 for null."""
    full = lambda a: a.isNotNull() & (collapsed_text(a["source"]) != "") & (collapsed_text(a["explanation"]) != "")
    return F.coalesce(F.size(F.array_distinct(F.filter(c, full))), F.lit(0))


_OLDEST = -(2**62)


def _rank(score: Column, recorded: Column, trust: Column, key: Column) -> Column:
    """Smallest is best: high score, late, trusted, small key."""
    return F.struct((-score).alias("score"), (-F.coalesce(F.unix_micros(recorded.cast("timestamp")), F.lit(_OLDEST))).alias("late"), (-F.coalesce(trust, F.lit(1 - 2**31))).alias("trust"), key.alias("key"))


LABELS = ("direct", "indirect")
MAKERS = ("pipeline", "manual")


def _class(c: Column, names: Sequence[str]) -> Column:
    """0 or 1 for the two names of a closed list, in any case and with blanks; 2 for anything else."""
    bare = F.lower(F.trim(c))
    return F.when(bare == names[0], 0).when(bare == names[1], 1).otherwise(2)


def relation_records(relations: DataFrame) -> DataFrame:
    """One row for each delivered row that states an edge: ``h1, h2`` of its edge, ``key``, the fields, and the
    classes of its label and its maker."""
    cols = ["rel_id", "relation", "subject", "object", "description", "anchor_list", "recorded_at", "dependency_kind", "origin"]
    named = copies.stated(relations).select(*cols)
    keyed = named.withColumn("s", canon.canonical(canon.prepared(F.col("subject")))).withColumn("o", canon.canonical(canon.prepared(F.col("object"))))
    edge = copies.label(F.col("relation"))
    return keyed.select(
        F.xxhash64("s", "o", edge).alias("h1"), F.xxhash64(F.lit("edge"), "s", "o", edge).alias("h2"), F.col("rel_id").cast("string").alias("key"), "recorded_at", F.lit(None).cast("int").alias("trust"),
        "description", "anchor_list", "relation", "subject", "object", F.col("dependency_kind").alias("label"), F.col("origin").alias("maker"),
        _class(F.col("dependency_kind"), LABELS).alias("label_class"), _class(F.col("origin"), MAKERS).alias("maker_class"),
    )


def cluster_records(clusters: DataFrame, systems: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per member of each cluster; ``key`` is member_no; a cluster without members keeps one
    row of nulls.  Label classes: the relation is listed, coined, none; maker classes: the system is
    listed, not listed, none."""
    m = clusters.where("cluster_id is not null").select("cluster_id", F.explode_outer("members").alias("m"))
    one = systems.groupBy(F.col("system").alias("t_system")).agg(F.max("trust").alias("t_trust"))
    listed = labels.select(F.col("label").alias("t_label")).where("t_label is not null").distinct()
    m = m.join(one, F.col("m.system") == F.col("t_system"), "left").join(listed, F.col("m.relation") == F.col("t_label"), "left")
    known = lambda found, given: F.when(found.isNotNull(), 0).when(given.isNotNull(), 1).otherwise(2)
    return m.select(
        "cluster_id", F.col("m.member_no").alias("key"), F.col("m.recorded_at").alias("recorded_at"), F.col("t_trust").alias("trust"), F.col("m.description").alias("description"), F.col("m.anchor_list").alias("anchor_list"),
        F.col("m.relation").alias("relation"), F.col("m.subject").alias("subject"), F.col("m.object").alias("object"), F.col("m.relation").alias("label"), F.col("m.system").alias("maker"),
        known(F.col("t_label"), F.col("m.relation")).alias("label_class"), known(F.col("t_system"), F.col("m.system")).alias("maker_class"),
    )


CLASSES = (0, 1, 2)


def _states(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: the best record of the text and the evidence, and of each class of label, maker and names."""
    r = records.withColumn("d_len", description_length(F.col("description"))).withColumn("n_anchors", anchor_count(F.col("anchor_list")))
    rank = lambda score: _rank(score, F.col("recorded_at"), F.col("trust"), F.col("key"))
    d, a = F.when(F.col("d_len") > 0, rank(F.col("d_len"))), F.when(F.col("n_anchors") > 0, rank(F.col("n_anchors")))
    whole = rank(F.lit(0))
    full_names = rank(F.when(F.col("subject").contains("/"), 1).otherwise(0) + F.when(F.col("object").contains("/"), 1).otherwise(0))
    of = lambda c, kind, value: F.min(F.when(F.col(kind) == c, value))
    out = [F.min("key").alias("group_key"), F.max("key").alias("last_key"), F.min("relation").alias("relation"), F.min(d).alias("d"), F.min(a).alias("a"), F.min_by("description", d).alias("description"), F.min_by("anchor_list", a).alias("anchor_list")]
    for c in CLASSES:
        stands = F.col("key").isNotNull()
        out += [of(c, "label_class", F.when(stands, F.struct(whole.alias("r"), "label"))).alias(f"label{c}"), of(c, "maker_class", F.when(stands, F.struct(whole.alias("r"), "maker"))).alias(f"maker{c}")]
        out += [of(c, "maker_class", F.when(stands, F.struct(full_names.alias("r"), "subject", "object"))).alias(f"names{c}")]
    return r.groupBy(*keys).agg(*out)


def branch_and_bound(bundles: Sequence[Sequence[tuple[float, dict]]], consistent: Callable[[dict], bool]) -> list[dict] | None:
    """The choice of one candidate ``(trust, fields)`` per bundle with the greatest total trust for
    which ``consistent`` holds on the fields chosen so far; None if there is none.  The earlier
    candidate wins a tie."""
    order = [sorted(b, key=lambda c: -c[0]) for b in bundles]
    rest = [0.0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        rest[i] = rest[i + 1] + (order[i][0][0] if order[i] else 0.0)
    best: list = [float("-inf"), None]

    def grow(i: int, total: float, fields: dict, chosen: list[dict]) -> None:
        if total + rest[i] <= best[0]:
            return
        if i == len(order):
            best[0], best[1] = total, list(chosen)
            return
        for trust, values in order[i]:
            if total + trust + rest[i + 1] <= best[0]:
                return
            merged = fields | values
            if consistent(merged):
                grow(i + 1, total + trust, merged, [*chosen, values])

    grow(0, 0.0, {}, [])
    return best[1]


@lru_cache(maxsize=100_000)
def choose(text: int, evidence: int, label: tuple[int, ...], maker: tuple[int, ...], names: tuple[int, ...], must: int) -> tuple[int, int, int, int, int]:
    """Classes taken for text, evidence, label, maker and names, -1 for none.

    Each argument gives the trust of the candidates of a bundle by class, 0 where there is none;
    ``must`` is the class of label the relation determines, -1 if none.  A label that contradicts it is
    only taken where no candidate agrees.  The search depends on these few numbers alone, so each
    constellation is searched once per worker.
    """
    bundle = lambda name, trusts: [(float(t), {name: i}) for i, t in enumerate(trusts) if t] or [(0.0, {name: -1})]
    bundles = [bundle("text", (text,)), bundle("evidence", (evidence,)), bundle("label", label), bundle("maker", maker), bundle("names", names)]

    def consistent(f: dict, held: bool) -> bool:
        return (not held or f.get("label", must) in (must, -1)) and f.get("names", f.get("maker")) == f.get("maker", f.get("names"))

    found = branch_and_bound(bundles, lambda f: consistent(f, must >= 0)) or branch_and_bound(bundles, lambda f: consistent(f, False))
    taken = {k: v for part in found for k, v in part.items()}
    return tuple(taken[k] for k in ("text", "evidence", "label", "maker", "names"))


_TAKEN = StructType([StructField(b, IntegerType()) for b in ("text", "evidence", "label", "maker", "names")])


@F.pandas_udf(_TAKEN)
def _choose(*c: pd.Series) -> pd.DataFrame:
    rows = zip(*(x.tolist() for x in c))
    out = [choose(t, e, (l0, l1, l2), (m0, m1, m2), (n0, n1, n2), must) for t, e, l0, l1, l2, m0, m1, m2, n0, n1, n2, must in rows]
    return pd.DataFrame(out, columns=["text", "evidence", "label", "maker", "names"])


def _places(name: str) -> list[Column]:
    """Trust of the candidates of a bundle: how many candidates of the bundle are not better."""
    r = lambda c: F.col(f"{name}{c}.r")
    one = lambda x, y: F.when(r(y).isNotNull() & (r(y) >= r(x)), 1).otherwise(0)
    return [F.when(r(c).isNull(), 0).otherwise(one(c, 0) + one(c, 1) + one(c, 2)) for c in CLASSES]


def _taken(name: str, field: str) -> Column:
    out = F.lit(None)
    for c in CLASSES:
        out = F.when(F.col(f"take.{name}") == c, F.col(f"{name}{c}.{field}")).otherwise(out)
    return out


def _searched(states: DataFrame) -> DataFrame:
    """``states`` with what each group's survivor is made of."""
    there = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    chosen = states.withColumn("take", _choose(there("d"), there("a"), *_places("label"), *_places("maker"), *_places("names"), F.coalesce("must", F.lit(-1))))
    key = lambda b, taken: F.when(F.col(f"take.{taken}") >= 0, F.col(f"{b}.key").cast("string"))
    return chosen.select(
        "group_kind", "group_key", "relation", _taken("label", "label").alias("label"), _taken("maker", "maker").alias("maker"), _taken("names", "subject").alias("subject"), _taken("names", "object").alias("object"),
        F.when(F.col("take.text") >= 0, F.col("description")).alias("description"), F.when(F.col("take.evidence") >= 0, F.col("anchor_list")).alias("anchor_list"), F.col("must"),
        F.coalesce(key("d", "text"), F.lit("")).alias("description_from"), F.coalesce(key("a", "evidence"), F.lit("")).alias("anchors_from"),
        _taken("label", "r.key").cast("string").alias("label_from"), _taken("maker", "r.key").cast("string").alias("maker_from"), _taken("names", "r.key").cast("string").alias("names_from"),
    )


def relation_survivors(relations: DataFrame, labels: DataFrame) -> DataFrame:
    """The survivor of each group of two or more copies of an edge; ``group_key`` is its smallest rel_id."""
    must = labels.groupBy(F.col("label").alias("relation")).agg(F.min(_class(F.col("dependency_kind"), LABELS)).alias("must"))
    groups = _states(relation_records(relations), ["h1", "h2"]).where("group_key < last_key")
    ready = groups.join(must.withColumn("must", F.when(F.col("must") < 2, F.col("must"))), "relation", "left").withColumn("group_kind", F.lit("relation"))
    return _searched(ready)


def cluster_survivors(clusters: DataFrame, systems: DataFrame, labels: DataFrame) -> DataFrame:
    """The survivor of each cluster; ``group_key`` is cluster_id; one without members has no fields."""
    groups = _states(cluster_records(clusters, systems, labels), ["cluster_id"]).drop("group_key").withColumnRenamed("cluster_id", "group_key")
    return _searched(groups.withColumn("must", F.lit(None).cast("int")).withColumn("group_kind", F.lit("cluster")))


def survivors(relations: DataFrame, clusters: DataFrame, systems: DataFrame, labels: DataFrame) -> DataFrame:
    """One record for each group of copies of an edge and each cluster: ``group_kind, group_key, relation,
    dependency_kind, maker, subject, object, description, anchor_list`` and the records its bundles come from,
    ``description_from`` and ``anchors_from`` '' if no record has any.

    A dependency kind that is no word of the closed list gives way to the one its relation determines.
    Rows without rel_id, subject or object belong to no group; a row delivered again counts once; other columns are ignored; empty
    tables give no rows.
    """
    r, c = relation_survivors(relations, labels), cluster_survivors(clusters, systems, labels)
    kinds = F.when(F.col("must") == 0, LABELS[0]).when(F.col("must") == 1, LABELS[1])
    word = F.when(_class(F.col("label"), LABELS) < 2, F.lower(F.trim("label"))).otherwise(F.coalesce(kinds, F.col("label")))
    r = r.withColumn("dependency_kind", word)
    c = c.withColumn("dependency_kind", F.lit(None).cast("string")).withColumn("relation", F.col("label"))
    return r.unionByName(c).drop("label", "must")


def found(relations: DataFrame, clusters: DataFrame, systems: DataFrame, labels: DataFrame) -> DataFrame:
    """``group_kind, group_key, description_from, anchors_from``: whose description and whose
    anchors each group's survivor takes; '' if none has any."""
    return survivors(relations, clusters, systems, labels).select("group_kind", "group_key", "description_from", "anchors_from")
