"""Operators on the identity lattice: items with open facets, ordered by facet inclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import names
from edgewright.runtime import Stage

#: Link kinds that anchor one artifact only.
UNIQUE_LINKS = ("hf_model", "hf_dataset", "vendor_docs")
MOST_FACETS = 14


def items_of(lattice: DataFrame) -> DataFrame:
    """One row per item_id of non-null identity, with ``facets``: sorted distinct ``k=v`` of facets
    with a value (exact text), family included."""
    facets = F.array_sort(F.array_distinct(F.transform(F.filter("identity", lambda e: e.isNotNull() & (F.trim(e["v"]) != "")), lambda e: F.concat(e["k"], F.lit("="), e["v"]))))
    return lattice.where("identity is not null and item_id is not null").dropDuplicates(["item_id"]).withColumn("facets", facets).withColumn("family", F.coalesce("family", F.lit("")))


def own_facets() -> Column:
    return F.filter("facets", lambda f: ~f.startswith("family="))


def _masked_subsets(df: DataFrame, facets: str, strict: bool, least: int = 0) -> DataFrame:
    """Explodes each row into the subsets of an array column, as ``subset`` with its bit ``mask``."""
    n = F.size(facets)
    top = F.call_function("shiftleft", F.lit(1), n) - F.lit(2 if strict else 1)
    masks = df.withColumn("mask", F.explode(F.when(top >= least, F.sequence(F.lit(least), top)).otherwise(F.array().cast("array<int>"))))
    return masks.withColumn("subset", F.filter(facets, lambda e, i: F.getbit(F.col("mask"), i) == 1))


def _subsets(df: DataFrame, facets: str, strict: bool, least: int = 0) -> DataFrame:
    return _masked_subsets(df, facets, strict, least).drop("mask")


def _contained(sets: DataFrame, wide: DataFrame, by: list[str]) -> DataFrame:
    """Columns of ``wide`` with those of ``sets`` (``subset`` and more) whose ``subset`` lies properly within ``own``, both of one ``by``.

    Each set is posted under its rarest facet and met by the facets of the wide ones; the empty set is met as such.
    """
    single = sets.select(*by, "subset", F.explode("subset").alias("facet"))
    often = single.groupBy(*by, "facet").agg(F.count("*").alias("often"))
    rarest = single.join(often, [*by, "facet"]).groupBy(*by, "subset").agg(F.min_by("facet", F.struct("often", "facet")).alias("facet"))
    posted = sets.join(rarest, [*by, "subset"])
    met = wide.withColumn("facet", F.explode("own")).join(posted, [*by, "facet"]).where((F.size("subset") < F.size("own")) & (F.size(F.array_except("subset", "own")) == 0)).drop("facet")
    return met.unionByName(wide.join(sets.where(F.size("subset") == 0), by))


def subsumed_pairs(items: DataFrame) -> DataFrame:
    """``family, parent_id, child_id``: all facets of the parent are the child's, and not all the other
    way.  A set of up to ``MOST_FACETS`` meets its subsets by equality, so only true pairs are ever formed;
    wider ones meet the sets of each of their facets, and the containment is tested."""
    it = items.select("item_id", "family", own_facets().alias("own"))
    sets = it.groupBy("family", "own").agg(F.collect_list("item_id").alias("ids"))
    children = sets.withColumnRenamed("ids", "child_ids")
    probe = _subsets(children.where(F.size("own").between(1, MOST_FACETS)), "own", strict=True)
    held = sets.select("family", F.col("own").alias("subset"), F.col("ids").alias("parent_ids"))
    met = probe.join(held, ["family", "subset"])
    wide = children.where(F.size("own") > MOST_FACETS)
    if not wide.isEmpty():
        met = met.unionByName(_contained(held, wide, ["family"]))
    return met.select("family", F.explode("parent_ids").alias("parent_id"), "child_ids").select("family", "parent_id", F.explode("child_ids").alias("child_id"))


def direct_parents(items: DataFrame) -> DataFrame:
    """Subsumed pairs with no item strictly between.

    Found between the distinct facet sets, which are staged, and only then given their items.  What a set of up to
    ``MOST_FACETS`` contains is known as masks of its own facets: the parents are the masks within no other, chosen per set
    without a join.  Of what a wider set contains, a set goes that is a parent of another, or within another wide one.
    """
    stage = Stage(items.sparkSession, "parents")
    it = items.select("item_id", "family", own_facets().alias("own"))
    sets = stage.write(it.groupBy("family", "own").agg(F.min("item_id").alias("set_id"), F.collect_list("item_id").alias("ids")), "sets")
    held = sets.select("family", F.col("own").alias("subset"), F.col("set_id").alias("parent"))
    children = sets.select("family", "own", F.col("set_id").alias("child"))
    probe = _masked_subsets(children.where(F.size("own").between(1, MOST_FACETS)), "own", strict=True)
    met = probe.join(held, ["family", "subset"]).groupBy("child").agg(F.collect_list(F.struct("mask", "parent")).alias("met"))
    within = lambda a, b: (a != b) & (a.bitwiseAND(b) == a)
    largest = F.filter("met", lambda a: ~F.exists("met", lambda b: within(a["mask"], b["mask"])))
    direct = met.select("child", F.explode(F.transform(largest, lambda a: a["parent"])).alias("parent"))
    wide = children.where(F.size("own") > MOST_FACETS)
    if not wide.isEmpty():
        direct = stage.write(direct, "direct")
        inside = stage.write(_contained(held, wide, ["family"]).select("child", "parent"), "inside")
        below = direct.unionByName(inside).select(F.col("child").alias("mid"), "parent")
        between = below.join(inside.select("child", F.col("parent").alias("mid")), "mid").select("child", "parent").distinct()
        direct = direct.unionByName(inside.join(between, ["child", "parent"], "left_anti"))
    of_child = sets.select(F.col("set_id").alias("child"), "family", F.col("ids").alias("child_ids"))
    pairs = direct.join(of_child, "child").join(sets.select(F.col("set_id").alias("parent"), F.col("ids").alias("parent_ids")), "parent")
    return pairs.select("family", F.explode("parent_ids").alias("parent_id"), "child_ids").select("family", "parent_id", F.explode("child_ids").alias("child_id"))


def merged_items(lattice: DataFrame) -> DataFrame:
    """Items of one (formal_name, first link URL) over all families: the first family and kind win, aliases and
    links are united."""
    first_url = F.get(F.filter(F.transform(F.coalesce("links", F.array().cast("array<struct<kind:string,url:string>>")), lambda x: x["url"]), lambda u: u.isNotNull()), F.lit(0))
    it = lattice.where("formal_name is not null").dropDuplicates(["item_id"]).withColumn("url", first_url)
    base = it.groupBy("formal_name", "url").agg(F.min("item_id").alias("item_id"), F.min_by("family", "item_id").alias("family"), F.min_by("kind", "item_id").alias("kind"), F.count("*").alias("merged"))
    aliases = it.select("formal_name", "url", F.explode("aliases").alias("a")).groupBy("formal_name", "url").agg(F.countDistinct("a").alias("n_aliases"))
    key = [F.col("formal_name") == F.col("f2"), F.col("url").eqNullSafe(F.col("u2"))]
    return base.join(aliases.select(F.col("formal_name").alias("f2"), F.col("url").alias("u2"), "n_aliases"), key, "left").select("item_id", "formal_name", "url", "family", "kind", "merged", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))


def identity_conflicts(lattice: DataFrame) -> DataFrame:
    """Facets of one formal_name with several values: the first value and each later other one."""
    e = lattice.where("formal_name is not null and identity is not null").dropDuplicates(["item_id"]).select("item_id", "formal_name", F.explode("identity").alias("e")).where("e is not null and e.v is not null").select("formal_name", F.col("e.k").alias("k"), F.col("e.v").alias("v"), "item_id")
    per = e.groupBy("formal_name", "k", "v").agg(F.min("item_id").alias("ord"))
    rank = per.withColumn("r", F.row_number().over(Window.partitionBy("formal_name", "k").orderBy("ord", "v")))
    first = rank.where("r = 1").select("formal_name", "k", F.col("v").alias("first_value"))
    return rank.where("r > 1").join(first, ["formal_name", "k"]).select("formal_name", "k", "first_value", F.col("v").alias("other_value"))


def family_keys(lattice: DataFrame) -> DataFrame:
    """Facet keys in use per family, in the order of their first item."""
    e = items_of(lattice).select("family", "item_id", F.explode("identity").alias("e")).where("e is not null")
    return e.groupBy("family", F.col("e.k").alias("k")).agg(F.min("item_id").alias("first_item"), F.count("*").alias("n"))


def expanded(items: DataFrame, most_facets: int = MOST_FACETS) -> DataFrame:
    """Concepts between root and items: every facet subset of 1 to N-1 own facets that no item of the
    family has, once, with its label and the first item that yields it.  An item of more than ``most_facets``
    has too many and is an error."""
    wide = F.raise_error(F.concat(F.lit(f"more than {most_facets} facets to expand: item "), F.col("item_id").cast("string")))
    own = F.when(F.size(own_facets()) > most_facets, wide.cast("array<string>")).otherwise(own_facets())
    it = items.select("item_id", "family", own.alias("own")).where(F.size("own") >= 2)
    made = _subsets(it, "own", strict=True, least=1)
    new = made.groupBy("family", "subset").agg(F.min("item_id").alias("from_item"))
    known = items.select("family", own_facets().alias("subset")).distinct()
    label = F.concat_ws(" ", F.col("family"), F.array_join(F.transform("subset", lambda f: F.substring(f, F.instr(f, "=") + 1, F.length(f))), " "))
    return new.join(known, ["family", "subset"], "left_anti").select("family", F.array_join("subset", ", ").alias("facets"), label.alias("label"), "from_item")


def completed_roots(lattice: DataFrame) -> DataFrame:
    """Families without a root item (facets of ``family`` only) and the root made for each: named as the
    family, kind of its first item."""
    it = items_of(lattice).where("family <> ''")
    per = it.groupBy("family").agg(F.max(F.size(own_facets()) == 0).alias("has_root"), F.min_by("kind", "item_id").alias("kind"), F.count("*").alias("n_items"))
    return per.where("not has_root").select("family", F.col("family").alias("formal_name"), "kind", "n_items")


def lattice_stats(lattice: DataFrame) -> DataFrame:
    """Items, families, roots, linked, described and aliasless items."""
    it = items_of(lattice)
    n = lambda c: F.sum(c.cast("long"))
    return it.agg(
        F.count("*").alias("n_items"), F.countDistinct("family").alias("n_families"), n(F.size(own_facets()) == 0).alias("n_roots"), n(F.coalesce(F.size("links"), F.lit(0)) > 0).alias("n_linked"),
        n(F.coalesce(F.trim("description"), F.lit("")) != "").alias("n_described"), n(F.coalesce(F.size("aliases"), F.lit(0)) == 0).alias("n_without_alias"), F.sum(F.coalesce(F.size("subsets"), F.lit(0)).cast("long")).alias("n_subsets"),
    )


def link_kinds(lattice: DataFrame) -> DataFrame:
    return items_of(lattice).select(F.explode("links").alias("x")).groupBy(F.col("x.kind").alias("kind")).agg(F.count("*").alias("n"))


def has_unique_link() -> Column:
    return F.coalesce(F.exists("links", lambda x: x["kind"].isin(*UNIQUE_LINKS) & (F.trim(x["url"]) != "")), F.lit(False))


def _bare_domain(url: Column) -> Column:
    """A URL of scheme and host only."""
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/*([?#].*)?$"), F.lit(False))


#: Link kinds that make an item a released artifact, or a concept.
CANONICAL_LINKS, CONCEPT_LINKS = ("hf_model", "hf_dataset", "github"), ("paper", "blog", "vendor_docs", "hf_collection")


def item_role() -> Column:
    """family-root, unanchored, concept, canonical or other, by the facet keys and the first link."""
    first = F.get("links", F.lit(0))
    keys = F.array_distinct(F.transform(F.filter("identity", lambda e: e.isNotNull()), lambda e: e["k"]))
    kind = F.coalesce(first["kind"], F.lit(""))
    by_kind = F.when(kind.isin(*CANONICAL_LINKS), "canonical").when(kind.isin(*CONCEPT_LINKS), "concept").otherwise("other")
    return F.when((F.size(keys) == 1) & (keys[0] == "family"), "family-root").when(kind == "", "unanchored").when(_bare_domain(first["url"]), "concept").otherwise(by_kind)


def item_roles(lattice: DataFrame) -> DataFrame:
    return items_of(lattice).select("item_id", item_role().alias("role"))


def rebuilt(lattice: DataFrame, canon: DataFrame) -> DataFrame:
    """One item per canonical name (``canon(name, canonical)``; unknown names stay, names mapped to null go): the item of that
    very name, else the first, with the number of items it stands for."""
    it = items_of(lattice).where("formal_name <> ''").join(canon.select(F.col("name").alias("formal_name"), "canonical", F.lit(True).alias("known")), "formal_name", "left")
    it = it.withColumn("name", F.when(F.col("known"), F.col("canonical")).otherwise(F.col("formal_name"))).where("name <> ''")
    order = F.struct((F.col("formal_name") != F.col("name")).alias("other"), "item_id")
    taken = F.min_by(F.struct("item_id", "family", "kind"), order).alias("i")
    return it.groupBy("name").agg(taken, F.count("*").alias("alias_count")).select("name", "i.item_id", "i.family", "i.kind", "alias_count")


def name_variants(c: Column) -> Column:
    """The forms under which a name may stand in a list of subsets: its slug without, with other or with spelled-out marks, and
    its alphanumeric form; distinct, none empty."""
    s = names.slug(c)
    swap = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    forms = [s, swap(s, "-", ""), swap(s, "-", "_"), swap(s, "+", "plus"), swap(s, "+", "-plus"), names.alnum_form(names.strip(c)), swap(swap(s, "-", ""), "+", "plus"), swap(swap(s, "-", "_"), "+", "plus")]
    return F.array_distinct(F.filter(F.array(*forms), lambda f: f != ""))


# -- edges over the lattice --------------------------------------------------------------------
def endpoint_identities(e: DataFrame, lattice: DataFrame) -> DataFrame:
    """``name, family, facets`` of each endpoint: of the first item of that formal_name, else of its
    virtual address; endpoints with neither are left out."""
    by_name = items_of(lattice).where("formal_name is not null").groupBy("formal_name").agg(F.min_by(F.struct("family", "facets"), "item_id").alias("i"))
    ends = e.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    address = names.address_facets(F.col("name"))
    met = ends.join(by_name, ends.name == by_name.formal_name, "left").withColumn("facets", F.coalesce("i.facets", address)).where("facets is not null")
    family = F.get(F.filter("facets", lambda f: f.startswith("family=")), F.lit(0))
    return met.select("name", F.coalesce(F.substring(family, F.lit(8), F.length(family)), F.lit("")).alias("family"), "facets")


def identified_edges(e: DataFrame, identities: DataFrame) -> DataFrame:
    s = identities.select(F.col("name").alias("subject"), F.col("family").alias("s_family"), F.col("facets").alias("s_facets"))
    o = identities.select(F.col("name").alias("object"), F.col("family").alias("o_family"), F.col("facets").alias("o_facets"))
    return e.join(s, "subject").join(o, "object").select("rel_id", "relation", F.coalesce("dependency_kind", F.lit("")).alias("kind"), "s_family", "s_facets", "o_family", "o_facets", "subject", "object")


def _classes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation", "kind", "s_family", "o_family", "s_facets", "o_facets").agg(F.min("rel_id").alias("first_id"), F.count("*").alias("n"))


def class_members(edges: DataFrame) -> DataFrame:
    """``class_id, rel_id``: each edge and the first edge of its identities, relation and kind."""
    at = ["relation", "kind", "s_family", "o_family", "s_facets", "o_facets"]
    return edges.select("rel_id", *at).join(edges.groupBy(*at).agg(F.min("rel_id").alias("class_id")), at).select("class_id", "rel_id")


def edge_subsumption(edges: DataFrame) -> DataFrame:
    """``general_id, specific_id`` between classes of edges with equal identities: same relation and kind,
    the general one's facets within the specific one's at both ends, not both equal.

    Each class of up to ``MOST_FACETS`` meets the generalisations of its own facets by equality, wider ones
    meet the classes of each of their facets.
    """
    c = _classes(edges)
    drop = lambda a: F.filter(a, lambda f: ~f.startswith("family="))
    both = c.withColumn("own", F.array_sort(F.concat(F.transform(drop("s_facets"), lambda f: F.concat(F.lit("s:"), f)), F.transform(drop("o_facets"), lambda f: F.concat(F.lit("o:"), f)))))
    probe = _subsets(both.where(F.size("own").between(1, MOST_FACETS)), "own", strict=True)
    keys = ["relation", "kind", "s_family", "o_family"]
    held = both.select(*keys, F.col("own").alias("subset"), F.col("first_id").alias("general_id"))
    pairs = probe.join(held, [*keys, "subset"]).select("general_id", F.col("first_id").alias("specific_id"))
    wide = both.where(F.size("own") > MOST_FACETS).select(*keys, "own", "first_id")
    if not wide.isEmpty():
        pairs = pairs.unionByName(_contained(held, wide, keys).select("general_id", F.col("first_id").alias("specific_id")))
    return pairs


def sibling_conflicts(edges: DataFrame) -> DataFrame:
    """``first_id, second_id``: classes of one relation, kind and subject identity whose objects are of
    one family and incomparable."""
    c = _classes(edges)
    b = c.select("relation", "kind", "s_family", "s_facets", "o_family", F.col("o_facets").alias("o2"), F.col("first_id").alias("second_id"))
    incomparable = (F.size(F.array_except("o_facets", "o2")) > 0) & (F.size(F.array_except("o2", "o_facets")) > 0)
    return c.join(b, ["relation", "kind", "s_family", "s_facets", "o_family"]).where((F.col("first_id") < F.col("second_id")) & incomparable).select("first_id", "second_id")


# -- hints -------------------------------------------------------------------------------------
def hints(lattice: DataFrame) -> DataFrame:
    """``hint, family, item_id, detail`` of the item and family rules that need no outside text."""
    it = items_of(lattice)
    row = lambda df, hint, detail: df.select(F.lit(hint).alias("hint"), "family", "item_id", detail.alias("detail"))
    nothing = F.lit(None).cast("string")
    urls = it.select("family", "item_id", "formal_name", F.explode("links").alias("x")).where("trim(x.url) <> ''").select("family", "item_id", F.col("x.url").alias("url"), F.col("x.kind").alias("kind"))
    phantom = row(it.where(F.coalesce(F.size("aliases"), F.lit(0)) == 0), "phantom_item", nothing)
    twin = it.groupBy("family", "facets").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n")).where("n > 1")
    collision = row(twin, "sibling_identity_collision", F.col("n").cast("string"))
    branch = row(it.where("formal_name like '%@%'"), "branch_variant_in_formal_name", F.expr("substring_index(formal_name, '@', -1)"))
    fam = it.where("family <> ''").groupBy("family").agg(F.min("item_id").alias("item_id"), F.max(F.size(own_facets()) == 0).alias("root"), F.max(has_unique_link()).alias("entity"), F.count("*").alias("n"), F.countDistinct(F.nullif(names.org(F.col("formal_name")), F.lit(""))).alias("orgs"))
    no_root = row(fam.where("not root"), "missing_family_root", nothing)
    cross = row(fam.where("orgs > 1 and n > 1"), "cross_org_family", F.col("orgs").cast("string"))
    no_entity = row(fam.where("not entity and n > 1"), "concept_with_no_entity", F.col("n").cast("string"))
    over = row(it.where((F.size(own_facets()) > 0) & (names.alnum_form(F.get("aliases", F.lit(0))) == names.alnum_form(F.col("family")))), "over_specified", F.get("aliases", F.lit(0)))
    same = urls.groupBy("family", "url").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("n")).where("n > 1")
    same_url = row(same, "same_url_duplicate", F.col("url"))
    over_families = urls.where(F.col("kind").isin(*UNIQUE_LINKS)).groupBy("url").agg(F.min("item_id").alias("item_id"), F.countDistinct("family").alias("n"), F.min("family").alias("family")).where("n > 1")
    cross_url = row(over_families, "same_url_cross_family", F.col("url"))
    inside = subsumed_pairs(it).join(it.where(F.size(own_facets()) > 0).select(F.col("item_id").alias("parent_id"), has_unique_link().alias("held")), "parent_id")
    partial = inside.select(F.when(F.col("held"), "subset_with_anchor").otherwise("concept_subsumed_candidate").alias("hint"), "family", F.col("parent_id").alias("item_id"), F.col("child_id").cast("string").alias("detail"))
    path = F.regexp_extract(F.col("first.url"), r"huggingface\.co/(?:datasets/)?([^/]+/[^/?#]+)", 1)
    primary = it.select("family", "item_id", "formal_name", F.get("links", F.lit(0)).alias("first")).where("first.kind in ('hf_model', 'hf_dataset')").withColumn("path", path)
    mismatch = row(primary.where((F.col("path") != "") & (F.lower("path") != F.lower(F.coalesce("formal_name", F.lit(""))))), "formal_name_vs_canonical_url_mismatch", F.col("path"))
    out = phantom
    for more in (collision, branch, no_root, cross, no_entity, over, same_url, cross_url, partial, mismatch):
        out = out.unionByName(more)
    return out


def name_matches_subset(lattice: DataFrame) -> DataFrame:
    """``item_id, parent_id``: items of which a form of the name or of an alias is a subset of another item, as written or in
    its alphanumeric form."""
    it = items_of(lattice)
    own = it.select("item_id", F.explode(F.concat(F.array("formal_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    own = own.select("item_id", F.explode(name_variants(F.col("n"))).alias("s")).distinct()
    sub = it.select(F.col("item_id").alias("parent_id"), F.explode("subsets").alias("x")).select("parent_id", F.explode(F.array("x", names.alnum_form(F.col("x")))).alias("s")).where("s <> ''").distinct()
    return own.join(sub, "s").where("item_id <> parent_id").select("item_id", "parent_id").distinct()


def invented_root_aliases(lattice: DataFrame, piled: DataFrame) -> DataFrame:
    """``item_id, family``: root items none of whose aliases is one of the names ``piled(name)`` the lattice was made from."""
    it = items_of(lattice)
    keys = F.array_distinct(F.transform(F.filter("identity", lambda e: e.isNotNull()), lambda e: e["k"]))
    roots = it.where((F.size(keys) == 1) & (keys[0] == "family")).select("item_id", "family", "aliases")
    known = roots.select("item_id", F.explode("aliases").alias("name")).join(piled.select("name").distinct(), "name", "left_semi").select("item_id").distinct()
    return roots.join(known, "item_id", "left_anti").select("item_id", "family")


def violations(lattice: DataFrame, link_vocabulary: tuple[str, ...]) -> DataFrame:
    """``item_id, rule`` of every broken lattice rule (all of them, not the first)."""
    it = lattice.where("identity is not null").dropDuplicates(["item_id"])
    family = F.get(F.filter("identity", lambda e: e["k"] == "family"), F.lit(0))["v"]
    first = F.get("links", F.lit(0))
    rules = {
        "family_facet": F.coalesce(F.trim(family), F.lit("")) == "",
        "no_alias": F.coalesce(F.size("aliases"), F.lit(0)) == 0,
        "link_kind": first.isNotNull() & ~F.coalesce(first["kind"].isin(*link_vocabulary), F.lit(False)),
        "link_url": first.isNotNull() & ~F.coalesce(first["url"].rlike("^https?://"), F.lit(False)),
        "blank_subset": F.coalesce(F.exists("subsets", lambda s: s.isNull() | (F.trim(s) == "")), F.lit(False)),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return it.select("item_id", F.explode(broken).alias("rule"))
