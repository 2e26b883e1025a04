"""Parent-child rows of unknown depth to nested-set hierarchies.

Method: subtree sizes upward, preorder ranges handed to siblings by prefix sums downward, cycles
are what the downward pass never reaches; ancestors and descendants come from the ranges.  Both
passes double the distance of a node's pointer in each round, so a chain of depth d takes log2(d)
rounds instead of d:

* upward, a node with pointer at distance 2^k adds the size it knows (descendants nearer than 2^k)
  to the pointer's; nodes whose pointer passed a root drop out, so rounds shrink;
* downward, a node holds the sum of sibling offsets to its pointer and takes over root, depth and
  position as soon as that pointer has them.

Only nodes with children take part in the rounds; leaves, which are most nodes, add themselves to
their parent once and take their range from it once.  In round k of the downward pass only nodes
that had a descendant at distance 2^k in the upward pass can be pointed at, the others stay out of
the join.  Nodes go by dense numbers given when their ids are staged, not by their texts.

Hot parents and hot roots are split off (:func:`edgewright.operators.skew.meet`).  Sibling prefix
sums of parents with very many children run in two levels (bucket of the child, then buckets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.operators.skew import meet
from edgewright.runtime import Stage

SIBLING_BUCKETS = 1024
#: Parents with more children than this have their sibling sums in two levels.
WIDE_PARENT = 50_000


def _fingerprint(c: Column, one: str, two: str) -> list[Column]:
    """128 bits of an id, two long columns."""
    return [F.xxhash64(c).alias(one), F.xxhash64(F.lit("id"), c).alias(two)]


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def nested_sets(links: DataFrame, wide_parent: int = WIDE_PARENT) -> DataFrame:
    """Nested sets of a forest given as ``links(id, parent)``, both strings, ``id`` unique.

    Returns ``id, parent, root, depth, pre, size``.  Within a root, the descendants of a node are the
    nodes whose ``pre`` lies in ``[pre + 1, pre + size - 1]``; its ancestors are those whose range
    encloses its ``pre``.

    Defined edge cases: a null parent, or one that is no ``id``, makes the row a root (depth 0, own
    root, null parent); rows of null id are left out; nodes in a loop or below one get root '' , depth -1 and
    null pre and size; an empty input gives an empty result; other columns are ignored.
    """
    stage = Stage(links.sparkSession, "hierarchy")
    given = links.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent")).where("id is not null")
    nodes = stage.write(given.select(F.monotonically_increasing_id().alias("n"), "id", "parent"), "nodes")
    tree, inner_roots = _numbered(stage, nodes)
    log, senders = _sizes_upward(stage, tree)
    placed, tops = _ranges_downward(stage, tree, inner_roots, log, senders, wide_parent)
    roots = stage.write(tops.join(nodes.select(F.col("n").alias("r"), F.col("id").alias("root")), "r"), "roots")
    rooted = meet(placed, roots, ["r"], "size_of_root", nodes.count(), "left")
    lone = nodes.join(tree.select("n").unionByName(inner_roots.select("n")), "n", "left_anti")
    lone = lone.select("id", F.lit(None).cast("string").alias("parent"), F.col("id").alias("root"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pre"), F.lit(1).cast("long").alias("size"))
    full = rooted.join(nodes, "n").select("id", F.when(F.col("depth") != 0, F.col("parent")).alias("parent"), F.coalesce("root", F.lit("")).alias("root"), "depth", "pre", "size")
    return full.unionByName(lone)


def _numbered(stage: Stage, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tree, inner_roots)``: ``n, p, kids, many`` of every node whose parent is a node (``kids`` null
    for a leaf, ``many`` the number of children of its parent), and ``n, kids`` of roots with children."""
    up = nodes.where("parent is not null").select("n", *_fingerprint(F.col("parent"), "p1", "p2"))
    asked = up.groupBy("p1", "p2").agg(F.count("*").alias("kids"))
    ids = nodes.select(*_fingerprint(F.col("id"), "p1", "p2"), F.col("n").alias("p"))
    parents = stage.write(asked.join(ids, ["p1", "p2"]), "parents")
    total = nodes.count()
    child = meet(up, parents.select("p1", "p2", "p", F.col("kids").alias("many"), F.col("kids").alias("w")), ["p1", "p2"], "w", total).select("n", "p", "many")
    inner = parents.select(F.col("p").alias("n"), "kids")
    tree = stage.write(child.join(inner, "n", "left").select("n", "p", "kids", "many"), "tree")
    roots = stage.write(inner.join(tree.where("kids is not null").select("n"), "n", "left_anti"), "inner-roots")
    stage.drop(parents)
    return tree, roots


def _sizes_upward(stage: Stage, tree: DataFrame) -> tuple[list[DataFrame], list[int]]:
    """``(log, active)``: ``n, gain, c, k`` per round k, the size each node of the round gained from its
    ``c`` senders at distance 2^k (k -1: its leaves), and the number of senders of each round."""
    leaves = stage.write(tree.where("kids is null").groupBy(F.col("p").alias("n")).agg(F.count("*").alias("gain"), F.count("*").alias("c")).withColumn("k", F.lit(-1)), "leaves")
    inner = tree.where("kids is not null").select("n", "p")
    size = F.coalesce("gain", F.lit(0).cast("long")) + 1
    active = stage.write(inner.join(leaves.select("n", "gain"), "n", "left").select("n", "p", size.alias("size")), "up")
    left, log, counts = active.count(), [leaves], []
    while left:
        counts.append(left)
        gains = stage.write(active.groupBy(F.col("p").alias("n")).agg(F.sum("size").alias("gain"), F.count("*").alias("c")).withColumn("k", F.lit(len(counts) - 1)), "gain")
        log.append(gains)
        grown = active.join(gains.select("n", "gain", "c"), "n", "left").select("n", "p", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), F.coalesce("c", F.lit(0)).alias("c"))
        hop = grown.where("c > 0").select(F.col("n").alias("p"), F.col("p").alias("next"), "c")
        if _hot(gains, left):
            hop = stage.write(hop, "hop")
        moved = meet(grown.drop("c"), hop, ["p"], "c", left) if _hot(gains, left) else grown.drop("c").join(hop.drop("c"), "p")
        new = stage.write(moved.select("n", F.col("next").alias("p"), "size"), "up")
        stage.drop(active)
        active, before, left = new, left, new.count()
        if left == before:  # no pointer passed a root in this round: only loops are left
            break
    stage.drop(active)
    return log, counts


def _hot(gains: DataFrame, senders: int) -> bool:
    return not gains.where(F.col("c") * 1000 > senders).isEmpty() if senders > 1000 else False


def _ranges_downward(stage: Stage, tree: DataFrame, inner_roots: DataFrame, log: list[DataFrame], counts: list[int], wide_parent: int) -> tuple[DataFrame, DataFrame]:
    """``n, r, depth, pre, size`` of every node but roots without children (r null, depth -1 on loops), and
    ``r, size_of_root`` of the roots with children."""
    summed = _all(log).groupBy("n").agg((F.sum("gain") + 1).alias("size"), F.max("k").alias("reach"))
    sizes = stage.write(summed, "sizes")
    stage.drop(log[0])
    sized = tree.join(sizes, "n", "left").select("n", "p", "many", F.coalesce("size", F.lit(1).cast("long")).alias("size"), "reach")
    long0 = F.lit(0).cast("long")
    bucket = F.when(F.col("many") > wide_parent, F.pmod(F.xxhash64("n"), F.lit(SIBLING_BUCKETS))).otherwise(long0)
    sized = sized.withColumn("bucket", bucket)
    within = Window.partitionBy("p", "bucket").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    off = stage.write(sized.withColumn("offset", F.coalesce(F.sum("size").over(within), long0) + 1), "offsets")
    wide = off.where(F.col("many") > wide_parent)
    if not wide.isEmpty():
        totals = wide.groupBy("p", "bucket").agg(F.sum("size").alias("total"))
        across = Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select("p", "bucket", F.coalesce(F.sum("total").over(across), long0).alias("base"))
        lifted = wide.join(F.broadcast(base) if base.count() <= 1_000_000 else base, ["p", "bucket"]).withColumn("offset", F.col("offset") + F.col("base")).drop("base")
        off = off.where(F.col("many") <= wide_parent).unionByName(lifted)
    null = F.lit(None).cast("long")
    placed = [stage.write(inner_roots.join(sizes, "n").select("n", F.col("n").alias("r"), F.lit(0).alias("depth"), long0.alias("pre"), "size", "reach"), "roots")]
    waiting = stage.write(off.where("reach is not null").select("n", "p", "offset", "size", "reach"), "down")
    left = waiting.count()
    for k, senders in enumerate(counts):
        met = _all(placed).where(F.col("reach") >= k).select(F.col("n").alias("p"), "r", "depth", F.col("pre").alias("far"), null.alias("next"))
        met = met.unionByName(waiting.where(F.col("reach") >= k).select(F.col("n").alias("p"), null.alias("r"), F.lit(None).cast("int").alias("depth"), F.col("offset").alias("far"), F.col("p").alias("next")))
        gains = log[k + 1]
        if _hot(gains, senders):
            met = stage.write(met.join(gains.select(F.col("n").alias("p"), "c"), "p"), "met")
            joined = meet(waiting, met, ["p"], "c", senders)
            joined = joined.drop("c") if "c" in joined.columns else joined
        else:
            joined = waiting.join(met, "p")
        step = stage.write(joined.select("n", "r", (F.col("depth") + (1 << k)).alias("depth"), (F.col("offset") + F.col("far")).alias("pre"), "size", "reach", F.col("next").alias("p")), "down")
        placed.append(step.where("r is not null").drop("p"))
        waiting = step.where("r is null").select("n", "p", F.col("pre").alias("offset"), "size", "reach")
        before, left = left, waiting.count()
        if not left or left == before:  # what is left hangs on loops
            break
    stage.drop(*log[1:], sizes)
    lost = [null.alias("r"), F.lit(-1).alias("depth"), null.alias("pre"), null.alias("size")]
    inner = _all(placed).select("n", "r", "depth", "pre", "size")
    if left:
        inner = inner.unionByName(waiting.select("n", *lost))
    kids = off.where("reach is null").select("n", "p", "offset")
    above = inner.where("r is not null").select(F.col("n").alias("p"), "r", "depth", F.col("pre").alias("far"))
    many = off.where("reach is null").groupBy("p").agg(F.count("*").alias("w")).where(F.col("w") > 1) if not wide.isEmpty() else None
    if many is None:
        leaf = kids.join(above, "p", "left")
    else:
        leaf = meet(kids, stage.write(above.join(many, "p", "left").fillna(1, ["w"]), "above"), ["p"], "w", tree.count(), "left")
    leaf = leaf.select("n", "r", F.when(F.col("r").isNull(), -1).otherwise(F.col("depth") + 1).alias("depth"), (F.col("far") + F.col("offset")).alias("pre"), F.when(F.col("r").isNotNull(), F.lit(1).cast("long")).alias("size"))
    return inner.unionByName(leaf), placed[0].select("r", F.col("size").alias("size_of_root"))


#: Blocks of a range: 16^0 to 16^3 positions; a key of the range join never has more than 4096 nodes.
BLOCK_BITS = (0, 4, 8, 12)


def descendants(sets: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance``: one row for each node and each node whose range encloses it.

    ``sets`` is a result of :func:`nested_sets`.  The range of a node is cut into aligned blocks of 1,
    16, 256 and 4096 positions, of each size at most 30 but of the last; a node stands in one block of
    each size; so the range join is an equi-join on (root, block size, block), in which no key has more
    than 4096 nodes, however large the tree.  Nodes on loops, which have no range, give no row.
    """
    root = [F.xxhash64("root").alias("r1"), F.xxhash64(F.lit("id"), F.col("root")).alias("r2")]
    ranged = sets.where("depth >= 0").select("id", *root, "depth", "pre", "size")
    held = ranged.where("size > 1").select(F.col("id").alias("ancestor"), "r1", "r2", F.col("depth").alias("from"), F.explode(_blocks(F.col("pre") + 1, F.col("pre") + F.col("size"))).alias("b"))
    at = ranged.where("depth > 0").select(F.col("id").alias("descendant"), "r1", "r2", "depth", F.explode(F.array(*(F.struct(F.lit(bits).alias("bits"), F.shiftright("pre", bits).alias("no")) for bits in BLOCK_BITS))).alias("b"))
    hit = held.select("ancestor", "r1", "r2", "from", "b.bits", "b.no").join(at.select("descendant", "r1", "r2", "depth", "b.bits", "b.no"), ["r1", "r2", "bits", "no"])
    return hit.select("ancestor", "descendant", (F.col("depth") - F.col("from")).alias("distance"))


def _blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks that make up ``[lo, hi)``: greedy from both ends, largest in the middle."""
    made = []
    for bits, above in zip(BLOCK_BITS, BLOCK_BITS[1:] + (None,)):
        first, last = F.shiftright(lo + (1 << bits) - 1, bits), F.shiftright(hi, bits)  # whole blocks [first, last)
        if above is None:
            runs = [(first, last)]
        else:
            wide = above - bits
            up, down = F.shiftleft(F.shiftright(lo + (1 << above) - 1, above), wide), F.shiftleft(F.shiftright(hi, above), wide)
            split = up < down
            runs = [(first, F.when(split, up).otherwise(F.least(up, last))), (F.when(split, down).otherwise(F.greatest(F.least(up, last), first)), last)]
        for a, b in runs:
            made.append(F.when(a < b, _numbered_blocks(a, b, bits)).otherwise(F.array().cast("array<struct<bits:int,no:bigint>>")))
    return F.concat(*made)


def _numbered_blocks(a: Column, b: Column, bits: int) -> Column:
    return F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(bits).alias("bits"), x.alias("no")))


def paths(sets: DataFrame) -> DataFrame:
    """``sets`` with ``path``: the ids from the root to the node, by the ranges that enclose it; null on
    loops."""
    above = descendants(sets).groupBy("descendant").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("far"), "ancestor"))).alias("up"))
    full = sets.join(above.withColumnRenamed("descendant", "id"), "id", "left")
    line = F.concat(F.coalesce(F.transform("up", lambda x: x["ancestor"]), F.array().cast("array<string>")), F.array("id"))
    return full.select(*sets.columns, F.when(F.col("depth") >= 0, line).alias("path"))


def link_key(c: Column) -> Column:
    """Comparable form of an id written unevenly: case, outer blanks and braces, UUID dashes."""
    bare = F.regexp_replace(F.lower(c), r"^(?:\s|urn:uuid:|[{}()\[\]\"'])+|[\s{}()\[\]\"']+$", "")
    key = F.regexp_replace(bare, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    return F.when(key != "", key)


def run_links(runs: DataFrame) -> DataFrame:
    """``id, parent`` of a run log; a run delivered again counts once, the latest ``ended_at`` first (null
    is oldest), then the greatest parent.  ``id`` is as given but for outer blanks and case."""
    one = runs.where("id is not null").groupBy("id").agg(F.max(F.struct(F.coalesce("ended_at", F.lit("")).alias("t"), F.coalesce("parent_run_id", F.lit("")).alias("p"))).alias("m"))
    return one.select(link_key(F.col("id")).alias("id"), link_key(F.col("m.p")).alias("parent")).where("id is not null")


WIDE_FACETS = 12


def facet_links(items: DataFrame, wide: int = WIDE_FACETS) -> DataFrame:
    """``id, parent`` of identity-lattice items: the parent is the item of the same family with the
    largest facet set properly inside the item's own (ties and equal sets: smallest item_id).

    The facet ``family`` and facets without a value don't count; case and outer blanks of values
    don't matter; a facet given twice counts once; a null family is its own family.  Items of null
    identity are left out.  An item delivered again counts once.

    Sets of up to ``wide`` facets look their parent up among all their own subsets, an equi-join by
    128-bit fingerprints of family and subset: no pair of items of a family is ever formed.  Wider sets would have too many
    subsets; they probe by single facets, each known set being posted under its rarest facet only,
    and the containment is tested.  Both ways are exact.
    """
    stage = Stage(items.sparkSession, "facets")
    clean = F.filter("identity", lambda e: e.isNotNull() & e["k"].isNotNull() & (F.lower(F.trim(e["k"])) != "family") & (_blank_free(e["v"]) != ""))
    facets = F.array_sort(F.array_distinct(F.transform(clean, lambda e: F.concat(F.lower(F.trim(e["k"])), F.lit("="), _blank_free(e["v"])))))
    named = F.filter("identity", lambda e: F.lower(F.trim(e["k"])) == "family")[0]["v"]
    family = F.coalesce(F.nullif(_blank_free(F.col("family")), F.lit("")), _blank_free(named), F.lit(""))
    own = (
        items.where("identity is not null and item_id is not null")
        .select(F.col("item_id").cast("long").alias("item_id"), family.alias("family"), facets.alias("facets"))
        .groupBy("item_id").agg(F.min(F.struct("family", "facets")).alias("m")).select("item_id", "m.family", "m.facets")
    )
    own = stage.write(own.select("item_id", "family", "facets", *_set_fingerprint("family", "facets")), "own")
    sets = own.groupBy("x1", "x2").agg(F.min("item_id").alias("first_id"), F.min_by(F.struct("family", "facets"), "item_id").alias("s"))
    sets = stage.write(sets.select("x1", "x2", "first_id", "s.family", "s.facets"), "sets")
    both = F.arrays_zip(_subset_fingerprints("family", "facets", 0).alias("a"), _subset_fingerprints("family", "facets", 1).alias("b"), _subset_sizes("facets").alias("n"))
    probes = sets.where(F.size("facets").between(1, wide)).select("first_id", F.size("facets").alias("all"), F.explode(both).alias("s")).where(F.col("s.n") < F.col("all"))
    held = sets.select(F.col("x1").alias("a"), F.col("x2").alias("b"), F.col("first_id").alias("held_id"))
    best = F.max(F.struct("n", (-F.col("held_id")).alias("neg"))).alias("b")
    found = probes.select("first_id", "s.a", "s.b", "s.n").join(held, ["a", "b"]).groupBy("first_id").agg(best)
    broad = sets.where(F.size("facets") > wide)
    if not broad.isEmpty():
        longest = F.max(F.struct(F.size("inside").alias("n"), (-F.col("held_id")).alias("neg"))).alias("b")
        found = found.unionByName(_wide_parents(sets.withColumnRenamed("first_id", "held_id"), broad, longest))
    parent = sets.select("x1", "x2", "first_id").join(found, "first_id").select("x1", "x2", (-F.col("b.neg")).alias("parent_id"))
    return own.select("item_id", "x1", "x2").join(parent, ["x1", "x2"], "left").select(F.col("item_id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent"))


def _facet_hash(e: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), e)


def _family_hash(family: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("family"), F.col(family))


def _set_fingerprint(family: str, facets: str) -> list[Column]:
    """128 bits of a family and a facet set: the exclusive or of the family's and the facets' hashes."""
    one = lambda seed: F.aggregate(facets, _family_hash(family, seed), lambda acc, e: acc.bitwiseXOR(_facet_hash(e, seed)))
    return [one(0).alias("x1"), one(1).alias("x2")]


def _subset_fingerprints(family: str, facets: str, seed: int) -> Column:
    """Fingerprints of all subsets; each facet doubles the list."""
    return F.aggregate(facets, F.array(_family_hash(family, seed)), lambda acc, e: F.concat(acc, F.transform(acc, lambda x: x.bitwiseXOR(_facet_hash(e, seed)))))


def _subset_sizes(facets: str) -> Column:
    return F.aggregate(facets, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.transform(acc, lambda x: x + 1)))


def _wide_parents(sets: DataFrame, broad: DataFrame, best: Column) -> DataFrame:
    """``first_id, b`` of each set of ``broad``, by the known sets posted under their rarest facet."""
    single = sets.select("family", "facets", "held_id", F.explode("facets").alias("facet"))
    often = single.groupBy("family", "facet").agg(F.count("*").alias("often"))
    posted = single.join(often, ["family", "facet"]).groupBy("held_id").agg(F.min(F.struct("often", "family", "facet", "facets")).alias("r")).select("r.family", "r.facet", F.col("r.facets").alias("inside"), "held_id")
    probe = broad.select("first_id", "family", "facets", F.explode("facets").alias("facet"))
    hits = probe.join(posted, ["family", "facet"]).where((F.size("inside") < F.size("facets")) & (F.size(F.array_except("inside", "facets")) == 0)).select("first_id", "inside", "held_id")
    bare = broad.select("first_id", "family").join(sets.where(F.size("facets") == 0).select("family", F.col("facets").alias("inside"), "held_id"), "family").select("first_id", "inside", "held_id")
    return hits.unionByName(bare).groupBy("first_id").agg(best)


def _blank_free(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s ​]+|[\s ​]+$", ""))


def combined_forest(spark: SparkSession, runs: DataFrame, items: DataFrame) -> DataFrame:
    """Run log and identity lattice as one forest: ``node_kind, node_id`` and the columns of
    :func:`nested_sets`, so both share every round."""
    r, i = run_links(runs), facet_links(items)
    runs_side = r.select(F.concat(F.lit("run:"), "id").alias("id"), F.concat(F.lit("run:"), "parent").alias("parent"))
    items_side = i.select(F.concat(F.lit("item:"), "id").alias("id"), F.concat(F.lit("item:"), "parent").alias("parent"))
    sets = nested_sets(runs_side.unionByName(items_side))
    bare = lambda c: F.expr(f"substring({c}, instr({c}, ':') + 1)")
    return sets.withColumn("node_kind", F.substring_index("id", ":", 1)).withColumn("node_id", bare("id")).withColumn("root_id", bare("root"))
