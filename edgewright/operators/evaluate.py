"""Pooled evaluation and mention resolution; judgements are an input table, never a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import names
from edgewright.runtime import small

#: Most surface tokens of entries that are broadcast.
BROADCAST_ROWS = 200_000
MENTION_PARTITIONS = 48
#: Endings that name a part of a corpus, in the order they are tried.
SUBCORPUS_SUFFIXES = ("-pool", "-web", "-web-pro", "-web-pro-max", "-edu", "-baseline", "-refinedweb", "-code", "-math", "-qa", "-instruct-mix", "_pool", "_web", "_edu", "_code", "_math")


def claims(clusters: DataFrame) -> DataFrame:
    """One row per member of each cluster with both endpoints canonical."""
    m = clusters.dropDuplicates(["cluster_id"]).select("cluster_id", "target", F.explode("members").alias("m"))
    return m.select("cluster_id", "target", F.col("m.member_no").alias("ord"), F.col("m.system").alias("system"), names.canonical_name(F.col("m.subject")).alias("subject"), names.canonical_name(F.col("m.object")).alias("object"), F.col("m.description").alias("description"))


def pooled(c: DataFrame) -> DataFrame:
    """Clusters by (target, canonical subject, object): claims, systems, the longest description (the first
    on ties).  Pairs with an empty end are left out."""
    one = c.where("subject <> '' and object <> ''").withColumn("len", F.length(F.coalesce("description", F.lit(""))))
    ordinal = F.struct((-F.col("len")).alias("l"), "cluster_id", "ord")
    return one.groupBy("target", "subject", "object").agg(F.count("*").alias("n_claims"), F.countDistinct("system").alias("n_systems"), F.array_join(F.array_sort(F.collect_set("system")), "|").alias("systems"), F.min_by("description", ordinal).alias("description"))


def verdicts_of(clusters: DataFrame) -> DataFrame:
    """A stand-in for a table of outside judgements, which the test tables lack: one verdict per cluster with members,
    spread over all kinds by a hash of its id.  The operators take any table of these columns."""
    c = claims(clusters).where("cluster_id is not null").select("cluster_id", "target").distinct()
    digit = F.substring(F.md5("cluster_id"), 1, 1)
    return c.select("cluster_id", "target", F.when(digit < "b", "verified").when(digit < "d", "refuted").when(digit < "f", "unclear").otherwise("error").alias("verdict"))


def precision(c: DataFrame, verdicts: DataFrame, systems: DataFrame, by_target: bool = False) -> DataFrame:
    """Verdict counts and the terms of verified / (verified + refuted) per system (and target), systems
    without a row included."""
    per = c.select("cluster_id", "system").where("system is not null").distinct().join(verdicts, "cluster_id")
    keys = ["system", *(["target"] if by_target else [])]
    n = lambda v: F.sum((F.col("verdict") == v).cast("long")).alias(v)
    out = per.groupBy(*keys).agg(n("verified"), n("refuted"), n("unclear"), n("error"))
    if not by_target:
        out = systems.select("system").distinct().join(out, "system", "left").fillna(0)
    decided = F.col("verified") + F.col("refuted")
    return out.withColumn("decided", decided).withColumn("precision", F.when(decided > 0, F.round(F.col("verified") / decided, 9)))


def pending(clusters: DataFrame, verdicts: DataFrame) -> DataFrame:
    return clusters.join(verdicts.select("cluster_id"), "cluster_id", "left_anti").select("cluster_id", "target")


def audit_totals(verdicts: DataFrame) -> DataFrame:
    n = lambda v: F.sum((F.col("verdict") == v).cast("long")).alias(v)
    return verdicts.agg(F.count("*").alias("total"), n("verified"), n("refuted"), n("unclear"), n("error")).withColumn("decisive", F.col("verified") + F.col("refuted")).withColumn("precision", F.when(F.col("decisive") > 0, F.round(F.col("verified") / F.col("decisive"), 9)))


def resolved(mentions: DataFrame, entries: DataFrame, top: int = 3, floor: float = 50.0) -> DataFrame:
    """``mention, entry_id, score``: the ``top`` entries of each of ``mentions(mention)`` from
    ``entries(entry_id, surface)``.

    100 for an equal alphanumeric form, 10 by the share of the mention's tokens in common and 5 by the
    entry's; the best surface counts; entries below ``floor`` are left out; ties by entry.  Entries with
    no token in common are never formed, they would score 0.
    """
    m = mentions.where("mention is not null").select("mention").distinct().select("mention", names.alnum_form(F.col("mention")).alias("form"), _tokens(F.col("mention")).alias("ts")).where("size(ts) > 0")
    e = entries.where("surface is not null").select("entry_id", "surface").distinct().select("entry_id", "surface", names.alnum_form(F.col("surface")).alias("e_form"), _tokens(F.col("surface")).alias("es"))
    common = F.size(F.array_intersect("ts", "es"))
    score = lambda exact, n, n_ts, n_es: (F.lit(exact) + 10 * n / n_ts + 5 * n / F.greatest(n_es, F.lit(1))).alias("score")
    scored = m.join(e, F.col("form") == F.col("e_form")).select("mention", "entry_id", score(100.0, common, F.size("ts"), F.size("es")))
    if floor < 50:
        scored = scored.unionByName(_near(m, e, top, lambda n, n_ts, n_es: score(0.0, n, n_ts, n_es)))
    best = scored.groupBy("mention", "entry_id").agg(F.max("score").alias("score")).where(F.col("score") >= floor)
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "entry_id"))
    return best.withColumn("place", rank).where(F.col("place") <= top)


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[/_\-. ]+"), lambda t: t != ""))


def _near(m: DataFrame, e: DataFrame, top: int, score) -> DataFrame:
    """``mention, entry_id, score``: the ``top`` entries of each mention by tokens in common alone.

    A mention counts by its number of tokens and those that entries have, so mentions alike in both are
    searched once.  Few entries are broadcast; then the searches, dealt out once, keep their place through count and rank.
    """
    posted = e.select("entry_id", "surface", F.size("es").alias("n_es"), F.explode("es").alias("t"))
    few = small(posted, BROADCAST_ROWS)
    sent = F.broadcast if few else (lambda df: df)
    known = m.select("mention", F.size("ts").alias("n_ts"), F.explode("ts").alias("t")).join(sent(posted.select("t").distinct()), "t", "left_semi")
    asked = known.groupBy("mention", "n_ts").agg(F.array_join(F.array_sort(F.collect_list("t")), "/").alias("known"))  # no token has a "/"
    search = asked.select("n_ts", "known").distinct()
    search = search.repartition(MENTION_PARTITIONS, "n_ts", "known") if few else search
    met = search.select("n_ts", "known", F.explode(F.split("known", "/")).alias("t")).join(sent(posted), "t")
    met = met.groupBy("n_ts", "known", "entry_id", "surface", "n_es").agg(F.count("*").alias("n"))
    best = met.groupBy("n_ts", "known", "entry_id").agg(F.max(score(F.col("n"), F.col("n_ts"), F.col("n_es"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("n_ts", "known").orderBy(F.desc("score"), "entry_id"))
    return asked.join(best.withColumn("place", rank).where(F.col("place") <= top).drop("place"), ["n_ts", "known"]).select("mention", "entry_id", "score")


def subset_parents(mentions: DataFrame, lattice: DataFrame) -> DataFrame:
    """``mention, item_id, slug``: the lattice item that each of ``mentions(mention)`` is a part of, at most one.

    The first item with a subset of the mention's form wins; else the first of ``SUBCORPUS_SUFFIXES`` the
    mention ends in, before which stands a surface of an item, and the first such item.
    """
    m = mentions.where("mention is not null").select("mention").distinct().where(F.size(_tokens(F.col("mention"))) > 0)
    it = lattice.where("item_id is not null").dropDuplicates(["item_id"])
    slugs = it.select("item_id", F.posexplode("subsets").alias("no", "slug")).where(names.strip(F.col("slug")) != "")
    slugs = slugs.select(names.unicode_alnum(F.col("slug")).alias("form"), "item_id", "slug", "no").groupBy("form").agg(F.min_by(F.struct("item_id", "slug"), F.struct("item_id", (-F.col("no")).alias("no"))).alias("hit"))
    direct = m.join(slugs, names.unicode_alnum(F.col("mention")) == F.col("form")).select("mention", F.lit(-1).alias("no"), "hit.item_id", "hit.slug")
    surfaces = it.select("item_id", F.explode(F.concat(F.array("formal_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))
    firsts = surfaces.select("item_id", names.unicode_alnum(F.col("surface")).alias("form")).where("form <> ''").groupBy("form").agg(F.min("item_id").alias("item_id"))
    low = F.col("low")
    cuts = m.withColumn("low", names.strip(F.lower("mention"))).withColumn("x", F.explode(F.array(*(F.struct(F.lit(i).alias("no"), F.lit(x).alias("suffix")) for i, x in enumerate(SUBCORPUS_SUFFIXES)))))
    cuts = cuts.where(low.endswith(F.col("x.suffix")) & (F.length("low") > F.length("x.suffix") + 2))
    prefix = F.regexp_replace(F.substring(low, F.lit(1), F.length("low") - F.length("x.suffix")), "[-_ ]+$", "")
    cuts = cuts.withColumn("prefix", prefix).withColumn("form", names.unicode_alnum(F.col("prefix"))).where("form <> ''")
    slug = F.regexp_replace(F.substring(low, F.length("prefix") + 1, F.length("low")), "^[-_ ]+", "")
    ends = cuts.join(firsts, "form").select("mention", "x.no", "item_id", slug.alias("slug"))
    return direct.unionByName(ends).groupBy("mention").agg(F.min_by(F.struct("item_id", "slug"), "no").alias("hit")).select("mention", "hit.item_id", "hit.slug")


def resolved_with_subsets(mentions: DataFrame, entries: DataFrame, lattice: DataFrame, top: int = 3, floor: float = 0.0) -> DataFrame:
    """``mention, form, candidate, slug, score, place``: the ``top`` of the entries of :func:`resolved` (form ``direct``)
    and the lattice item of :func:`subset_parents` (form ``subset``), which scores 70 whatever ``floor`` is."""
    nothing = F.lit(None).cast("string")
    direct = resolved(mentions, entries, top, floor).select("mention", F.lit("direct").alias("form"), F.col("entry_id").cast("string").alias("candidate"), nothing.alias("slug"), "score")
    subset = subset_parents(mentions, lattice).select("mention", F.lit("subset").alias("form"), F.col("item_id").cast("string").alias("candidate"), "slug", F.lit(70.0).alias("score"))
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "form", "candidate"))
    return direct.unionByName(subset).withColumn("place", rank).where(F.col("place") <= top)
