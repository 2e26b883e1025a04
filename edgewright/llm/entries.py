"""Map freely typed values to the entries of a reference list, or report them as unmatched.

Method: the distinct values are normalised to (spec, body): the spec holds size, stage and other
numbers, which must be equal, the body the name's letters.  Which words are stages the list itself
tells: last words that many of its names share.  A typed word stands for the stage it begins or that begins
it, or that it nearly is, whatever the list's stages are called.  Candidates come from an inverted index of
character n-grams, a table joined on (spec, n-gram); they are scored by idf-weighted cosine, and the
best is accepted above a threshold and a margin to the next entry.  An edit-distance check of the
accepted one follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from edgewright.llm.canon import fold
from edgewright.llm.history import edits
from edgewright.operators.skew import meet
from edgewright.runtime import Stage, small

THRESHOLD = 0.2
MARGIN = 0.05
LIST_ROWS = 1_000_000

#: A last word of at least one in so many of the list's names is a stage; there are at most so many.
STAGE_SHARE = 200
#: Words a worker remembers.
WORDS_MET = 100_000
#: Other words for common stages, of which neither begins the other.
SYNONYMS = {"pretrained": "base", "foundation": "base", "supervised": "sft", "finetuned": "sft", "preference": "dpo", "conversational": "chat", "reasoning": "think", "reasoner": "think", "rm": "reward"}
#: Words beside a name that name nothing.
FILLERS = frozenset("the a an model models version versions data dataset datasets set sets tuned size stage date variant checkpoint release family billion bn".split())
#: Auxiliaries before a relation label.
AUXILIARIES = re.compile(r"^(?:(?:is|are|was|were|be|been|being|has|have|had|it|gets?|got)[\s_-]+)+")
_SIZE = re.compile(r"(\d+(?:\.\d+)?)\s*(billion|bn|b|million|mn|m|trillion|tn|t)(?![a-z]{0,1}\d)")
_UNIT = {"billion": "b", "bn": "b", "b": "b", "million": "m", "mn": "m", "m": "m", "trillion": "t", "tn": "t", "t": "t"}


class Stages:
    """The stage words of a list, and which of them a typed word stands for.

    ``names`` are words of the list's names that look like a stage but are none.
    """

    def __init__(self, words: Iterable[str], names: Iterable[str] = ()):
        self.words = sorted(set(words))
        self.names = frozenset(names)
        self.met: dict[str, str | None] = {}
        self.exact = {w: w for w in self.words} | {f: s for f, s in SYNONYMS.items() if s in set(self.words)}
        self.forms = sorted({*self.exact, *(w[:n] for w in self.words for n in range(4, len(w)))}, key=lambda f: (-len(f), f))

    def of(self, word: str) -> str | None:
        """The stage a whole word stands for: its own, one that it begins or that begins it, one that shares
        all but three letters of its beginning, ends it, or is one letter off."""
        known = self.exact.get(word)
        if known is not None or len(word) < 4 or word in self.names:
            return known
        if word not in self.met:
            if len(self.met) >= WORDS_MET:
                self.met.clear()
            self.met[word] = self._near(word)
        return self.met[word]

    def _near(self, word: str) -> str | None:
        best = (0, None)
        for stage in self.words:
            same = len(commonprefix((word, stage)))
            fits = same == len(stage) or same == len(word) or same >= max(4, len(stage) - 3) or len(stage) >= 4 and word.endswith(stage)
            if fits or len(stage) >= 5 and abs(len(word) - len(stage)) <= 1 and edits(word, stage) == 1:
                best = max(best, (same, stage), key=lambda b: b[0]) if best[1] else (same, stage)
        return best[1]

    def ending(self, body: str) -> tuple[str, str]:
        """(stage, rest) of a name written in one word."""
        for form in self.forms:
            if body.endswith(form) and len(body) - len(form) >= 4:
                return self.exact.get(form) or next(w for w in self.words if w.startswith(form)), body[: -len(form)]
        return "", body


def _compact(s: str) -> str:
    return "".join(re.findall(r"[^\W_]+", s))


def _numbers_out(s: str) -> tuple[str, list[str]]:
    """A folded name without its sizes, and its sizes and other numbers in comparable form."""
    numbers: list[str] = []

    def size(m: re.Match) -> str:
        n = m.group(1)
        n = n.rstrip("0").rstrip(".") if "." in n else n.lstrip("0") or "0"
        numbers.append(n + _UNIT[m.group(2)])
        return " "

    s = _SIZE.sub(size, s)
    return s, numbers + re.findall(r"\d+(?:\.\d+)*", s)


@F.pandas_udf(ArrayType(StringType()))
def _name_words(text: pd.Series) -> pd.Series:
    """The words of a list's full name, organisation and numbers left out."""
    return text.map(lambda t: re.findall(r"[^\W\d_]+", _numbers_out(fold(t).partition("/")[2])[0]))


def learn_stages(entries: DataFrame) -> Stages:
    """The stages of a list of ``entries(kind, ref_id, text)``: the last words at least one in ``STAGE_SHARE``
    of its full names (``organisation/name``) share.  At most ``STAGE_SHARE`` words, and those names that
    look like one of them, come to the driver."""
    full = entries.where("kind <> 'relation' and text like '%/%'").select(_name_words("text").alias("w")).where("size(w) > 1")
    n = full.count()
    last = full.groupBy(F.element_at("w", -1).alias("word")).agg(F.count("*").alias("n"), F.countDistinct("w").alias("names")).where((F.col("n") * STAGE_SHARE >= n) & (F.col("names") > 1))
    stages = Stages(r.word for r in last.collect())
    like = full.select(F.explode(F.slice("w", 1, F.size("w") - 1)).alias("word")).distinct()
    alike = F.lit(False)
    for w in stages.words:
        alike = alike | F.col("word").startswith(w[:4]) | F.col("word").endswith(w) | (F.levenshtein("word", F.lit(w)) <= 2)
    return Stages(stages.words, [r.word for r in like.where(alike).collect() if r.word not in stages.words])


def parse_artifact(text: str, orgs: dict[str, str], stages: Stages) -> tuple[str, str, str]:
    """(spec, organisation, body) of an artifact name in any writing.

    ``orgs`` maps compact organisation names to themselves.  A value without letters gives an empty
    body, which matches nothing.
    """
    s = fold(text)
    s = re.sub(r"\([^()]*\)", " ", s) if re.search(r"[^\W_].*\(|\).*[^\W_]", s) else s
    s, numbers = _numbers_out(s)
    words = re.findall(r"[^\W\d_]+", s)
    org = ""
    for n in range(min(3, len(words)), 0, -1):  # an organisation may be written as several words, anywhere
        for i in range(len(words) - n + 1):
            if "".join(words[i : i + n]) in orgs:
                org = orgs["".join(words[i : i + n])]
                del words[i : i + n]
                break
        if org:
            break
    words = [w for w in words if w not in FILLERS] or words
    stage, at = "", None
    exact = [i for i, w in enumerate(words) if w in stages.exact]
    near = exact or [i for i, w in enumerate(words) if stages.of(w)]
    if near and len(words) > 1:
        at = near[-1] if near[-1] >= len(words) - 1 - near[0] else near[0]
        stage = stages.of(words[at])
        words = [w for i, w in enumerate(words) if i != at and not (i in exact and stages.exact[w] == stage)]
    body = "".join(words)
    if not stage:
        stage, body = stages.ending(body)
    if not org:
        for o in orgs:
            if len(o) >= 5 and body.startswith(o) and len(body) - len(o) >= 4:
                org, body = orgs[o], body[len(o) :]
                break
    return "|".join([stage, *sorted(numbers)]), org, body


def parse_label(text: str) -> tuple[str, str, str]:
    """(spec, '', body) of a relation label: auxiliaries, remarks and separators are left out."""
    s = fold(text).strip()
    s = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", s)
    s = AUXILIARIES.sub("", s.strip(" \t\n\"'`*?.:"))
    return "label", "", "".join(re.findall(r"[^\W_]+", s))


def grams(body: str) -> list[str]:
    """Distinct two- and three-letter grams, with the ends marked."""
    b = f"^{body}$"
    return sorted({b[i : i + n] for n in (2, 3) for i in range(len(b) - n + 1)}) if body else []


_PARSED = StructType([StructField("spec", StringType()), StructField("org", StringType()), StructField("body", StringType()), StructField("grams", ArrayType(StringType()))])


def _parser(orgs: dict[str, str], stages: Stages):
    def parse(kind: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = []
        for k, t in zip(kind, text):
            spec, org, body = parse_label(t) if k == "relation" else parse_artifact(t, orgs, stages)
            out.append((spec, org, body, grams(body)))
        return pd.DataFrame(out, columns=["spec", "org", "body", "grams"])

    return F.pandas_udf(parse, _PARSED)


@F.pandas_udf(StringType())
def _verified(ref_id: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """``ref_id`` where the bodies differ by few letters, else ''."""
    return pd.Series([r if edits(x, y) <= 1 + max(len(x), len(y)) // 5 else "" for r, x, y in zip(ref_id, a, b)])


def match(values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """``kind, value, ref_id`` for each distinct ``values(kind, value)`` against ``entries(kind,
    ref_id, text)``, ref_id '' where unmatched.

    kind 'relation' compares labels, any other kind artifact names, within kind only.  A value that
    names another organisation than the entry's is no match; ties between entries are unmatched
    (margin).  The reference list must have at most ``LIST_ROWS`` rows, else ValueError; only its
    organisation names, its stages and the names like them come to the driver.
    """
    if not small(entries, LIST_ROWS):
        raise ValueError(f"the reference list has more than {LIST_ROWS} rows")
    names = entries.where("kind <> 'relation' and text like '%/%'").select(F.explode(F.array(F.lower(F.substring_index("text", "/", 1)))).alias("org")).distinct().collect()
    parse = _parser({_compact(r.org): r.org for r in names}, learn_stages(entries))
    stage = Stage(values.sparkSession, "match")  # texts are parsed once, not in each branch below
    forms = entries.where("text is not null").distinct().withColumn("p", parse("kind", "text"))
    full = entries.where("text like '%/%'").groupBy("ref_id").agg(F.min(F.lower(F.substring_index("text", "/", 1))).alias("own_org"))
    forms = forms.select("kind", "ref_id", "p.spec", "p.body", "p.grams").where("body <> ''").distinct().join(full, "ref_id", "left")
    forms = stage.write(forms, "forms")
    posted = forms.withColumn("gram", F.explode("grams")).drop("grams")
    count = forms.groupBy("kind").agg(F.count("*").alias("n"))
    often = posted.groupBy("kind", "gram").agg(F.count("*").alias("df"))
    idf = often.join(count, "kind").select("kind", "gram", F.log(1 + F.col("n") / F.col("df")).alias("w"))
    posted = posted.join(idf, ["kind", "gram"])
    norm = posted.groupBy("kind", "ref_id", "spec", "body").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ref_norm"))
    posted = posted.join(norm, ["kind", "ref_id", "spec", "body"]).select("kind", "spec", "gram", "ref_id", F.col("body").alias("ref_body"), "own_org", "w", "ref_norm")

    parsed = values.where("value is not null").distinct().withColumn("p", parse("kind", "value")).select("kind", "value", "p.spec", "p.org", "p.body", "p.grams")
    parsed = stage.write(parsed, "values")
    vg = parsed.select("kind", "value", "spec", "org", "body", F.explode("grams").alias("gram"))
    vg = vg.join(idf.withColumnRenamed("w", "vw"), ["kind", "gram"], "left").join(count, "kind").withColumn("vw", F.coalesce("vw", F.log(1 + F.col("n"))))
    vnorm = vg.groupBy("kind", "value").agg(F.sqrt(F.sum(F.col("vw") * F.col("vw"))).alias("value_norm"))
    hits = vg.where("vw is not null").join(posted, ["kind", "spec", "gram"]).where("org = '' or own_org is null or org = own_org")
    scores = hits.groupBy("kind", "value", "body", "ref_id", "ref_body", "ref_norm").agg(F.sum(F.col("w") * F.col("vw")).alias("dot")).join(vnorm, ["kind", "value"])
    scores = scores.withColumn("score", F.col("dot") / (F.col("ref_norm") * F.col("value_norm")))
    per_ref = scores.groupBy("kind", "value", "body", "ref_id").agg(F.max(F.struct("score", "ref_body")).alias("s"))
    place = F.row_number().over(Window.partitionBy("kind", "value").orderBy(F.desc("score"), F.desc("ref_id")))
    two = per_ref.select("kind", "value", "body", "s.score", "ref_id", "s.ref_body").withColumn("place", place).where("place <= 2")
    ranked = two.groupBy("kind", "value", "body").agg(F.max(F.struct("score", "ref_id", "ref_body")).alias("best"), F.min(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    best, second = F.col("best"), F.coalesce("second", F.lit(0.0))
    taken = ranked.where((best["score"] >= threshold) & (best["score"] - second >= margin)).select("kind", "value", _verified(best["ref_id"], F.col("body"), best["ref_body"]).alias("ref_id")).where("ref_id <> ''")
    return parsed.select("kind", "value").join(taken, ["kind", "value"], "left").select("kind", "value", F.coalesce("ref_id", F.lit("")).alias("ref_id"))


def list_entries(artifacts: DataFrame, relations: DataFrame) -> DataFrame:
    """``kind, ref_id, text``: every name and alias of both reference lists."""
    named = lambda df, name, kind: df.select(F.lit(kind).alias("kind"), "ref_id", F.explode(F.concat(F.array(name), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text")).where("text is not null")
    return named(artifacts, "formal_name", "artifact").unionByName(named(relations, "label", "relation"))


def found(relations: DataFrame, items: DataFrame, artifacts: DataFrame, labels: DataFrame) -> DataFrame:
    """``field_name, row_key, ref_id`` of every manual, non-null relation, object and formal_name.

    A row delivered again counts once (smallest value); an empty value is unmatched; null keys are
    left out.  Hot values are split off.
    """
    stage = Stage(relations.sparkSession, "entries")
    one = relations.where("origin = 'manual' and rel_id is not null").groupBy(F.col("rel_id").cast("string").alias("row_key")).agg(F.min("relation").alias("relation"), F.min("object").alias("object"))
    cells = one.select("row_key", F.explode(F.array(F.struct(F.lit("relation").alias("field_name"), F.lit("relation").alias("kind"), F.col("relation").alias("value")), F.struct(F.lit("object").alias("field_name"), F.lit("artifact").alias("kind"), F.col("object").alias("value")))).alias("c")).select("row_key", "c.*")
    its = items.where("origin = 'manual' and item_id is not null").groupBy(F.col("item_id").cast("string").alias("row_key")).agg(F.min("formal_name").alias("value"))
    cells = cells.unionByName(its.select("row_key", F.lit("formal_name").alias("field_name"), F.lit("artifact").alias("kind"), "value")).where("value is not null")
    cells = stage.write(cells, "cells")
    values = cells.groupBy("kind", "value").agg(F.count("*").alias("n"))
    total = cells.count()
    mapped = match(values.select("kind", "value"), list_entries(artifacts, labels)).where("ref_id <> ''")
    weighed = stage.write(mapped.join(values, ["kind", "value"]), "weighed")
    return meet(cells, weighed, ["kind", "value"], "n", total, "left").select("field_name", "row_key", F.coalesce("ref_id", F.lit("")).alias("ref_id"))
