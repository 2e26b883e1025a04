"""Name normalizers and name-derived values as JVM-side column functions.

The normalizers are not interchangeable; each operator names the one it needs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lex_collapse(c: Column) -> Column:
    """Lower case, letters and digits of ASCII only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def lex_norm(c: Column) -> Column:
    """:func:`lex_collapse` without parts in parentheses and brackets."""
    return lex_collapse(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\[[^\]]*\]", ""))


def alnum_form(c: Column) -> Column:
    """Lower case with ``+`` spelled out, ASCII letters and digits only."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("+"), F.lit("plus")), "[^a-z0-9]", "")


def unicode_alnum(c: Column) -> Column:
    """Lower case letters and numbers of any script."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def canonical_name(c: Column) -> Column:
    """Without blanks of any script at its ends, lower; the organisation before the first ``/`` stays as it is, the rest has runs of
    other characters as one ``-``, none at its ends."""
    s = F.lower(strip(c))
    dashed = lambda x: F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rest = F.substring(s, F.instr(s, "/") + 1, F.length(s))
    return F.when(s.contains("/"), F.concat(F.substring_index(s, "/", 1), F.lit("/"), dashed(rest))).otherwise(dashed(s))


def slug(c: Column) -> Column:
    """Lower, blanks of any script and ``_`` as ``-``, only ``a-z 0-9 - + .``, dashes squeezed and trimmed."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\-+.]", ""), "-{2,}", "-"), "^-+|-+$", "")


def file_slug(c: Column, default: str = "source") -> Column:
    """Only ``A-Z a-z 0-9 . _ -``, others as ``-``, trimmed; ``default`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


#: The patterns of an organisation and its rest, token borders, sizes, versions, month-day dates, and paths and addresses of
#: internal stores.
_ORG = r"^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$"
_TOKEN_BORDER = r"[\s\-_/.\[\](),=:]+"
_SIZE = r"\b(\d+(?:\.\d+)?)[Bb]\b"
_VERSION = r"\b(\d+(?:[._]\d+)+|\d+)\b"
_DATE = r"(?<!\d)(0[1-9]\d{2}|1[0-2]\d{2})(?!\d)"
_INTERNAL = r"^(?:/|gs://|weka://|s3://|/weka/|/scratch/|/fsx/)"


def org(c: Column) -> Column:
    """Organisation before the first ``/`` in lower case, '' if there is none."""
    return F.lower(F.regexp_extract(c, _ORG, 1))


def bare(c: Column) -> Column:
    """The name without its organisation."""
    return F.when(c.rlike(_ORG), F.regexp_extract(c, _ORG, 2)).otherwise(c)


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(c), _TOKEN_BORDER), lambda t: F.length(t) > 1))


def sizes(c: Column) -> Column:
    """Sorted distinct sizes such as ``7`` of ``7B``."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(_SIZE), 1)))


#: Stage keywords.
STAGES = (
    "sft", "dpo", "instruct", "think", "base", "rl", "rl-zero", "rlzero", "rlhf", "rlvr",
    "reasoning", "content-safety", "gen-rm", "genrm", "preview", "fp8", "bf16", "nvfp4", "onnx", "fp16",
    "int4", "int8", "quantized", "chat", "completions", "completion", "reward", "rm", "policy", "retriever",
    "encoder", "embedding", "embed", "tokenizer", "checkpoint", "intermediate", "mid", "cpt", "awq", "gguf",
)


def stage_substrings(c: Column) -> Column:
    """Stage keywords that occur anywhere in the lower-case name (not as tokens), sorted."""
    s = F.lower(c)
    return F.array_sort(F.filter(F.array(*map(F.lit, STAGES)), lambda k: s.contains(k)))


def stage_tokens(c: Column) -> Column:
    """Stage keywords among the tokens; hyphenated ones never are."""
    return F.array_sort(F.array_intersect(tokens(c), F.array(*map(F.lit, STAGES))))


def versions(c: Column) -> Column:
    """Numbers of up to eight characters that no letter follows, ``_`` as ``.``, without sizes."""
    found = F.transform(F.regexp_extract_all(c, F.lit(_VERSION), 1), lambda v: F.replace(v, F.lit("_"), F.lit(".")))
    return F.array_sort(F.array_except(F.array_distinct(F.filter(found, lambda v: F.length(v) <= 8)), sizes(c)))


def dates(c: Column) -> Column:
    """Four-digit month-day tokens, no digit beside them."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(_DATE), 1)))


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def address_facets(c: Column) -> Column:
    """Facets of a virtual address ``Family [k=v, ...]`` as sorted ``k=v`` strings with ``family``;
    null if it has no brackets, a piece without ``=``, or an empty key or value.  A later key wins."""
    family = strip(F.regexp_extract(c, r"(?U)^\s*(.+?)\s*\[([^\]]*)\]\s*$", 1))
    inside = F.regexp_extract(c, r"(?U)^\s*(.+?)\s*\[([^\]]*)\]\s*$", 2)
    pieces = F.transform(F.split(inside, ","), lambda p: strip(p))
    good = (family != "") & F.forall(pieces, lambda p: (p == "") | p.rlike(r"(?U)^[^=]*[^=\s][^=]*=.*\S.*$"))
    pairs = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("k"), strip(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["k"] == e["k"]) & (e["k"] != "family"))
    facets = F.array_sort(F.concat(F.array(F.concat(F.lit("family="), family)), F.transform(last, lambda e: F.concat(e["k"], F.lit("="), e["v"]))))
    return F.when(good, facets)


def is_internal_path(c: Column) -> Column:
    return c.rlike(_INTERNAL)


def categorical_drop(c: Column) -> Column:
    """Names that name no artifact: empty, an internal path, a URL off the hub, long prose."""
    c = strip(c)
    paren = F.regexp_extract(c, r"\(([^)]*)\)", 1)
    return c.isNull() | (c == "") | is_internal_path(c) | (c.contains("://") & ~c.startswith("https://huggingface.co/")) | (F.length(paren) > 50) | (F.length(c) > 200)


def looks_like_concept(c: Column) -> Column:
    """No organisation, brackets or model size; short."""
    return (c != "") & ~c.rlike(r"[/\[(]") & ~(c.rlike("[0-9]") & c.rlike("[Bb]")) & (F.length(c) < 30)


#: Blog words of the two rules.
_BLOG_CODE, _BLOG = "blog|announcement|/news/|/posts/", "blog|/announcement|/news/|/posts/"


def source_class(c: Column) -> Column:
    """hf_card, pdf, code, blog or doc_other of an anchor source; null for none.  The first rule wins."""
    s = F.lower(F.trim(c))
    return (
        F.when(c.isNull() | (s == ""), F.lit(None).cast("string"))
        .when(s.contains("huggingface.co"), "hf_card")
        .when(s.contains("arxiv.org") | s.endswith(".pdf"), "pdf")
        .when(s.contains("github.com") | s.rlike(r"\.(py|yaml|yml|json|sh|md)$") | s.contains("/blob/"), F.when(s.contains("readme"), "doc_other").when(s.rlike(_BLOG_CODE), "blog").otherwise("code"))
        .when(s.rlike(_BLOG), "blog")
        .otherwise("doc_other")
    )


def edge_id(s: Column, r: Column, o: Column) -> Column:
    return F.concat_ws("::", *(F.coalesce(x, F.lit("")) for x in (s, r, o)))


def truncate(c: Column, limit: int, suffix: str = "...") -> Column:
    """At most ``limit`` characters, the suffix included where it fits."""
    cut = F.concat(F.substring(c, 1, max(0, limit - len(suffix))), F.lit(suffix)) if limit > len(suffix) else F.substring(c, 1, limit)
    return F.when(F.length(c) <= limit, c).otherwise(cut)
