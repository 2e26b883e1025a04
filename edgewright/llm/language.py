"""Language of each document and of each segment of a mixed one.

Method: a byte convolutional network.  Sentences, freed of what has no language (front matter, program
text, tables, links, names, numbers), are cut into batched fixed-length windows of bytes; filters of
several widths run over them, each filter's maximum over the window is kept, and a softmax over the
maxima gives the languages.  The network is trained in numpy on labelled texts of the corpus itself: a
bounded sample, first as labelled, then without the sentences the first network firmly contradicts.

The sentences of a text are decoded together: changing the language between neighbours costs a fixed
amount of evidence, so a doubtful sentence goes with its neighbours, and runs of one language are the
segments.  An exact check follows the network: a language that isn't written in a sentence's script comes
last for it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.runtime import folders_in, shared_dir

#: The languages and their notations (ISO 639 codes, English and own names).
LANGUAGES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi chinese mandarin cmn 中文 汉语 漢語",
    "ja": "ja jpn japanese jp 日本語",
}
CODES = tuple(LANGUAGES)
_NOTATION = {n: code for code, names in LANGUAGES.items() for n in names.split()}

#: Rows of labelled texts the network is fitted on at most.
FIT_ROWS = 2500
#: Sentences of the sample used at most.
FIT_SENTENCES = 12_000
#: Windows shown to the network in its last training, repeats included.
STEPS = 200_000
WINDOW, STRIDE = 64, 48
DIM, FILTERS, WIDTHS = 8, 32, (2, 3, 4, 5)
SWITCH = 3.0
FIRM = 0.9
#: Sentences seen this often under their label are never dropped.
SUPPORTED = 3
KEPT = 200_000


def label_code(label: str | None) -> str | None:
    """Two-letter code a label stands for in any notation, None if it is missing or names none."""
    if label is None:
        return None
    s = unicodedata.normalize("NFKC", label).strip().casefold()
    return _NOTATION.get(s) or _NOTATION.get(re.split(r"[-_\s(/,;:]", s, maxsplit=1)[0])


# -- what has a language ---------------------------------------------------------------------
_FRONT = re.compile(r"\A\s*(?:---|\+\+\+)[ \t]*\n.*?\n(?:---|\+\+\+)[ \t]*(?:\n|\Z)", re.S)
_FENCE = re.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_NAMELESS = re.compile(
    r"`[^`\n]*`"
    r"|<[^<>\n]{1,200}>"
    r"|(?<![A-Za-z0-9_.-])(?:"
    r"(?:https?|ftp)://[^\s)>\]。，、]++|www\.[^\s)>\]。，、]++"
    r"|(?:[A-Za-z0-9_+-]++(?:\.[A-Za-z0-9_+-]++)*+/)++[A-Za-z0-9_+-]++(?:\.[A-Za-z0-9_+-]++)*+"
    r"|[A-Za-z0-9_.+-]++@[\w-]+(?:\.\w+)+"
    r"|(?:[A-Z][A-Za-z]*+[ -]?+){1,3}+(?:\[[^\[\]\n]*=[^\[\]\n]*\]|(?:\d{4}[ -])?\d+(?:\.\d+)?[BbMmKk](?![a-z])(?:[ -](?:Base|SFT|DPO|Instruct|Chat|Think|Reward|Preview|Corpus|Mix|Prompts|Pairs|Bench|Synth|Traces|Annealing)\b)?)"
    r"|[A-Za-z]*+[0-9](?:[.,:]?[A-Za-z0-9_/-])*+"
    r")"
)
_BREAK = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])|(?<=[぀-ヿ㐀-鿿][!?])")
_MARKS = re.compile(r"^[\s>*+#•·–—-]+")
_PROGRAM = re.compile(r"[=(){};]")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s")
_NOT_WORDS = re.compile(r"[^\w']+|_")


def sentences(text: str) -> list[tuple[str, bool]]:
    """(sentence, is a heading) of the parts of ``text`` that may have a language, in text order."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if text.lstrip().startswith(("---", "+++")):
        text = _FRONT.sub("\n", text, count=1)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    out = []
    for line in _NAMELESS.sub(" ", text).split("\n"):
        if not line or line.isspace():
            continue
        if line[0] in " \t|" or "|" in line:
            if line.lstrip()[0] == "|" or line.count("|") > 1 or line.startswith(("    ", "\t")) and _PROGRAM.search(line):
                continue
        heading = "#" in line and _HEADING.match(line) is not None
        for s in _BREAK.split(_MARKS.sub("", line)):
            out.append((s, heading))
    return out


def words(s: str) -> str:
    """The words of a sentence; '' if it has none."""
    return _NOT_WORDS.sub(" ", s).strip()


def as_bytes(s: str) -> bytes:
    return f" {s.casefold()} ".encode("utf-8", "replace")


def windows_of(b: bytes) -> list[bytes]:
    """Windows of ``WINDOW`` bytes that cover ``b`` whole."""
    if len(b) <= WINDOW:
        return [b]
    starts = list(range(0, len(b) - WINDOW, STRIDE)) + [len(b) - WINDOW]
    return [b[i : i + WINDOW] for i in starts]


def matrix(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(len(windows), WINDOW)


# -- the network -----------------------------------------------------------------------------
class ByteNet:
    """Embedding of bytes, filters of several widths, maximum over the window, softmax."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.3, (256, DIM)).astype(np.float32), "out": np.zeros((FILTERS * len(WIDTHS), len(CODES)), np.float32), "bias": np.zeros(len(CODES), np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = r.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def _conv(self, e: np.ndarray, w: int) -> np.ndarray:
        n, t = e.shape[0], WINDOW - w + 1
        patches = np.lib.stride_tricks.as_strided(e, (n, t, w * DIM), e.strides[:2] + (e.strides[2],))
        return (np.ascontiguousarray(patches).reshape(n * t, w * DIM) @ self.p[f"f{w}"]).reshape(n, t, FILTERS)

    def _pooled(self, x: np.ndarray, keep: bool = False):
        e = np.ascontiguousarray(self.p["emb"][x])
        hidden, at = [], {}
        for w in WIDTHS:
            z = self._conv(e, w)
            if keep:
                at[w] = z.argmax(1)
            hidden.append(np.maximum(z.max(1) + self.p[f"b{w}"], 0))
        return e, np.concatenate(hidden, 1), at

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), 256):
            _, h, _ = self._pooled(x[i : i + 256])
            z = h @ self.p["out"] + self.p["bias"]
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(CODES)), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 3, rate: float = 4e-3, size: int = 128) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        top = rate
        for epoch in range(epochs):
            rate = top * (0.05 + 0.95 * (1 - epoch / epochs))
            order = r.permutation(len(x))
            for i in range(0, len(x), size):
                rows = order[i : i + size]
                g = self._gradient(x[rows], y[rows])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        e, h, at = self._pooled(x, keep=True)
        z = h @ self.p["out"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        d = np.exp(z)
        d /= d.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(self.p["emb"])}
        dh = (d @ self.p["out"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            part = dh[:, i * FILTERS : (i + 1) * FILTERS]
            pos = at[w][:, :, None] + np.arange(w)
            ids = x[np.arange(n)[:, None, None], pos]
            patch = self.p["emb"][ids].reshape(n, FILTERS, w * DIM)
            g[f"f{w}"] = np.matmul(patch.transpose(1, 2, 0), part.T[:, :, None])[:, :, 0].T
            g[f"b{w}"] = part.sum(0)
            back = (part[:, :, None] * self.p[f"f{w}"].T[None]).reshape(-1, DIM)
            flat = ids.reshape(-1)
            for k in range(DIM):
                g["emb"][:, k] += np.bincount(flat, back[:, k], 256)
        return g


def plain(s: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def fit(texts: list[tuple[str, str]], seed: int = 5) -> ByteNet:
    """The network fitted on ``(text, code)``; of no texts, one that finds all languages alike."""
    votes: dict[str, Counter] = {}
    forms: dict[str, set[str]] = {}
    for text, code in texts:
        for s, heading in sentences(text):
            s = words(s)
            if not heading and len(s) >= 6:
                bare = plain(s.casefold())
                votes.setdefault(bare, Counter())[code] += 1
                forms.setdefault(bare, set()).add(s.casefold())
    # one sentence under several labels, whatever its case and accents, goes with the most frequent one
    best = []
    for bare, v in votes.items():
        (code, n), *others = sorted(v.items(), key=lambda cn: (-cn[1], cn[0]))
        if not others or n > others[0][1]:
            best.append((bare, code, n))
    chosen = sorted(best, key=lambda c: (-c[2], c[0]))[:FIT_SENTENCES]
    net = ByteNet()
    if not chosen:
        return net
    r = np.random.default_rng(seed)
    for last in (False, True):
        x, y = _examples(chosen, forms, r)
        net = ByteNet()
        net.train(x, y, max(3, min(40, (STEPS if last else STEPS // 2) // len(x))))
        if last:
            break
        lp = _evidence(net, [bare for bare, _, _ in chosen])
        firm = np.exp(lp - lp.max(1, keepdims=True))
        firm /= firm.sum(1, keepdims=True)
        chosen = [c for c, q in zip(chosen, firm) if c[2] >= SUPPORTED or CODES[int(q.argmax())] == c[1] or q.max() < FIRM]
    return net


def _examples(chosen: list, forms: dict[str, set[str]], r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the sentences as the corpus writes them and without accents, whole and from a random
    place; rare languages are repeated up to a third of the most frequent one."""
    per = Counter(code for _, code, _ in chosen)
    most = max(per.values())
    windows, y = [], []
    for bare, code, n in chosen:
        support = 1 + (n >= SUPPORTED) + (n >= 10 * SUPPORTED)
        for _ in range(support * max(1, min(8, round(most / (3 * per[code]))))):
            for form in sorted(forms[bare] | {bare}):
                b = as_bytes(form)
                own = windows_of(b)
                if len(b) > 24:
                    i = int(r.integers(0, len(b) - 16))
                    own.append(b[i : i + WINDOW])
                windows += own
                y += [CODES.index(code)] * len(own)
    return matrix(windows), np.array(y)


def _evidence(net: ByteNet, texts: list[str]) -> np.ndarray:
    """Log-likelihoods of each text: the mean over its windows, times their number up to 3."""
    windows, ends = [], [0]
    for t in texts:
        windows += windows_of(as_bytes(t))
        ends.append(len(windows))
    if not texts:
        return np.zeros((0, len(CODES)), np.float32)
    lp = np.maximum(net.log_probabilities(matrix(windows)), -12.0)
    n = np.diff(ends)
    return np.add.reduceat(lp, ends[:-1]) * (np.minimum(n, 3) / n)[:, None]


_KANA, _HAN, _CYRILLIC, _LATIN = (re.compile(c) for c in ("[\u3040-\u30ff]", "[\u3400-\u9fff]", "[\u0400-\u04ff]", "[A-Za-z\u00c0-\u024f]"))


def script_check(w: str, lp: np.ndarray) -> np.ndarray:
    """The network's evidence for ``w`` with languages that aren't written in its main script put last."""
    kana, han, cyrillic, latin = (len(r.findall(w)) for r in (_KANA, _HAN, _CYRILLIC, _LATIN))
    kana, han = 3 * kana, 3 * han  # such a letter says as much as some three of an alphabet
    if kana and kana + han > latin:
        fit = ("ja",)
    elif han > latin:
        fit = ("zh", "ja")
    elif cyrillic > latin:
        fit = ("ru",)
    elif latin:
        fit = tuple(c for c in CODES if c not in ("ru", "zh", "ja"))
    else:
        return lp
    return np.where([c in fit for c in CODES], lp, np.minimum(lp, lp.min() - 1.0))


class Labeller:
    """Segments of texts by one network; keeps the evidence of sentences it met, bounded."""

    def __init__(self, net: ByteNet):
        self.net = net
        self.known: dict[str, np.ndarray] = {}

    def _fill(self, wanted: set[str]) -> None:
        """Evidence of sentences not met before, weighted by how much text they are; None for those
        without words."""
        new = [s for s in wanted if s not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(wanted)
        for i in range(0, len(new), 4096):
            pairs = [(s, w) for s in new[i : i + 4096] if (w := words(s))]
            self.known.update(dict.fromkeys(new[i : i + 4096]))
            for (s, w), lp in zip(pairs, _evidence(self.net, [w for _, w in pairs])):
                self.known[s] = script_check(w, lp) * min(1.0, len(w) / 12 if w.isascii() else len(w) / 5)

    def label(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """(language, confidence) of each segment of each text; no segment if nothing has one.

        Headings take part only where a text has nothing else.
        """
        out = []
        for i in range(0, len(texts), 64):
            cut = [sentences(t) if t else [] for t in texts[i : i + 64]]
            self._fill({s for c in cut for s, _ in c})
            for c in cut:
                body = [e for s, heading in c if not heading and (e := self.known[s]) is not None]
                out.append(self._segments(body or [e for s, _ in c if (e := self.known[s]) is not None]))
        return out

    def _segments(self, evidence: list[np.ndarray]) -> list[tuple[str, float]]:
        if not evidence:
            return []
        lp = np.stack(evidence)
        n = len(lp)
        tops = lp.argmax(1)
        if (tops == tops[0]).all():  # nothing to weigh against a change of language
            path = tops.tolist()
        else:
            score, back = lp[0].copy(), np.zeros((n, len(CODES)), np.int32)
            own = np.arange(len(CODES))
            for i in range(1, n):
                top = int(score.argmax())
                back[i] = np.where(score >= score[top] - SWITCH, own, top)
                score = np.maximum(score, score[top] - SWITCH) + lp[i]
            path = [int(score.argmax())]
            for i in range(n - 1, 0, -1):
                path.append(int(back[i][path[-1]]))
            path.reverse()
        out, start = [], 0
        for i in range(1, n + 1):
            if i == n or path[i] != path[start]:
                q = lp[start:i].sum(0) / (i - start)  # an average: many like sentences are not independent evidence
                q = np.exp(q - q.max())
                out.append((CODES[path[start]], float(q[path[start]] / q.sum())))
                start = i
        return out


_NETS: dict[int, Labeller] = {}


def fit_on(documents: DataFrame, rows: int = FIT_ROWS, folder: str | None = None) -> ByteNet:
    """The network fitted on at most ``rows`` labelled documents, those of the smallest hash of doc_id.

    A fitted network is stored below ``folder`` (by default in the shared folder) under a digest of its sample,
    so other queries and later runs over the same documents read it instead of training again.
    """
    spark = documents.sparkSession
    labelled = documents.where("text is not null and lang is not null and length(text) > 20").select("doc_id", "lang", "text")
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    texts = [(r.text, code) for r in sample if (code := label_code(r.lang))]
    digest = hashlib.sha256("\0".join([f"{FIT_SENTENCES} {STEPS} {WINDOW} {DIM} {FILTERS}", *(f"{c}\0{t}" for t, c in texts)]).encode("utf-8", "replace")).hexdigest()[:32]
    folder, name = (folder or f"{shared_dir(spark)}/language-networks").rstrip("/"), f"net-{digest}"
    net = ByteNet()
    if name in folders_in(spark, folder, "_SUCCESS"):
        for r in spark.read.schema(_STORED).parquet(f"{folder}/{name}").collect():
            net.p[r.name] = np.array(r["values"], np.float32).reshape(r["shape"])
        return net
    net = fit(texts)
    rows_of = [(k, list(v.shape), v.ravel().tolist()) for k, v in net.p.items()]
    spark.createDataFrame(rows_of, _STORED).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    return net


_STORED = "name string, shape array<int>, values array<float>"


def segments(documents: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, segment_no, n_segments, lang, confidence, label_right`` of every document with text
    that has a language, one row per segment, numbered from 1 in text order.

    Null, empty and blank texts, and texts of names, numbers, links, tables, program text and front
    matter only, give no row.  Whole texts are read; documents are never split between tasks and
    never shuffled.
    """
    spark = documents.sparkSession
    params = spark.sparkContext.broadcast(fit_on(documents, fit_rows).p)
    key = hash(params.value["out"].tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _NETS:
            net = ByteNet()
            net.p = params.value
            _NETS.clear()
            _NETS[key] = Labeller(net)
        for b in batches:
            rows = []
            for doc_id, lang, found in zip(b["doc_id"].tolist(), b["lang"].tolist(), _NETS[key].label(b["text"].tolist())):
                right = len(found) > 0 and label_code(lang if isinstance(lang, str) else None) == found[0][0]
                for n, (code, confidence) in enumerate(found, 1):
                    rows.append((doc_id, n, len(found), code, confidence, right))
            yield pd.DataFrame(rows, columns=["doc_id", "segment_no", "n_segments", "lang", "confidence", "label_right"])

    kept = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return kept.mapInPandas(run, "doc_id long, segment_no int, n_segments int, lang string, confidence double, label_right boolean")


def found(documents: DataFrame) -> DataFrame:
    """``doc_id, segment_no, lang`` of documents whose label is missing or wrong, and of mixed ones."""
    return segments(documents).where("n_segments > 1 or not label_right").select("doc_id", "segment_no", "lang")
