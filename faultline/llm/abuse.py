"""Problem 8: abusive, hateful or sexual passages, by a counterfactually regularised classifier.

A document is a bag of passages (sentences); reviewers label documents, so the classifier learns which of
a document's passages earned the verdict: passages that also stand in documents found clean are clean, and
in a document found abusive the weight goes to the passages the current model finds worst. Passages are
read through their disguises (look-alike letters, digits for letters, separators, stretched letters) and
hashed into word, word-pair and in-word character features of a logistic model.

Naming a group of people is not abuse. Each training passage that names one is copied with the name swapped for
other groups' names, and the squared change of its score is a penalty, so that no group's name carries
weight of its own; what is said about the group does.

The model is fitted on at most `max_labelled` reviewed documents, chosen by the hash of their ids; every
document is scored whole. A document's score is that of its worst passage, and the cut is where a
two-fold cross-check over the reviewed documents gives the best F1.

Defined results: null, empty and blank texts score 0; undecided verdicts are no label; several verdicts on a
document count by their mean, a tie as abusive; without any abusive verdict all scores are 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
MAX_LABELLED = 20_000
#: Letters of other scripts that look like Latin ones; fixed values.
LOOKALIKES = str.maketrans("асеоріјѕухкмтвнԁԛԝгαοενρικτυχ", "aceopijsyxkmtbhdqwraoevpiktyx")
#: Digits and signs used for letters; fixed values.
LEET = str.maketrans("013457@$!€|", "oieastasiei")
#: Names of groups of people, by kind and language; fixed values.
IDENTITIES = (
    "women men girls boys mothers fathers wives gays lesbians homosexuals transsexuals queers jews muslims christians hindus buddhists catholics "
    "atheists believers blacks whites asians africans arabs mexicans indians chinese poles germans russians turks gypsies immigrants migrants refugees "
    "foreigners southerners northerners pensioners elderly disabled deaf blind autistic",
    "woman man girl boy mother father wife lesbian homosexual transsexual jew muslim christian hindu buddhist catholic atheist asian african arab mexican "
    "indian pole german russian turk gypsy immigrant migrant refugee foreigner southerner northerner pensioner",
    "jewish islamic female male gay black white polish turkish foreign old young",
    "frauen männer juden muslime christen ausländer flüchtlinge einwanderer schwule lesben behinderte türken polen russen",
    "frau mann jude muslim christ ausländerin flüchtling einwanderin lesbe türke pole russe",
    "mujeres hombres judíos musulmanes cristianos extranjeros refugiados inmigrantes gitanos negros",
    "mujer hombre judío musulmán cristiano extranjero refugiado inmigrante gitano negro",
    "femmes hommes juifs musulmans chrétiens étrangers réfugiés immigrés arabes noirs",
    "femme homme juif musulman chrétien étranger réfugié immigré arabe noir",
    "mulheres homens judeus muçulmanos cristãos estrangeiros refugiados imigrantes negros",
    "mulher homem judeu muçulmano cristão estrangeiro refugiado imigrante",
    "женщины мужчины евреи мусульмане христиане иностранцы беженцы мигранты",
    "женщина мужчина еврей мусульманин христианин иностранец беженец мигрант",
    "kobiety mężczyźni żydzi muzułmanie chrześcijanie cudzoziemcy uchodźcy imigranci",
    "kobieta mężczyzna żyd muzułmanin chrześcijanin cudzoziemiec uchodźca imigrant",
)
#: Written without blanks between words, so found anywhere in a passage; fixed values.
IDENTITIES_WIDE = ("女性", "男性", "外国人", "移民", "難民", "ユダヤ人", "イスラム教徒", "キリスト教徒", "同性愛者", "障害者", "高齢者")
_GROUPS = [g.split() for g in IDENTITIES]
_GROUP_OF = {w: g for g in reversed(_GROUPS) for w in g}
_SPLIT = re.compile(r"[\r\n]+|(?<=[.!?;:…])\s+|(?<=[。！？、])|\s+[-–—]\s+")
_SPEAKER = re.compile(r"^\s*[\w-]{1,20}:\s+")
_ID = re.compile(r"`[^`]*`|https?://\S+|\b\w*[a-z][A-Z]\w*\b|\b\w*_\w*\b|\b[\w-]*\d[\w.-]*\b")
_SPELLED = re.compile(r"(?<!\w)(?:\w[ .\-_*·]){3,}\w(?!\w)")
_WORD = re.compile(r"[^\W_]+(?:[’'*][^\W_]+)*|[@#]")
_SAME = re.compile(r"(.)\1{2,}")
_ID_SIGN = re.compile(r"[`_\d]|://|[a-z][A-Z]")
_LEET_SIGN = re.compile(r"[013457@$!€|]")
_LATIN = re.compile(r"[a-z]")
_OTHER = re.compile(r"[Ͱ-ϿЀ-ԯ]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_LEETED = re.compile(r"(?<![\w@$])(?=[^\s]*[a-z])(?=[^\s]*[013457@$!€|])[a-z013457@$!€|*]{3,}(?![\w@$])")
_NOT_HEX = re.compile(r"[g-z]")


def _deleet(m: re.Match) -> str:
    w = m.group()
    body = w.rstrip("!")
    # an identifier is mostly digits or hexadecimal; a disguised word is not
    if w[0] == "@" or re.search(r"\d{3}", w) or sum(c.isdigit() for c in body) > len(body) // 2 or len(_NOT_HEX.findall(body)) < 2:
        return w
    return body.translate(LEET)


class _Invisible(dict):
    """Format characters and combining marks map to nothing; categories are looked up once each."""

    def __missing__(self, c: int) -> int | None:
        self[c] = out = None if unicodedata.category(chr(c)) in ("Cf", "Mn") else c
        return out


_INVISIBLE = _Invisible()


def _squeeze(m: re.Match) -> str:
    return re.sub(r"[ .\-_*·]", "", m.group())


def normalise(passage: str) -> str:
    """The passage in one spelling: identifiers masked, disguises undone."""
    plain = passage.isascii()
    s = passage if plain else unicodedata.normalize("NFKC", passage).translate(_INVISIBLE)
    if ":" in s:
        s = _SPEAKER.sub("", s)
    s = _SPELLED.sub(_squeeze, s)
    low = s.lower()
    if low != s and _ID_SIGN.search(s) and (masked := _ID.sub("#", s)) != s:
        low = masked.lower()
    if _LEET_SIGN.search(low):
        low = _LEETED.sub(_deleet, low)
    if _ID_SIGN.search(low):
        low = _ID.sub("#", low)
    words = low.split()
    if not plain and _OTHER.search(low):
        words = [w.translate(LOOKALIKES) if _LATIN.search(w) and _OTHER.search(w) else w for w in words]
    low = " ".join(words)
    return _SAME.sub(r"\1", low)


def passages(text: str | None) -> list[str]:
    return [p for p in _SPLIT.split(text) if p and not p.isspace()] if text else []


def _hash(s: str) -> int:
    return crc32(s.encode("utf-8", "surrogatepass")) % DIMENSIONS


@lru_cache(maxsize=200_000)
def _word_features(w: str) -> frozenset[int]:
    """The features a word has by itself: the word, and its character groups."""
    out = {_hash("w" + w)}
    if _WIDE.search(w):
        out.update(_hash("z" + w[i : i + n]) for n in (2, 3, 4) for i in range(len(w) - n + 1))
    elif len(w) > 3:
        x = f"<{w}>"
        out.update(_hash("c" + x[i : i + 4]) for i in range(len(x) - 3))
    return frozenset(out)


def features(form: str) -> np.ndarray:
    """Distinct hashed features of a normalised passage."""
    words = _WORD.findall(form)
    out: set[int] = set().union(*map(_word_features, words))
    out.update(_hash("b" + a + " " + b) for a, b in zip(["^", *words], [*words, "$"]))
    out.update(_hash("s" + a + " " + b) for a, b in zip(words, words[2:]))
    return np.fromiter(out, np.int64, len(out))


def swaps(form: str, n: int = 3) -> list[str]:
    """The passage with each group it names replaced by n others of the same language and word form."""
    out = []
    for w in _WORD.findall(form):
        group = _GROUP_OF.get(w)
        if group:
            at = group.index(w)
            step = max(1, len(group) // (n + 1))
            out += [re.sub(rf"(?<!\w){re.escape(w)}(?!\w)", group[(at + step * (i + 1)) % len(group)], form) for i in range(n)]
    for at, w in enumerate(IDENTITIES_WIDE):
        if w in form:
            out += [form.replace(w, IDENTITIES_WIDE[(at + 3 * (i + 1)) % len(IDENTITIES_WIDE)]) for i in range(n)]
    return out


class _Matrix:
    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        size = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(self.n), size)
        self.filled = np.flatnonzero(size)
        self.start = (np.cumsum(size) - size)[self.filled]
        self.col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.value = 1 / np.sqrt(np.maximum(size, 1))[self.row]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(w[self.col] * self.value, self.start)
        return out

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row] * self.value, self.width)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float

    def scores(self, forms: list[str]) -> np.ndarray:
        """The score of each normalised passage; passages without features score 0."""
        feats = [features(f) for f in forms]
        size = np.array([len(f) for f in feats], np.int64)
        out = np.zeros(len(forms))
        some = np.flatnonzero(size)
        if len(some):
            sums = np.add.reduceat(self.weights[np.concatenate(feats)].astype(float), (np.cumsum(size) - size)[some])
            out[some] = 1 / (1 + np.exp(-(sums / np.sqrt(size[some]) + self.bias)))
        return out

    def score(self, form: str) -> float:
        return float(self.scores([form])[0])

    def documents(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """The score of each text's worst passage. known: scores of passages and forms met before."""
        cut = [passages(t) for t in texts]
        form_of = {p: normalise(p) for p in {p for ps in cut for p in ps if p not in known}}
        new = list({f for f in form_of.values() if "\0" + f not in known})
        known.update(("\0" + f, x) for f, x in zip(new, self.scores(new).tolist()))
        known.update((p, known["\0" + f]) for p, f in form_of.items())
        return np.array([max((known[p] for p in ps), default=0.0) for ps in cut], float)


def _descend(x: _Matrix, y: np.ndarray, weight: np.ndarray, a: _Matrix, b: _Matrix, fairness: float, ridge: float, steps: int, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Weighted logistic loss + ridge + the counterfactual penalty, by Adam on the full sample."""
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    total = weight.sum()
    for t in range(1, steps + 1):
        z = x.dot(w) + bias
        r = weight * (1 / (1 + np.exp(-z)) - y) / total
        g, gb = x.t_dot(r) + ridge * w, r.sum()
        if a.n:
            gap = (a.dot(w) - b.dot(w)) * (2 * fairness / a.n)
            g += a.t_dot(gap) - b.t_dot(gap)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.15 * (1 - 0.7 * t / steps)
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, bias


def train(docs: list[tuple[list[str], int]], fairness: float = 0.3, ridge: float = 1e-6, steps: int = 160, rounds: int = 3) -> tuple[np.ndarray, float]:
    """docs: (normalised passages, label). Passages of clean documents are clean; each abusive document shares one
    document's weight among its worst passages."""
    index: dict[str, int] = {}
    ids = [np.array(sorted({index.setdefault(p, len(index)) for p in ps}), np.int64) for ps, _ in docs]
    forms = list(index)
    clean, bad = np.zeros(len(forms)), np.zeros(len(forms))
    for own, (_, y) in zip(ids, docs):
        (bad if y else clean)[own] += 1
    if not bad.any():
        return np.zeros(DIMENSIONS), -20.0
    # every swapped passage's features too; only the columns that occur are trained
    named = {i: swaps(f) for i, f in enumerate(forms)}
    swapped = {s: features(s) for own in named.values() for s in own}
    feats = [features(f) for f in forms]
    columns = np.unique(np.concatenate([*feats, *swapped.values(), np.zeros(0, np.int64)]))
    feats = [np.searchsorted(columns, f) for f in feats]
    swapped = {s: np.searchsorted(columns, f) for s, f in swapped.items()}
    width = len(columns)
    x = _Matrix(feats, width)
    # first belief: how much more often a passage's features stand in abusive documents than in clean ones
    seen = np.zeros((2, width))
    for own, (_, y) in zip(ids, docs):
        if len(own):
            seen[y, np.unique(np.concatenate([feats[i] for i in own]))] += 1
    n_bad = sum(y for _, y in docs)
    odds = np.log((seen[1] + 0.3) / (n_bad + 1)) - np.log((seen[0] + 0.3) / (len(docs) - n_bad + 1))
    belief = np.array([1 / (1 + np.exp(-1.5 * odds[f].mean())) if len(f) else 0.0 for f in feats])
    belief = np.where(clean > bad, 0.0, np.maximum(belief, 1e-3))
    w, bias = np.zeros(width), -2.0
    for turn in range(rounds):
        blame, worst = np.zeros(len(forms)), np.zeros(len(forms), bool)
        for own, (_, y) in zip(ids, docs):
            if y and len(own):
                share = belief[own] ** 2 * (belief[own] >= 0.5 * belief[own].max())
                blame[own] += share / share.sum() if share.sum() > 0 else 0
                worst[own[belief[own].argmax()]] = True
        blame = np.where(clean > bad, 0, blame)
        # more copies of one sentence teach little more
        weight_bad, weight_clean = np.where(blame <= 1, blame, np.sqrt(blame)), clean**0.5
        # small shares teach little, but every abusive document keeps its worst passage
        weight_bad = np.where((blame > 0.2) | worst, weight_bad, 0)
        rows = np.concatenate((np.flatnonzero(weight_bad), np.flatnonzero(weight_clean)))
        y = np.concatenate((np.ones((weight_bad > 0).sum()), np.zeros((weight_clean > 0).sum())))
        weight = np.concatenate((weight_bad[weight_bad > 0], weight_clean[weight_clean > 0]))
        weight[y == 1] *= max(1.0, min(2.0, weight[y == 0].sum() / max(weight[y == 1].sum(), 1e-9)))
        both = [(i, s) for i in np.unique(rows) for s in named[i]]
        a, b = _Matrix([feats[i] for i, _ in both], width), _Matrix([swapped[s] for _, s in both], width)
        w, bias = _descend(_Matrix([feats[i] for i in rows], width), y, weight, a, b, fairness, ridge, steps if turn == 0 else steps // 2, w, bias)
        belief = 1 / (1 + np.exp(-(x.dot(w) + bias)))
        belief = np.where(clean > bad, 0.0, np.maximum(belief, 1e-3))
    out = np.zeros(DIMENSIONS)
    out[columns] = w
    return out, bias


def fit(docs: list[tuple[int, str, int]], **how: float) -> Model:
    """docs: (doc_id, text, label). The cut comes from a two-fold cross-check."""
    ready = [([normalise(p) for p in passages(t)], y) for _, t, y in docs]
    fold = np.array([crc32(str(d).encode()) & 1 for d, _, _ in docs])
    truth = np.array([y for _, y in ready], int)
    threshold = 0.5
    if truth.sum() >= 4:
        score = np.zeros(len(ready))
        for f in (0, 1):
            w, bias = train([d for d, k in zip(ready, fold) if k != f], **how)
            own = np.flatnonzero(fold == f)
            forms = list({p for i in own for p in ready[i][0]})
            known = dict(zip(forms, Model(w, bias, 0.5).scores(forms).tolist()))
            for i in own:
                score[i] = max((known[p] for p in ready[i][0]), default=0.0)
        order = np.argsort(-score, kind="stable")
        hits = np.cumsum(truth[order])
        f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
        k = int(f1.argmax())
        after = score[order[k + 1]] if k + 1 < len(order) else 0.0
        threshold = float(np.clip((score[order[k]] + after) / 2, 0.05, 0.95))
    w, bias = train(ready, **how)
    return Model(w.astype(np.float32), float(bias), threshold)


class AbuseClassifier:
    """Fits on the reviewed documents and scores all of them."""

    def __init__(self, documents: DataFrame, review_labels: DataFrame, max_labelled: int = MAX_LABELLED, **how: float):
        label = review_labels.where("verdict is not null").groupBy("doc_id").agg((F.avg("verdict") >= 0.5).cast("int").alias("y"))
        label = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        rows = documents.select("doc_id", "text").where("text is not null").join(label, "doc_id").collect()  # at most max_labelled
        self.model = fit([(r.doc_id, r.text, r.y) for r in sorted(rows, key=lambda r: r.doc_id)], **how)
        self.documents = documents

    def scores(self) -> DataFrame:
        """doc_id, source, score and flagged of every document."""
        shared = self.documents.sparkSession.sparkContext.broadcast(self.model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, known = shared.value, {}
            for b in batches:
                if len(known) > 300_000:
                    known.clear()
                s = model.documents(b.column(2).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array(s >= model.threshold)], ["doc_id", "source", "score", "flagged"])

        kind = dict(self.documents.dtypes)["doc_id"]
        return self.documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, score double, flagged boolean")

    def rates(self) -> DataFrame:
        """Per source: documents, flagged ones and their share."""
        n = F.count(F.lit(1))
        return self.scores().groupBy("source").agg(n.alias("n_docs"), F.count_if("flagged").alias("n_flagged"), (F.count_if("flagged") / n).alias("rate"))
