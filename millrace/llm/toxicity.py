"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words whose documents are labelled toxic far more often
than chance (a G statistic), with the log odds as their weight.  A text's dense
features are densities and rates over its whole length: lexicon hits, their
weight and variety, hits near a second person, capitals, punctuation and
obfuscated spellings.  Boosting, on binned features, and isotonic calibration are
fitted on the driver from the feature rows of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_fold, own_columns

#: Bound: labelled rows that are learned from.
SAMPLE_ROWS = 20_000
#: Least G statistic and least toxic documents of a lexicon word.
LEAST_G, LEAST_DOCS = 25.0, 5
#: Words between a hit and a second person that count as near.
NEAR = 5
ROUNDS, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 32, 20
CHUNK = 3_000_000

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus vosotros usted ustedes".split())
# Digits and signs written for letters.
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")

FEATURES = ("hits", "weight", "variety", "near", "person", "capitals", "shouted", "exclaimed", "punctuation", "digits", "obfuscated", "disguised", "stretched", "length")

_WORD = re.compile(r"[^\W\d_]+")
# A match begins where a run of letters does, and no part of it is tried again, so a run of any length is read once.
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!*|][0-9@$!*|.\-]*+[^\W\d_]++")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_STRETCH = re.compile(r"([^\W\d_])\1\1")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 1 upper case, 2 other letters, 3 digits, 4 exclamation and question marks, 5 other signs, 0 the rest."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        table[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "!?¡¿" else 5 if c.isprintable() and c != " " else 0
    return table


def _counts(texts: list[str]) -> np.ndarray:
    """Characters of each class, by text."""
    codes = _classes()[np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    return np.bincount(owner * 6 + codes, minlength=len(texts) * 6).reshape(-1, 6)


def features(texts: list[str | None], lexicon: dict[str, float]) -> np.ndarray:
    """A row of FEATURES per text; null and empty texts have zeros."""
    texts = [t or "" for t in texts]
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float32)
    lo = 0
    while lo < len(texts):
        hi, room = lo + 1, CHUNK - len(texts[lo])
        while hi < len(texts) and len(texts[hi]) <= room:
            room -= len(texts[hi])
            hi += 1
        kinds = _counts(texts[lo:hi])
        for k in range(lo, hi):
            text = texts[k]
            words = _WORD.findall(text.lower())
            n = max(1, len(words))
            at = [i for i, w in enumerate(words) if w in lexicon]
            person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            near = 0
            if at and person:
                p = np.array(person)
                right = np.searchsorted(p, at)
                gap = np.minimum(np.abs(p[np.minimum(right, len(p) - 1)] - at), np.abs(p[np.maximum(right - 1, 0)] - at))
                near = int((gap <= NEAR).sum())
            mixed = _MIXED.findall(text)
            plain = [_WORD.findall(m.lower().translate(LOOK_ALIKE)) for m in mixed]
            hidden = [w for m in plain for w in {*m, "".join(m)} if w in lexicon]
            hits = [words[i] for i in at] + hidden
            upper, lower, digit, mark, sign = kinds[k - lo, 1:]
            chars = max(1, len(text))
            out[k] = (
                len(hits) / n, sum(lexicon[w] for w in hits) / n, len(set(hits)), near / n, len(person) / n, upper / max(1, upper + lower), len(_SHOUT.findall(text)) / n,
                mark / chars, sign / chars, digit / chars, len(mixed) / n, len(hidden), len(_STRETCH.findall(text)) / n, np.log1p(len(words)),
            )
        lo = hi
    return out


def learn_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Words with a weight, from (word, toxic documents, clean documents) and the documents in all."""
    kept = []
    for word, a, b in counts:
        share = toxic / (toxic + clean)
        e = (a + b) * share
        if a < LEAST_DOCS or a <= e:
            continue
        g = 2 * (a * np.log(a / e) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0))
        if g >= LEAST_G:
            kept.append((-g, word, float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))))
    return {w: x for _, w, x in sorted(kept) if x > 1}


@dataclass
class Boosted:
    """Trees over binned features, and an isotonic map from their margin to a probability."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self.binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - (2**DEPTH - 1)]
        return f

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.margin(x), *self.knots), 0.0, 1.0) if len(x) else np.empty(0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Boosted:
        """Trees from the rows that are not `held`, calibration from those that are; without both labels, the base rate."""
        self = cls()
        fit = ~held if len(set(y[~held])) == 2 and len(set(y[held])) == 2 else np.ones(len(y), dtype=bool)
        rate = float((y.sum() + 0.5) / (len(y) + 1))
        self.base = float(np.log(rate / (1 - rate)))
        self.knots = (np.array([self.base]), np.array([y.mean() if len(y) else 0.0]))
        if len(set(y)) < 2:
            return self
        self.edges = [np.unique(np.quantile(x[fit, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b, t, f = self.binned(x[fit]), y[fit], np.full(int(fit.sum()), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            g, h = t - p, p * (1 - p)
            feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, BINS)
            node = np.zeros(len(t), dtype=np.int64)
            for depth in range(DEPTH):
                first = 2**depth - 1
                key = (node - first)[:, None] * BINS + b
                sums = [[np.bincount(key[:, j], weights=w, minlength=BINS * 2**depth).reshape(-1, BINS).cumsum(axis=1) for w in (g, h, np.ones(len(t)))] for j in range(b.shape[1])]
                for k in range(2**depth):
                    best = 1e-6
                    for j, (gs, hs, ns) in enumerate(sums):
                        G, H, N = gs[k, -1], hs[k, -1], ns[k, -1]
                        gain = gs[k] ** 2 / (hs[k] + 1) + (G - gs[k]) ** 2 / (H - hs[k] + 1) - G**2 / (H + 1)
                        gain[(ns[k] < LEAF) | (N - ns[k] < LEAF)] = 0
                        if gain.max() > best:
                            best, feature[first + k], cut[first + k] = gain.max(), j, int(gain.argmax())
                node = 2 * node + 1 + (b[np.arange(len(t)), feature[node]] > cut[node])
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + 1)
            f += value[leaf]
            self.trees.append((feature, cut, value))
        rest = held if not fit.all() else fit
        self.knots = isotonic(self.margin(x[rest]), y[rest])
        return self


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y over the margin (pooled adjacent violators)."""
    at, inverse = np.unique(margin, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, weights=y) / weight
    pools: list[list[float]] = []
    for k in range(len(at)):
        pools.append([mean[k], weight[k], k, k])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, _, hi = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + m * w) / (pools[-1][1] + w), pools[-1][1] + w, pools[-1][2], hi]
    xs = [at[int(k)] for p in pools for k in (p[2], p[3])]
    return np.array(xs), np.array([p[0] for p in pools for _ in range(2)])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.trees.score(features(texts, self.lexicon))


def learnable(id_col: str = "doc_id") -> Column:
    """The rows whose labels training may use: crc32 of the id modulo 5 is not 0."""
    return id_fold(id_col, 5) != 0


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the SAMPLE_ROWS usable labels of least hashed id.

    Rows without id, text or a label of 0 or 1 are left out; of repeated labels of
    one id the larger counts, and of its texts the smallest.  A quarter of the rows
    calibrates; the lexicon and the trees are learned from the rest.  Without both
    labels every score is the base rate.
    """
    own = own_columns(labels.where(usable) if usable is not None else labels, id=id_col, y=label_col)
    own = own.where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    picked = own.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(SAMPLE_ROWS)
    texts = own_columns(docs, id=id_col, text=text_col).where("text is not null")
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # at most SAMPLE_ROWS rows
    rows = checkpointed(rows.withColumn("held", F.crc32(F.concat(F.lit("held"), F.col("id").cast("string")).cast("binary")) % 4 == 0))

    def counted(it):
        for b in it:
            for label in (0, 1):
                seen = Counter(w for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()) if y == label for w in set(_WORD.findall(t.lower())))
                seen[""] = sum(y == label for y in b.column("y").to_pylist())
                n = pa.array(list(seen.values()), pa.int64())
                zero = pa.array(np.zeros(len(seen), np.int64))
                yield pa.record_batch([pa.array(list(seen), pa.string()), n if label else zero, zero if label else n], names=["word", "a", "b"])

    totals = rows.where("not held").mapInArrow(counted, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = checkpointed(totals.where(f"word = '' or a >= {LEAST_DOCS}"))
    whole = totals.where("word = ''").first()
    toxic, clean = (whole.a, whole.b) if whole else (0, 0)
    lexicon: dict[str, float] = {}
    if toxic and clean:
        # all words that pass the test's two conditions travel: their number is bounded by the sample's texts
        e = (F.col("a") + F.col("b")) * F.lit(toxic / (toxic + clean))
        rest = (F.col("a") + F.col("b")) * F.lit(clean / (toxic + clean))
        g = 2 * (F.col("a") * F.log(F.col("a") / e) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / rest)).otherwise(0.0))
        passing = totals.where("word != ''").where((F.col("a") > e) & (g > LEAST_G - 1e-6))
        lexicon = learn_lexicon([(r.word, r.a, r.b) for r in passing.collect()], toxic, clean)

    def measured(it):
        for b in it:
            x = features(b.column("text").to_pylist(), lexicon)
            yield pa.record_batch([b.column("id"), b.column("y"), b.column("held"), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["id", "y", "held", "x"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    got = rows.select("id", "y", "held", "text").mapInArrow(measured, f"id {types['id']}, y {types['y']}, held boolean, x array<float>")
    data = got.toPandas().sort_values(["id"], kind="stable")
    x = np.array(data["x"].tolist(), dtype=np.float64).reshape(len(data), len(FEATURES))
    return Model(lexicon, Boosted.fit(x, data["y"].to_numpy(dtype=np.float64), data["held"].to_numpy(dtype=bool)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row over its whole text; null and empty texts are scored by their zero features; repeated rows stay."""

    def batches(it):
        for b in it:
            yield pa.record_batch([b.column("id"), pa.array(model.score(b.column("text").to_pylist()), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return own_columns(docs, id=id_col, text=text_col).mapInArrow(batches, f"id {kind}, score double")
