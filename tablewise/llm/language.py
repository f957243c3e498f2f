"""Language identification: the family first, then one-versus-one linear SVMs within the family.

Texts become counts of hashed byte pairs and triples of letters and blanks, square-rooted and set
to length one. One linear SVM per family picks the family; inside it, every pair of languages has
an SVM of its own and the language with most votes wins, the summed margins deciding ties.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import LOWER, crc_bucket, map_texts, mix, text_slices, windows

#: Families of related languages by code; a language that is not listed is a family of its own. Fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa", "ur"),
    "uralic": ("fi", "et", "hu"),
}
UNKNOWN = "und"
DIMENSIONS = 2048
#: Documents that the classifier is fitted on, at most: an equal share of each language, chosen by a hash of the id.
SAMPLE_ROWS = 3000
_TEXT = np.zeros(256, bool)
_TEXT[[0x20, *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_SLICE_ROWS = 1024


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``[rows, DIMENSIONS]`` of unit length; zero where a text has no letters."""
    rows = len(bounds) - 1
    lower, plain = LOWER[data].astype(np.uint64), _TEXT[data]
    out = np.zeros(rows * DIMENSIONS)
    for size in (2, 3):
        at, row = windows(bounds, size)
        good = plain[at].copy()
        code = np.full(len(at), np.uint64(size << 40))
        for k in range(size):
            good &= plain[at + k]
            code |= lower[at + k] << np.uint64(8 * k)
        key = (mix(code[good]) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
        out += np.bincount(row[good] * DIMENSIONS + key, minlength=len(out))
    out = np.sqrt(out.reshape(rows, DIMENSIONS))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-12)[:, None]


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 200) -> np.ndarray:
    """Linear SVM with squared hinge loss and classes weighed alike; ``y`` is +-1. The last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    w = v = np.zeros(x.shape[1])
    # Accelerated gradient; the loss's curvature is bounded by the rows' length of at most 2.
    rate = 1 / (1 + 2 * cost * 2)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * x.T @ (weight * slack * y))
        v, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and confidence of every row."""
        ones = np.column_stack([x, np.ones(len(x))])
        if len(self.families) > 1:
            margin = ones @ self.family_weights.T
            pick = margin.argmax(axis=1)
            sure = 1 / (1 + np.exp(-2 * np.clip(margin.max(axis=1), -15, 15)))
        else:
            pick, sure = np.zeros(len(x), int), np.ones(len(x))
        langs = np.empty(len(x), object)
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(pick == f)
            names = self.members[family]
            votes, total = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            least = np.full((len(rows), len(names)), 1.0)
            for (a, b), w in self.pairs.items():
                if a in names and b in names:
                    i, j = names.index(a), names.index(b)
                    m = ones[rows] @ w
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    total[:, i] += m
                    total[:, j] -= m
                    p = 1 / (1 + np.exp(-2 * np.clip(m, -15, 15)))
                    least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
            best = np.lexsort((-np.arange(len(names))[None, :].repeat(len(rows), 0), total, votes), axis=1)[:, -1]
            langs[rows] = np.array(names, object)[best]
            sure[rows] *= least[np.arange(len(rows)), best]
        return langs.tolist(), np.clip(np.round(sure, 9), 0, 1)


def _sample(docs: DataFrame, rows: int, held_out: int, remainder: int) -> DataFrame:
    """``(doc_id, text, lang)``: an equal share of each language among the rows that may be learned from."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_bucket(F.col("doc_id"), held_out) != remainder))
    counts = known.groupBy("lang").count()
    order = F.xxhash64("doc_id", F.lit("language"))
    share = F.lit(float(rows)) / F.greatest(F.lit(1), F.lit(counts.count())) / F.col("count")
    some = known.join(F.broadcast(counts.orderBy(F.desc("count"), "lang").limit(1000)), "lang").filter(
        F.pmod(order, F.lit(1_000_000)) < F.ceil(share * 1_000_000))
    return some.orderBy(order, "doc_id").limit(2 * rows).select("doc_id", "text", "lang")


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, held_out: int = 3, remainder: int = 1) -> Model:
    """Fit on rows with a language whose crc32(doc_id as text) mod ``held_out`` is not ``remainder``."""
    def work():
        def run(texts):
            blobs = []
            for x in _rows(texts):
                blobs += [r.astype(np.float32).tobytes() for r in x]
            return [pa.array(blobs, pa.binary())]
        return run

    rows = map_texts(_sample(docs, sample_rows, held_out, remainder), "features binary", work).select("doc_id", "lang", "features").collect()
    rows.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], float).reshape(len(rows), DIMENSIONS)
    y = np.array([r[1] for r in rows], object)
    langs = sorted(set(y))
    families = sorted({family_of(v) for v in langs})
    members = {f: [v for v in langs if family_of(v) == f] for f in families}
    of = np.array([family_of(v) for v in y], object)
    tops = np.array([fit_svm(x, np.where(of == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.zeros((1, DIMENSIONS + 1))
    pairs = {}
    for f in families:
        for a, b in itertools.combinations(members[f], 2):
            use = (y == a) | (y == b)
            pairs[a, b] = fit_svm(x[use], np.where(y[use] == a, 1.0, -1.0))
    return Model(families, tops, members, pairs)


def _rows(texts: pa.Array):
    for low in range(0, len(texts), _SLICE_ROWS):
        for _, _, data, bounds in text_slices(texts.slice(low, _SLICE_ROWS)):
            yield features(data, bounds)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; older columns of these names are replaced.

    A null text, or one without a letter, is ``und`` with score 0. A model without languages says so
    of every text.
    """
    def work():
        def run(texts):
            langs, scores = [], []
            for x in _rows(texts):
                a, b = model.predict(x) if model.families else ([UNKNOWN] * len(x), np.zeros(len(x)))
                langs += a
                scores.append(b)
            return [langs, np.concatenate(scores)]
        return run

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    named = map_texts(docs, "lang_pred string, score double", work)
    return named.withColumns({"lang_pred": F.when(letter, F.col("lang_pred")).otherwise(UNKNOWN),
                              "score": F.when(letter, F.col("score")).otherwise(0.0)})


def languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document."""
    model = train(docs, sample_rows)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(own, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
