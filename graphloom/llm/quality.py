"""Quality scores from pairwise preferences (Bradley-Terry), thresholded at a score quantile.

Features are counts over the whole text, taken column-wise in tasks: shares of kinds of characters and of repeats, sizes, and
the shares of the words in ``WORDS`` hash buckets.  Preference pairs (a good and a
bad labelled document) train a linear score by the logistic loss on feature differences.  The
threshold is the quantile of the training scores that best parts the labels, and a document's
result is its chance of being preferred to a document at the threshold, shifted so that the
threshold has ``cutoff``.

The fit uses at most ``sample`` labelled documents, those whose id hashes lowest.

Defined results: null text counts as empty; repeated rows get equal scores; without labels of both kinds
every document scores ``cutoff``; labels without a document, null labels, and ids whose labels contradict each other are
unused; of several texts of one id the one with the smallest features teaches; all input columns are kept unless one bears the result's name (in any letter case).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.scratch import numbered, other_columns
from graphloom.llm.textkit import slices, word_hashes

#: Hash buckets of words, and their weight beside the other features.
WORDS, WORD_SCALE = 256, 0.2
GROUPS = ("lower", "upper", "digit", "blank", "line", "stop", "loud", "bar", "sign", "mark", "far")
_GROUP = np.full(256, GROUPS.index("mark"), dtype=np.int64)
_GROUP[128:] = GROUPS.index("far")
for _name, _chars in {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "blank": " \t", "line": "\n\r", "stop": ".,;:", "loud": "!?", "bar": "|", "sign": "*$&%#@^~+="}.items():
    _GROUP[list(_chars.encode())] = GROUPS.index(_name)


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    out = []
    for first, last, raw, bounds in slices(column):
        n, sizes = last - first, np.diff(bounds)
        row = np.repeat(np.arange(n), sizes)
        counts = np.bincount(row * len(GROUPS) + _GROUP[raw], minlength=n * len(GROUPS)).reshape(n, len(GROUPS))
        share = counts / np.maximum(sizes, 1)[:, None]
        words, at = word_hashes(raw, bounds)
        n_words = np.diff(at)
        owner = np.repeat(np.arange(n), n_words)
        repeats = []
        for lag in (1, 2, 3):
            same = (words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag]) if len(words) > lag else np.zeros(0, bool)
            repeats.append(np.bincount(owner[lag:][same], minlength=n)[:n] / np.maximum(n_words, 1) if len(words) > lag else np.zeros(n))
        letters = counts[:, 0] + counts[:, 1] + counts[:, 10]
        ratios = np.column_stack([share, *repeats, counts[:, 1] / np.maximum(letters, 1), (counts[:, 6] + counts[:, 7] + counts[:, 8]) / np.maximum(n_words, 1)])
        extent = np.column_stack([np.log1p(sizes), np.log1p(n_words), np.minimum(sizes / np.maximum(n_words, 1), 40) / 10])
        used = np.bincount(owner * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        out.append(np.column_stack([ratios, np.sqrt(ratios), ratios > 0.03, np.minimum(1.0, 8 * ratios), extent, np.sqrt(used / np.maximum(n_words, 1)[:, None])]))
    return np.concatenate(out) if out else np.zeros((0, 0))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    cutoff: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weight - self.threshold + np.log(self.cutoff / (1 - self.cutoff))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, *, cutoff: float, steps: int = 1500, pairs: int = 512, decay: float = 1e-4, seed: int = 5) -> Model:
    """Train on preference pairs by Adam steps over fresh random pairs."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    scale[-WORDS:] /= WORD_SCALE
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, steps + 1):
        diff = z[rng.choice(up, pairs)] - z[rng.choice(down, pairs)]
        grad = -(diff * (1 / (1 + np.exp(np.clip(diff @ w, -40, 40))))[:, None]).mean(axis=0) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, w, score_quantile(z @ w, good), cutoff)


def score_quantile(raw: np.ndarray, good: np.ndarray) -> float:
    """The cut between two neighbouring scores with the best balanced accuracy (ties: the widest gap)."""
    order = np.argsort(raw, kind="stable")
    ranked, kind = raw[order], good[order]
    kept = 1 - np.cumsum(kind) / kind.sum()
    stopped = np.cumsum(~kind) / (~kind).sum()
    value = np.round(kept + stopped, 9)[:-1]
    gap = np.diff(ranked)
    usable = np.flatnonzero(gap > 0)
    if not len(usable):
        return float(ranked[0])
    best = max(usable, key=lambda i: (value[i], gap[i]))
    return float((ranked[best] + ranked[best + 1]) / 2)


def held_out(doc_id: Column, folds: int) -> Column:
    """True for ids whose checksum falls into fold 0; those never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(
    documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = 20_000, cutoff: float = 0.3
) -> Model | None:
    """Fit on at most ``sample`` labelled documents outside the held-out fold; None without labels of both kinds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id), folds))
    agreed = known.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_good"), F.max(label).alias("_most")).where("_good = _most").select("_id", "_good")
    # Ids are drawn by hash first, with a margin, so that tasks pass on only about ``sample`` rows together.
    share = min(1.0, 1.2 * sample / max(agreed.count(), 1) + 1e-4)
    drawn = agreed.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    chosen = drawn.orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id").limit(sample)
    texts = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "_good", "x"])

    measured = texts.select("_id", "_text", "_good").mapInArrow(measure, "_id bigint, _good int, x binary")
    rows = measured.groupBy("_id", "_good").agg(F.min("x").alias("x")).toArrow()  # one row an id
    if not rows.num_rows or rows["_good"].to_numpy().min() == rows["_good"].to_numpy().max():
        return None
    order = np.argsort(rows["_id"].to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), dtype=np.float32).reshape(rows.num_rows, -1)[order].astype(np.float64)
    return fit(x, rows["_good"].to_numpy()[order] == 1, cutoff=cutoff)


def score_documents(documents: DataFrame, model: Model | None, *, text: str = "text", cutoff: float = 0.3, into: str = "score") -> DataFrame:
    """``documents`` with a score from 0 to 1 in the column ``into``."""
    own = other_columns(documents, into)
    at = own.index(text)
    schema = T.StructType([*[documents.schema[c] for c in own], T.StructField(into, T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(features(batch.column(at))) if model is not None and batch.num_rows else np.full(batch.num_rows, cutoff)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*own, into])

    return numbered(documents, own).mapInArrow(judge, schema)
