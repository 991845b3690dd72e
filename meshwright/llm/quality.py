"""Quality by a support vector machine over naive Bayes features.

The n-grams of a text are its words, and runs of one to three word shapes (letters by case, digits and
the signs themselves, a mark for a word that repeats the one before). Their indicators are hashed to a fixed
number of slots and scaled by the slot's log-count ratio, which all labelled rows outside fold 0 give; the
scaled vector has length 1. A linear machine with hinge loss is then fitted by dual coordinate descent on
a bounded sample of those rows, and its margins are turned into probabilities on a part of the sample that
the descent has not seen.

Bounds: SAMPLE rows of the sample, those with the least hashes of their ids; SLOTS weights to broadcast.

Defined cases: a word is what white space bounds, of any length, and its hash and shape are of the whole word;
one that fewer than three labelled rows have has no weight, like any n-gram.
A null text is empty, and a text without words scores as the bias alone. Rows that repeat
an id are scored one by one. Without labels of both kinds every score is the share of label 1 (0.5 if none).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshwright.llm.common import blank, cut, with_labels

SLOTS = 1 << 19
#: Labelled rows for the descent and the calibration.
SAMPLE = 6_000
EPOCHS, COST, SMOOTHING = 12, 0.5, 1.0
HELD = 200_000
CHUNK = 1 << 14
_SIGNS = re.compile(r"(.)\1+", re.S)


class _Kinds(dict):
    """What str.translate makes of a character, found once for each."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_KINDS = _Kinds()


def shape(word: str) -> str:
    """Runs of upper case, lower case, digits and of each other sign, each as one character, over the whole word."""
    return _SIGNS.sub(r"\1", word.translate(_KINDS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Features:
    """Slots of a text's n-grams; a worker's own, as it remembers words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes, self.shapes = np.zeros(HELD + 1, np.uint64), np.zeros(HELD + 1, np.uint64)

    def _learn(self, word: str) -> int:
        k = len(self.known)
        self.known[word] = k
        self.hashes[k] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        self.shapes[k] = xxhash.xxh64_intdigest(shape(word).encode("utf-8", "surrogatepass"), seed=1)
        return k

    def __call__(self, text: str) -> np.ndarray:
        """Distinct slots, ascending."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int32)
        parts = []
        for at in range(0, len(words), HELD // 2):  # so that a very long text fits what is remembered
            part = words[max(0, at - 2) : at + HELD // 2]
            if len(self.known) + len(part) > HELD:
                self.known.clear()
            known = self.known
            ids = np.array([known[w] if w in known else self._learn(w) for w in part])
            word, own = self.hashes[ids], self.shapes[ids].copy()
            own[1:][ids[1:] == ids[:-1]] = 7
            two = _mix(own[:-1] * np.uint64(3) + own[1:])
            three = _mix(two[:-1] * np.uint64(5) + own[2:]) if len(two) > 1 else two[:0]
            parts += [_mix(np.unique(word)), _mix(own + np.uint64(11)), two, three]
        return np.unique(np.concatenate(parts) & np.uint64(SLOTS - 1)).astype(np.int32)


@dataclass
class QualityModel:
    """weights: of each slot's scaled indicator; ratios: the scales; then the margin's probability."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, slots: np.ndarray) -> float:
        r = self.ratios[slots]
        norm = float(np.sqrt((r * r).sum()))
        return self.bias + (float(self.weights[slots] @ r) / norm if norm else 0.0)

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.offset, -500, 500))))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int) -> np.ndarray:
    """Weights of the hinge-loss machine, by dual coordinate descent; the last one is the bias's."""
    weights, duals = np.zeros(size + 1), np.zeros(len(rows))
    rng = np.random.default_rng(0)
    # both kinds together have equal say
    costs = COST * len(signs) / 2 / np.where(signs > 0, max((signs > 0).sum(), 1), max((signs < 0).sum(), 1))
    squares = np.array([float(v @ v) + 1 for _, v in rows])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = signs[i] * (weights[at] @ v + weights[-1]) - 1
            new = min(max(duals[i] - gradient / squares[i], 0.0), costs[i])
            if step := (new - duals[i]) * signs[i]:
                weights[at] += step * v
                weights[-1] += step
                moved = max(moved, abs(step))
                duals[i] = new
        if moved < 1e-3:
            break
    return weights


def sigmoid_fit(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of most likelihood, by Newton's method with a little damping."""
    target = np.where(label == 1, ((label == 1).sum() + 1) / ((label == 1).sum() + 2), 1 / ((label == 0).sum() + 2))
    x, w = np.stack([margins, np.ones(len(margins))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    labelled = with_labels(docs.select(id_col, text_col), labels, label_col, id_col).where((F.col("_fold") > 0) & F.col("_label").isin(0, 1))
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = labelled.select(order.alias("_order")).orderBy("_order").limit(SAMPLE).agg(F.max("_order"), F.count("*")).first()
    last = chosen[0] if chosen[0] is not None else 0

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, counts, rows = Features(), np.zeros((2, SLOTS), np.int32), np.zeros(2, np.int64)
        for frame in frames:
            sample = []
            for text, label, order in zip(frame["_text"].tolist(), frame["_label"].tolist(), frame["_order"].tolist(), strict=True):
                slots = features(text)
                counts[label][slots] += 1
                rows[label] += 1
                if order <= last:
                    sample.append((-1, label, order, slots.tobytes()))
            yield pd.DataFrame(sample, columns=["chunk", "label", "order", "blob"])
        if rows.any():
            parts = [(k, label, int(rows[label]), zlib.compress(counts[label][k * CHUNK : (k + 1) * CHUNK].tobytes(), 1)) for label in (0, 1) for k in range(SLOTS // CHUNK)]
            yield pd.DataFrame(parts, columns=["chunk", "label", "order", "blob"])

    rows = labelled.select(blank(text_col).alias("_text"), "_label", order.alias("_order"))
    made = cut(rows.mapInPandas(task, "chunk int, label int, order long, blob binary"))

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for blob in frame["blob"]:
            total += np.frombuffer(zlib.decompress(blob), np.int32)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "label": frame["label"].iloc[:1], "rows": [int(frame["order"].sum())], "blob": [total.tobytes()]})

    counts, seen = np.zeros((2, SLOTS)), np.zeros(2)
    for r in made.where("chunk >= 0").groupBy("chunk", "label").applyInPandas(add, "chunk int, label int, rows long, blob binary").collect():
        counts[r["label"]][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["blob"], np.int64)
        seen[r["label"]] = r["rows"]
    if not seen.all():
        share = seen[1] / seen.sum() if seen.sum() else 0.5
        return QualityModel(np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    share = (counts + SMOOTHING) / (seen[:, None] + 2 * SMOOTHING)
    ratios = (np.log(share[1]) - np.log(share[0])).astype(np.float32)
    ratios[counts.sum(0) < 3] = 0  # an n-gram of one or two rows says nothing of a class

    sample = made.where("chunk < 0").orderBy("order", "label").limit(SAMPLE).select("label", "order", "blob").collect()
    vectors, kinds = [], np.array([r["label"] for r in sample])
    for r in sample:
        at = np.frombuffer(r["blob"], np.int32)
        v = ratios[at].astype(np.float64)
        at, v = at[v != 0], v[v != 0]
        vectors.append((at, v / (np.sqrt(v @ v) or 1.0)))
    fitted = np.arange(len(sample)) % 3 > 0
    if len({*kinds[fitted]}) < 2:
        fitted[:] = True
    weights = descend([x for x, f in zip(vectors, fitted, strict=True) if f], np.where(kinds[fitted] == 1, 1.0, -1.0), SLOTS)
    other = ~fitted if len({*kinds[~fitted]}) == 2 else fitted
    margins = np.array([weights[a] @ v + weights[-1] for (a, v), o in zip(vectors, other, strict=True) if o])
    slope, offset = sigmoid_fit(margins, kinds[other])
    return QualityModel(ratios, weights[:-1].astype(np.float32), float(weights[-1]), slope, offset)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), shared.value
        for batch in batches:
            scores = [own.score(features(t)) for t in batch.column("_text").to_pylist()]
            yield batch.drop_columns(["_text"]).append_column("score", pa.array(scores, pa.float64()))

    rows = docs.select(id_col, blank(text_col).alias("_text"))
    scored = rows.mapInArrow(task, StructType([rows.schema[id_col]]).add("score", "double"))
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    return scored.select(
        id_col, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= at_least, 1).otherwise(0).alias("predicted")
    )
