"""Toxicity by a linear classifier over character n-grams.

A feature is the presence of an n-gram (by hash) in the lower-cased text, scaled by its naive Bayes
log-count ratio: how much more often toxic texts hold it than others, smoothed. The model is fitted on
a bounded sample of the labelled texts; every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import renamed
from matchloom.session import materialise

ORDERS = (3, 4, 5, 6, 7)
BITS = 21
SMOOTHING = 0.5
LEAST_Z = 3.0  # a ratio counts if it is that many standard errors away from none
FEATURES = 8192  # of those, at most so many, the surest first
SAMPLE_ROWS = 16_000  # labelled rows the model is fitted on, at most
STEPS, RATE, RIDGE = 60, 0.05, 1e-4
_BLOCK = 1000  # rows of the sample handled at once
_CHARS = 1 << 20  # characters handled at once; a longer text is read in overlapping parts

# Odd 64-bit multipliers of the rolling hash and its finish.
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes below ``2**BITS`` of all n-grams of a text between blanks, repeats included."""
    chars = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for start in range(0, len(chars), _CHARS):
        c = chars[start : start + _CHARS + ORDERS[-1] - 1].astype(np.uint64)
        c[(c >= 9) & (c <= 13)] = 32
        h = c + np.uint64(1)
        for n in range(1, ORDERS[-1] + 1):
            if n > 1:
                h = h[:-1] * _BASE + c[n - 1 :] + np.uint64(1)
            if n in ORDERS and len(h):
                g = (h + np.uint64(n)) * _MIX
                g = (g ^ (g >> np.uint64(32))) * _MIX
                yield (g >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray  # the fitted weight times the log-count ratio
    bias: float

    def score(self, held: np.ndarray) -> float:
        """``held``: positions in ``features`` of those a text holds."""
        s = float(self.weights[held].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(s, -500, 500))))


def _held(text: str | None, place: np.ndarray) -> np.ndarray:
    """Which of the chosen features the text holds; ``place`` is -1 for the others."""
    found = [p[p >= 0] for p in (place[g] for g in ngrams(text))]
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int32)


def _places(features: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)
    return place


def _counts(rows: DataFrame) -> DataFrame:
    """``feature, toxic, other``: rows (text, label) of either kind that hold a feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), dtype=np.int64)
        mark = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for g in ngrams(text.as_py()):
                    mark[g] = True
                held = np.flatnonzero(mark)
                seen[label, held] += 1
                mark[held] = False
        found = np.flatnonzero(seen.any(axis=0))
        for start in range(0, len(found), 100_000):
            f = found[start : start + 100_000]
            columns = [pa.array(f.astype(np.int32)), pa.array(seen[1, f]), pa.array(seen[0, f])]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "other"])

    parts = rows.select("text", "label").mapInArrow(count, "feature int, toxic long, other long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _fit(cat: np.ndarray, ends: np.ndarray, ratios: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by full-batch steps (Adam). Row k holds the features
    ``cat[ends[k]:ends[k + 1]]``; rows are gone through in blocks, which bounds what a step needs."""
    rows, size = len(labels), len(ratios) + 1
    rate = min(max(labels.mean(), 1e-6), 1 - 1e-6)
    w = np.zeros(size)
    w[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        grad, scaled = np.zeros(size), w[:-1] * ratios
        for at in range(0, rows, _BLOCK):
            end = min(rows, at + _BLOCK)
            part = cat[ends[at] : ends[end]]
            row = np.repeat(np.arange(end - at), np.diff(ends[at : end + 1]))
            s = np.bincount(row, weights=scaled[part], minlength=end - at) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - labels[at:end]) / rows
            grad[:-1] += np.bincount(part, weights=error[row], minlength=size - 1) * ratios
            grad[-1] += error.sum()
        grad[:-1] += RIDGE * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1] * ratios, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the rows of ``docs`` (id, text) whose id is in ``labels`` (id, label 0 or 1) and for
    which ``may_learn`` holds: those of the ``sample_rows`` labelled ids that come first by a hash, or all
    if there are fewer. A null label is no label; an id with several labels has their rounded mean.

    The list of sampled ids is bounded by that parameter and so can be broadcast; no text is shuffled.
    The driver receives at most FEATURES ratios and which of them each sampled text holds. Without rows of
    both kinds there are no features and every score is near 0 or 1, as the labels are.
    """
    known = (
        labels.filter(F.col("label").isNotNull() & F.col("id").isNotNull() & may_learn)
        .groupBy("id")
        .agg(F.round(F.avg("label")).cast("int").alias("label"))
    )
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.filter(may_learn).join(F.broadcast(sample), "id").select("id", "text", "label")
    rows = materialise(rows, "labelled")
    toxic, other = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not toxic or not other:
        return Model(np.empty(0, np.int32), np.empty(0), -500.0 if not toxic else 500.0)

    t, o = F.col("toxic") + SMOOTHING, F.col("other") + SMOOTHING
    ratio = F.log(t / (toxic + 2 * SMOOTHING)) - F.log(o / (other + 2 * SMOOTHING))
    z = F.abs(F.col("ratio")) / F.sqrt(1 / t + 1 / o)
    chosen = (
        _counts(rows).withColumn("ratio", ratio).withColumn("z", z).filter(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature", "ratio").toPandas()
    )
    features = chosen["feature"].to_numpy(np.int32)
    ratios = chosen["ratio"].to_numpy(np.float64)
    table = _features_of(rows, features).orderBy("id").toArrow()
    held = table.column("held").combine_chunks()
    lengths = np.asarray(pc.list_value_length(held))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    labels_of = table.column("label").to_numpy().astype(np.float64)
    weights, bias = _fit(np.asarray(pc.list_flatten(held)), ends, ratios, labels_of)
    return Model(features, weights, bias)


def _features_of(rows: DataFrame, features: np.ndarray) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(features)
        for batch in batches:
            held = [_held(t.as_py(), place) for t in batch.column(1)]
            columns = [batch.column(0).cast(pa.int64()), pa.array(held, pa.list_(pa.int32())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held", "label"])

    return rows.mapInArrow(find, "id long, held array<int>, label int")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row of ``docs``, from its whole text alone. A null text is an empty one, and
    gets the score of a text without features; ids may be null or repeat; extra columns are not
    looked at; an empty table gives no rows. The model is at most FEATURES numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(model.features)
        for batch in batches:
            scores = [model.score(_held(t.as_py(), place)) for t in batch.column(1)]
            columns = [batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "score"])

    return renamed(docs, id=id_col, text=text_col).mapInArrow(run, "id long, score double")


def held_out(id_: Column) -> Column:
    """A third of the ids, told by the CRC-32 of their decimal text; no model learns from them."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def keep_clean(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score lies below ``least``, with all their columns, whatever they are called. A null
    text is an empty one; ids may be null or repeat; repeated rows go or stay together; an empty table gives no rows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, text = _places(model.features), names.index(text_col)
        for batch in batches:
            clean = [model.score(_held(t.as_py(), place)) < least for t in batch.column(text)]
            yield batch.filter(pa.array(clean, pa.bool_()))
        pa.default_memory_pool().release_unused()  # the worker waits for its next task

    return docs.mapInArrow(run, docs.schema)
