"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1 outside the held-out fold; unlabelled web
text is a sample of all documents outside it, whose labels are not looked at;
labels of 0 are used nowhere. The class prior is estimated from positive and
unlabelled text alone: a positive-against-unlabelled model is fitted on one half
of both samples and scores the other half; for every threshold the share of
unlabelled text above it over the share of positive text above it bounds the
prior from above, and the threshold with the least bound, sampling error
included, gives the estimate. A linear model over ``features`` minimises

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with the logistic loss; where the second part is negative its gradient is
followed upwards. Fits use at most ``positives`` and ``unlabelled`` rows, whole
texts; every document is scored.

Null and empty texts have zero features and get the score of those. Repeated
rows get equal scores, texts of any length are read whole; an id with both
labels is no trusted positive. Without any positive label every score is 0.5. An
empty table gives no rows. Only id and text of documents, id and quality of
labels are read; with ``keep_rows`` other columns pass unchanged, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroba.llm.common import crc32_fold, free_name
from corroba.llm.features import WIDTH, Scale, small_sample, text_features


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nonnegative(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 250, rate: float = 0.02, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam on all rows."""
    w, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)

    def with_bias(g: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.append(g @ x, g.sum()) / len(x)

    for t in range(1, steps + 1):
        zp, zu = (x @ w[:-1].astype(np.float32) + np.float32(w[-1]) for x in (p, u))
        gp, gu = _sigmoid(zp), _sigmoid(zu)
        # log(1 + exp(z)) stays finite where a sigmoid is 1 in single precision.
        negative = np.logaddexp(0, zu.astype(float)).mean() - prior * np.logaddexp(0, zp.astype(float)).mean()
        positive = -prior * with_bias(1 - gp, p)
        other = with_bias(gu, u) - prior * with_bias(gp, p)
        grad = positive + other if negative >= 0 else -other
        grad = grad + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray, miss: float = 0.1) -> float:
    """The share of positives in unlabelled text, by the best threshold of a model that never saw the rows it scores. ``miss``: the chance that the bound allows."""
    if min(len(p), len(u)) < 4:
        return 0.5
    w, b = fit_nonnegative(p[::2], u[::2], 0.5)
    sp, su = np.sort(p[1::2] @ w + b), np.sort(u[1::2] @ w + b)
    above_p = 1 - np.arange(len(sp)) / len(sp)
    above_u = 1 - np.searchsorted(su, sp, "left") / len(su)
    error = np.sqrt(np.log(4 / miss) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held_out: int = 0,
    positives: int = 2500,
    unlabelled: int = 4000,
    threshold: float = 0.3,
    keep_rows: bool = False,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row a row of ``docs``; ``keep_rows``: all its columns and, last, ``predicted`` instead, under the name that ``free_name`` gives for it."""
    fold = crc32_fold(id_col, folds)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where("__id is not null and __label is not null").groupBy("__id").agg(F.min("__label").alias("__label"))
    trusted = known.where("__label = 1").where(crc32_fold("__id", folds) != held_out).select("__id")
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    p, _ = small_sample(base, "__id", "__text", positives, 1, base.select("__id").join(trusted, "__id", "left_semi"))
    u, _ = small_sample(base.where(crc32_fold("__id", folds) != held_out), "__id", "__text", unlabelled, 2)
    if len(p) and len(u):
        scale = Scale(u)
        p, u = scale(p), scale(u)
        prior = estimate_prior(p, u)
        w, b = fit_nonnegative(p, u, prior)
        bias = b
        mean, by, w = scale.mean, scale.by, w.astype(np.float32)
    else:
        mean, by, w, bias = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0

    def score(texts: pa.Array) -> np.ndarray:
        x = np.zeros(len(texts))
        for i, t in enumerate(texts):
            x[i] = np.clip((text_features(t.as_py()) - mean) * by, -8, 8).astype(np.float64) @ w
        return _sigmoid(x + bias)

    if keep_rows:
        rows = docs.withColumn(free_name(docs, "score_text"), F.col(text_col).cast("string"))
        schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs, "predicted"), T.IntegerType())])

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = (score(batch.column(batch.num_columns - 1)) >= threshold).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(good)], schema.names)

        return rows.mapInArrow(keep, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
