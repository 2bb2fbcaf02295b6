"""Mixing by soft membership: domain posteriors and nonnegative rates by projected gradient.

1. A multinomial logistic model learns domains from a labelled table (rows whose
   domain is not null), at most ``per_domain`` whole texts of each domain, with
   weights that restore the domains' shares. It gives every document posteriors
   p_i over the domains.
2. With n_i tokens (words ``[^\\x20\\x09-\\x0D]+``), rates r_i are to make
   S_d = sum_i r_i n_i p_id meet the targets T_d. The squares of S - T, in the
   metric of the inverse of G = sum_i n_i p_i p_i', are minimised over
   r_i >= floor (0: nonnegative) by accelerated projected gradient, started from
   r_i = 1 and preconditioned by 1 / n_i, so rates depend on the posterior alone.
   In this metric a small domain weighs like a large one and a step of size one
   is safe. Steps end when each domain is within ``tolerance`` of its own target;
   if the floor keeps that out of reach, when the worst domain gets no nearer or
   after ``max_steps``, and then a warning names the totals that were reached.
   A rate is a function of p_i and of the few domain vectors that the steps had;
   so a step is one pass over the stored (n_i, p_i) that returns a sum for each
   domain, and only these sums reach the driver.
3. ``copies`` is the rate's whole part, and one more if a hash of the id falls
   under the rest, so expected copies equal the rate.

Null text has no tokens; its posterior is that of zero features. Documents with
a null domain are unlabelled. With no labelled row there is one domain ``all``.
Repeated rows and ties have equal rates; an id with two domains teaches both. Texts
of any length are read whole. An empty table gives no rows. ``mixing_rates``
reads the id, text and domain columns alone, ``mix`` passes all others on
unchanged, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroba.llm.common import free_name, stored
from corroba.llm.features import WIDTH, Scale, small_sample, text_features

#: More domains than this are an error: the model and the sums are held by the driver.
MAX_DOMAINS = 200
#: Steps without a nearer worst domain after which targets count as out of reach.
PATIENCE = 10


class DomainModel:
    def __init__(self, domains: list[str], mean: np.ndarray, by: np.ndarray, w: np.ndarray):
        self.domains, self.mean, self.by, self.w = domains, mean, by, w

    def posterior(self, text: str | None) -> np.ndarray:
        x = np.clip((text_features(text) - self.mean) * self.by, -8, 8)
        z = x @ self.w[:-1] + self.w[-1]
        z = np.exp((z - z.max()).astype(np.float64))
        return z / z.sum()


def fit_domains(labelled: DataFrame, id_col: str, text_col: str, domain_col: str, per_domain: int = 400, steps: int = 120, rate: float = 0.02) -> DomainModel:
    counts = labelled.where(F.col(domain_col).isNotNull()).groupBy(F.col(domain_col).cast("string").alias("d")).agg(F.count("*").alias("n")).orderBy("d").limit(MAX_DOMAINS + 1).collect()
    if len(counts) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not counts:
        return DomainModel(["all"], np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), np.zeros((WIDTH + 1, 1), np.float32))
    names = [c.d for c in counts]
    x, of = small_sample(labelled, id_col, text_col, per_domain, 3, by=domain_col)
    if not len(x):
        return DomainModel(["all"], np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), np.zeros((WIDTH + 1, 1), np.float32))
    y = np.array([names.index(d) for d in of])
    scale = Scale(x)
    x = np.hstack([scale(x), np.ones((len(x), 1), np.float32)])
    share, size = np.array([c.n for c in counts], float), np.bincount(y, minlength=len(names))
    weight = (share / share.sum() / np.maximum(1, size))[y].astype(np.float32)
    w = np.zeros((WIDTH + 1, len(names)), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        grad = x.T @ (z * weight[:, None]) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - np.float32(rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return DomainModel([c.d for c in counts], scale.mean, scale.by, w.astype(np.float32))


def replay(p: np.ndarray, steps: list[tuple[float, np.ndarray]], floor: float) -> np.ndarray:
    """The rates of documents with posteriors ``p`` after the given (momentum, direction) steps."""
    now = old = np.ones(len(p))
    for momentum, direction in steps:
        ahead = now + momentum * (now - old)
        old, now = now, np.maximum(floor, ahead - p @ direction)
    return now


def ahead_of(p: np.ndarray, steps: list[tuple[float, np.ndarray]], floor: float, momentum: float) -> tuple[np.ndarray, np.ndarray]:
    now = replay(p, steps, floor)
    return now, now + momentum * (now - (replay(p, steps[:-1], floor) if steps else now))


def _read(model: DomainModel, texts: list[str | None]) -> list[pa.Array]:
    """Tokens and posteriors of texts."""
    n = [len(t.encode("utf-8", "replace").split()) if t else 0 for t in texts]
    return [pa.array(n, pa.int64()), pa.array([model.posterior(t) for t in texts], pa.list_(pa.float64()))]


def posteriors(docs: DataFrame, model: DomainModel, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_tokens, posterior)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_read(model, [t.as_py() for t in batch.column(1)])], ["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, posterior array<double>")


def _matrix(column: pa.Array, domains: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def _sums(known: DataFrame, domains: int, f, width: int) -> np.ndarray:
    """Sums over all rows of the vectors that ``f(n, p)`` gives for a batch; one vector a task leaves the workers. Vectors of up to ``2 * MAX_DOMAINS`` sums are added by one task, as a step is not worth a shuffle over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = f(batch.column(0).to_numpy().astype(float), _matrix(batch.column(1), domains))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "s"])

    parts = known.select("n_tokens", "posterior").mapInArrow(run, "k int, s double")
    rows = (parts.repartition(1) if width <= 2 * MAX_DOMAINS else parts).groupBy("k").agg(F.sum("s").alias("s")).collect()
    return np.array([r.s for r in sorted(rows)])


def target_totals(available: np.ndarray, domains: list[str], weights: dict[str, float] | None, temper: float, keep_all: bool) -> np.ndarray:
    """Token totals: ``weights``, or the shares to the power ``temper``; their sum is what there is, or, with ``keep_all``, the least that leaves no domain below what it has."""
    share = np.array([weights.get(d, 0.0) for d in domains]) if weights else (available / max(1.0, available.sum())) ** temper * (available > 0)
    share = share / max(share.sum(), 1e-12)
    has = (share > 0) & (available > 0)
    total = float(np.max(available[has] / share[has])) if keep_all and has.any() else float(available.sum())
    return share * total


def fit_rates(known: DataFrame, domains: list[str], weights: dict[str, float] | None, temper: float, floor: float, max_steps: int, tolerance: float) -> tuple[list[tuple[float, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """The steps that ``replay`` needs; tokens there are, targets and reached totals by domain."""
    k = len(domains)
    first = _sums(known, k, lambda n, p: np.concatenate([n @ p, ((p * n[:, None]).T @ p).ravel()]), k + k * k)
    if not len(first) or not first[:k].sum():
        return [], np.zeros(k), np.zeros(k), np.zeros(k)
    available, gram = first[:k], first[k:].reshape(k, k)
    target = target_totals(available, domains, weights, temper, floor >= 1)
    inverse = _inverse(gram, available)
    own = np.maximum(np.where(target > 0, target, available), 1e-9)
    steps: list[tuple[float, np.ndarray]] = []
    reached, t, square, errors = available, 1.0, np.inf, []
    while True:
        momentum = 0.0
        if steps:
            after = (1 + (1 + 4 * t * t) ** 0.5) / 2
            momentum, t = (t - 1) / after, after
        sums = _sums(known, k, lambda n, p, s=list(steps), m=momentum: np.concatenate([(n * r) @ p for r in ahead_of(p, s, floor, m)]), 2 * k) if steps else np.tile(available, 2)
        reached, ahead = sums[:k], sums[k:]
        errors.append(float((np.abs(reached - target) / own).max()))
        if errors[-1] <= tolerance:
            break
        if len(steps) >= max_steps or (len(errors) > 2 * PATIENCE and min(errors[-PATIENCE:]) > 0.99 * min(errors[:-PATIENCE])):
            gaps = ", ".join(f"{d}: {r:.6g} of {x:.6g}" for d, r, x, o in zip(domains, reached, target, own, strict=True) if abs(r - x) > tolerance * o)
            warnings.warn(f"mixing targets not met after {len(steps)} steps, tokens by domain: {gaps}", stacklevel=2)
            break
        before, square = square, float((reached - target) @ inverse @ (reached - target))
        if square > before:  # overshot: start the momentum again
            momentum, t, ahead = 0.0, 1.0, reached
        steps.append((momentum, np.round(inverse @ (ahead - target), 12)))
    return steps, available, target, reached


def _inverse(gram: np.ndarray, available: np.ndarray) -> np.ndarray:
    """The inverse of ``gram``, without directions that hardly any token has."""
    scale = np.where(available > 0, 1 / np.sqrt(np.maximum(available, 1e-9)), 0)
    size, along = np.linalg.eigh(scale[:, None] * gram * scale)
    along = along * scale[:, None]
    fine = size > 1e-9
    return (along[:, fine] / size[fine]) @ along[:, fine].T


def copies_of(rate: Column, id_col: str, seed: int) -> Column:
    """Whole copies whose expectation is the rate."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(1 << 30)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixing_rates(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "lang",
    weights: dict[str, float] | None = None,
    temper: float = 0.5,
    floor: float = 0.0,
    per_domain: int = 400,
    max_steps: int = 100,
    tolerance: float = 1e-3,
    seed: int = 11,
) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies), one row a row of ``docs``."""
    model = fit_domains(labelled if labelled is not None else docs, id_col, text_col, domain_col, per_domain)
    known = stored(posteriors(docs, model, id_col, text_col), "posteriors")
    steps, *_ = fit_rates(known, model.domains, weights, temper, floor, max_steps, tolerance)
    kind, domains = docs.schema[id_col].dataType.simpleString(), model.domains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column(2), len(domains))
            best = [domains[i] for i in p.argmax(1)] if len(p) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(np.round(replay(p, steps, floor), 9))], ["doc_id", "n_tokens", "posterior", "domain", "rate"])

    out = known.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, posterior array<double>, domain string, rate double")
    return out.select("doc_id", "n_tokens", "domain", "posterior", "rate", copies_of(F.col("rate"), "doc_id", seed).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", weights: dict[str, float] | None = None, temper: float = 0.5, floor: float = 0.0, per_domain: int = 400, max_steps: int = 100, tolerance: float = 1e-3, seed: int = 11) -> DataFrame:
    """``docs`` with every row as many times as its rate says, all columns kept, whatever their names. Rows are stored once with their posteriors, so that no text is read by the model twice."""
    model = fit_domains(labelled if labelled is not None else docs, id_col, text_col, domain_col, per_domain)
    tokens, posterior, rate, copies = (free_name(docs, n) for n in ("mix_tokens", "mix_posterior", "mix_rate", "mix_copies"))
    schema = T.StructType([*docs.schema.fields, T.StructField(tokens, T.LongType()), T.StructField(posterior, T.ArrayType(T.DoubleType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_read(model, texts)], schema.names)

    known = stored(docs.withColumn(free_name(docs, "mix_text"), F.col(text_col).cast("string")).mapInArrow(read, schema), "posteriors")
    steps, *_ = fit_rates(known.select(F.col(tokens).alias("n_tokens"), F.col(posterior).alias("posterior")), model.domains, weights, temper, floor, max_steps, tolerance)
    final = T.StructType([*docs.schema.fields, T.StructField(rate, T.DoubleType())])

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column(batch.num_columns - 1), len(model.domains))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.round(replay(p, steps, floor), 9))], final.names)

    out = known.drop(tokens).mapInArrow(rated, final).withColumn(copies, copies_of(F.col(rate), id_col, seed)).where(F.col(copies) > 0)
    again = out.withColumn(free_name(out, "mix_copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return again.select(*(F.col(f"`{c}`") for c in docs.columns))
