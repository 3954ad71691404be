"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct terms (runs of letters, A-Z folded, and the
first ``STEM`` bytes of longer ones, for inflected forms), each a 64-bit hash.  The machine has a weight and a vector for each term, so pairs of
terms that are harmless alone, such as an insult and a mention of a group, get
an interaction that additive weights miss.

Training takes at most ``SAMPLE`` labelled rows (those with the smallest hashed
ids, so the choice doesn't depend on partitions; of rows that repeat an id one
counts).  First the ``TERMS`` terms whose presence tells most about the label
(log-likelihood ratio) make a machine.  The toxic rows that it leaves below the
threshold are then searched for pairs of terms that make a text more likely
toxic than either does alone (``telling_pairs``), among the ``PAIR_TERMS`` rarest
terms with enough such rows.  The machine is fitted again with the terms of
those pairs; the others are ignored in scoring.  Scoring is one pass over the texts.

Defined cases: null and empty texts score by the bias alone; rows without a
label, with a null label or with a null id are scored, not learned from; a
label that repeats counts once, toxic if any of its rows is; without labels of
both kinds every score is the share of toxic rows (0 if there are none); equal
texts get equal scores, however long; a column named ``score`` is replaced by
``score``, and ``drop_toxic`` hands on every column, whatever its name; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import NOT_LETTERS, U, word_hashes
from .session import durable, map_arrow, table

SAMPLE = 20_000
TERMS = 1024
PAIR_TERMS = 2048
STEM = 5
#: Least log-likelihood ratio (nats) of a term: chance alone rarely gives so much among many thousand terms.
LEAST_GAIN = 10.0
LEAST_ROWS = 3
FACTORS = 4
STEPS = 200
THRESHOLD = 0.7


@dataclass(frozen=True)
class Machine:
    """terms: sorted hashes; weights and vectors: theirs."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, words: np.ndarray) -> float:
        at = present(self.terms, words)
        v = self.vectors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def present(terms: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Indices of the model's terms among a text's words."""
    if not len(terms) or not len(words):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    return np.unique(at[terms[at] == words])


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, factors: int = FACTORS, steps: int = STEPS, seed: int = 7) -> Machine:
    """Logistic loss with weight decay, full-batch Adam; rows: indices of the terms of each text.

    Toxic rows are the rarer ones and weigh more, by the square root of the odds.
    """
    n, m = len(rows), len(terms)
    share = float(labels.mean()) if n else 0.0
    if n == 0 or share in (0.0, 1.0) or m == 0:
        return Machine(terms, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(m), np.zeros((m, factors)))
    row, col = np.repeat(np.arange(n), [len(x) for x in rows]), np.concatenate(rows)
    theta = np.concatenate([[np.log(share / (1 - share))], np.zeros(m), np.random.default_rng(seed).normal(0, 0.02, m * factors)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    decay = np.concatenate([[0.0], np.full(m, 2e-4), np.full(m * factors, 2e-3)])
    weigh = np.where(labels > 0, np.sqrt((1 - share) / share), 1.0) / n
    sum_rows = lambda x: np.bincount(row, weights=x, minlength=n)
    sum_cols = lambda x: np.bincount(col, weights=x, minlength=m)
    for step in range(1, steps + 1):
        w, v = theta[1 : m + 1], theta[m + 1 :].reshape(m, factors)
        sums = np.stack([sum_rows(v[col, f]) for f in range(factors)], axis=1)
        squares = sum_rows((v[col] ** 2).sum(axis=1))
        z = theta[0] + sum_rows(w[col]) + 0.5 * ((sums**2).sum(axis=1) - squares)
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) * weigh
        by_col = sum_cols(error[row])
        grad_v = np.stack([sum_cols(error[row] * sums[row, f]) for f in range(factors)], axis=1) - by_col[:, None] * v
        grad = np.concatenate([[error.sum()], by_col, grad_v.ravel()]) + decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(theta[0]), theta[1 : m + 1], theta[m + 1 :].reshape(m, factors))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(words).view(np.int64) for _, words in word_hashes(batch.column(2), NOT_LETTERS, STEM)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["_id", "toxic", "terms"])


def _gain(n, t, share: float):
    """Log-likelihood ratio (nats) of n rows with t toxic ones."""
    part = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)
    return part(t, n * share) + part(n - t, n * (1 - share))


def pair_gain(n_terms: int) -> float:
    """Least gain of a pair: chance gives no more of n_terms ** 2 / 2 pairs than LEAST_GAIN lets through of n_terms terms."""
    return LEAST_GAIN + float(np.log(max(n_terms / 2, 1.0)))


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, m: int, block: int = 1024) -> list[tuple[int, int]]:
    """All pairs of the m terms that are toxic together: their joint ratio passes each one's own by ``pair_gain`` and the toxic share is above the base.

    Rows with both terms are counted ``block`` rows at a time, in m * m numbers.
    """
    share = float(labels.mean()) if len(rows) else 0.0
    if m < 2 or share in (0.0, 1.0):
        return []
    n, t = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for y, total in ((0, n), (1, t)):
        at = np.flatnonzero(labels == y)
        for part in (at[i : i + block] for i in range(0, len(at), block)):
            has = np.zeros((len(part), m), np.float32)
            for i, r in enumerate(part.tolist()):
                has[i, rows[r]] = 1
            total += has.T @ has
    n += t
    own = _gain(np.diag(n).astype(float), np.diag(t).astype(float), share)
    least, out = pair_gain(m), []
    for i in range(m - 1):
        n_i, t_i = n[i, i + 1 :].astype(float), t[i, i + 1 :].astype(float)
        likely = np.flatnonzero((t_i > n_i * share) & (n_i >= LEAST_ROWS))
        gain = _gain(n_i[likely], t_i[likely], share) - np.maximum(own[i], own[likely + i + 1])
        out += [(i, int(j)) for j in likely[gain >= least] + i + 1]
    return out


def _pair_support(times: np.ndarray, share: float) -> int:
    """Toxic rows that a term of a telling pair has at least; times: toxic rows of each term.

    A pair's gain is at most its toxic rows times log(1 / share), and no term has fewer than its pair.
    """
    t = LEAST_ROWS
    while t < times.max(initial=0) and t * -np.log(share) < pair_gain(min(int((times >= t).sum()), PAIR_TERMS)):
        t += 1
    return t


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, terms: int = TERMS) -> Machine:
    """The machine, learned from at most ``sample`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").alias("_id"), "toxic").filter("_id IS NOT NULL AND toxic IS NOT NULL AND crc32(cast(_id AS string)) % 3 <> 1").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(durable(known.orderBy(F.xxhash64("_id"), "_id").limit(sample)))  # `sample` rows of two numbers
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").select("_id", F.col("toxic").cast("int"), "_text")
    rows = map_arrow(texts, _terms, f"_id {texts.schema['_id'].dataType.simpleString()}, toxic int, terms array<long>")
    rows = durable(rows.groupBy("_id").agg(F.max("toxic").alias("toxic"), F.min_by("terms", F.xxhash64("terms")).alias("terms")).drop("_id"))
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n:
        return Machine(np.empty(0, U), -35.0, np.zeros(0), np.zeros((0, FACTORS)))
    share = n_toxic / n
    counts = durable(rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= LEAST_ROWS))
    n_col, t_col = F.col("n").cast("double"), F.col("t").cast("double")
    gain = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = gain(t_col, n_col * max(share, 1e-9)) + gain(n_col - t_col, n_col * max(1 - share, 1e-9))
    best = _hashes(counts.filter(ratio >= LEAST_GAIN).orderBy(F.round(ratio, 9).desc(), "term").limit(terms))
    texts_of, known_as = _learned(rows, best)
    machine = fit_machine(texts_of, known_as, best)
    left = sum(machine.score(best[x]) < THRESHOLD for x, y in zip(texts_of, known_as, strict=True) if y)
    if share in (0.0, 1.0) or not left:
        return machine
    share = left / (left + n - n_toxic)
    # the toxic rows that single terms don't show, and the terms that these have
    missed = durable(map_arrow(rows.filter("toxic = 1"), lambda it: _missed(it, machine), "term long"))
    missed = missed.groupBy("term").agg(F.count(F.lit(1)).alias("left"))
    support = missed.groupBy("left").agg(F.count(F.lit(1)).alias("n")).collect()  # at most a row for each number of toxic rows
    times = np.repeat([x.left for x in support], [x.n for x in support]) if support else np.empty(0, np.int64)
    likely = _hashes(missed.filter(F.col("left") >= _pair_support(times, share)).join(counts, "term").orderBy("n", "term").limit(PAIR_TERMS))
    texts_of, known_as = _learned(rows, both := np.unique(np.concatenate([best, likely])))
    own, pairs = present(both, best), present(both, likely)
    rest = [i for i, (x, y) in enumerate(zip(texts_of, known_as, strict=True)) if not y or machine.score(both[x]) < THRESHOLD]
    place = np.full(len(both), -1)
    place[pairs] = np.arange(len(pairs))
    told = telling_pairs([(p := place[texts_of[i]])[p >= 0] for i in rest], known_as[rest], len(pairs))
    if not told:
        return machine
    kept = np.unique(np.concatenate([own, pairs[np.array(told).ravel()]]))
    return fit_machine([present(kept, x) for x in texts_of], known_as, both[kept])


def _hashes(terms: DataFrame) -> np.ndarray:
    """The terms of a frame that is limited to the model's size, sorted."""
    return np.sort(np.array([x.term for x in terms.select("term").collect()], dtype=np.int64).view(U))


def _missed(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    """The terms of the rows that score below the threshold."""
    for batch in batches:
        for x in batch.column(1):
            words = x.values.to_numpy() if len(x) else np.empty(0, np.int64)
            if machine.score(words.view(U)) < THRESHOLD:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64())], names=["term"])


def _learned(rows: DataFrame, kept: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The places of each row's terms in ``kept``, and the labels, in an order that depends on the rows alone."""
    short = map_arrow(rows, lambda it: _shortened(it, kept), "toxic int, places binary")
    data = sorted((x.toxic, bytes(x.places)) for x in short.collect())  # at most `sample` rows of four bytes a term
    return [np.frombuffer(x, "<u4").astype(np.int64) for _, x in data], np.array([t for t, _ in data], dtype=float)


def _shortened(batches: Iterator[pa.RecordBatch], kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [present(kept, np.array(x, dtype=np.int64).view(U)).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["toxic", "places"])


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs with a column score."""
    docs = docs.drop(*[c for c in ("score",) if c in docs.columns])
    names, at = docs.columns, docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.score(words) for _, words in word_hashes(batch.column(at), NOT_LETTERS, STEM)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return map_arrow(docs, scored, schema)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs that score below the threshold, with their columns as they are."""
    machine, at = train(docs, table(spark, sf_dir, "labels"), text_col=text_col), docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([machine.score(words) for _, words in word_hashes(batch.column(at), NOT_LETTERS, STEM)])
            yield batch.filter(pa.array(scores < threshold))

    return map_arrow(docs, clean, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
