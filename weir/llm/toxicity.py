"""Toxicity (operator 1): non-negative positive-unlabelled learning.

Linear classifiers over the presence of letter runs are trained in numpy from
confirmed toxic texts and unlabelled ones by the non-negative risk estimator
(Kiryo et al. 2017): with class prior p, positive risk p R+(g) plus
max(0, R-(unlabelled) - p R-(positive)); where the second part turns negative,
the step goes the other way. Several classifiers, each with its own share of the
unlabelled texts, are averaged.

Training sees a bounded, seeded sample (`positives`, `unlabelled`); the prior is
counted over all labelled rows. Scoring is one pass over whole texts: a word's
hash is looked up in the sorted vocabulary, in numpy, a bounded model in every
task; no text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import chunks, materialise, table, word_hashes

#: Bounds of the training sample: ids, one text each, and bytes of distinct word hashes of each list.
POSITIVES, UNLABELLED = 4000, 9000
SAMPLE_BYTES = 64 << 20
CLASSIFIERS = 3
#: A word is a feature if it lies in so many texts of the sample, and if its share of
#: the toxic texts is so many standard errors from its share of the unlabelled ones.
MIN_TEXTS, MIN_Z = 5, 6.0
#: At most so many features, those farthest off.
VOCABULARY = 20_000
#: Texts that agree in so many smallest word hashes count once in training.
SKETCH = 8
THRESHOLD = 0.3

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[ord("a") : ord("z") + 1] = False
_BETWEEN[128:] = False


def letter_runs(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each run of letters; A-Z are lower-cased, bytes beyond ASCII are letters."""
    starts, _, hashes = word_hashes(np.frombuffer(data.lower(), np.uint8), _BETWEEN)
    return np.searchsorted(offsets, starts, side="right") - 1, hashes


def presence(texts: DataFrame, most: int = SAMPLE_BYTES) -> list[np.ndarray]:
    """The distinct word hashes of the texts (k, text) of a bounded sample, in order of their keys: one text a key.

    Of rows that share a key the one with the least packed hashes stays. Keys
    are left out from where all before have `most` bytes together.
    """

    def run(batches):
        for batch in batches:
            keys, out = batch.column(0), []
            for _, data, offsets in chunks(batch.column(1)):
                doc, hashes = letter_runs(data, offsets)
                bound = np.searchsorted(doc, np.arange(len(offsets)))
                out += [np.unique(hashes[a:b]).tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.binary())], names=["k", "words"])

    one = materialise(texts.select("k", "text").mapInArrow(run, "k bigint, words binary").groupBy("k").agg(F.min("words").alias("words")))
    last, held = None, 0
    for k, n in one.select("k", F.octet_length("words")).orderBy("k").collect():  # two numbers for each text of the sample
        held += n
        if held > most and last is not None:
            break
        last = k
    rows = (one.limit(0) if last is None else one.where(F.col("k") <= last)).orderBy("k").toArrow()
    return [np.frombuffer(w, np.uint64) for w in rows["words"].to_pylist()]


def nnpu(pos: tuple, unl: tuple, n_pos: int, n_unl: int, size: int, prior: float, *, steps: int = 250, rate: float = 0.05, penalty: float = 2e-4, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by full-batch Adam.

    `pos` and `unl` are (row, column) arrays of the ones of two binary matrices.
    """
    w, b = np.zeros(size + 1), np.log(prior / (1 - prior))
    w[size] = b
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        gp = np.bincount(pos[0], weights=w[pos[1]], minlength=n_pos) + w[size]
        gu = np.bincount(unl[0], weights=w[unl[1]], minlength=n_unl) + w[size]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        du, dp = sigmoid(gu) / n_unl, -prior * sigmoid(gp) / n_pos
        if negative >= -beta:
            dp = dp - prior * sigmoid(-gp) / n_pos
        else:
            du, dp = -gamma * du, -gamma * dp
        grad = np.append(np.bincount(pos[1], weights=dp[pos[0]], minlength=size) + np.bincount(unl[1], weights=du[unl[0]], minlength=size), dp.sum() + du.sum())
        grad[:size] += penalty * w[:size]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[size])


def distinct(texts: list[np.ndarray]) -> list[np.ndarray]:
    """One of all texts with the same sketch: copies would vouch for each other's rare words."""
    return list({t[:SKETCH].tobytes(): t for t in texts}.values())


def features(positive: list[np.ndarray], unlabelled: list[np.ndarray], *, min_texts: int = MIN_TEXTS, min_z: float = MIN_Z, most: int = VOCABULARY) -> np.ndarray:
    """Sorted hashes of the words that tell toxic texts from unlabelled ones."""
    words, n = np.unique(np.concatenate(positive + unlabelled), return_counts=True)
    words = words[n >= min_texts]

    def share(texts):
        flat = np.concatenate(texts)
        at = np.searchsorted(words, flat)
        at = at[words[np.minimum(at, len(words) - 1)] == flat] if len(words) else at[:0]
        return np.bincount(at, minlength=len(words)) / len(texts)

    p, u = share(positive), share(unlabelled)
    floor = np.maximum(u, 1 / len(unlabelled))
    z = np.abs(p - u) / np.sqrt(floor * (1 - np.minimum(floor, 0.99)) * (1 / len(positive) + 1 / len(unlabelled)))
    often = np.maximum(p * len(positive), u * len(unlabelled)) >= min_texts
    at = np.flatnonzero((z >= min_z) & often)
    return np.sort(words[at[np.argsort(-z[at], kind="stable")[:most]]])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, classifiers: int = CLASSIFIERS, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted word hashes, their weights and the bias, averaged over the classifiers.

    Without examples of either kind, or a prior of 0 or 1, the prior alone decides.
    """
    positive, unlabelled = distinct(positive), distinct(unlabelled)
    if not positive or not unlabelled or not 0 < prior < 1:
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    words = features(positive, unlabelled)

    def ones(texts):
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = np.concatenate(texts)
        at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
        hit = words[at] == flat if len(words) else np.zeros(len(flat), bool)
        return rows[hit], at[hit]

    found = []
    pos = ones(positive)
    for c in range(min(classifiers, len(unlabelled))):
        share = unlabelled[c::classifiers]
        found.append(nnpu(pos, ones(share), len(positive), len(share), len(words), prior, **options))
    return words, np.mean([w for w, _ in found], axis=0), float(np.mean([b for _, b in found]))


def held_out(column):
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, **options):
    """The model from rows that are not held out: sample, prior, training.

    `labels` has the id and a 0/1 label; null labels count for nothing. An id
    counts once in the sample, however many rows share it; the prior counts all
    labelled rows. Empty tables give a model of the prior alone.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    n, toxic = known.agg(F.count("*"), F.sum("y")).first()
    order = lambda: (F.xxhash64(F.lit(1), "id"), F.col("id"))
    # both lists are limited to the sample's bounds, so they may be broadcast
    some = known.where("y = 1").select("id").distinct().orderBy(*order()).limit(positives)
    rest = d.select("id").where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct().orderBy(*order()).limit(unlabelled)
    both = [presence(d.join(F.broadcast(ids), "id").select(F.xxhash64(F.lit(2), "id").alias("k"), "text")) for ids in (some, rest)]
    return train(*both, (toxic or 0) / n if n else 0.0, **options)


def score(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts score by the bias alone. Repeated rows are scored each,
    and alike; extra columns are left alone; an empty table gives an empty one.
    A text of any length is read as a whole, within one task.
    """
    words, weights, bias = model
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            out = []
            for _, data, offsets in chunks(batch.column(1)):
                n = len(offsets) - 1
                total = np.full(n, bias)
                if len(words):
                    doc, hashes = letter_runs(data, offsets)
                    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                    hit = words[at] == hashes
                    pairs = np.unique(doc[hit] * len(words) + at[hit])
                    total += np.bincount(pairs // len(words), weights=weights[pairs % len(words)], minlength=n)
                out.append(1 / (1 + np.exp(-np.clip(total, -40, 40))))
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
