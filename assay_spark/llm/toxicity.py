"""Operator 11: toxicity by subword-bag embeddings averaged into a linear softmax.

A word (a run of letters and digits, lower-cased, cut every ``WORD_CHARS``
characters) is the bag of its character n-grams, of 3 to 5 characters with both
edges marked, and of itself; each of them has a vector in a hashed table, so an
unseen misspelling or inflection shares most vectors with the words it comes
from.  A passage of ``PASSAGE`` words is the average of its words' vectors, a
linear softmax of that average gives its odds, and a text is as toxic as its
passages together (log-sum-exp of their logits), so that a few words count in a
long text.  Vectors, softmax and bias are trained jointly in numpy on the
driver, by Adam over the whole fitted sample.

The sample is bounded: ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows (those of
smallest hash of the id), of each text ``FIT_CHARS`` characters at most (longer
ones give ``FIT_PIECES`` pieces spread evenly over the text).  Scoring reads
whole texts of all rows.  Because the softmax is linear, a bucket of the table
enters the odds by one number; only those numbers are broadcast (a fixed size).

Null and empty texts, and those without a word, are one empty word.  Without a
toxic row in the sample every score is 0, without a clean one (but with toxic
ones) 1.  Several labels of one id count as toxic if one is; labels without id
or value are ignored; rows that repeat an id are scored each for itself.  Extra
columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay_spark.llm.common import CACHE_ENTRIES, text_slices, worker_cache

BUCKETS, WIDTH, PASSAGE, WORD_CHARS = 1 << 17, 8, 4, 24
NGRAMS = (3, 4, 5)
#: Bound of the fitted sample.
MAX_TOXIC, MAX_CLEAN, FIT_CHARS, FIT_PIECES = 1500, 4000, 6000, 4
STEPS, RATE, TOXIC_SHARE = 80, 0.05, 0.2
_WORDS = re.compile(r"[^\W_]{1,%d}" % WORD_CHARS)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower()) or [""]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how many of each word): buckets of n-grams and words, word by word."""
    raw = "".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass")
    c = _mix(np.frombuffer(raw, "<u4").astype(np.uint64) + _C)
    size = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(words)), size)
    left = (begin + size)[of] - np.arange(len(c))  # characters to the word's end
    place = (np.arange(len(c)) - begin[of]).astype(np.uint64)
    hashes, owner = [_mix(np.add.reduceat(_mix(c + place * _B), begin))], [np.arange(len(words))]
    h = c.copy()
    for n in range(2, max(NGRAMS) + 1):
        h = _mix(h[:len(h) - 1] * _C + c[n - 1:]) if len(h) > 1 else h[:0]
        if n in NGRAMS:
            at = np.flatnonzero(left[:len(h)] >= n)
            hashes.append(h[at] + np.uint64(n))
            owner.append(of[at])
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (hashes[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(words))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def passages(n: int, size: int = PASSAGE) -> np.ndarray:
    """Lengths of the passages of a text of n words; the last one takes the rest."""
    k = max(1, n // size)
    out = np.full(k, size)
    out[-1] = n - (k - 1) * size
    return out


def pool(z: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-sum-exp of each text's passages, and each passage's share in it."""
    top = np.maximum.reduceat(z, starts)
    e = np.exp(z - np.repeat(top, sizes))
    total = np.add.reduceat(e, starts)
    return top + np.log(total), e / np.repeat(total, sizes)


class Bags:
    """Texts as bags of passages of words of buckets, in flat arrays."""

    def __init__(self, texts: list[str]) -> None:
        number: dict[str, int] = {}
        rows = [[number.setdefault(w, len(number)) for w in words_of(t)] for t in texts]
        cut = [passages(len(r)) for r in rows]
        self.words = np.array([w for r in rows for w in r], np.int64)
        self.sizes = np.concatenate(cut)  # words of a passage
        self.count = np.array([len(c) for c in cut])  # passages of a text
        self.grams, self.gram_count = subwords(list(number))

    def logits(self, bucket_scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.add.reduceat(bucket_scores[self.grams], _starts(self.gram_count)) / self.gram_count
        z = np.add.reduceat(s[self.words], _starts(self.sizes)) / self.sizes * PASSAGE
        return pool(z, _starts(self.count), self.count)

    def bucket_grads(self, texts: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Gradient by bucket scores, from that by the texts' logits."""
        passage = np.repeat(texts, self.count) * share / self.sizes * PASSAGE
        word = np.bincount(self.words, np.repeat(passage, self.sizes), len(self.gram_count))
        return np.bincount(self.grams, np.repeat(word / self.gram_count, self.gram_count), BUCKETS)


@dataclass
class ToxicModel:
    """Vectors of buckets, the softmax's weights (toxic less clean) and bias; or one score for all."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def bucket_scores(self) -> np.ndarray:
        return (self.vectors @ self.weights).astype(np.float32)


def loss_and_grads(bags: Bags, toxic: np.ndarray, model: ToxicModel) -> tuple[float, tuple[np.ndarray, np.ndarray, float]]:
    """Weighted cross-entropy over texts; toxic ones together weigh ``TOXIC_SHARE``."""
    weight = np.where(toxic, TOXIC_SHARE / max(1, toxic.sum()), (1 - TOXIC_SHARE) / max(1, (~toxic).sum()))
    z, share = bags.logits(model.vectors @ model.weights)
    z = z + model.bias
    loss = float((weight * np.logaddexp(0, np.where(toxic, -z, z))).sum())
    e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) * weight
    g = bags.bucket_grads(e, share)
    return loss, (np.outer(g, model.weights), model.vectors.T @ g, float(e.sum()))


def train(texts: list[str], toxic: list[bool], steps: int = STEPS, seed: int = 0) -> ToxicModel:
    """Fit vectors, weights and bias together."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return ToxicModel(np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 0.0, float(len(y) > 0 and y.all()))
    rng = np.random.default_rng(seed)
    bags = Bags(texts)
    params = [rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 3, WIDTH), np.array([-2.0])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        _, grads = loss_and_grads(bags, y, ToxicModel(params[0], params[1], float(params[2][0])))
        for p, g, m, v, rate in zip(params, grads, first, second, (RATE, RATE / 2, RATE / 2)):
            m += 0.1 * (g - m)
            v += 0.01 * (np.square(g) - v)
            p -= (rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)).astype(p.dtype)
    return ToxicModel(params[0], params[1], float(params[2][0]))


class WordScores:
    """Scores of words by a model, remembered per worker."""

    def __init__(self, buckets: np.ndarray) -> None:
        self.buckets, self.cache = buckets, {}

    def learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHE_ENTRIES:
            self.cache.clear()
        some = list(words)
        for lo in range(0, len(some), 50_000):
            part = some[lo:lo + 50_000]
            g, n = subwords(part)
            self.cache.update(zip(part, (np.add.reduceat(self.buckets[g], _starts(n)) / n).tolist()))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        cut = [words_of(t) for t in texts]
        every = set().union(*cut)
        before, new = len(self.cache), every.difference(self.cache)
        if new:
            self.learn(new)
            if len(self.cache) < before + len(new):  # the cache started anew
                self.learn(every.difference(self.cache))
        get = self.cache.__getitem__
        return [np.fromiter(map(get, c), np.float64, len(c)) for c in cut]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _excerpt(text: Column) -> Column:
    step = FIT_CHARS // FIT_PIECES
    at = [F.floor((F.length(text) - step) * F.lit(k) / F.lit(FIT_PIECES - 1)).cast("int") + 1 for k in range(FIT_PIECES)]
    return F.when(F.length(text) > FIT_CHARS, F.concat_ws("\n", *[F.substring(text, a, F.lit(step)) for a in at])).otherwise(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """A model of the labelled rows among ``docs`` (the caller leaves held-out rows out)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col) > 0).alias("_toxic"))
    ids = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    known = known.join(ids, "_id").select("_id", "_toxic", F.xxhash64("_id").alias("_draw"))
    picked = known.where("_toxic").orderBy("_draw", "_id").limit(MAX_TOXIC).unionByName(
        known.where("NOT _toxic").orderBy("_draw", "_id").limit(MAX_CLEAN))
    picked = docs.sparkSession.createDataFrame(picked.select("_id", "_toxic", "_draw").toArrow())  # MAX_TOXIC + MAX_CLEAN ids
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), _excerpt(text).alias("_text")).join(F.broadcast(picked), "_id")
    # rows that repeat an id could be many: the first by text stands for them
    rows = rows.groupBy("_draw", "_id", "_toxic").agg(F.min("_text").alias("_text")).toPandas().sort_values(["_draw", "_id"])
    return train(rows["_text"].tolist(), rows["_toxic"].tolist())


def score_texts(texts: list[str], scores: WordScores, bias: float) -> np.ndarray:
    """Probability that each text is toxic."""
    each = scores.of(texts)
    sizes = [passages(len(s)) for s in each]
    count = np.array([len(c) for c in sizes], np.int64)
    size = np.concatenate(sizes)
    z = np.add.reduceat(np.concatenate(each), _starts(size)) / size * PASSAGE
    return 1 / (1 + np.exp(-np.clip(pool(z, _starts(count), count)[0] + bias, -500, 500)))


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    docs = docs.select(F.col(id_col), F.col(text_col))
    if model.constant is not None:
        return docs.select(id_col, F.lit(model.constant).alias("score"))
    known = docs.sparkSession.sparkContext.broadcast((model.bucket_scores(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, bias = known.value
        scores = worker_cache(f"toxic-words:{hash(buckets.tobytes())}", lambda: WordScores(buckets))
        for b, texts in text_slices(batches, text_col):
            p = score_texts(texts, scores, bias) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], [id_col, "score"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
