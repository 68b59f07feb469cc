"""Operator 8: quality by hierarchical empirical Bayes over documents, paths and hosts.

Document evidence: two logistic models (quality, toxic) on the presence of the
words and stems that best tell the classes apart (G-squared of document counts) and on
surface measures of the whole text, fitted on a bounded sample of labelled rows
(``per_class`` documents of at most ``sample_chars`` characters per class).

Site evidence, by grouped aggregation over all documents: a host's rate is the
mean of its documents' evidence shrunk towards the global mean, a path's is
shrunk towards its host's; how strongly, is estimated from the spread of the
rates (method of moments), so sparse sites stay near their prior.  A document
itself is left out of its path's rate.  Its posterior odds are the odds of its
own evidence times those of its path over the global ones.

A document is kept if its quality is 0.5 or more and its toxicity below 0.5.
Each target is fitted on its own: one whose sample lacks a class (no labels, no
toxic one among them) has evidence 0.5 for all and decides nothing, so without
any fitted target all documents are kept.  Null texts count as empty; null hosts
or paths are a site of their own.  Repeated rows count as documents of their
own; extra columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay_spark.llm.common import stage, text_slices

TARGETS = ("quality", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
#: Evidence stays this far from 0 and 1, so that no document is beyond its site's evidence.
EDGE = 1e-4
#: Letters of a word's stem; stems are terms like whole words, as inflected and rare words share them.
STEM = 5
MEASURES = 11
#: Texts of the sample that hold a term at least, for it to count.
LEAST_TEXTS = 4


def surface(text: str, words: list[str]) -> list[float]:
    """Measures of a whole text."""
    n = max(1, len(text))
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    most = max(counts.values(), default=0) / max(1, len(words))
    alpha = sum(map(len, words)) / n
    digits = sum(text.count(d) for d in "0123456789") / n
    marks = sum(text.count(c) for c in ".,;:!?") / n
    odd = sum(text.count(c) for c in "|#*<>{}[]=_~^@$%&+\\/") / n
    return [np.log1p(len(words)), len(words) and alpha * n / len(words), len(counts) / max(1, len(words)), most, alpha, digits, marks, odd,
            text.count("!") / n, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines)))]


def terms(words: list[str]) -> set[str]:
    """The words of a text and, marked by a hyphen, their stems."""
    own = set(words)
    return own | {f"{w[:STEM]}-" for w in own if len(w) > STEM}


@dataclass
class Evidence:
    """Fitted models over one feature row; ``weights`` has the targets whose sample held both classes."""

    words: dict[str, int]
    at: dict[str, int]
    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def rows(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words) + MEASURES + 4 * len(TARGETS)))
        for k, t in enumerate(texts):
            words = _WORD.findall(t.lower())
            own = terms(words)
            for w in self.words.keys() & own:
                x[k, self.words[w]] = 1
            x[k, len(self.words):] = surface(t, words) + odds_measures(self.odds[[self.at[w] for w in self.at.keys() & own]])
        return x

    def probabilities(self, texts: list[str]) -> dict[str, np.ndarray]:
        out = {t: np.full(len(texts), 0.5) for t in TARGETS}
        if self.weights:
            x = (self.rows(texts) - self.mean) / self.scale
            out |= {t: np.clip(1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30))), EDGE, 1 - EDGE) for t, w in self.weights.items()}
        return out


class Sample:
    """Term numbers of the sample's texts, so that counts are array sums."""

    def __init__(self, texts: list[str]) -> None:
        self.number: dict[str, int] = {}
        new = self.number.setdefault
        self.docs = [np.array([new(w, len(self.number)) for w in sorted(terms(_WORD.findall(t.lower())))], np.int64) for t in texts]
        self.flat = np.concatenate([*self.docs, np.zeros(0, np.int64)])
        self.row = np.repeat(np.arange(len(texts)), [len(d) for d in self.docs])

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """Sum of a weight per text over the texts that hold each term."""
        return np.bincount(self.flat, weight[self.row], len(self.number))

    def odds(self, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Log odds of each target given each term, over the texts in use; NaN for terms of too few, 0 for a target of one class."""
        n, seen = float(use.sum()), self.counts(use)[:, None]
        one = np.stack([self.counts(use * col) for col in y.T], 1)
        n1 = (y * use[:, None]).sum(0)
        out = np.log((one + 0.5) / (n1 + 1) / ((seen - one + 0.5) / (n - n1 + 1)))
        return np.where(seen >= LEAST_TEXTS, np.where(y.min(0) < y.max(0), out, 0.0), np.nan)

    def telling(self, y: np.ndarray, top: int) -> np.ndarray:
        """Numbers of the terms whose text counts differ most between the classes, by G-squared."""
        n, n1 = float(len(y)), float(y.sum())
        a, c = self.counts(y), self.counts(np.ones(len(y)))
        g = np.zeros(len(c))
        for seen, of in ((a, c * n1 / n), (c - a, c * (n - n1) / n), (n1 - a, (n - c) * n1 / n), (n - n1 - c + a, (n - c) * (n - n1) / n)):
            g += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(of, 1e-9)), 0)
        g[c < LEAST_TEXTS] = -1
        best = np.argsort(-g, kind="stable")[:top]
        return best[g[best] >= 0]


def odds_measures(found: np.ndarray) -> list[float]:
    """Largest, third largest, mean and smallest log odds of a text's terms, for each target."""
    if not len(found):
        return [0.0] * (4 * len(TARGETS))
    x = np.sort(found, 0)
    return np.concatenate([x[-1], x[-min(3, len(x))], x.mean(0), x[0]]).tolist()


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 2.0, rounds: int = 12) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_evidence(texts: list[str], labels: dict[str, np.ndarray], top: int = 150) -> Evidence:
    """Fit a model for each target of which the sample holds both classes."""
    both = [t for t in TARGETS if len(set(labels[t].tolist())) > 1]
    if not both:
        return Evidence({}, {}, np.zeros((0, len(TARGETS))), np.zeros(0), np.ones(0), {})
    sample, y = Sample(texts), np.stack([labels[t] for t in TARGETS], 1).astype(float)
    chosen = sorted(set(np.concatenate([sample.telling(labels[t].astype(float), top) for t in both]).tolist()))
    name = list(sample.number)
    ev = Evidence({name[k]: j for j, k in enumerate(chosen)}, {}, np.zeros((0, len(TARGETS))), np.zeros(0), np.ones(0), {})
    x = ev.rows(texts)
    fold = np.arange(len(texts)) * 5 // len(texts)  # a text's log odds come from the other folds
    for f in range(5):
        odds = sample.odds(y, (fold != f).astype(float))
        for k in np.flatnonzero(fold == f):
            own = odds[sample.docs[k]]
            x[k, len(chosen) + MEASURES:] = odds_measures(own[~np.isnan(own[:, 0])])
    odds = sample.odds(y, np.ones(len(texts)))
    known = np.flatnonzero(~np.isnan(odds[:, 0]))
    ev.at, ev.odds = {name[k]: j for j, k in enumerate(known.tolist())}, odds[known]
    ev.mean, ev.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - ev.mean) / ev.scale
    ev.weights = {t: _logistic(x, labels[t].astype(float)) for t in both}
    return ev


def fit_on_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1000, sample_chars: int = 10_000,
                  id_col: str = "doc_id", text_col: str = "text") -> Evidence:
    """Fit on a bounded, repeatable sample of the labelled rows of each class."""
    lab = labels.select(F.col(id_col).alias("id"), "quality", "toxic").where(
        F.col("id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    counts = lab.groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = lab.join(F.broadcast(counts), ["quality", "toxic"]).where(draw < F.lit(2.0 * per_class + 20) / F.col("n"))
    first = F.row_number().over(Window.partitionBy("quality", "toxic").orderBy(F.xxhash64("id"), "id"))
    drawn = drawn.withColumn("k", first).where(F.col("k") <= per_class).drop("k", "n").dropDuplicates(["id"])  # at most 4 * per_class rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.length("t") <= sample_chars)
    rows = sorted((r["id"], r["t"], r["quality"], r["toxic"]) for r in rows.join(F.broadcast(drawn), "id").collect())
    return fit_evidence([r[1] for r in rows], {"quality": np.array([r[2] for r in rows]), "toxic": np.array([r[3] for r in rows])})


def document_evidence(docs: DataFrame, evidence: Evidence, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(id, host, path, text_hash, p_quality, p_toxic) from every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
                       F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches, "text"):
            p = evidence.probabilities(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(p["quality"]), pa.array(p["toxic"])],
                                             ["id", "host", "path", "text_hash", "p_quality", "p_toxic"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, text_hash bigint, p_quality double, p_toxic double")


def _strength(mean: Column, rate: Column, n: Column) -> Column:
    """Prior strength by the method of moments: how many documents the prior is worth, 1 to a million."""
    between = F.avg((rate - mean) * (rate - mean)) - F.avg(mean * (1 - mean) / n)
    return F.coalesce(F.least(F.greatest(F.avg(mean * (1 - mean)) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6)), F.lit(1.0))


def _odds(p: Column) -> Column:
    return p / (1 - p)


def combine(evidence: DataFrame, decide: Iterable[str] = TARGETS) -> DataFrame:
    """Add host and path rates, posteriors of both targets and the decision by those in ``decide`` to document evidence."""
    sums = [F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS]
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), *sums)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{t}").alias(f"h_{t}") for t in TARGETS])
    whole = hosts.agg(F.sum("hn").alias("gn"), *[(F.sum(f"h_{t}") / F.sum("hn")).alias(f"g_{t}") for t in TARGETS])
    hosts = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one")
    prior = hosts.agg(*[_strength(F.col(f"g_{t}"), F.col(f"h_{t}") / F.col("hn"), F.col("hn")).alias(f"a_{t}") for t in TARGETS])
    hosts = hosts.join(F.broadcast(prior.withColumn("_one", F.lit(1))), "_one").select(
        "host", *[f"g_{t}" for t in TARGETS],
        *[((F.col(f"h_{t}") + F.col(f"a_{t}") * F.col(f"g_{t}")) / (F.col("hn") + F.col(f"a_{t}"))).alias(f"host_{t}") for t in TARGETS])
    paths = paths.join(hosts, "host")
    within = paths.agg(*[_strength(F.col(f"host_{t}"), F.col(f"s_{t}") / F.col("n"), F.col("n")).alias(f"b_{t}") for t in TARGETS])
    paths = paths.withColumn("_one", F.lit(1)).join(F.broadcast(within.withColumn("_one", F.lit(1))), "_one").drop("_one")
    paths = stage(paths, "sites")
    out = evidence.join(paths, ["host", "path"])
    for t in TARGETS:
        rest = (F.col(f"s_{t}") - F.col(f"p_{t}") + F.col(f"b_{t}") * F.col(f"host_{t}")) / (F.col("n") - 1 + F.col(f"b_{t}"))
        out = out.withColumn(f"path_{t}", rest)
        odds = _odds(F.col(f"p_{t}")) * _odds(F.col(f"path_{t}")) / _odds(F.col(f"g_{t}"))
        out = out.withColumn(t, odds / (1 + odds))
    keep = F.lit(True)
    if "quality" in decide:
        keep = keep & (F.col("quality") >= 0.5)
    if "toxic" in decide:
        keep = keep & (F.col("toxic") < 0.5)
    return out.withColumn("keep", keep)


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
          per_class: int = 1000) -> DataFrame:
    """Evidence, site rates, posteriors and the decision of every document."""
    model = fit_on_sample(docs, labels, per_class=per_class, id_col=id_col, text_col=text_col)
    evidence = stage(document_evidence(docs, model, id_col, text_col, host, path), "evidence")
    cols = ["host", "path", "text_hash", "p_quality", "p_toxic", *[f"{k}_{t}" for k in ("host", "path") for t in TARGETS], "quality", "toxic", "keep"]
    return combine(evidence, tuple(model.weights)).select(F.col("id").alias(id_col), *cols)
