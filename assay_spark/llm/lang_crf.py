"""Operator 1: language ID by a linear-chain conditional random field over words.

Each line of a text is a chain of its lower-cased words.  A word's features are
its affixes, its character 2- and 3-grams (hashed) and the languages in whose
lexicon it stands; transitions between the labels of neighbouring words are
learned with them.  Forward-backward gives every word's label probabilities, so
code-switched lines keep their parts; a document's score of a language is the
mean over its words.

The model is fitted on a bounded sample of labelled rows (``per_lang`` documents
of at most ``sample_chars`` characters per language, drawn by a hash of the id),
whose words carry the document's label; lines of different documents are joined
into one chain at times so that switches are seen.  Prediction reads whole texts
and nothing else.

A text that is null or has no letter, or a table without labelled rows, gives
``und`` with score 0.  Ties go to the language that comes first by name.
Repeated rows give equal results; extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay_spark.llm.common import text_slices, worker_cache

FEATURES = 1 << 15
#: Characters kept of each end of a very long word, for its features.
WORD_END = 12
#: Words whose emissions a worker remembers, words whose features are taken at once, and characters of a slice.
WORD_ENTRIES, FEATURE_WORDS, SLICE_CHARS = 200_000, 4_000, 1_000_000
_WORD = re.compile(r"[^\W\d_]+")


def lines_of(text: str) -> list[list[str]]:
    """Words of each line that has any."""
    return [w for line in text.lower().split("\n") if (w := _WORD.findall(line))]


def has_letter(lines: list[list[str]]) -> bool:
    return any(c.isalpha() for line in lines for w in line for c in w)


def word_features(words: list[str]) -> np.ndarray:
    """Hashed feature numbers of each word, one row per word; FEATURES stands for none."""
    width = 2 * WORD_END
    short = [w if len(w) <= width else w[:WORD_END] + w[-WORD_END:] for w in words]
    n = np.array([len(w) for w in short], np.int64)
    c = np.zeros((len(words), width + 2), np.uint64)
    c[:, 1:-1] = np.array(short, f"U{width}").view("<u4").reshape(len(words), width)
    c[:, 0] = 1
    r = np.arange(len(words))
    c[r, n + 1] = 2
    mul, at = np.uint64(0x9E3779B97F4A7C15), np.arange(width + 2)

    def hashed(kind: int, *cols: np.ndarray) -> np.ndarray:
        h = np.full(cols[0].shape, kind, np.uint64)
        for x in cols:
            h = (h ^ x) * mul
            h ^= h >> np.uint64(29)
        return (h % np.uint64(FEATURES)).astype(np.int64)

    two = np.where(at[:-1] <= n[:, None], hashed(1, c[:, :-1], c[:, 1:]), FEATURES)
    three = np.where(at[:-2] <= n[:, None] - 1, hashed(2, c[:, :-2], c[:, 1:-1], c[:, 2:]), FEATURES)
    out = [two, three]
    for k in (1, 2, 3):
        first = [c[:, 1 + j] for j in range(k)]
        last = [c[r, np.maximum(n - j, 0)] for j in range(k)]
        for kind, cols in ((2 + k, first), (5 + k, last)):
            out.append(np.where(n >= k, hashed(kind, *cols), FEATURES)[:, None])
    return np.concatenate(out, 1)


@dataclass
class Chains:
    """Chains laid out step by step, longest first, so that one step is one array slice."""

    place: np.ndarray  # of each word, in chain order
    active: np.ndarray  # chains that have a word at each step
    start: np.ndarray  # where each step begins

    @classmethod
    def of(cls, lengths: np.ndarray) -> Chains:
        rank = np.empty(len(lengths), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        active = len(lengths) - np.cumsum(np.bincount(lengths))[:-1]
        start = np.concatenate([[0], np.cumsum(active)])[:-1]
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return cls(start[step] + np.repeat(rank, lengths), active, start)


def forward_backward(e: np.ndarray, chains: Chains, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward values and posteriors; ``e``: exp(emissions), step by step."""
    a, b = np.empty_like(e), np.ones_like(e)
    for k, (s, m) in enumerate(zip(chains.start.tolist(), chains.active.tolist())):
        x = e[s:s + m] if not k else e[s:s + m] * (a[before:before + m] @ t)
        a[s:s + m] = x / x.sum(1, keepdims=True)
        before = s
    for k in range(len(chains.start) - 1, 0, -1):
        s, m, prev = int(chains.start[k]), int(chains.active[k]), int(chains.start[k - 1])
        x = (e[s:s + m] * b[s:s + m]) @ t.T
        b[prev:prev + m] = x / x.sum(1, keepdims=True)
    p = a * b
    return a, b, p / p.sum(1, keepdims=True)


class LanguageModel:
    """Weights of a fitted chain; a worker remembers the emissions of words it has seen."""

    def __init__(self, langs: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: dict[str, int]) -> None:
        self.langs, self.weights, self.transitions, self.lexicon = langs, weights, transitions, lexicon
        self.key = f"crf:{hash(weights.tobytes())}:{langs}"

    def features(self, words: list[str]) -> np.ndarray:
        """Hashed features, and the lexicon's language as the last one."""
        lex = np.array([FEATURES + 1 + self.lexicon[w] if w in self.lexicon else FEATURES for w in words])
        return np.concatenate([word_features(words), lex[:, None]], 1)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = [self.weights[self.features(words[k:k + FEATURE_WORDS])].sum(1) for k in range(0, len(words), FEATURE_WORDS)]
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))

    def posteriors(self, lines: list[list[str]]) -> np.ndarray:
        """Label probabilities of all words of the lines, in order."""
        store = worker_cache(self.key, lambda: {"at": {}, "e": np.zeros((0, len(self.langs)))})
        words = set().union(*lines)
        new = list(words.difference(store["at"]))
        if len(store["at"]) + len(new) > WORD_ENTRIES:
            store["at"].clear()
            store["e"], new = store["e"][:0], list(words)
        if new:
            e = self.emissions(new)
            if len(store["at"]) + len(new) > len(store["e"]):
                # room for as many words as may be held; one slice may need more
                most = max(WORD_ENTRIES, len(store["at"]) + len(new))
                grown = np.zeros((min(most, 2 * (len(store["at"]) + len(new))), len(self.langs)))
                grown[:len(store["at"])] = store["e"][:len(store["at"])]
                store["e"] = grown
            store["e"][len(store["at"]):len(store["at"]) + len(new)] = np.exp(e - e.max(1, keepdims=True))
            store["at"].update(zip(new, range(len(store["at"]), len(store["at"]) + len(new))))
        get = store["at"].__getitem__
        at = np.fromiter((get(w) for line in lines for w in line), np.int64)
        chains = Chains.of(np.array([len(x) for x in lines]))
        e = np.empty((len(at), len(self.langs)))
        e[chains.place] = store["e"][at]
        return forward_backward(e, chains, np.exp(self.transitions))[2][chains.place]


def fit(texts: list[str], labels: list[str], rounds: int = 30, rate: float = 0.25, l2: float = 1e-4, chain: int = 60) -> LanguageModel:
    """Fit by Adam on the conditional log likelihood of the sample."""
    langs = sorted(set(labels))
    size = len(langs)
    number = {x: k for k, x in enumerate(langs)}
    pieces, counts = [], {}
    for text, lab in zip(texts, labels):
        for line in lines_of(text):
            for w in line:
                counts.setdefault(w, np.zeros(size, np.int32))[number[lab]] += 1
            pieces += [(line[k:k + chain], number[lab]) for k in range(0, len(line), chain)]
    # lexicon: words met three times or more, nine of ten times in one language
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 3 and c.max() * 10 >= 9 * c.sum()}
    model = LanguageModel(langs, np.zeros((FEATURES + 1 + size, size)), np.zeros((size, size)), lexicon)
    if not pieces:
        return model
    rng = np.random.default_rng(7)
    order = rng.permutation(len(pieces)).tolist()
    lengths, words, y = [], [], []
    for k in range(0, len(order), 2):  # every other pair of lines is one chain
        pair = [pieces[i] for i in order[k:k + 2]]
        y += [lab for p, lab in pair for _ in p]
        words += [w for p, _ in pair for w in p]
        lengths += [sum(len(p) for p, _ in pair)] if k % 4 else [len(p) for p, _ in pair]
    vocabulary = sorted(counts)
    at = {w: k for k, w in enumerate(vocabulary)}
    at, y, chains = np.array([at[w] for w in words]), np.array(y), Chains.of(np.array(lengths))
    features = model.features(vocabulary)
    gold = np.zeros((len(y), size))
    gold[np.arange(len(y)), y] = 1
    ends = np.cumsum(lengths) - 1
    inner = np.setdiff1d(np.arange(len(y)), ends)  # words with a next one
    pairs = np.bincount(y[inner] * size + y[inner + 1], minlength=size * size).reshape(size, size)
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros((size, size)), np.zeros((size, size))]
    for step in range(1, rounds + 1):
        e = np.concatenate([model.weights[features[k:k + 20_000]].sum(1) for k in range(0, len(features), 20_000)])
        e = np.exp(e - e.max(1, keepdims=True))
        steps = np.empty((len(y), size))
        steps[chains.place] = e[at]
        t = np.exp(model.transitions)
        a, b, p = forward_backward(steps, chains, t)
        wrong = p[chains.place] - gold
        now, nxt = chains.place[inner], chains.place[inner + 1]
        xi = a[now][:, :, None] * t * (steps[nxt] * b[nxt])[:, None, :]
        xi /= xi.sum((1, 2), keepdims=True)
        by_word = np.stack([np.bincount(at, wrong[:, k], len(vocabulary)) for k in range(size)], 1)
        flat = features.ravel()
        grad = np.stack([np.bincount(flat, np.repeat(by_word[:, k], features.shape[1]), len(model.weights)) for k in range(size)], 1) / len(y)
        for value, g, m, v in ((model.weights, grad + l2 * model.weights, *moments[:2]),
                               (model.transitions, (xi.sum(0) - pairs) / len(y) + l2 * model.transitions, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        model.weights[FEATURES] = 0  # stands for no feature
    return LanguageModel(langs, model.weights, model.transitions, lexicon)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, sample_chars: int) -> list:
    """A bounded, repeatable sample of labelled rows: [(text, lang)]."""
    ok = (F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) <= sample_chars))
    rows = docs.where(ok).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    # ids and languages alone are counted, joined and ranked; texts are read for the drawn ids
    light = rows.select("i", "l")
    counts = light.groupBy("l").agg(F.count("*").alias("n"))
    key = F.xxhash64(F.col("i").cast("string"))
    draw = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = light.join(F.broadcast(counts), "l").where(draw < F.lit(2.0 * per_lang + 20) / F.col("n"))  # a row per language
    first = F.row_number().over(Window.partitionBy("l").orderBy(key, "i"))
    drawn = near.withColumn("k", first).where(F.col("k") <= per_lang).select("i", "l").distinct()  # per_lang rows per language
    return sorted((r["t"], r["l"]) for r in rows.join(F.broadcast(drawn), ["i", "l"]).select("t", "l").collect())


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       per_lang: int = 150, sample_chars: int = 20_000) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    rows = training_sample(docs, id_col, text_col, lang_col, per_lang, sample_chars)
    return fit([t for t, _ in rows], [x for _, x in rows])


def _judged(batches: Iterator[pa.RecordBatch], model: LanguageModel, text_col: str):
    """(slice, predictions, scores, words) of slices of documents."""
    for b, texts in text_slices(batches, text_col, rows=1000, chars=SLICE_CHARS):
        lines = [lines_of(t) for t in texts]
        per_doc = np.array([sum(map(len, x)) for x in lines])
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        if model.langs and per_doc.sum():
            p = model.posteriors([w for x in lines for w in x])
            doc = np.repeat(np.arange(len(texts)), per_doc)
            mean = np.stack([np.bincount(doc, p[:, k], len(texts)) for k in range(p.shape[1])], 1) / np.maximum(per_doc, 1)[:, None]
            for k in np.flatnonzero(per_doc).tolist():
                if has_letter(lines[k]):
                    best = int(mean[k].argmax())
                    pred[k], score[k] = model.langs[best], min(1.0, float(mean[k, best]))
        yield b, pred, score, per_doc.astype(np.int64)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_words): the language of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pred, score, words in _judged(batches, model, text_col):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score), pa.array(words)],
                                             [id_col, "lang_pred", "score", "n_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, n_words bigint")


def accept(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language of score ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pred, score, _ in _judged(batches, model, text_col):
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(pred, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def label_words(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words array<struct<line, word, lang, p>>): the label of every word of code-switched texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))
        for b, texts in text_slices(batches, text_col):
            out = []
            for lines in map(lines_of, texts):
                if not lines or not model.langs:
                    out.append([])
                    continue
                p = model.posteriors(lines)
                flat = [(k, w) for k, line in enumerate(lines) for w in line]
                out.append([{"line": k, "word": w, "lang": model.langs[int(x.argmax())], "p": float(x.max())} for (k, w), x in zip(flat, p)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], [id_col, "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, words array<struct<line:int,word:string,lang:string,p:double>>")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose crc32 of the id as text leaves remainder 1 by 3: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
