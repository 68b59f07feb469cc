"""Operator 4: stupid-backoff scores over whole words, each document against all others, computed relationally.

Words are told apart by 56 bits of their MD5; the vocabulary grows with the
corpus.  Counts cover all documents less the scored one (exact leave-one-out):

    S(w | v) = c(v w) / c(v)                 if c(v w) > 0
             = alpha * (c(w) + 1) / (N + V)  otherwise

with the second form without alpha for a text's first word; N is the number of
the other documents' words, V that of distinct words of the whole corpus.  The
score is the mean of ln S over the document's words.

The ``hot`` words (frequent in a sample; the choice changes the work, not the
result) and their bigrams are counted exactly in bounded tables and broadcast.
Every occurrence of another word goes once to the bucket of that word, with the
word after it, and once more where it follows a hot word or starts a text.  So
a bucket has all counts of its words and of the bigrams it was dealt, and the
document's own.  Only bigrams of two other words that back off need another
bucket's word count; they go there in a second shuffle.  Records travel packed,
a word once per bucket and slice of documents.

A document without words (or null text) has n_words 0 and a null score.  Every
row is a document of its own, with or without an id, repeated or not.  Extra
columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay_spark.llm.common import SLICE_ROWS, stage, text_slices, worker_cache

HOT, ALPHA = 512, 0.4
#: Words of a bucket, rows of a block of sums, documents of the sample for hot words, about.
BUCKET_WORDS, BLOCK_DOCS, SAMPLE_DOCS = 1_500_000, 8192, 20_000
#: Words a worker remembers, words asked for in one packed piece (their rows are numbered by two bytes).
CACHE_ENTRIES, ASK_WORDS = 400_000, 50_000
#: What a record says of its word: the next word is another / a hot one, it ends a text, follows a hot word, starts a text.
NEXT, NEXT_HOT, END, AFTER_HOT, START = range(5)
#: Bytes of a word's hash.
WIDE = 7
#: Stands for a null id in sums.
NO_ID = -(2 ** 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """56-bit hashes of words, remembered per worker."""

    def __init__(self) -> None:
        self.cache: dict[bytes, bytes] = {}

    def of(self, text: str) -> np.ndarray:
        words, cache = text.encode().lower().split(), self.cache
        new = set(words).difference(cache)
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache.clear()
            new = set(words)
        for w in new:
            cache[w] = hashlib.md5(w).digest()[:WIDE] + b"\0"
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), "<u8")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words, their rows, whether they start a text) of slices of documents."""
    of = worker_cache("word-hashes", WordHashes).of
    for b, texts in text_slices(batches, "text", SLICE_ROWS, 1_000_000):
        words = [of(t) for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate([*words, np.zeros(0, "<u8")])
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(size) - size)[size > 0]] = True
        yield b, flat, np.repeat(np.arange(len(size)), size), first


def _numbers(hot: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of words among the sorted hot ones, -1 for others."""
    if not len(hot):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    return np.where(hot[at] == words, at, -1)


def _own(group: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How often each (group, document) occurs, at each occurrence."""
    _, at, n = np.unique(group * docs + doc, return_inverse=True, return_counts=True)
    return n[at]


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words * _MIX) >> np.uint64(24)) % np.uint64(buckets)


def _cuts(to: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal values."""
    at = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]).tolist()
    return ((lo, hi) for lo, hi in zip(at, at[1:]) if hi > lo)


def _narrow(words: np.ndarray) -> bytes:
    return words.astype("<u8").view("u1").reshape(-1, 8)[:, :WIDE].tobytes()


def _wide(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :WIDE] = np.frombuffer(data, np.uint8, n * WIDE, at).reshape(-1, WIDE)
    return out.view("<u8").ravel()


def _once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and how often each occurs."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[begin], np.diff(np.append(begin, len(x)))


def _pack(x: np.ndarray, *columns: bytes) -> bytes:
    """Sorted words, each once with its number of records, and further columns of the records, compressed."""
    xs, n = _once(x)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(xs), len(x)], "<u4").tobytes(), _narrow(xs), n.astype("<u4").tobytes(), *columns]))


def _unpack(data: bytes) -> tuple[np.ndarray, bytes, int]:
    """(the words, what holds the further columns, and from where)."""
    data = zstandard.ZstdDecompressor().decompress(data)
    k = int(np.frombuffer(data, "<u4", 1)[0])
    at = 8 + WIDE * k
    return np.repeat(_wide(data, k, 8), np.frombuffer(data, "<u4", k, at)), data, at + 4 * k


def pack_records(x: np.ndarray, y: np.ndarray, own_y: np.ndarray, kind: np.ndarray, row: np.ndarray) -> bytes:
    """Records sorted by x.  Rows are numbers below 256."""
    return _pack(x, _narrow(y), own_y.astype("<u4").tobytes(), kind.astype("u1").tobytes(), row.astype("u1").tobytes())


def unpack_records(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, data, at = _unpack(data)
    n = len(x)
    y = _wide(data, n, at)
    at += WIDE * n
    return x, y, np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "u1", n, at + 4 * n), np.frombuffer(data, "u1", n, at + 5 * n)


def pack_sums(row: np.ndarray, s: np.ndarray, n: np.ndarray | int = 0, b: np.ndarray | int = 0, id_: np.ndarray | int = 0) -> bytes:
    """Parts of the sums of rows (ascending numbers); what is not given is 0."""
    columns = [np.broadcast_to(np.asarray(x, t), len(row)).tobytes() for x, t in ((np.diff(row, prepend=0), "<i8"), (s, "<f8"), (n, "<i8"), (b, "<i8"), (id_, "<i8"))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(columns))


def unpack_sums(data: bytes) -> pd.DataFrame:
    data = zstandard.ZstdDecompressor().decompress(data)
    k = len(data) // 40
    row, s, n, b, id_ = (np.frombuffer(data, t, k, 8 * k * c) for c, t in enumerate(("<i8", "<f8", "<i8", "<i8", "<i8")))
    return pd.DataFrame({"row": np.cumsum(row), "s": s, "n": n, "b": b, "id": id_})


def _total(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts).groupby("row", as_index=False).sum()


def _hot_words(docs: DataFrame, n_docs: int, hot: int) -> np.ndarray:
    """Sorted hashes of the most frequent words of a bounded sample of documents."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(min(1.0, SAMPLE_DOCS / max(1, n_docs)) * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, words, _, _ in _slices(batches):
            total.update(dict(zip(*[x.tolist() for x in np.unique(words.astype("<i8"), return_counts=True)])))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["w", "c"])

    top = part.mapInArrow(run, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "w").limit(hot).collect()
    return np.sort(np.array([r["w"] for r in top], np.int64).view(np.uint64))


def _hot_counts(docs: DataFrame, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts of hot words and of their bigrams, and the number of words."""
    width = len(hot)
    cells = width + width * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + 1, np.int64)
        for _, words, _, first in _slices(batches):
            number = _numbers(hot, words)
            total[-1] += len(words)
            pair = np.flatnonzero((number[1:] >= 0) & (number[:-1] >= 0) & ~first[1:]) + 1
            code = np.concatenate([number[number >= 0], width + number[pair - 1] * width + number[pair]])
            total += np.bincount(code, minlength=cells + 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo:lo + 100_000]), pa.array(total[at[lo:lo + 100_000]])], ["cell", "c"])

    rows = docs.mapInArrow(run, "cell bigint, c bigint").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()  # cells + 1 numbers
    out = np.zeros(cells + 1, np.int64)
    out[rows["cell"].to_numpy()] = rows["c"].to_numpy()
    return out[:width], out[width:-1], int(out[-1])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, alpha: float = ALPHA) -> DataFrame:
    """(id, n_words, lm_score) of every row, by the counts of all other rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    n_docs = docs.count()
    hot_words = _hot_words(docs.select("text"), n_docs, hot)
    one, two, n_words = _hot_counts(docs.select("text"), hot_words)
    known = spark.sparkContext.broadcast((hot_words, one, two))
    width, buckets, blocks = len(hot_words), max(16, n_words // BUCKET_WORDS), max(16, n_docs // BLOCK_DOCS)
    ln_alpha = float(np.log(alpha))

    #: kind r: records of a bucket's words (rows: whose), s: parts of sums, w: the bucket's words and their counts, q: words asked for
    schema = pa.schema([("bucket", pa.int64()), ("kind", pa.string()), ("rows", pa.list_(pa.int64())), ("data", pa.binary())])
    passed = "bucket bigint, kind string, rows array<bigint>, data binary"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_, one_, two_ = known.value
        for turn, (batch, words, doc, first) in enumerate(_slices(batches)):
            row, m = batch.column(0).to_numpy(), batch.num_rows
            number = _numbers(hot_, words)
            is_hot, last = number >= 0, np.append(first[1:], True)
            own = _own(np.unique(words, return_inverse=True)[1], doc, m)
            # bigrams of two hot words, and hot words that start a text, are scored here
            at = np.flatnonzero(is_hot[1:] & is_hot[:-1] & ~first[1:]) + 1
            pair = number[at - 1] * width + number[at]
            c = two_[pair] - (_own(pair, doc[at], m) if len(at) else 0)
            seen = c > 0
            s, b = np.zeros(m), np.zeros(m, np.int64)
            hit, miss, begin = at[seen], at[~seen], np.flatnonzero(first & is_hot)
            s += np.bincount(doc[hit], np.log(c[seen]) - np.log(one_[number[hit - 1]] - own[hit - 1]), m)
            s += np.bincount(doc[miss], ln_alpha + np.log(one_[number[miss]] - own[miss] + 1), m)
            s += np.bincount(doc[begin], np.log(one_[number[begin]] - own[begin] + 1), m)
            b += np.bincount(doc[miss], minlength=m) + np.bincount(doc[begin], minlength=m)
            ids = np.array([NO_ID if i is None else i for i in batch.column(1).to_pylist()], np.int64)
            out: list[tuple] = [(turn * 7919 % buckets, "s", None, pack_sums(row, s, np.bincount(doc, minlength=m), b, ids))]
            cold = np.flatnonzero(~is_hot)
            after = cold[~last[cold]]
            to_cold, to_hot = after[~is_hot[after + 1]], after[is_hot[after + 1]]
            end, start = cold[last[cold]], cold[first[cold]]
            behind = cold[~first[cold]]
            behind = behind[is_hot[behind - 1]]
            none = lambda k: np.zeros(len(k), np.uint64)
            parts = [(NEXT, to_cold, words[to_cold + 1], own[to_cold + 1]), (NEXT_HOT, to_hot, number[to_hot + 1], own[to_hot + 1]),
                     (END, end, none(end), none(end)), (AFTER_HOT, behind, number[behind - 1], own[behind - 1]), (START, start, none(start), none(start))]
            kind = np.concatenate([np.full(len(p[1]), p[0], np.uint8) for p in parts])
            where = np.concatenate([p[1] for p in parts])
            y = np.concatenate([p[2].astype(np.uint64) for p in parts])
            own_y = np.concatenate([p[3].astype(np.uint32) for p in parts])
            x, of = words[where], doc[where]
            to = _bucket(x, buckets)
            order = np.lexsort((x, to))
            x, y, own_y, kind, of, to = x[order], y[order], own_y[order], kind[order], of[order], to[order]
            for lo, hi in _cuts(to):
                there, at_ = np.unique(of[lo:hi], return_inverse=True)
                out.append((int(to[lo]), "r", row[there], pack_records(x[lo:hi], y[lo:hi], own_y[lo:hi], kind[lo:hi], at_)))
            yield pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(zip(*out), schema)], schema=schema)

    def count(g: pd.DataFrame) -> pd.DataFrame:
        here = int(g["bucket"].iloc[0])
        out = [(here, "s", None, d) for d in g.loc[g["kind"] == "s", "data"]]
        g = g[g["kind"] == "r"]
        if not len(g):
            return pd.DataFrame(out, columns=schema.names)
        each = [unpack_records(d) for d in g["data"]]
        size = [len(r) for r in g["rows"]]
        base = np.cumsum(size) - size
        doc = np.concatenate([e[4].astype(np.int64) + k for e, k in zip(each, base.tolist())])
        x, y, own_y, kind = (np.concatenate([e[k] for e in each]) for k in range(4))
        rows = np.concatenate(list(g["rows"])).astype(np.int64)
        m = len(rows)
        del g, each
        own_y = own_y.astype(np.int64)
        xs, xi = np.unique(x, return_inverse=True)
        occurs = kind <= END
        c = np.bincount(xi[occurs], minlength=len(xs))
        # every (word, row) occurs: own counts over occurrences, looked up at all records
        codes, ci = np.unique(xi * m + doc, return_inverse=True)
        own = np.bincount(ci[occurs], minlength=len(codes))[ci]
        rest = c[xi] - own
        del codes, ci, x, own
        s, b = np.zeros(len(kind)), np.ones(len(kind), np.int64)
        b[kind == END] = 0
        gram = np.flatnonzero((kind == NEXT) | (kind == NEXT_HOT) | (kind == AFTER_HOT))
        ys, yi = np.unique(y[gram], return_inverse=True)
        key = (xi[gram] * 4 + kind[gram]) * len(ys) + yi
        _, ki, kn = np.unique(key, return_inverse=True, return_counts=True)
        left = kn[ki] - _own(ki, doc[gram], m)
        del key, ki, kn, ys, yi, xi
        one_ = known.value[1]
        hot_rest = lambda at: one_[y[at].astype(np.int64)] - own_y[at]
        hit, miss = gram[left > 0], gram[left <= 0]
        s[hit] = np.log(left[left > 0])
        b[hit] = 0
        front = kind[hit] == AFTER_HOT
        s[hit[~front]] -= np.log(rest[hit[~front]])
        s[hit[front]] -= np.log(hot_rest(hit[front]))
        s[miss] = ln_alpha
        front, hot_next = miss[kind[miss] == AFTER_HOT], miss[kind[miss] == NEXT_HOT]
        s[front] += np.log(rest[front] + 1)
        s[hot_next] += np.log(hot_rest(hot_next) + 1)
        start = kind == START
        s[start] = np.log(rest[start] + 1)
        ask = miss[kind[miss] == NEXT]
        by_row = np.argsort(rows)
        out.append((here, "s", None, pack_sums(rows[by_row], np.bincount(doc, s, m)[by_row], 0, np.bincount(doc, b, m)[by_row].astype(np.int64))))
        some = c > 0
        out.append((here, "w", None, xs[some].tobytes() + c[some].astype("<i8").tobytes()))
        y, own_y, doc = y[ask], own_y[ask], doc[ask]
        to = _bucket(y, buckets)
        order = np.lexsort((y, to))
        y, own_y, doc, to = y[order], own_y[order], doc[order], to[order]
        for lo, hi in _cuts(to):
            for at in range(lo, hi, ASK_WORDS):
                part = slice(at, min(hi, at + ASK_WORDS))
                there, place = np.unique(doc[part], return_inverse=True)
                out.append((int(to[lo]), "q", rows[there], _pack(y[part], own_y[part].astype("<u4").tobytes(), place.astype("<u2").tobytes())))
        return pd.DataFrame(out, columns=schema.names)

    def look_up(g: pd.DataFrame) -> pd.DataFrame:
        sums, asked, own_words = (g[g["kind"] == k] for k in "sqw")
        raw = list(own_words["data"])
        words = np.concatenate([*[np.frombuffer(d, "<u8", len(d) // 16) for d in raw], np.zeros(0, "<u8")])
        c = np.concatenate([*[np.frombuffer(d, "<i8", len(d) // 16, len(d) // 2) for d in raw], np.zeros(0, "<i8")])
        parts = [unpack_sums(d) for d in sums["data"]] or [unpack_sums(pack_sums(np.zeros(0, np.int64), 0))]
        for r in asked.itertuples():
            y, data, at = _unpack(r.data)
            own, place = np.frombuffer(data, "<u4", len(y), at).astype(np.int64), np.frombuffer(data, "<u2", len(y), at + 4 * len(y))
            ln = np.log(c[np.searchsorted(words, y)] - own + 1)
            parts.append(pd.DataFrame({"row": r.rows, "s": np.bincount(place, ln, len(r.rows)), "n": 0, "b": 0, "id": 0}))
        t = _total(parts)
        block = _bucket(t["row"].to_numpy().view(np.uint64), blocks).astype(np.int64)
        out = [(int(k), pack_sums(*[x[f].to_numpy() for f in ("row", "s", "n", "b", "id")]), None) for k, x in t.groupby(block)]
        out.append((-1, None, len(words)))
        return pd.DataFrame(out, columns=["block", "data", "vocab"]).astype({"vocab": "Int64"})

    def add_up(g: pd.DataFrame) -> pd.DataFrame:
        if g["block"].iloc[0] < 0:
            return pd.DataFrame({"s": [0.0], "n": [0], "b": [0], "id": pd.array([None], "Int64"), "vocab": pd.array([int(g["vocab"].sum())], "Int64")})
        t = _total([unpack_sums(d) for d in g["data"]])
        t["id"] = t["id"].astype("Int64").mask(t["id"] == NO_ID)
        t["vocab"] = pd.array([None] * len(t), "Int64")
        return t.drop(columns="row")

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    counted = numbered.mapInArrow(explode, passed).groupBy("bucket").applyInPandas(count, passed)
    looked = counted.groupBy("bucket").applyInPandas(look_up, "block bigint, data binary, vocab bigint")
    sums = stage(looked.groupBy("block").applyInPandas(add_up, "s double, n bigint, b bigint, id bigint, vocab bigint"), "lm-sums")
    vocab = width + (sums.where("vocab IS NOT NULL").agg(F.sum("vocab")).first()[0] or 0)
    ln_all = F.log(F.lit(float(n_words + vocab)) - F.col("n"))
    return sums.where("vocab IS NULL").select(F.col("id").alias(id_col), F.col("n").alias("n_words"),
                                              F.when(F.col("n") > 0, (F.col("s") - F.col("b") * ln_all) / F.col("n")).alias("lm_score"))
