"""Operator 5: packing documents into sequences of at most ``max_len`` tokens.

Method: pattern packing by non-negative least squares.  The histogram of piece
lengths (at most ``max_len`` rows, whatever the input) is fitted by patterns of
one to three lengths that fill a sequence exactly; their repeat counts are the
non-negative least-squares solution, rounded and capped by what is there.  What
remains is packed longest first, each sequence taking the longest piece that
still fits, repeated as often as the counts allow.  The driver holds the
histogram and this plan only; each piece finds its place by its rank among the
pieces of its length.

Only documents longer than ``max_len`` are cut, into full pieces and a last one.
Null texts count as empty (one token, the end id); repeated rows are separate
documents; an empty table packs into no sequence.  Other columns are not
carried.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay_spark.llm.common import CACHE_ENTRIES, stage, text_slices, worker_cache

#: Patterns that take part in the fit, at most.
FIT_PATTERNS = 30_000
FIT_ROUNDS = 150
#: New words that the library encodes at once.
JOINED = 1000


class WordIds:
    """Ids of white-space-free chunks, remembered; the library sees each new word once.

    The vocabulary's pre-tokenizer drops white space and never joins across it,
    nor across a letter and a following mark, so a text's ids are those of its
    chunks one after the other, and a chunk's those of its word and its marks.
    New words of letters go to the library many at a time: each ends with the
    only token that has the vocabulary's word end, which parts the ids again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Latin letters that lower-casing and composition leave single letters
        letters = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
        # and ASCII marks but the apostrophe, which begins a piece of its own
        self.parts = re.compile(letters + r"(?=[!-&(-/:-@\[-`{-~]|$)|.+", re.DOTALL)
        self.word = re.compile(letters)
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix")
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _one_by_one(self, new: list[str]) -> None:
        for u, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
            self.words[u] = np.array(e.ids, "<u4").tobytes()

    def _learn_words(self, new: set[str]) -> None:
        plain = [w for w in new if self.word.fullmatch(w)] if self.ends.any() else []
        self._one_by_one(list(new.difference(plain)))
        for lo in range(0, len(plain), JOINED):
            part = plain[lo:lo + JOINED]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(part) or end[-1] != len(ids):
                self._one_by_one(part)
                continue
            raw, at = ids.tobytes(), [0, *(4 * end).tolist()]
            self.words.update((w, raw[x:y]) for w, x, y in zip(part, at, at[1:]))

    def learn(self, new: set[str]) -> dict[str, bytes]:
        parts = {c: self.parts.findall(c) for c in new}
        words = set().union(*parts.values())
        if len(self.words) + len(words) > CACHE_ENTRIES // 2:
            self.words.clear()
        self._learn_words(words.difference(self.words))
        get = self.words.__getitem__
        out = {c: get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for c, p in parts.items()}
        self.chunks.update(out)
        return out

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        every = list(set().union(*cut))
        here = dict(zip(every, map(self.chunks.get, every)))  # small, so that most look-ups stay near
        new = {c for c, ids in here.items() if ids is None}
        if new:
            if len(self.chunks) + len(new) > CACHE_ENTRIES:
                self.chunks.clear()
            here.update(self.learn(new))
        get, last = here.__getitem__, np.array([end], "<u4").tobytes()
        return [b"".join(map(get, c)) + last for c in cut]


def cut_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 1,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = worker_cache(f"words:{tokenizer_path}", lambda: WordIds(tokenizer_path))
        for b, texts in text_slices(batches, text_col):
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(voc.encode(texts, end_id)):
                for p, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at:at + 4 * max_len]
                    row.append(k), piece.append(p), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                [id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _enumerate(lengths: np.ndarray, max_len: int) -> np.ndarray:
    """Patterns (rows of three lengths, 0: none) of present lengths that fill a sequence exactly."""
    there = np.zeros(max_len + 1, bool)
    there[lengths] = True
    a = lengths[lengths * 2 >= max_len]
    a = a[(a < max_len)]
    pairs = a[there[max_len - a]]
    out = [np.stack([pairs, max_len - pairs, 0 * pairs], 1)]
    n = len(lengths)
    step = max(1, int(np.ceil(n * n / 6 / FIT_PATTERNS)))  # a regular grid of triples
    i, j = np.triu_indices(n) if n <= 300 else (None, None)
    if i is None:
        flat = np.arange(0, n * n, step)
        i, j = flat // n, flat % n
    x, y = lengths[i], lengths[j]
    z = max_len - x - y
    ok = (x <= y) & (y <= z)
    x, y, z = x[ok], y[ok], z[ok]
    ok = there[z]
    out.append(np.stack([z[ok], y[ok], x[ok]], 1))
    return np.concatenate(out)[:FIT_PATTERNS * 2]


def fit_repeats(patterns: np.ndarray, hist: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by multiplicative updates."""
    used = (patterns > 0).astype(float)
    want = (hist[patterns] * used).sum(1)
    x = np.full(len(patterns), max(1.0, hist.sum() / 3 / max(1, len(patterns))))
    for _ in range(rounds):
        got = np.bincount(patterns.ravel(), (x[:, None] * used).ravel(), len(hist))
        x *= want / np.maximum((got[patterns] * used).sum(1), 1e-12)
    return x


def plan_sequences(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how often)] that uses up all counts."""
    hist = np.zeros(max_len + 1, np.int64)
    for k, n in counts.items():
        hist[k] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if hist[max_len]:
        plan.append(((max_len,), int(hist[max_len])))
        hist[max_len] = 0
    lengths = np.flatnonzero(hist)
    patterns = _enumerate(lengths, max_len) if len(lengths) else np.zeros((0, 3), int)
    if len(patterns):
        x = fit_repeats(patterns, hist.astype(float))
        for k in np.argsort(-x, kind="stable"):
            n = int(x[k] + 0.5)
            if n < 1:
                break
            parts = [int(v) for v in patterns[k] if v]
            n = min([n] + [int(hist[v]) // parts.count(v) for v in parts])
            if n > 0:
                for v in parts:
                    hist[v] -= n
                plan.append((tuple(parts), n))
    left = [int(v) for v in np.flatnonzero(hist)]  # ascending; emptied lengths are skipped by bisection on a fresh list
    import bisect

    while left:
        space, parts, free = max_len, [], {}
        hi = len(left)
        while space > 0:
            hi = bisect.bisect_right(left, space, 0, hi)
            while hi and free.get(left[hi - 1], int(hist[left[hi - 1]])) == 0:
                hi -= 1
            if not hi:
                break
            v = left[hi - 1]
            have = free.get(v, int(hist[v]))
            n = min(have, space // v)
            parts += [v] * n
            free[v] = have - n
            space -= n * v
        n = min(int(hist[v]) // parts.count(v) for v in free)
        for v in free:
            hist[v] -= n * parts.count(v)
        plan.append((tuple(parts), n))
        gone = {v for v in free if hist[v] == 0}
        if gone:
            left = [v for v in left if v not in gone]
    return plan


def pack_pieces(pieces: DataFrame, max_len: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces of given length (read from a written table)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_sequences(counts, max_len)

    lengths = np.array(sorted(counts), np.int64)
    before = dict(zip(lengths.tolist(), np.concatenate([[0], np.cumsum([counts[v] for v in lengths.tolist()])])[:-1].tolist() if len(lengths) else []))
    taken, seq, ranges = dict(before), 0, []
    for parts, n in plan:
        at = 0
        for v in dict.fromkeys(parts):
            c = parts.count(v)
            ranges.append((taken[v], c, v, seq, at))
            taken[v] += c * n
            at += c * v
        seq += n
    ranges = np.array(sorted(ranges), np.int64).reshape(-1, 5)

    # rank among equal lengths: row numbers in salted parts of a length, plus the parts before
    part_rows = max(256, sum(counts.values()) // 4096)
    salts = spark.createDataFrame([(int(v), int(-(-n // part_rows))) for v, n in counts.items()], "length bigint, salts bigint")
    # rows with equal keys go on by their checksum, so that no salt holds one repeated row only
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), "salts"))
    sizes = sorted((r["length"], r["salt"], r["n"]) for r in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    bases, run = [], {}
    for v, s, n in sizes:
        bases.append((v, s, before[v] + run.get(v, 0)))
        run[v] = run.get(v, 0) + n
    bases = spark.createDataFrame(bases, "length bigint, salt bigint, base bigint")
    order = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "start")
    placed = salted.join(F.broadcast(bases), ["length", "salt"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.row_number().over(order) - 1).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = ranges[np.searchsorted(ranges[:, 0], b["rank"].to_numpy(), side="right") - 1] if len(b) else ranges[:0]
            nth = b["rank"].to_numpy() - r[:, 0]
            yield b.drop(columns="rank").assign(sequence_id=r[:, 3] + nth // r[:, 1], offset=r[:, 4] + nth % r[:, 1] * r[:, 2])

    kind = pieces.schema[id_col].dataType.simpleString()
    return placed.mapInPandas(place, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 1,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stage(cut_documents(docs, tokenizer_path, max_len, end_id, id_col, text_col), "pieces")
    return pack_pieces(pieces, max_len, id_col)
