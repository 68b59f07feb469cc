"""Operator 2: encoding and decoding with a merge-type piece vocabulary.

Method: adjacent symbol pairs whose concatenation is a piece go into an agenda
ordered by piece score (then by position); the best pair merges, its new
neighbours enter the agenda, until the agenda is empty.  Characters that are no
piece fall back to byte pieces.

No piece holds a space mark after another character, and none holds a newline
(both are checked when a vocabulary is loaded), so a merge never crosses such a
boundary and each unit between them is encoded once per worker and remembered.
Every unit is checked, in each Arrow batch in which a worker first meets it,
against the sentencepiece library; a difference raises.  ``check="texts"``
also checks every whole text.

Null texts count as empty; an empty text has the begin and end ids only.
Repeated rows give repeated results.  Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assay_spark.llm.common import CACHE_ENTRIES, text_slices, worker_cache

SPACE = "▁"


class PieceVocabulary:
    """Piece ids and scores of a merge-type model, with a cache of encoded units."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk, self.bos, self.eos = sp.unk_id(), sp.bos_id(), sp.eos_id()
        for p in self.ids:
            if SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n"):
                raise ValueError(f"piece {p!r} crosses a unit boundary; this vocabulary needs whole-text agendas")
        # marks that no piece has behind a letter end a word, so "word" and "word." share an entry
        marks = "".join(c for c in ".,;:!?|" if not any(re.search(f"[^\\W\\d_]{re.escape(c)}", p) for p in self.ids))
        word = f"{SPACE}*[^\\W\\d_]+(?![^{SPACE}\n{re.escape(marks)}])|" if marks else ""
        self.units = re.compile(f"\n|{word}{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        pairs = {(self.ids[p[:k]] * n + self.ids[p[k:]]): i for p, i in self.ids.items()
                 for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.n = n
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.pair_rank = np.array([-sp.get_score(int(i)) for i in self.pair_to])
        self.cache: dict[str, bytes] = {}

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit, its agenda a heap."""
        rank, sym, n = self.rank, list(unit), len(unit)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := unit[i:i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, p = heapq.heappop(agenda)
            j = nxt[i]
            if sym[i] is None or j >= n or sym[i] + sym[j] != p:
                continue  # one of its symbols has merged meanwhile
            sym[i], sym[j] = p, None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (q := p + sym[k]) in rank:
                    heapq.heappush(agenda, (rank[q], i, q))
            if (h := prv[i]) >= 0 and (q := sym[h] + p) in rank:
                heapq.heappush(agenda, (rank[q], h, q))
        out: list[int] = []
        for s in sym:
            if s is None:
                continue
            if s in self.ids:
                out.append(self.ids[s])
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unk)
        return out

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (inf: none) and piece of each adjacent pair."""
        code = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        hit = self.pair[at] == code
        return np.where(hit, self.pair_rank[at], np.inf), np.where(hit, self.pair_to[at], -1)

    def merge_many(self, units: list[str]) -> list[list[int]]:
        """Ids of many units; the agendas of units of one length are the rows of an array."""
        out: list = [None] * len(units)
        by_length: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            by_length.setdefault(len(u), []).append(k)
        for length, where in by_length.items():
            if length == 1 or length > 64 or not len(self.pair):
                for k in where:
                    out[k] = self.merge(units[k])
                continue
            row = np.array(where)
            sym = self.char_id[np.frombuffer("".join([units[k] for k in where]).encode("utf-32-le"), "<u4")].reshape(-1, length)
            odd = (sym < 0).any(axis=1)  # characters that are no piece
            for k in row[odd].tolist():
                out[k] = self.merge(units[k])
            row, sym = row[~odd], sym[~odd]
            rank, to = self._agenda(sym[:, :-1], sym[:, 1:])
            while len(row):
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), int)
                live = np.isfinite(rank[np.arange(len(row)), best]) if rank.shape[1] else np.zeros(len(row), bool)
                for k, ids in zip(row[~live].tolist(), sym[~live].tolist()):
                    out[k] = ids
                row, sym, rank, to, best = row[live], sym[live], rank[live], to[live], best[live]
                m, r = sym.shape[1], np.arange(len(row))
                if not len(row):
                    break
                sym[r, best] = to[r, best]
                keep = np.arange(m - 1) + (np.arange(m - 1) > best[:, None])
                sym = np.take_along_axis(sym, keep, 1)
                if m == 2:
                    rank, to = rank[:, :0], to[:, :0]
                    continue
                # the pair right of the merged one takes its place in the agenda
                keep = np.arange(m - 2) + (np.arange(m - 2) >= best[:, None])
                rank, to = np.take_along_axis(rank, keep, 1), np.take_along_axis(to, keep, 1)
                for at in (best - 1, best):
                    ok = (at >= 0) & (at < m - 2)
                    rr, aa = r[ok], at[ok]
                    rank[rr, aa], to[rr, aa] = self._agenda(sym[rr, aa], sym[rr, aa + 1])
        return out

    def learn(self, units: set[str]) -> None:
        """Encode new units and check them against the library."""
        if len(self.cache) + len(units) > CACHE_ENTRIES:
            self.cache.clear()
        new = list(units)
        ours = self.merge_many(new)
        # the library puts a space mark in front of each text
        theirs = self.sp.encode([u[1:] if u[0] == SPACE and len(u) > 1 else "\n" + u for u in new], num_threads=1)
        for u, a, b in zip(new, ours, theirs):
            if a != (b if u[0] == SPACE and len(u) > 1 else b[2:]):
                raise ValueError(f"unit {u!r}: {a} here, {b} in sentencepiece")
            self.cache[u] = np.array(a, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, begin and end included."""
        cut = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        cache = self.cache
        new = set().union(*cut).difference(cache)
        if new:
            before = len(cache)
            self.learn(new)
            if len(self.cache) < before + len(new):  # started anew: learn what went
                self.learn({u for units in cut for u in units if u not in self.cache})
        get, first, last = self.cache.__getitem__, np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        return [first + b"".join(map(get, units)) + last for units in cut]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  check: str = "units") -> DataFrame:
    """(id, ids array<int>, decoded string) of every text, begin and end ids included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, ids, decoded in _coded(batches, text_col, model_path, check):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  check: str = "units") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text: digests of ``encode_pieces``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, ids, decoded in _coded(batches, text_col, model_path, check):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _coded(batches, text_col, model_path, check):
    voc = worker_cache(f"pieces:{model_path}", lambda: PieceVocabulary(model_path))
    for b, texts in text_slices(batches, text_col):
        ids = voc.encode(texts)
        lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
        if check == "texts":
            for a, c in zip(lists, voc.sp.encode(texts, num_threads=1, add_bos=True, add_eos=True)):
                if a != c:
                    raise ValueError("a text's ids differ from sentencepiece")
        yield b, texts, ids, voc.sp.decode(lists)
