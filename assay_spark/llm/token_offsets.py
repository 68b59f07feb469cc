"""Operator 10: token counts of a document's sections, from one encoding of the whole text.

Each whole text is encoded once; the character spans of its tokens are joined
to the spans of its sections by interval (both are sorted, so this is one
binary search per section).  Sections are the lines of a text, each with the
newline that ends it.  A token that crosses a boundary goes to one section by
``rule``: ``start`` (where its first character lies), ``end`` (its last), or
``majority`` (most of its bytes, the earlier one on a tie).

Null and empty texts have one empty section without tokens.  Repeated rows give
repeated results.  Other columns are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assay_spark.llm.common import CACHE_ENTRIES, text_slices, worker_cache

RULES = ("start", "end", "majority")


class TokenSpans:
    """Byte lengths of a text's tokens; pre-tokens are encoded once per worker."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, "<u4")
        for b, i in ranks.items():
            self.length[i] = len(b)
        self.cut = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def lengths(self, text: str) -> np.ndarray:
        """Bytes of each token of a text, in order."""
        words, cache = self.cut(text), self.cache
        for w in set(words).difference(cache):
            if len(cache) >= CACHE_ENTRIES:
                cache.clear()
                return self.lengths(text)
            cache[w] = self.length[self.encoding.encode_ordinary(w)].tobytes()
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), "<u4")


def attribute(lengths: np.ndarray, starts: np.ndarray, size: int, rule: str) -> np.ndarray:
    """Tokens of each section; ``starts``: first byte of each section, ``size``: bytes in all."""
    ends = np.cumsum(lengths, dtype=np.int64)
    first = np.searchsorted(starts, ends - lengths, side="right") - 1
    if rule != "start":
        last = np.searchsorted(starts, ends - 1, side="right") - 1
        if rule == "end":
            first = last
        else:
            edges = np.append(starts, size)
            for k in np.flatnonzero(first != last):
                over = np.arange(first[k], last[k] + 1)
                share = np.minimum(edges[over + 1], ends[k]) - np.maximum(edges[over], ends[k] - lengths[k])
                first[k] = over[share.argmax()]
    return np.bincount(first, minlength=len(starts))


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "start",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, start, n_chars, n_tokens): characters and tokens of every section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = worker_cache(f"spans:{ranks_path}:{pattern}", lambda: TokenSpans(ranks_path, pattern))
        for b, texts in text_slices(batches, text_col):
            row, section, start, chars, tokens = [], [], [], [], []
            for k, text in enumerate(texts):
                data = np.frombuffer(text.encode(), "u1")
                starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
                if len(starts) > 1 and starts[-1] == len(data):
                    starts = starts[:-1]  # a last newline opens no section
                chars_before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                at = chars_before[starts]
                row.append(np.full(len(starts), k))
                section.append(np.arange(len(starts)))
                start.append(at)
                chars.append(np.diff(np.append(at, chars_before[-1])))
                tokens.append(attribute(voc.lengths(text), starts, len(data), rule))
            cat = lambda x, t: pa.array(np.concatenate(x).astype(t))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(cat(row, "i8")), cat(section, "i4"), cat(start, "i8"), cat(chars, "i8"), cat(tokens, "i8")],
                [id_col, "section", "start", "n_chars", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, section int, start bigint, n_chars bigint, n_tokens bigint")
