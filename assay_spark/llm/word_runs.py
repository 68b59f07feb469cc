"""Operator 13: runs of periodic words by Baier grouping, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q, at least
``least`` words and ``exponent`` periods long, that neither neighbouring word
extends with the same period.  Within each text:

1. Words become numbers.  A word inside a run occurs ``exponent`` times in it at
   least, so rarer words separate the text into stretches that hold whole runs;
   the count is repeated within the stretches until nothing changes (this is
   exact: a separator neither lies in a run nor extends one).
2. Phase one of Baier's suffix sorter.  Suffixes stand in groups of one common
   prefix each, at first by word.  Groups are taken from the greatest to the
   smallest; each suffix of a group points to the nearest suffix before it that
   is in a smaller group, and the suffixes pointed to move to new groups just
   above their old one, those with more pointers higher, with the group's prefix
   appended once per pointer.  A group's prefix when it is taken is the longest
   Lyndon word that starts there: the Lyndon array, in linear time, without the
   suffix array.  It is computed under the order of the numbers and under the
   reverse order.
3. Every run has a Lyndon root at which one of the two arrays holds its period,
   and holds it again one period later when there are three periods or more.
   Each such place is extended to the left and right as far as words q apart
   are equal (longest common extension), which gives the run.

Words are what ``[^\\x20\\x09-\\x0D]+`` matches, numbered from 0.  Null, empty and
blank texts have no words and no runs; their collapsed text is empty.  Rows that
repeat are handled each for itself, ids are carried as they are (null too);
extra columns are not carried.  One text is the unit of work: its words are held
in memory by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay_spark.llm.common import text_slices

LEAST, EXPONENT = 6, 4


def lyndon_array(s: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place (phase one of Baier's suffix sorter)."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(s, kind="stable")
    cuts = np.flatnonzero(np.diff(s[order])) + 1
    members: list[list[int]] = [x.tolist() for x in np.split(order, cuts)]  # ascending places by group
    size = [1] * len(members)  # length of a group's prefix
    below = list(range(-1, len(members) - 1))  # the next smaller group
    group = np.repeat(np.arange(len(members)), [len(m) for m in members])[np.argsort(order, kind="stable")].tolist()
    before, after = list(range(-1, n)), list(range(1, n + 2))  # links of the places not yet taken; n is the end
    out = [1] * n
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    now = len(members) - 1
    while now >= 0:
        length, pointed = size[now], {}
        for i in members[now]:
            if group[i] != now:
                continue  # it has moved to a greater group
            out[i] = length
            # in ascending order, so smaller members of this group have left the links
            p, q = before[i], after[i]
            before[q] = p
            if p >= 0:
                after[p] = q
                pointed[p] = pointed.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, c in pointed.items():
            moved.setdefault((group[p], c), []).append(p)
        top: dict[int, int] = {}  # of an old group, the greatest new one so far
        for old, c in sorted(moved) if len(moved) > 1 else moved:
            low, new, places = top.get(old, old), len(members), moved[old, c]
            high = above[low]
            members.append(places)
            size.append(size[old] + c * length)
            below.append(low)
            above.append(high)
            above[low] = top[old] = new
            if high >= 0:
                below[high] = new
            for p in places:
                group[p] = new
        now = below[now]
    return np.array(out, np.int64)


def stretches(ids: np.ndarray, least: int, exponent: int) -> list[np.ndarray]:
    """Places of the stretches that can hold runs: at least ``least`` words, each ``exponent`` times in its stretch."""
    place = np.flatnonzero(np.bincount(ids)[ids] >= exponent) if len(ids) else ids
    while len(place) >= least:
        part = np.concatenate([[0], np.cumsum(np.diff(place) != 1)])
        _, at, n = np.unique(part * (int(ids.max()) + 1) + ids[place], return_inverse=True, return_counts=True)
        ok = (n[at] >= exponent) & (np.bincount(part)[part] >= least)
        if ok.all():
            return np.split(place, np.flatnonzero(np.diff(part)) + 1)
        place = place[ok]
    return []


def _extension(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two arrays of one length agree."""
    at, step = 0, 16
    while at < len(a):
        differ = a[at:at + step] != b[at:at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 4
    return len(a)


def stretch_runs(s: np.ndarray, least: int, exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch, from both Lyndon arrays."""
    found = set()
    for order in (s, s.max() - s):
        root = lyndon_array(order)
        place = np.arange(len(s))
        again = place + root
        ok = again < len(s)
        at = np.where(ok, again, 0)
        ok &= s[at] == s
        if exponent >= 3:
            ok &= root[at] == root
        end: dict[int, int] = {}  # by period, where the last extension stopped
        for i in np.flatnonzero(ok).tolist():
            q = int(root[i])
            if i + q < end.get(q, 0):
                continue  # the same extension
            right = i + q + _extension(s[i + q:], s[i:len(s) - q])
            left = i - _extension(s[:i][::-1], s[q:i + q][::-1])
            end[q] = right
            if right - left >= max(least, exponent * q):
                found.add((left, right - left, q))
    return found


def find_runs(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start and period."""
    if len(words) < least:
        return []
    number = dict.fromkeys(words)
    number.update(zip(number, range(len(number))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out = []
    for place in stretches(ids, least, exponent):
        s = np.unique(ids[place], return_inverse=True)[1]
        out += [(int(place[0]) + a, n, q) for a, n, q in stretch_runs(s, least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words less those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(id, runs array<struct<start, length, period>>, collapsed) of every whole text."""
    if exponent < 2:
        raise ValueError("a run has two periods or more")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b, texts in text_slices(batches, text_col):
            runs, kept = [], []
            for t in texts:
                words = t.encode().split()  # at ASCII white space
                found = find_runs(words, least, exponent)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(b" ".join(without_repeats(words, found)).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, row), pa.array(kept, pa.string())], [id_col, "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest_run(runs: Column) -> Column:
    """The run of greatest length / period; of equal ones the first by start and period; null without runs."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def runs_digest(runs: Column) -> Column:
    """SHA-256 of the runs as lines ``start,length,period``."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.sha2(F.array_join(F.transform(runs, line), "").cast("binary"), 256)


def echo_some(id_col: Column, text: Column) -> Column:
    """The text, or for ids whose crc32 is a multiple of 10 its words with the end replaced by a repeating block."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def echo(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.lit(""))

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t\n\x0B\f\r]+"), "")
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), echo), F.lit(0))).otherwise(text)
