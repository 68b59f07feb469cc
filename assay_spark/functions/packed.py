"""Rows of one group as one row of bytes, for tables that are stored or shuffled.

A packed row holds rows of one group and vector length among some BATCH_BYTES
of a partition: the other columns as arrays, the vectors as one matrix, either its
doubles or, where that is smaller, its distinct doubles and a compressed number
of one or two bytes for each entry.  Packing is lossless: bits, nulls and
repeated rows come back as they were, in any order.
"""

from __future__ import annotations

import zlib
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BATCH_BYTES = 32 << 20  # of rows that are packed at once
CODES = 1 << 16  # most distinct values that have numbers


def _ddl(df: DataFrame, names: Sequence[str], wrap: str = "{}") -> list:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{c}` {wrap.format(types[c])}" for c in names]


def _group_numbers(columns, n: int):
    """One number per row, equal where all columns are (nulls are equal)."""
    import numpy as np
    import pyarrow.compute as pc

    code = np.zeros(n, dtype=np.int64)
    for c in columns:
        at = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy().astype(np.int64)
        code = np.unique(code * (at.max() + 1) + at, return_inverse=True)[1]
    return code


def _entries_packed(flat) -> tuple[bytes, bytes | None]:
    import numpy as np
    import pyarrow as pa

    bits = pa.array(flat.view(np.int64))  # by bits: -0.0 is not 0.0
    first = bits.slice(0, 2 * CODES).dictionary_encode()
    if len(first.dictionary) <= CODES:  # else all of them are too many as well
        coded = first if len(first) == len(bits) else bits.dictionary_encode()
        values, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if len(values) <= CODES:
            packed = zlib.compress(at.astype(np.uint8 if len(values) <= 1 << 8 else np.uint16).tobytes(), 1)
            if values.nbytes + len(packed) < flat.nbytes:
                return values.tobytes(), packed
    return flat.tobytes(), None


def entries(values: bytes, coded: bytes | None):
    """The doubles of a packed row."""
    import numpy as np

    v = np.frombuffer(values) if values else np.zeros(0)
    return v if coded is None else v[np.frombuffer(zlib.decompress(coded), np.uint8 if len(v) <= 1 << 8 else np.uint16)]


def pack(df: DataFrame, keys: Sequence[str], vec: str, rest: Sequence[str]) -> DataFrame:
    """(keys, rest as arrays, _w, _v, _at, _no): ``_w`` is the length of the
    vectors, -1 if they are null, ``_no`` marks null entries, if there are any.
    Rows are packed where they lie; nothing is shuffled."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys, rest = list(keys), list(rest)
    schema = ", ".join([*_ddl(df, keys), *_ddl(df, rest, "array<{}>"), "_w int", "_v binary", "_at binary", "_no binary"])

    most = BATCH_BYTES

    def gathered(batches):
        held, size = [], 0
        for b in batches:
            held, size = [*held, b], size + b.nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()

    def packed(batches):
        for b in (b for some in gathered(batches) for b in some):
            if not b.num_rows:
                continue
            width = pc.fill_null(pc.list_value_length(b.column(vec)), -1).cast(pa.int32())
            code = _group_numbers([*(b.column(c) for c in keys), width], b.num_rows)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            ends = np.r_[starts[1:], len(order)]
            b, width = b.take(pa.array(order)), width.to_numpy()[order[starts]]
            flat = b.column(vec).flatten()
            no = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
            flat = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), dtype=float)
            at, made = 0, []
            for lo, hi, w in zip(starts, ends, width):
                to = at + int(hi - lo) * max(int(w), 0)
                gone = None if no is None or not no[at:to].any() else np.packbits(no[at:to]).tobytes()
                made.append((*_entries_packed(flat[at:to]), gone))
                at = to
            offsets = pa.array(np.r_[starts, len(order)], pa.int32())
            cols = [b.column(c).take(pa.array(starts)) for c in keys]
            cols += [pa.ListArray.from_arrays(offsets, b.column(c)) for c in rest]
            cols += [pa.array(width, pa.int32()), *(pa.array(list(m), pa.binary()) for m in zip(*made))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *rest, "_w", "_v", "_at", "_no"])

    return df.select(*keys, *rest, vec).mapInArrow(packed, schema)


def unpack(df: DataFrame, like: DataFrame, keys: Sequence[str], vec: str, rest: Sequence[str]) -> DataFrame:
    """The rows that ``pack`` was given, with ``like``'s columns."""
    import numpy as np
    import pyarrow as pa

    keys, rest, names = list(keys), list(rest), like.columns
    schema = ", ".join(_ddl(like, names))

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = {c: b.column(c)[i] for c in b.schema.names}
                w, n = one["_w"].as_py(), len(one[rest[0]].values)
                cols = {c: pa.repeat(one[c], n) for c in keys} | {c: one[c].values for c in rest}
                if w < 0:
                    cols[vec] = pa.nulls(n, pa.list_(pa.float64()))
                else:
                    flat, no = entries(one["_v"].as_py(), one["_at"].as_py()), one["_no"].as_py()
                    mask = None if no is None else np.unpackbits(np.frombuffer(no, np.uint8))[:len(flat)].astype(bool)
                    cols[vec] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(flat, pa.float64(), mask=mask))
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return df.mapInArrow(rows, schema)


def without_vectors(df: DataFrame, keys: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """The keys and other columns of the rows that were packed."""
    return df.select(*keys, F.inline(F.arrays_zip(*rest)))


def column(packed, name: str):
    """A column of a pandas frame of packed rows, in its order; nulls become NaN."""
    import numpy as np

    flat = np.concatenate(packed[name].to_numpy())
    return flat.astype(float) if flat.dtype == object else flat


def matrix(packed, n: int):
    """The ``n`` vectors of a pandas frame of packed rows, in its order."""
    import numpy as np

    width = packed["_w"].iat[0]
    if width < 0 or (packed["_w"] != width).any():
        raise ValueError("vectors are null or of unequal length: impute them first")
    return np.concatenate([entries(v, a) for v, a in zip(packed["_v"], packed["_at"])]).reshape(n, width)
