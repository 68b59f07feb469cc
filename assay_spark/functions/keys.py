"""Deterministic draw keys.

Every sampler orders rows by an md5 key of (id, salt..., seed) instead of
``rand()``, so a draw is the same on every run, partition count and engine.
The DuckDB twin of ``draw_key``/``key_int`` is::

    md5(concat_ws('|', CAST(id AS VARCHAR), ..., '<seed>'))
    ('0x' || substr(k, 1, 15))::BIGINT

``draw_ints`` is the numpy twin, for tasks that need many draws of one row.
``generators`` are numpy's own, for many rows that have one each.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hex digits = 60 bits: a non-negative bigint, ties rare even at 1e11 rows.
KEY_HEX = 15
KEY_BITS = 4 * KEY_HEX


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def draw_key(*parts, seed: int) -> Column:
    """md5 hex of the parts joined with '|', seed last.  Parts must be
    integer or string columns (double text differs between engines)."""
    cols = [_c(p).cast("string") for p in parts] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *cols))


def key_int(key: Column) -> Column:
    """First 60 bits of an md5 hex key as a non-negative bigint."""
    return F.conv(F.substring(key, 1, KEY_HEX), 16, 10).cast("bigint")


def draw_int(*parts, seed: int) -> Column:
    return key_int(draw_key(*parts, seed=seed))


def permuted(pos: Column, n: Column, *parts, seed: int, rounds: int = 24) -> Column:
    """Where a keyed permutation of 0..n-1 puts ``pos``, for any n.

    Swap-or-not rounds: x and (k - x) mod n are partners, and a keyed bit of the
    larger of them says whether both change places.  Every round is its own
    inverse, so distinct places stay distinct; no place is looked up or stored.
    """
    def swap(x: Column, i: Column) -> Column:
        partner = F.pmod(draw_int(*parts, i, seed=seed) - x, n)
        flip = draw_int(*parts, i, F.greatest(x, partner), seed=seed + 1) % 2 == 1
        return F.when(flip, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), pos.cast("bigint"), swap)


def uniform(*parts, seed: int) -> Column:
    """A repeatable uniform in [0, 1) from the draw key."""
    return draw_int(*parts, seed=seed) / F.lit(float(2 ** KEY_BITS))


# ---------------------------------------------------------------- many draws of one row (RFC 1321)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_STEPS = ((1, 0), (5, 1), (3, 5), (7, 0))  # which word each step of a round adds
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]


def _texts(texts: Sequence[bytes], at: int, size: int):
    """Texts of one length as rows of ``size`` bytes, from byte ``at`` on."""
    import numpy as np

    out = np.zeros((len(texts), size), np.uint8)
    n = len(texts[0])
    out[:, at:at + n] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), n)
    return out


def draw_ints(left: Sequence[bytes], right: Sequence[bytes]):
    """``key_int`` of the md5 of every left text followed by every right one:
    a uint64 table.  All left texts have one length, all right ones as well."""
    import numpy as np

    n, m = len(left[0]), len(left[0]) + len(right[0])
    size = -(-(m + 9) // 64) * 64
    tail = _texts(right, n, size)
    tail[:, m] = 0x80
    tail[:, size - 8:] = np.frombuffer((8 * m).to_bytes(8, "little"), np.uint8)
    head, tail = (np.ascontiguousarray(t.view("<u4").T) for t in (_texts(left, 0, size), tail))
    # a word of left or of right text alone is one row or one column of the table
    words = [h[:, None] if 4 * w + 4 <= n else t if 4 * w >= n else h[:, None] | t
             for w, (h, t) in enumerate(zip(head, tail))]
    shape = (len(left), len(right))
    state, spare = [np.full(shape, v, np.uint32) for v in _START], np.empty(shape, np.uint32)
    for block in range(0, len(words), 16):
        (a, b, c, d), f = (v.copy() for v in state), np.empty(shape, np.uint32)
        for i in range(64):
            r = i // 16
            if r < 2:  # the bits of x where z is set, those of y elsewhere
                x, y, z = (c, d, b) if r == 0 else (b, c, d)
                np.bitwise_xor(x, y, out=f)
                f &= z
                f ^= y
            elif r == 2:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.bitwise_not(d, out=f)
                f |= b
                f ^= c
            f += a
            f += words[block + (_STEPS[r][0] * i + _STEPS[r][1]) % 16] + np.uint32(_SINES[i])
            turn = _TURNS[r][i % 4]
            np.left_shift(f, np.uint32(turn), out=spare)
            f >>= np.uint32(32 - turn)
            f |= spare
            f += b
            a, b, c, d, f = d, f, b, c, a
        for v, w in zip(state, (a, b, c, d)):
            v += w
    first, second = (v.byteswap().astype(np.uint64) for v in state[:2])
    return (first << np.uint64(32) | second) >> np.uint64(64 - KEY_BITS)


# ---------------------------------------------------------------- one numpy generator per row
_POOL, _WORD = 4, 0xFFFFFFFF


def _hashes(start: int, factor: int):
    """The successive hashes of numpy's ``SeedSequence``, over arrays of 32-bit words."""
    import numpy as np

    const = start

    def hashed(x):
        nonlocal const
        x = x ^ np.uint32(const)
        const = const * factor & _WORD
        x = x * np.uint32(const)
        return x ^ (x >> np.uint32(16))

    return hashed


def seed_words(entropy: Sequence):
    """Rows of the four 64-bit words that ``SeedSequence`` of each row's
    ``entropy`` gives to a generator: arrays of 32-bit words, one for each place,
    or single ones that all rows share."""
    import numpy as np

    words = [w.astype(np.uint32) for w in np.broadcast_arrays(*entropy)]
    hashed = _hashes(0x43B0D7E5, 0x931E8875)

    def mix(x, y):
        z = x * np.uint32(0xCA01F9DD) - y * np.uint32(0x4973F715)
        return z ^ (z >> np.uint32(16))

    none = np.zeros_like(words[0])
    pool = [hashed(words[i] if i < len(words) else none) for i in range(_POOL)]
    for src in range(_POOL):
        for dst in range(_POOL):
            if src != dst:
                pool[dst] = mix(pool[dst], hashed(pool[src]))
    for w in words[_POOL:]:
        for dst in range(_POOL):
            pool[dst] = mix(pool[dst], hashed(w))
    hashed = _hashes(0x8B51F9DD, 0x58F38DED)
    out = np.stack([hashed(pool[i % _POOL]) for i in range(2 * _POOL)], axis=1)
    return np.ascontiguousarray(out).view("<u8").astype(np.uint64)


def generators(entropy: Sequence):
    """``numpy.random.default_rng`` of each row's ``entropy``, given as for
    ``seed_words``: the words of all rows are hashed at once."""
    import numpy as np
    from numpy.random.bit_generator import ISeedSequence

    class Words(ISeedSequence):
        def generate_state(self, n_words, dtype=np.uint32):
            return self.words

    at = Words()
    for at.words in seed_words(entropy):
        yield np.random.Generator(np.random.PCG64(at))
