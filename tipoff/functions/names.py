"""Fuzzy name scores: Indel similarity of sorted tokens, the one function that SQL lacks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: White space as str.split() has it (fixed values).
SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sorted_tokens(name: Column | str) -> Column:
    """Tokens in code point order, joined by blanks."""
    tokens = F.filter(F.split(F.col(name) if isinstance(name, str) else name, SPACE), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def common_subsequences(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences, pair by pair.

    Bits of a word stand for the characters of one name; each character of the other moves
    all of them by an addition. Pairs go through the steps together; names of over 64
    characters go one by one, on long integers.
    """
    out = np.zeros(len(left), np.int64)
    short = [k for k, a in enumerate(left) if 0 < len(a) <= 64 and right[k]]
    for k in set(range(len(left))) - set(short):
        out[k] = _long(left[k], right[k])
    for at in range(0, len(short), 4096):
        some = short[at : at + 4096]
        a, b = (_codes([side[k] for k in some]) for side in (left, right))
        bits = np.uint64(1) << np.arange(a.shape[1], dtype=np.uint64)
        state = np.full(len(some), ~np.uint64(0))
        for j in range(b.shape[1]):  # past its end, a name has a code that no other has
            same = np.where(a == b[:, j, None], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64) & state
            state = (state + same) | (state - same)
        out[some] = (~state[:, None] & np.where(a >= 0, bits, np.uint64(0)) != 0).sum(axis=1)
    return out


def _codes(names: list[str]) -> np.ndarray:
    out = np.full((len(names), max(map(len, names))), -1, np.int64)
    for k, name in enumerate(names):
        out[k, : len(name)] = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _long(a: str, b: str) -> int:
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    state = full
    for x in b:
        same = state & places.get(x, 0)
        state = (state + same | state - same) & full
    return len(a) - state.bit_count()


def token_sort_score(a: str | None, b: str | None) -> float | None:
    """0 to 100; two names without tokens are equal."""
    if a is None or b is None:
        return None
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return float(indel_scores([a], [b])[0])


def indel_scores(left: list[str], right: list[str]) -> np.ndarray:
    """200 x common length / sum of lengths, 100 for two empty names."""
    total = np.array([len(a) + len(b) for a, b in zip(left, right)], dtype=np.float64)
    return np.where(total == 0, 100.0, 200.0 * common_subsequences(left, right) / np.maximum(total, 1))


@F.arrow_udf(DoubleType())
def indel_score(left: pa.Array, right: pa.Array) -> pa.Array:
    """Of names whose tokens are sorted; null if either is null."""
    a, b = left.to_pylist(), right.to_pylist()
    known = np.array([x is not None and y is not None for x, y in zip(a, b)], dtype=bool)
    scores = np.zeros(len(a))
    if known.any():
        scores[known] = indel_scores([x for x, k in zip(a, known) if k], [y for y, k in zip(b, known) if k])
    return pa.array(scores, mask=~known)
