"""A pair of Bloom filters, for keys seen once and seen twice, over all partitions.

Every partition reports, block by block, the bits it has set once and those it has set twice. A bit that
two partitions have set, or one has set twice, is twice-seen. Different keys that share bits add false
suspects and never hide a repeat. The twice-seen filter has at most ``MAX_BITS`` bits; beyond the keys
that these serve well, more keys are suspected, and callers confirm all suspects exactly anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_BITS, MAX_BITS = 1 << 20, 1 << 30  # the largest filter has 128 MB
BLOCK_BITS = 1 << 16
N_HASHES = 2


def filter_bits(n_keys: int, bits_per_key: int) -> int:
    """A power of two, at least bits_per_key for each key, within MIN_BITS and MAX_BITS."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, n_keys * bits_per_key - 1).bit_length()))


def places(h: np.ndarray, n_bits: int) -> np.ndarray:
    """Places in the filter of 64-bit hashes, a row for each."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(n_bits - 1) for i in range(N_HASHES)], axis=1)


def suspected(bits: np.ndarray, h: np.ndarray, n_bits: int) -> np.ndarray:
    """Which hashes have all their bits in the filter."""
    at = places(h, n_bits)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _report(n_bits: int, hashes_of: Callable[[list], np.ndarray]):
    schema = pa.schema([("block", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        again: list[np.ndarray] = []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            u, c = np.unique(np.concatenate(seen or [np.empty(0, np.uint64)]), return_counts=True)
            two = np.unique(np.concatenate([u[c > 1], *again]))
            seen[:], again[:] = [u], [two]
            return u, two

        for b in batches:
            texts = b.column(0)
            for at in range(0, len(texts), 1024):
                h = hashes_of(texts.slice(at, 1024).to_pylist())
                if len(h):
                    u, c = np.unique(places(h, n_bits), return_counts=True)
                    seen.append(u)
                    again.append(u[c > 1])
            if len(seen) > 64:
                fold()
        u, two = fold()
        names, starts = np.unique(u // np.uint64(BLOCK_BITS), return_index=True)
        ends = np.append(starts[1:], len(u))
        edges = lambda x, k: np.searchsorted(x, (names + np.uint64(k)) * np.uint64(BLOCK_BITS))
        low = lambda x: (x % np.uint64(BLOCK_BITS)).astype("<u2").tobytes()
        t0, t1 = edges(two, 0), edges(two, 1)
        for a in range(0, len(names), 4096):
            z = slice(a, a + 4096)
            yield pa.record_batch([
                pa.array(names[z].astype(np.int64)),
                pa.array([low(u[s:e]) for s, e in zip(starts[z], ends[z], strict=True)], pa.binary()),
                pa.array([low(two[s:e]) for s, e in zip(t0[z], t1[z], strict=True)], pa.binary()),
            ], schema=schema)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of block: the twice-seen bits of each block."""
    schema = pa.schema([("block", pa.int64()), ("twice", pa.binary())])
    block, count = None, np.zeros(BLOCK_BITS, np.uint8)

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], schema=schema)

    for b in batches:
        for k, once, twice in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != block:
                if block is not None and (count > 1).any():
                    yield out()
                block, count = k, np.zeros(BLOCK_BITS, np.uint8)
            o = np.frombuffer(once, "<u2")
            count[o] = np.minimum(count[o] + 1, 2)
            count[np.frombuffer(twice, "<u2")] = 2
    if block is not None and (count > 1).any():
        yield out()


def twice_seen(texts: DataFrame, n_bits: int, hashes_of: Callable[[list], np.ndarray]) -> bytes:
    """The twice-seen filter of the keys that hashes_of finds in the values of a one-column table; n_bits / 8 bytes."""
    rows = texts.mapInArrow(_report(n_bits, hashes_of), "block long, once binary, twice binary")
    parts = max(1, min(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bits // BLOCK_BITS))
    merged = rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_merge, "block long, twice binary").toArrow()
    whole = np.zeros(n_bits // 8, np.uint8)
    for batch in merged.to_batches():
        for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            whole[k * (BLOCK_BITS // 8) : (k + 1) * (BLOCK_BITS // 8)] = np.frombuffer(bits, np.uint8)
    return whole.tobytes()
