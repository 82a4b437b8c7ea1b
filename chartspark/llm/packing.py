"""Fixed-width tuples on their way through a shuffle: one compressed blob of sorted columns per task and bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

SCHEMA = "bucket int, kind int, n int, rows binary"
Columns = dict[str, np.ndarray]


def split48(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (values & np.uint64(0xFFFFFFFF)).astype("<u4"), (values >> np.uint64(32)).astype("<u2")


def join48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def pack(kind: int, types: dict[str, str], columns: Columns, buckets: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Blobs of ``columns`` by bucket; order within a bucket is kept.  48-bit columns have type ``u6``."""
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)])) if len(buckets) else np.zeros(1, np.int64)
    flat: list[np.ndarray] = []
    for name, kind_of in types.items():
        values = columns[name][order]
        flat += split48(values) if kind_of == "u6" else [values.astype(kind_of)]
    press = zstandard.ZstdCompressor(level=1)
    return [
        (int(buckets[a]), kind, b - a, press.compress(b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in flat))) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())
    ]


def unpack(table: pa.Table, kind: int, types: dict[str, str]) -> Columns:
    """All tuples of one kind."""
    press = zstandard.ZstdDecompressor()
    flat = [t for kind_of in types.values() for t in (("<u4", "<u2") if kind_of == "u6" else (kind_of,))]
    parts: list[list[np.ndarray]] = [[] for _ in flat]
    for k, n, blob in zip(table.column("kind").to_pylist(), table.column("n").to_pylist(), table.column("rows")):
        if k == kind:
            data, at = press.decompress(blob.as_buffer()), 0
            for column, t in zip(parts, flat):
                column.append(np.frombuffer(data, t, n, at))
                at += n * np.dtype(t).itemsize
    found = iter([np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, flat)])
    return {name: join48(next(found), next(found)) if kind_of == "u6" else next(found) for name, kind_of in types.items()}


def batch(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, (_, t) in enumerate(kinds)], names=[name for name, _ in kinds])


def taken(columns: Columns, which: np.ndarray) -> Columns:
    return {name: values[which] for name, values in columns.items()}


def stacked(parts: list[Columns]) -> Columns:
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
