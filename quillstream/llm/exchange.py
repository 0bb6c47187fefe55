"""Exchanges of packed arrays: one row for each (sender, bucket) in place of one for each key.

Keys that a task counts or asks for travel sorted, as byte planes, so that a shuffle
moves a few bytes a key and the JVM sees few rows. Buckets are ranges of hashes, so
no key, however common, makes a bucket large: a sender names a key once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Most partitions of an exchange; above it a partition holds several buckets, one after another.
PARTITIONS = 1 << 14


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; ascending with the hash."""
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def by_bucket(df: DataFrame, buckets: int, *then: str) -> DataFrame:
    """Rows with the same `b` in one partition, sorted by it (and by `then`)."""
    parts = min(buckets, PARTITIONS)
    return df.repartitionById(parts, F.pmod(F.col("b"), F.lit(parts)).cast("int")).sortWithinPartitions("b", *then)


def runs(batches, key: str) -> Iterator[list[dict]]:
    """The rows of each run of equal keys, across batches."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            if held and held[-1][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as byte planes, each no wider than its largest value needs."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        wide = (int(a.max(initial=0)).bit_length() + 7) // 8
        out.append(np.array([len(a), wide], "<u8").tobytes())
        out.append(a.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())
    return b"".join(out)


def unpack(data: bytes | memoryview) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, wide = np.frombuffer(data, "<u8", 2, at).astype(np.int64).tolist()
        planes = np.frombuffer(data, np.uint8, n * wide, at + 16).reshape(wide, n)
        a = np.zeros((n, 8), np.uint8)
        a[:, :wide] = planes.T
        out.append(a.view("<u8").reshape(-1))
        at += 16 + n * wide
    return out


def blob(row: dict, name: str = "body") -> memoryview:
    return memoryview(row[name].as_buffer())


def rows_of(fields: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in fields.values()], names=list(fields))
