"""Variants of the test tables: empty ones, and ones with repeated rows and rows of nulls."""

from __future__ import annotations

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq


def make(src: str, dst: str, kind: str) -> str:
    os.makedirs(dst, exist_ok=True)
    for p in glob.glob(f"{src}/*.parquet"):
        t = pq.read_table(p)
        if kind == "empty":
            t = t.slice(0, 0)
        else:
            nulls = pa.table({f.name: pa.nulls(3, f.type) for f in t.schema}, schema=pa.schema([f.with_nullable(True) for f in t.schema]))
            t = pa.concat_tables([t.cast(nulls.schema), nulls, t.slice(0, max(1, len(t) // 3)).cast(nulls.schema)])
        pq.write_table(t, f"{dst}/{os.path.basename(p)}")
    return dst


if __name__ == "__main__":
    import sys

    make(*sys.argv[1:4])
