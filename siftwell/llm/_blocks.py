"""Documents packed into blocks: one row holds many texts, so later passes read the same groups again without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siftwell.llm._store import LARGE_ROWS, written


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_table(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def text_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, docs): the rows in blocks of about block_bytes, written, so that block numbers stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        part = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_pydict({"block": pa.array([part + number], pa.int64()), "docs": pa.array([pack_table(table)], pa.binary())})

        for batch in batches:
            step = max(1, int(batch.num_rows * block_bytes / 4 / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                size += held[-1].nbytes
                if size >= block_bytes:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    return written(rows.mapInArrow(run, "block long, docs binary"), "blocks", LARGE_ROWS)
