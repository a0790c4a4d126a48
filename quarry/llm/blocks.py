"""Tables in files of so many rows each, for tasks that read a whole table block by block.

A block is the unit that goes to all tasks: its size is bounded, and a task holds one at a time.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from quarry.llm._common import staged
from quarry.llm.warc import open_shared


def save_blocks(df: DataFrame, folder: str, rows: int) -> list[str]:
    """Writes df to files of at most rows rows in the shared folder; returns their names, one a file.

    Files of lost or repeated tasks are named by no row, so they are not read.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def write(table: pa.Table) -> pa.RecordBatch:
            name, out = f"{uuid.uuid4().hex}.parquet", io.BytesIO()
            pq.write_table(table, out)
            with open_shared(f"{folder}/{name}", "wb") as f:
                f.write(out.getvalue())
            return pa.RecordBatch.from_pydict({"name": [name]})

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                yield write(table.slice(0, rows))
                held = table.slice(rows).to_batches()
        if sum(b.num_rows for b in held):
            yield write(pa.Table.from_batches(held))

    return [r["name"] for r in staged(df.mapInArrow(save, "name string"), "blocks").collect()]


def read_block(folder: str, name: str) -> pa.Table:
    with open_shared(f"{folder}/{name}", "rb") as f:
        return pq.read_table(io.BytesIO(f.read())).combine_chunks()
