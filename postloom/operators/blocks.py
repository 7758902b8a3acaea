"""Rows packed into blocks, so that joins by the strings of a list column move each string of a block once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Arrow bytes of a block's rows. A worker holds a block and its unpacked copy.
BLOCK_BYTES = 16 * 1024 * 1024
PACKED = "forms array<string>, rows binary"


def packed(df: DataFrame, lists: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of rows: the distinct strings of the column ``lists``, and the rows, compressed.

    In the rows, numbers stand for the strings. A block holds rows of one task, in their order.
    """
    place = df.columns.index(lists)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            step = max(1, batch.num_rows * block_bytes // max(batch.nbytes, 1))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                held.append(part)
                size += part.nbytes
                if size >= block_bytes:
                    yield _block(held, place)
                    held, size = [], 0
        if held:
            yield _block(held, place)

    return df.toDF(*_plain_names(df.schema)).mapInArrow(pack, PACKED)


def unpacked(blocks: DataFrame, schema: T.StructType, lists: str) -> DataFrame:
    """The rows of ``packed`` blocks, with other strings in the column ``lists``.

    The column ``found`` of a block has pairs of a place among its forms and the string to set there.
    """
    place = schema.names.index(lists)
    names = _plain_names(schema)
    fields = [T.StructField(n, f.dataType, f.nullable, f.metadata) for n, f in zip(names, schema, strict=True)]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for forms, rows, found in zip(*batch.columns, strict=True):
                with pa.ipc.open_stream(rows.as_buffer()) as stream:
                    part = stream.read_next_batch()
                strings = _replaced(forms.values, found.values) if found.is_valid else forms.values
                codes = part.column(place)
                yield part.set_column(place, names[place], _lists_like(codes, strings.take(codes.flatten())))

    rows = blocks.select("forms", "rows", "found").mapInArrow(unpack, T.StructType(fields))
    return rows.toDF(*schema.names)


def _plain_names(schema: T.StructType) -> list[str]:
    return [f"c{i}" for i in range(len(schema))]


def _block(parts: list[pa.RecordBatch], place: int) -> pa.RecordBatch:
    batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    lists = batch.column(place)
    coded = lists.flatten().dictionary_encode()
    batch = batch.set_column(place, batch.schema.names[place], _lists_like(lists, coded.indices))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    forms = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    rows = pa.array([sink.getvalue().to_pybytes()], pa.binary())
    return pa.RecordBatch.from_arrays([forms, rows], ["forms", "rows"])


def _replaced(strings: pa.Array, found: pa.StructArray) -> pa.Array:
    at, new = (found.field(i) for i in range(2))
    order = pc.sort_indices(at)
    mask = np.zeros(len(strings), bool)
    mask[at.to_numpy()] = True
    return pc.replace_with_mask(strings, pa.array(mask), new.take(order))


def _lists_like(lists: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` in lists as long as those of ``lists``, null where those are."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null())
