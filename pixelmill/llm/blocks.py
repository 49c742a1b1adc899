"""Blocks of queries against every block of an index, in one plan.

A search compares a stated set of queries with all rows. Index rows are packed
into parts, parts are dealt to slots, and the packed queries are sent to every
slot once: a slot loads its few parts and streams the queries past them. What a
task holds is bounded by ``PARTS_PER_SLOT`` parts and one block of queries, and the
plan is the same for any number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of one packed row (part of the index, block of queries), at most.
PART_ROWS = 4096
QUERY_ROWS = 1024
PARTS_PER_SLOT = 4


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without nulls, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def packed(rows: DataFrame, keys: dict[str, type], rows_each: int) -> DataFrame:
    """(dim, n, ``keys``..., vectors): consecutive rows of equal dimension (columns
    ``dim``, ``v`` and ``keys``, sorted as they come) packed into little-endian
    arrays of up to ``rows_each`` rows. ``keys`` names the numpy type of each."""
    names = list(keys)
    schema = "dim int, n int, " + "".join(f"{k} binary, " for k in names) + "vectors binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, dim = 0, None

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([h[i] for h in held]) for i in range(len(names) + 1)]
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([size], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]],
                names=["dim", "n", *names, "vectors"])

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if held and (dims[a] != dim or size >= rows_each):
                        yield flush()
                        held, size = [], 0
                    dim, take = int(dims[a]), min(b - a, rows_each - size)
                    some = batch.slice(a, take)
                    held.append((*[some.column(k).to_numpy(zero_copy_only=False).astype(t) for k, t in keys.items()],
                                 matrix(some.column("v"))))
                    size, a = size + take, a + take
        if held:
            yield flush()

    return rows.select("dim", *names, "v").mapInArrow(run, schema)


def unpacked(row: dict, keys: dict[str, type]) -> tuple:
    """The arrays of a packed row: keys in order, then the vectors."""
    return (*[np.frombuffer(row[k], t) for k, t in keys.items()],
            np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"]))


def against_all(index: DataFrame, queries: DataFrame, load: Callable, search: Callable, schema: str) -> DataFrame:
    """Every row of ``queries`` (packed) against every row of ``index`` (packed,
    written): ``load`` turns the index rows of a slot (dicts) into what ``search``
    is given with a query row; it returns record batches of ``schema``."""
    parts = index.count()
    slots = max(1, -(-parts // PARTS_PER_SLOT))
    columns = sorted(set(index.columns) | set(queries.columns))

    def filled(df: DataFrame, kind: int) -> DataFrame:
        kinds = {f.name: f.dataType for f in [*index.schema, *queries.schema]}
        return df.select("slot", F.lit(kind).alias("kind"),
                         *[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])

    dealt = index.withColumn("slot", F.pmod(F.xxhash64(*index.columns), F.lit(slots)).cast("int"))
    sent = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, rows, loaded = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["slot"] != slot:
                    slot, rows, loaded = row["slot"], [], None
                if row["kind"] == 0:
                    rows.append(row)
                elif rows:
                    if loaded is None:
                        loaded = load(rows)
                    yield from search(loaded, row)

    both = filled(dealt, 0).unionByName(filled(sent, 1))
    return both.repartition(slots, "slot").sortWithinPartitions("slot", "kind").mapInArrow(run, schema)
