"""An ordered fold: what only the rows before it, in order, decide about a row.

Rows are dealt by key and sorted in Spark; a task reads its partition as a stream
and holds one state, that of the key it is at, so a key of any size fits.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], start: Callable[[], Any], step: Callable[..., tuple], adds: str) -> DataFrame:
    """rows with the columns of `adds`; step(state, *reads) gives the next state, then a value per added column."""
    added = StructType.fromDDL(adds)
    out = StructType([*rows.schema.fields, *added.fields])

    def batches(it):
        from pyspark.sql.pandas.types import to_arrow_type

        key, state = None, None
        for b in it:
            own = list(zip(*(b.column(k).to_pylist() for k in keys)))
            values = list(zip(*(b.column(c).to_pylist() for c in reads)))
            got: list[tuple] = []
            for k, v in zip(own, values):
                if k != key:
                    key, state = k, start()
                state, *more = step(state, *v)
                got.append(tuple(more))
            columns = [pa.array([g[j] for g in got], to_arrow_type(f.dataType)) for j, f in enumerate(added.fields)]
            yield pa.record_batch([*b.columns, *columns], names=out.fieldNames())

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(batches, out)
