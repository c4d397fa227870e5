"""A Python function over rows in Arrow batches, where a row that fails is left out or reported and none stops the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string


def process(rows: DataFrame, key: list[str], value: str, f: Callable[[Any], Any], kind: str, *, keep_failed: bool = False, progress: Callable[[int], None] | None = None) -> DataFrame:
    """Key and result of f for each row; with ``keep_failed``, failed rows too, with their error. progress: called with rows done, on the executor."""
    arrow = to_arrow_type(_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            out, errors = [], []
            for x in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    out.append(f(x))
                    errors.append(None)
                except Exception as e:  # of one row, whatever it is
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            done += len(out)
            if progress:
                progress(done)
            full = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, arrow), pa.array(errors, pa.string())], names=[*key, "result", "error"])
            yield full if keep_failed else full.filter(pa.array([e is None for e in errors]))

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    made = rows.select(*key, F.col(value).alias("_v")).mapInArrow(run, f"{kinds}, result {kind}, error string")
    return made if keep_failed else made.drop("error")


def _type(kind: str) -> DataType:
    return _parse_datatype_string(kind)
