"""Small helpers shared by the operators of this package."""
from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKENIZER_PACKAGE = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file, as installed on every machine."""
    found = importlib.util.find_spec(TOKENIZER_PACKAGE)
    if found is None or not found.origin:
        raise FileNotFoundError(f"package {TOKENIZER_PACKAGE} is not installed")
    return os.path.join(os.path.dirname(found.origin), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """Run ``work`` on each Arrow batch; it yields dicts of column name to values."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``chars`` bytes of ``column``, so that the
    working set of a task follows neither the batch size nor the number of long texts in it."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)
