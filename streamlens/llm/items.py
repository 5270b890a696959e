"""Test items as words, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.llm.common import stored

#: What an item counts beside its words.
ITEM = 32
#: Bytes that words are made of stay, A-Z become a-z, all others become spaces.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def fold_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def numbered_items(items: DataFrame, block_words: int) -> DataFrame:
    """Items that have words, with a row number and the number of their block, by running sums of sizes.

    An item's size is its words and ``ITEM``. A block ends with the first item that fills it, so it is
    no larger than ``block_words`` and an item.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(fold_words(t.as_py())) for t in batch.column("text")]
            yield batch.append_column("size", pa.array(sizes, pa.int64()))

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"), "item_id", "text")
    schema = T.StructType([*rows.schema.fields, T.StructField("size", T.LongType())])
    sized = stored(rows.mapInArrow(count, schema).filter("size > 0").withColumn("size", F.col("size") + ITEM), "items")
    parts = sized.groupBy("part").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("row"))
    return (
        sized.withColumn("inside", inside)
        .join(parts, "part")
        .select("row", "item_id", "text", F.floor((F.col("before") + F.col("inside") - 1) / block_words).alias("block"))
    )


def item_blocks(numbered: DataFrame) -> Iterator[list[tuple[int, object, str]]]:
    """The items by blocks, as (row, item_id, text): what the driver gets at a time is one block."""
    blocks = [r.block for r in numbered.select("block").distinct().orderBy("block").collect()]
    for block in blocks:
        own = numbered.filter(F.col("block") == block).orderBy("row").select("row", "item_id", "text")
        yield [tuple(r) for r in own.collect()]
