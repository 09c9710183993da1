"""A product kept up to date while entries of A arrive.

The product is linear in A, so the product of a batch of new entries is what they add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.product import product


def append_product(entries: DataFrame, b: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write for each batch of the stream ``entries`` (i, j, v) its product with ``b`` under ``path``.

    A batch that is run again writes its folder anew, so its rows count once.
    """

    def each(batch: DataFrame, number: int) -> None:
        product(batch, b).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
