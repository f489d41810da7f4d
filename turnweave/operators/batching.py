"""Collation of text examples; the collator of matrices is a query over ``arrays.fit`` (see bat01_collate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions import arrays as X


def collate_text(rows: DataFrame, batch: str, ids: str, prompt_len: str | None = None, mask_pad: int = 0, filler: int = -1) -> DataFrame:
    """Ids padded with ``filler`` to the batch's longest, ``mask`` (1 on ids, ``mask_pad`` behind) and ``labels``.

    Labels are the ids with the prompt's cells ignored; without a prompt column they are the ids. The
    batch's length is one map-side combined maximum, joined back; batches are bounded by the caller.
    """
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("_most"))
    out = rows.join(longest, batch)
    n = F.size(ids)
    padded = X.fit(F.col(ids), F.col("_most"), filler)
    mask = F.concat(X.repeat(1, n), X.repeat(mask_pad, F.col("_most") - n))
    labels: Column = padded
    if prompt_len is not None:
        end = F.least(F.col(prompt_len), F.col("_most"))
        labels = F.concat(X.repeat(-1, end), F.slice(padded, end + 1, F.greatest(F.col("_most") - end, F.lit(0))))
    return out.withColumns({"mask": mask, "labels": labels, ids: padded}).drop("_most")
