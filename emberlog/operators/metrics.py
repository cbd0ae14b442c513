"""What became of the batches that a store was given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_report(attempts: DataFrame) -> DataFrame:
    """One row per source (null: batches without) over the attempts to append: how many batches were
    committed, replayed and failed, how many took more than one attempt, the rows accepted and
    rejected, and the seconds a commit took, on average and at most."""
    took = F.when(F.col("outcome") == "committed", F.col("seconds"))
    by_batch = attempts.groupBy("source", "version").agg(
        *[F.count_if(F.col("outcome") == outcome).alias(outcome) for outcome in ("committed", "replayed", "failed")],
        *[F.sum(F.when(F.col("outcome") == "committed", F.col(n)).otherwise(0)).alias(n) for n in ("accepted", "rejected")],
        F.sum(took).alias("seconds"),
        F.max(took).alias("longest"),
    )
    # Batches without a source have no number to be tried again under.
    again = (F.col("source").isNotNull()) & (F.col("committed") > 0) & (F.col("failed") > 0)
    return by_batch.groupBy("source").agg(
        *[F.sum(n).alias(n) for n in ("committed", "replayed", "failed")],
        F.count_if(again).alias("retried"),
        *[F.sum(n).alias(n) for n in ("accepted", "rejected")],
        (F.sum("seconds") / F.sum("committed")).alias("mean_seconds"),
        F.max("longest").alias("longest_seconds"),
    )
