"""Structured Streaming over an append-only table of sources: each micro-batch of new or changed files is scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stratalint.functions.config import ScanConfig
from stratalint.operators import rules, suppress
from stratalint.plans.api import shred_sources


def issues_of_stream(sources: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Per-file issues of a stream of package, root, path, source: stateless, so it needs no watermark."""
    return rules.file_issues(shred_sources(sources), config)


def rescan(sources: DataFrame, out: str, checkpoint: str, config: ScanConfig = ScanConfig()) -> StreamingQuery:
    """Append each batch's issues, suppression applied, to a Parquet table with the batch's id, which makes a retry visible."""

    def write(batch: DataFrame, epoch: int) -> None:
        facts = shred_sources(batch).persist()
        suppress.suppress(rules.file_issues(facts, config), facts, config).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        facts.unpersist()

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
