"""Sinks."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame


def write_bars(bars: DataFrame, path: str, single_file: bool = False) -> int:
    """Write bars as zstd Parquet and return how many. Committed as a whole: a run that fails leaves no half output.

    `single_file` is for consumers that need one file; it is off because it makes one task write everything.
    """
    target = urlparse(path).path.rstrip("/")
    if any(f"{urlparse(f).path}/".startswith(f"{target}/") for f in bars.inputFiles()):
        raise ValueError("bars are written over their own input")
    (bars.coalesce(1) if single_file else bars).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return bars.sparkSession.read.parquet(path).count()
