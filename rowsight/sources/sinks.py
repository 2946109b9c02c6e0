"""Writers for tables, indexes and reports."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, functions as F

from ..functions.identifiers import dataset_suffix
from .report_files import FORMAT, ReportFiles

log = logging.getLogger(__name__)

REPORT_FORMATS = {"markdown": "md", "html": "html", "json": "json"}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_index(index: DataFrame, path: str, recreate: bool = False) -> None:
    """Append to the table index, or replace it."""
    index.write.mode("overwrite" if recreate else "append").parquet(path)


def named_reports(documents: DataFrame, stamp: str, comprehensive: bool = True) -> DataFrame:
    """(dataset_id, format, document) -> (format, file_name, document); unknown formats drop out."""
    known = F.create_map(*[F.lit(x) for kv in REPORT_FORMATS.items() for x in kv])
    end = F.element_at(known, F.col("format"))
    if comprehensive:
        stem = F.concat(F.lit("comprehensive_dq_report_"), dataset_suffix(F.col("dataset_id")))
    else:
        stem = F.concat(F.lit("dq_report_"), F.replace("dataset_id", F.lit("."), F.lit("_")))
    return documents.where(F.col("format").isin(*REPORT_FORMATS)).select(
        "dataset_id", "format", F.concat(stem, F.lit(f"_{stamp}."), end).alias("file_name"), "document"
    )


def save_reports(documents: DataFrame, path: str, stamp: str, formats=tuple(REPORT_FORMATS), comprehensive: bool = True) -> DataFrame:
    """One file per report directly below ``path``, under its exact name; returns what was asked for.

    A rerun replaces the files of the same names. Unknown formats are skipped.
    """
    wanted = [f.strip().lower() for f in (formats.split(",") if isinstance(formats, str) else formats)]
    for f in wanted:
        if f not in REPORT_FORMATS:
            log.warning("unknown format %r skipped", f)
    files = named_reports(documents.where(F.col("format").isin(*wanted)), stamp, comprehensive)
    documents.sparkSession.dataSource.register(ReportFiles)
    files.select("dataset_id", "file_name", "document").write.format(FORMAT).mode("append").option("path", path).save()
    return files.select("dataset_id", "format", "file_name")
