"""Reports and other outputs. Every file appears under its name only when it is whole."""

from __future__ import annotations

import html
import json
import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.stats import class_counts, conserved, numbered
from kindred.schema import ANALYSIS

CSV_COLUMNS = ("runId", "comparisonImageId", "comparisonPath", "analysisType", "primaryMatchImageId", "primaryMatchPath", "phashDistance", "ssimScore", "sizeRatio", "resolutionRatio", "aspectDiff", "directionSmallerResolution", "directionSmallerFilesize", "reviewStatus", "actionStatus", "algorithmProfileId")
LABELS = {"exact_duplicate": "Exact duplicate", "likely_compressed": "Likely compressed", "variant": "Variant", "inconclusive": "Inconclusive", "similar_keep": "Similar, keep", "no_baseline_match": "No baseline match", "not_evaluated": "Not evaluated", "error": "Error"}


class ConservationError(ValueError):
    """The classes of a run do not add up to its comparison images."""


def text(column: Column | str, decimals: int | None = None, missing: str = "") -> Column:
    """A value as report text: fixed decimals for numbers, a stand-in for nulls."""
    column = F.col(column) if isinstance(column, str) else column
    shown = F.format_string(f"%.{decimals}f", column) if decimals is not None else column.cast("string")
    return F.when(column.isNull(), F.lit(missing)).otherwise(shown)


def label(column: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, column), column)


def csv_rows(report: DataFrame, run_id: str, profile_id: str) -> DataFrame:
    """The 16 columns of the CSV report as text. ``report``: the columns of ``plans.actions.report``."""
    values = (
        F.lit(run_id), text("image_id"), F.col("comparison_path"), F.col("analysis_type"), text("primary_id"), text("primary_path"), text("phash_distance"), text("score", 6), text("size_ratio", 6), text("resolution_ratio", 6),
        text("aspect_diff", 6), text("smaller_resolution"), text("smaller_filesize"), text("review_status", missing="N/A"), text("action_status", missing="N/A"), F.lit(profile_id),
    )
    return report.select(*(v.alias(c) for v, c in zip(values, CSV_COLUMNS, strict=True)))


def check_conservation(results: DataFrame, total: int) -> dict:
    row = conserved(class_counts(results), F.lit(total)).first().asDict()
    if not row["conserved"]:
        raise ConservationError(f"{row['classified']} of {total} images have a class")
    return {k: row[k] for k in ANALYSIS}


def file_system(spark, path: str):
    """(Hadoop file system, its path) of a path on any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _single_file(df: DataFrame, writer, path: str) -> str:
    """Spark's one part file, moved to ``path`` by the store's own file system."""
    folder = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    writer(df, folder)
    fs, at = file_system(df.sparkSession, folder)
    part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    _take_name(df.sparkSession, part, path)
    fs.delete(at, True)
    return path


def _take_name(spark, part, path: str) -> None:
    """Move a whole file to ``path``; a local store's checksum file does not stay."""
    fs, target = file_system(spark, path)
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")
    _, checksum = file_system(spark, f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc")
    if fs.exists(checksum):
        fs.delete(checksum, False)


def _text_file(spark, text: str, path: str) -> str:
    fs, at = file_system(spark, f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(at, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    _take_name(spark, at, path)
    return path


def write_csv(report: DataFrame, run_id: str, profile_id: str, folder: str) -> str:
    rows = csv_rows(report.repartition(1).sortWithinPartitions("image_id"), run_id, profile_id)
    return _single_file(rows, lambda d, p: d.write.option("header", True).option("emptyValue", "").csv(p), f"{folder}/export_{run_id}.csv")


def write_json(report: DataFrame, results: DataFrame, total: int, header: dict, folder: str) -> str:
    """One document: header, counts and all rows by image; the counts must be conserved. An executor writes the file."""
    counts = check_conservation(results, total)
    rows = numbered(report.select("image_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")), "image_id", name="place")
    rows = rows.select("place", F.when(F.col("place") > 1, F.concat(F.lit(","), F.col("line"))).otherwise(F.col("line")).alias("line"))
    ends = [(0, '{"header": ' + json.dumps(header) + ', "stats": ' + json.dumps(counts) + ', "results": ['), (2**62, "]}")]
    lines = rows.unionByName(report.sparkSession.createDataFrame(ends, "place long, line string"))
    return _single_file(lines.repartition(1).sortWithinPartitions("place").select("line"), lambda d, p: d.write.text(p), f"{folder}/report_{header['run_id']}.json")


def write_html(report: DataFrame, results: DataFrame, total: int, header: dict, folder: str, most: int = 100) -> str:
    """Header, counts and the first ``most`` rows, names without folders."""
    counts = check_conservation(results, total)
    name = lambda p: html.escape((p or "").replace("\\", "/").rpartition("/")[2])
    line = lambda r: f"<tr><td>{name(r['comparison_path'])}</td><td>{LABELS[r['analysis_type']]}</td><td>{name(r['primary_path'])}</td><td>{'' if r['score'] is None else format(r['score'], '.4f')}</td></tr>"
    rows = report.orderBy("image_id").limit(most).collect()
    body = "".join(f"<li>{html.escape(k)}: {html.escape(str(v))}</li>" for k, v in header.items())
    stats = "".join(f"<tr><td>{LABELS[k]}</td><td>{v}</td></tr>" for k, v in counts.items())
    page = f"<!doctype html><meta charset='utf-8'><title>Report</title><ul>{body}</ul><table>{stats}</table><table>{''.join(map(line, rows))}</table>\n"
    return _text_file(report.sparkSession, page, f"{folder}/report_{header['run_id']}.html")


def write_all(report: DataFrame, results: DataFrame, total: int, header: dict, folder: str) -> list[str]:
    return [write_json(report, results, total, header, folder), write_csv(report, header["run_id"], header.get("profile_id", ""), folder), write_html(report, results, total, header, folder)]


def delete_list(recycled: DataFrame, root: str) -> DataFrame:
    """Paths below ``root`` relative to it, by time; others are left out. ``recycled``: path, recycled_at."""
    prefix = root.rstrip("/") + "/"
    return recycled.filter(F.startswith(F.col("path"), F.lit(prefix))).orderBy("recycled_at", "path").select(F.expr(f"substr(path, {len(prefix) + 1})").alias("path"))


def overwrite_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """An upsert of whole partitions: those that ``df`` has are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("append").partitionBy(*keys).parquet(path)
