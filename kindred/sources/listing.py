"""File listings: what a scan takes, which roots it has, and the tree of what it found."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import paths
from kindred.schema import EXCLUDES, EXTENSIONS


def scan(spark: SparkSession, root: str, excludes=EXCLUDES, extensions=EXTENSIONS, recursive: bool = True, content: bool = False) -> DataFrame:
    """path, size, mtime (ms) and, on request, content of the image files below a root. Links are not followed.
    Spark's listing leaves out names that begin with a dot or an underscore.

    A pattern excludes a file if it occurs anywhere in its path, the root included; endings compare without case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    kept = files.filter(paths.included(F.col("path"), excludes) & paths.supported(F.col("path"), extensions))
    out = kept.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), *(["content"] if content else []))
    return out


def discover(spark: SparkSession, roots: list[str], recursive: bool = True) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Files of many roots by path, and errors (root, message). Roots that are none and roots inside others are dropped."""
    good, errors = [], []
    for root in dict.fromkeys(os.path.realpath(r) for r in roots):
        (good.append(root) if os.path.isdir(root) else errors.append((root, "not a directory")))
    kept = [r for r in sorted(good, key=lambda r: (r.count(os.sep), r)) if not any(r.startswith(o.rstrip(os.sep) + os.sep) for o in good if o != r)]
    out = None
    for root in kept:
        part = scan(spark, root, excludes=(), recursive=recursive)
        out = part if out is None else out.unionByName(part)
    return (out.orderBy("path") if out is not None else None), errors


def outermost(roots: DataFrame) -> DataFrame:
    """Roots (column root) that lie in no other one: an anti-join on all ancestors, not on all pairs."""
    all_ = roots.select("root").distinct()
    inside = all_.select("root", F.explode(paths.ancestors(F.col("root"))).alias("above")).join(all_.select(F.col("root").alias("above")), "above").select("root").distinct()
    return all_.join(inside, "root", "left_anti")


def conflicts(roots: DataFrame) -> DataFrame:
    """(a, b, issue): roots (role, root) that are equal across roles, or of which b lies inside a."""
    r = roots.select("role", "root")
    equal = r.alias("x").join(r.alias("y"), F.col("x.root") == F.col("y.root")).filter("x.role < y.role").select(F.col("x.root").alias("a"), F.col("y.root").alias("b"), F.lit("same").alias("issue"))
    inside = r.select(F.col("root").alias("b"), F.explode(paths.ancestors(F.col("root"))).alias("a")).join(r.select(F.col("root").alias("a")).distinct(), "a").select("a", "b", F.lit("nested").alias("issue"))
    return equal.distinct().unionByName(inside.distinct())


def preflight(baseline: str, comparisons: list[str], allow_internal: bool = False) -> tuple[list[str], list[str]]:
    """(errors, warnings) for the roots of a run, before anything is read."""
    errors, warnings = [], ["the baseline is read only"]
    roots = [(name, os.path.realpath(p)) for name, p in [("baseline", baseline), *((f"comparison {i + 1}", p) for i, p in enumerate(comparisons))]]
    if not comparisons:
        errors.append("at least one comparison root is needed")
    for name, p in roots:
        if not os.path.exists(p):
            errors.append(f"{name} does not exist")
        elif not os.path.isdir(p):
            errors.append(f"{name} is no directory")
        elif not os.access(p, os.R_OK):
            errors.append(f"{name} can't be read")
    for i, (name, p) in enumerate(roots):
        for other, q in roots[i + 1 :]:
            if p == q:
                (warnings if allow_internal and i == 0 else errors).append(f"{name} and {other} are the same")
            elif p.startswith(q.rstrip(os.sep) + os.sep) or q.startswith(p.rstrip(os.sep) + os.sep):
                errors.append(f"{name} and {other} are nested")
    return errors, warnings


def directory_tree(files: DataFrame) -> DataFrame:
    """Directories that hold images themselves: folder, label, parent, n, and the place among siblings by label."""
    d = files.filter(paths.supported(F.col("path"), (*EXTENSIONS, "tiff", "svg"))).groupBy(paths.folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n"))
    d = d.select("folder", paths.file_name(F.col("folder")).alias("label"), paths.folder(F.col("folder")).alias("parent"), "n")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy("label")).cast("long"))
