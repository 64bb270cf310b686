"""Paths as text: both separators are understood where the meaning allows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.schema import EXCLUDES, EXTENSIONS


def normalised(p: Column) -> Column:
    return F.lower(F.replace(p, F.lit("/"), F.lit("\\")))


def file_name(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/\\]*)$", 1)


def extension(p: Column) -> Column:
    """After the last dot of the file name; a leading dot alone starts a name without extension."""
    return F.regexp_extract(file_name(p), r"^.+\.([^.]*)$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(file_name(p), r"^(.+)\.[^.]*$", "$1")


def folder(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)[/\\][^/\\]*$", 1)


def relative(p: Column, root: Column) -> Column:
    """``p`` below ``root``, or unchanged if it is not."""
    prefix = F.concat(root, F.lit("/"))
    return F.when(F.startswith(p, prefix), F.substring(p, F.length(prefix) + 1, F.length(p))).otherwise(p)


def nested(child: Column, parent: Column) -> Column:
    return (child != parent) & F.startswith(child, F.concat(parent, F.lit("/")))


def same_location(a: Column, b: Column) -> Column:
    return (a == b) | (normalised(a) == normalised(b))


def ancestors(p: Column) -> Column:
    """All proper ancestors of a '/'-separated path."""
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def alias(index: Column) -> Column:
    """A is the baseline; B, C and so on number the others."""
    return F.char((F.lit(66) + index).cast("long"))


def included(p: Column, excludes: tuple[str, ...] = EXCLUDES) -> Column:
    """No excluded pattern occurs anywhere in the path."""
    return reduce(lambda a, b: a & b, (~F.contains(p, F.lit(x)) for x in excludes), F.lit(True))


def supported(p: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return F.lower(extension(p)).isin(*extensions)
