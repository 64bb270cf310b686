"""File names: templates, wildcards, and what a name may not be."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.paths import extension, stem

# Characters and stems that a file name may not have.
FORBIDDEN = r'[\x00-\x1F<>:"/\\|?*]'
RESERVED = r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
MARK = "\x00"


def render(template: Column | str, name: Column, reference: Column, group: Column, order: Column, captures: list[Column] = ()) -> Column:
    """The template filled in; null where an unknown variable is left. Longer variables come before their prefixes."""
    out = F.replace(F.lit(template) if isinstance(template, str) else template, F.lit("$$"), F.lit(MARK))
    number = order.cast("string")
    padded = lambda n: F.when(F.length(number) >= n, number).otherwise(F.lpad(number, n, "0"))
    values = [("$n:03", padded(3)), ("$n:02", padded(2)), ("$name", stem(name)), ("$ext", extension(name)), ("$ref", reference), ("$group", group.cast("string")), ("$n", number)]
    values += [(f"${i}", captures[i - 1] if i <= len(captures) else F.lit("")) for i in range(9, 0, -1)]
    for variable, value in values:
        out = F.replace(out, F.lit(variable), value)
    out = F.replace(out, F.lit(MARK), F.lit("$"))
    return F.when(~F.contains(out, F.lit("$")), out)


def wildcards(pattern: str, value: Column) -> tuple[Column, list[Column]]:
    """(whether ``value`` fits, what each ``*`` stands for). The first literal anchors the start, the last one the end,
    those between stand leftmost."""
    parts = pattern.split("*")
    if len(parts) == 1:
        return value == pattern, []
    quoted = [re.escape(x) for x in parts]
    middle = "".join(f"((?:(?!{q})[\\s\\S])*){q}" if q else "()" for q in quoted[1:-1])
    full = f"^{quoted[0]}{middle}([\\s\\S]*){quoted[-1]}$"
    return value.rlike(full), [F.regexp_extract(value, full, i) for i in range(1, len(parts))]


def invalid_name(name: Column) -> Column:
    """Why a file name is not allowed: empty, ending, character or reserved; null if it is."""
    return (
        F.when((F.trim(name) == "") | name.isin(".", ".."), "empty")
        .when(F.endswith(name, F.lit(" ")) | F.endswith(name, F.lit(".")), "ending")
        .when(name.rlike(FORBIDDEN), "character")
        .when(F.upper(stem(name)).rlike(RESERVED), "reserved")
    )


def invalid_folder(name: Column) -> Column:
    """As for file names; the reserved stem ends at the first dot."""
    return (
        F.when((F.trim(name) == "") | name.isin(".", ".."), "empty")
        .when(F.endswith(name, F.lit(" ")) | F.endswith(name, F.lit(".")), "ending")
        .when(name.rlike(FORBIDDEN), "character")
        .when(F.upper(F.substring_index(name, ".", 1)).rlike(RESERVED), "reserved")
    )


def destination(root: Column, folder: Column) -> Column:
    """The root, or a single folder below it where one is given."""
    return F.when(F.trim(F.coalesce(folder, F.lit(""))) == "", root).otherwise(F.concat(root, F.lit("/"), F.trim(folder)))


def quick_name(first_name: Column, order: Column, ext: Column) -> Column:
    """stem_1.ext, stem_2.ext, each with its own extension."""
    base = F.concat(stem(first_name), F.lit("_"), order.cast("string"))
    return F.when(ext == "", base).otherwise(F.concat(base, F.lit("."), ext))
