"""Plans of renames and transfers as DataFrames; nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import naming, paths


def rename_preview(items: DataFrame, template: str | None = None, pattern: str | None = None, first_name: str | None = None) -> DataFrame:
    """Adds proposed_name and rule_issue. ``items``: path, reference_name, group_index, order.

    A template alone fills itself in for each file; with a pattern, only for names that fit; a first name numbers them.
    Names that fit no rule keep theirs (RuleUnmatched, not blocking), a bad template is InvalidName and blocks.
    """
    name = paths.file_name(F.col("path"))
    x = items.withColumn("original_name", name)
    if first_name is not None:
        return x.withColumn("proposed_name", naming.quick_name(F.lit(first_name), F.col("order"), paths.extension(F.col("path")))).withColumn("rule_issue", F.lit(None).cast("string"))
    fits, captures = naming.wildcards(pattern, name) if pattern is not None else (F.lit(True), [])
    made = naming.render(template, name, F.col("reference_name"), F.col("group_index"), F.col("order"), captures)
    issue = F.when(~fits, "RuleUnmatched").when(made.isNull(), "InvalidName")
    return x.withColumn("proposed_name", F.when(fits, F.coalesce(made, name)).otherwise(name)).withColumn("rule_issue", issue)


def explicit_issues(items: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds issues (in order), blocking and conflicts of proposed names.

    ``items``: path, proposed_name, expected (fingerprint or null). ``listing``: path, fingerprint, digest now.
    """
    folder = paths.folder(F.col("path"))
    target = F.when(folder == "", F.col("proposed_name")).otherwise(F.concat(folder, F.lit("/"), F.col("proposed_name")))
    x = items.withColumn("target_path", target).withColumn("target_key", paths.normalised(target)).withColumn("source_key", paths.normalised(F.col("path")))
    x = x.withColumn("same_target", F.count("*").over(Window.partitionBy("target_key")))
    now = listing.select(F.col("path").alias("l_path"), F.col("fingerprint").alias("actual"), F.col("digest").alias("own_digest"))
    there = listing.select(paths.normalised(F.col("path")).alias("t_key"), F.col("digest").alias("there_digest"))
    sources = x.select(F.col("source_key").alias("s_key")).distinct().withColumn("is_source", F.lit(True))
    x = x.join(now, F.col("path") == F.col("l_path"), "left").join(there, F.col("target_key") == F.col("t_key"), "left").join(sources, F.col("target_key") == F.col("s_key"), "left")
    exists = F.col("t_key").isNotNull() & (F.col("target_key") != F.col("source_key")) & F.col("is_source").isNull()
    issues = F.filter(
        F.array(
            F.when(F.col("l_path").isNull(), "SourceMissing").when(F.col("expected").isNull() | (F.col("actual") != F.col("expected")), "SourceChanged"),
            F.when(naming.invalid_name(F.col("proposed_name")).isNotNull(), "InvalidName"),
            F.when(F.col("same_target") > 1, "BatchDuplicate"),
            F.when(exists, F.when(F.col("own_digest") == F.col("there_digest"), "SameContentExists").otherwise("TargetExists")),
        ),
        lambda i: i.isNotNull(),
    )
    return x.withColumn("issues", issues).withColumn("blocking", F.size("issues") > 0)


def transfer_issues(items: DataFrame, listing: DataFrame, directory: Column) -> DataFrame:
    """Adds target_path, issues and conflict of moves or copies into a directory; every issue is a conflict."""
    x = items.withColumn("target_path", F.concat(directory, F.lit("/"), paths.file_name(F.col("path"))))
    now = listing.select(F.col("path").alias("l_path"), F.col("fingerprint").alias("actual"), F.col("digest").alias("own_digest"))
    there = listing.select(F.col("path").alias("t_path"), F.col("digest").alias("there_digest"))
    x = x.join(now, F.col("path") == F.col("l_path"), "left").join(there, F.col("target_path") == F.col("t_path"), "left")
    issues = F.filter(
        F.array(
            F.when(F.col("l_path").isNull(), "SourceMissing").when(F.col("expected").isNull() | (F.col("actual") != F.col("expected")), "SourceChanged"),
            F.when(F.col("t_path").isNotNull(), F.when(F.col("own_digest") == F.col("there_digest"), "SameContentExists").otherwise("TargetExists")),
        ),
        lambda i: i.isNotNull(),
    )
    return x.withColumn("issues", issues).withColumn("conflict", F.size("issues") > 0)


def apply_paths(results: DataFrame, moved: DataFrame) -> DataFrame:
    """Results with the paths that a successful batch gave them. ``moved``: path, new_path."""
    return results.join(moved, "path", "left").withColumn("path", F.coalesce("new_path", "path")).drop("new_path")
