"""Lists, pairs and documents inside values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def longs_from_json(text: Column) -> Column:
    """A list of longs; anything that is none gives the empty list."""
    return F.coalesce(F.from_json(text, "array<bigint>"), F.array().cast("array<bigint>"))


def joined_ids(ids: Column) -> Column:
    """The ids in order, as one key."""
    return F.array_join(F.transform(F.sort_array(ids), lambda x: x.cast("string")), ",")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def data_url(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def scores_complete(scores: Column) -> Column:
    """Every entry has a score and no error."""
    return F.forall(scores, lambda s: s.score.isNotNull() & s.error.isNull())


def scores_valid(scores: Column, members: Column) -> Column:
    """Complete, between two different members, and no pair twice."""
    inside = F.forall(scores, lambda s: F.array_contains(members, s.left) & F.array_contains(members, s.right) & (s.left != s.right))
    keys = F.transform(scores, lambda s: pair_key(s.left, s.right))
    return scores_complete(scores) & inside & (F.size(F.array_distinct(keys)) == F.size(scores))


def member_signature(members: Column) -> Column:
    """A digest of the members' ids and content digests in id order."""
    return F.md5(F.array_join(F.transform(F.sort_array(members), lambda m: F.concat_ws(":", m.image_id, m.digest)), "|"))
