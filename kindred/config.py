"""The algorithm profile: all thresholds that a run depends on, stamped on its results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    profile_id: str = "spark-profile-v1"
    max_distance: int = 10
    compressed: float = 0.995
    variant: float = 0.75
    aspect_tolerance: float = 0.005
    tie: float = 0.001
    top_k: int = 50
    group_distance: int = 10
    anchor_pixels: float = 0.9
    anchor_size: float = 0.75
    lower: float = 0.98
    pair_distance: int = 24
    pair_k: int = 8
    longest_edge: int = 1600
    score_scope: str = "primary"  # "primary": one score for all candidates; "all": each has its own
    strict_null_hash: bool = False  # True: rows without a hash get a not_evaluated result


DEFAULT = Profile()


class ProfileMismatch(ValueError):
    """Rows of another algorithm profile must not be mixed with this one's."""


def guard_profile(df, profile: Profile = DEFAULT):
    """``df`` if all its rows have this profile's id; raises otherwise."""
    from pyspark.sql import functions as F

    if df.filter(F.col("algorithm_profile_id") != profile.profile_id).limit(1).count():
        raise ProfileMismatch(profile.profile_id)
    return df


def guard_distance(distance: int) -> int:
    if not 0 <= distance <= 24:
        raise ValueError("the grouping distance must be from 0 to 24")
    return distance


def guard_ids(ids: list[int], most: int = 800) -> list[int]:
    if len(ids) > most:
        raise ValueError(f"at most {most} images in one request")
    return ids
