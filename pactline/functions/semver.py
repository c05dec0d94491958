"""Semantic versions as STRUCT<major, minor, patch>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactline.functions.documents import let

_INTEGER = "^[+-]?[0-9]+$"


def parse_semver(text: Column) -> Column:
    """Three integers separated by dots; anything else is NULL."""

    def parts_to_struct(parts: Column) -> Column:
        numbers = F.transform(parts, lambda p: F.when(p.rlike(_INTEGER), p.try_cast("bigint")))
        return let(
            numbers,
            lambda n: F.when(
                (F.size(n) == 3) & ~F.exists(n, lambda x: x.isNull()),
                F.struct(
                    F.get(n, F.lit(0)).alias("major"),
                    F.get(n, F.lit(1)).alias("minor"),
                    F.get(n, F.lit(2)).alias("patch"),
                ),
            ),
        )

    return let(F.split(text, r"\.", -1), parts_to_struct)


def format_semver(version: Column) -> Column:
    return F.when(
        version.isNotNull(),
        F.concat_ws(".", *[version[p].cast("string") for p in ("major", "minor", "patch")]),
    )


def bump_level(current: Column, proposed: Column) -> Column:
    """MAJOR, MINOR or PATCH for a single-step increment with lower parts reset, else NULL."""
    same_major = proposed["major"] == current["major"]
    same_minor = proposed["minor"] == current["minor"]
    major = (proposed["major"] == current["major"] + 1) & (proposed["minor"] == 0)
    minor = same_major & (proposed["minor"] == current["minor"] + 1)
    patch = same_major & same_minor & (proposed["patch"] == current["patch"] + 1)
    return (
        F.when(major & (proposed["patch"] == 0), "MAJOR")
        .when(minor & (proposed["patch"] == 0), "MINOR")
        .when(patch, "PATCH")
    )


def bump_error(current: Column, proposed: Column) -> Column:
    """Why a pair of versions is not a valid step, NULL when it is one."""
    text = F.format_string(
        "version %s is not a valid single-level increment from %s",
        format_semver(proposed),
        format_semver(current),
    )
    return F.when(bump_level(current, proposed).isNull(), text)
