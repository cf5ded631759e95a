"""Path expressions over '/'-separated strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    """Back-slashes to slashes, empty segments dropped: '/a//b/' -> 'a/b'."""
    return F.array_join(segments(path), "/")


def segments(path: Column) -> Column:
    return F.array_remove(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Containing folder; '' for a top-level entry."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def suffix(name: Column) -> Column:
    """Last extension with its dot; '' for names such as '.bashrc' or 'README'."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def ancestors(path: Column) -> Column:
    """Folders above an entry, outermost first: 'a/b/c' -> ['a', 'a/b']."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(
        depth >= 1,
        F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def tree_depth(path: Column) -> Column:
    """Number of segments; 0 for the root ''."""
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))
