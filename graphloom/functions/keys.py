"""Stable keys of repositories and graph runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.urls import is_github


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def repo_key(url: Column) -> Column:
    """'owner-repo' for GitHub URLs, else the first 16 hex digits of the URL's SHA-256."""
    parts = F.split(url, "/")
    owner, repo = F.get(parts, F.lit(3)), F.get(parts, F.lit(4))
    named = is_github(url) & (F.coalesce(owner, F.lit("")) != "") & (F.coalesce(repo, F.lit("")) != "")
    return F.when(named, F.concat(owner, F.lit("-"), repo)).otherwise(short_hash(url))


def run_key(url: Column, mode: Column, layout: Column, extensions: Column) -> Column:
    """'{repo_key}::{hash}'; the hashed text lists the sorted extensions as ['a', 'b']."""
    quoted = F.transform(F.array_sort(extensions), lambda e: F.concat(F.lit("'"), e, F.lit("'")))
    listed = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return F.concat(repo_key(url), F.lit("::"), short_hash(F.concat_ws("::", url, mode, layout, listed)))
