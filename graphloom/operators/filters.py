"""Projections and predicates over files, nodes and edges."""

from __future__ import annotations

import functools
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.fixed import languages as L
from graphloom.functions import paths, text
from graphloom.operators.skew import own_shuffle


def extension_map() -> dict[str, str]:
    """Extension -> language, the last registration of an extension winning."""
    from graphloom.operators.extract import REGISTRY

    return REGISTRY.by_extension()


def normalise_extensions(extensions: list[str] | None) -> list[str]:
    """'PY' -> '.py'; None means every registered extension."""
    if extensions is None:
        return sorted(extension_map())
    return [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]


def ext_filter(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    return files.where(F.lower("ext").isin(normalise_extensions(extensions)))


def exclude_dirs(files: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """Drop files with an excluded directory anywhere above them."""
    pattern = text.glob_pattern(L.DEFAULT_EXCLUDED_DIRS if globs is None else globs)
    return files.where(~F.exists(paths.segments(F.col("folder")), lambda s: s.rlike(pattern)))


def is_platform_specific(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(text.any_fragment(L.PLATFORM_FRAGMENTS))


def platform_filter(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(~is_platform_specific(F.col(path)))


def platform_skipped(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(is_platform_specific(F.col(path)))


def subsystem_filter(entries: DataFrame, fragment: str) -> DataFrame:
    return entries.where(F.col("file").contains(fragment))


def max_files(files: DataFrame, limit: int) -> DataFrame:
    """First files in path order."""
    return files.orderBy("path").limit(limit)


def mode_to_depth(mode: str, depth: int = 2) -> int:
    return L.MODE_DEPTH.get(mode, depth)


def depth_filter(nodes: DataFrame, max_depth: int) -> DataFrame:
    return nodes.where(F.col("depth") <= max_depth)


def opened_by(line: Column, openers: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [line.startswith(o) for o in openers], F.lit(False))


def comment_openers(language: str, legacy_comments: bool = True) -> list[str]:
    """What opens a comment line: one list for every language, or else the language's own."""
    return L.COMMENT_OPENERS if legacy_comments else L.COMMENT_OPENERS_BY_LANGUAGE.get(language, L.SLASH)


def code_lines(lines: DataFrame, legacy_comments: bool = True) -> DataFrame:
    """Keep lines that are neither blank nor opened by a comment sign.

    With `legacy_comments` one list of openers holds for every language (so Markdown headings
    and CSS ids are skipped); otherwise each language has its own list.
    """
    if legacy_comments:
        comment = opened_by(F.col("text"), L.COMMENT_OPENERS)
    else:
        comment = F.lit(False)
        for openers in {tuple(o) for o in L.COMMENT_OPENERS_BY_LANGUAGE.values()}:
            langs = [k for k, v in L.COMMENT_OPENERS_BY_LANGUAGE.items() if tuple(v) == openers]
            comment = comment | (F.col("language").isin(langs) & opened_by(F.col("text"), list(openers)))
        comment = comment | (~F.col("language").isin(list(L.COMMENT_OPENERS_BY_LANGUAGE)) & opened_by(F.col("text"), L.SLASH))
    return lines.where((F.col("text") != "") & ~comment)


def time_cutoff(events: DataFrame, now: Column, minutes: int = 30, ts: str = "ts") -> DataFrame:
    if not 1 <= minutes <= 1440:
        raise ValueError("minutes must be between 1 and 1440")
    return events.where(F.col(ts) >= now - F.make_dt_interval(mins=F.lit(minutes)))


def known_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return (
        edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .select(edges.columns)
    )


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids touched by any edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def connected_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "id", "left_semi")


def drop_nodes(nodes: DataFrame, edges: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and the edges that touch them."""
    gone = dropped.select("id").distinct()
    kept_edges = edges.join(own_shuffle(gone.withColumnRenamed("id", "src")), "src", "left_anti").join(
        own_shuffle(gone.withColumnRenamed("id", "dst")), "dst", "left_anti").select(edges.columns)
    return nodes.join(gone, "id", "left_anti"), kept_edges


def select_all(nodes: DataFrame) -> DataFrame:
    return nodes.select("id")


def invert_selection(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    return nodes.select("id").join(selection.select("id").distinct(), "id", "left_anti")


def drop_anonymous(decls: DataFrame) -> DataFrame:
    return decls.where(~F.col("name").rlike("unnamed|anonymous"))


def positioned_only(nodes: DataFrame) -> DataFrame:
    return nodes.dropna(subset=["x", "y"])


def flatten_metadata(nodes: DataFrame, top: str = "attrs", metadata: str = "metadata", out: str = "attrs") -> DataFrame:
    """Merge two attribute maps; a key in the metadata map wins."""
    meta = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.col(top), lambda k, v: ~F.map_contains_key(meta, k))
    return nodes.withColumn(out, F.map_concat(kept, meta)).drop(*({top, metadata} - {out}))


def ext_to_language(ext: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(extension_map().items())])
    return F.coalesce(F.try_element_at(pairs, F.lower(ext)), F.lit("unknown"))


def no_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def parseable_files(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Files with an allowed extension and a url, with their owning folder."""
    return ext_filter(files, extensions).where(F.coalesce(F.col("url"), F.lit("")) != "").select("folder", "name", "url")


def in_target(decls: DataFrame, files: DataFrame) -> DataFrame:
    """Declarations located in one of the scanned files, by stem."""
    return decls.join(own_shuffle(files.select(F.col("stem").alias("file")).distinct()), "file", "left_semi").select(decls.columns)


def box_select(nodes: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Nodes inside the closed rectangle; corners may come in any order."""
    return nodes.where(F.col("x").between(min(x1, x2), max(x1, x2)) & F.col("y").between(min(y1, y2), max(y1, y2)))


def lasso_select(nodes: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Nodes inside the polygon by the even-odd rule; fewer than three corners select nothing."""
    if len(polygon) < 3:
        return nodes.where(F.lit(False))
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay == by:
            continue
        spans = (F.lit(ay) > F.col("y")) != (F.lit(by) > F.col("y"))
        at = F.lit((bx - ax) / (by - ay)) * (F.col("y") - F.lit(ay)) + F.lit(ax)
        crossings = crossings + F.when(spans & (F.col("x") < at), 1).otherwise(0)
    return nodes.where(crossings % 2 == 1)


def is_saved(entries: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Mark entries whose url is bookmarked."""
    marks = bookmarks.select("url").distinct().withColumn("__m", F.lit(True))
    return entries.join(own_shuffle(marks), "url", "left").withColumn("is_saved", F.col("__m").isNotNull()).drop("__m")


def except_ids(nodes: DataFrame, others: DataFrame) -> DataFrame:
    return nodes.join(others.select("id").distinct(), "id", "left_anti")


def union_selection(selection: DataFrame, more: DataFrame) -> DataFrame:
    return selection.select("id").union(more.select("id")).distinct()
