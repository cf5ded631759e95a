"""Aggregates over files, graphs, tokens and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators.ranking import chunked_lists, dense_codes
from graphloom.session import cut_lineage

# Drawn size of a node by depth.
DEPTH_SIZE = {0: 40, 1: 20, 2: 10, 3: 6}


def file_stats(files: DataFrame, folders: DataFrame) -> DataFrame:
    """One row: files, bytes, Python files, folders (the root not counted)."""
    n_folders = folders.where(F.col("parent_path").isNotNull()).agg(F.count(F.lit(1)))
    return files.agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.count_if(F.col("name").endswith(".py")).alias("python_files"),
    ).withColumn("folders", n_folders.scalar())


def folder_size_rollup(files: DataFrame) -> DataFrame:
    """Bytes below each folder at any depth, the root '' included.

    Sizes are first summed per folder, so only one row per folder fans out to its ancestors.
    """
    own = files.groupBy("folder").agg(F.sum("size").alias("size"))
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), paths.ancestors(F.col("folder")), F.array("folder")))
    return own.select(F.explode(above).alias("path"), "size").groupBy("path").agg(F.sum("size").alias("size"))


def kind_counts(rows: DataFrame, kind: str = "kind") -> DataFrame:
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def type_breakdown(nodes: DataFrame, top: int = 10, kind: str = "kind") -> DataFrame:
    """The `top` most frequent kinds and how many kinds are not shown."""
    # Cut, as the kinds are used twice and the rows are to be made once.
    counts = cut_lineage(kind_counts(nodes.select(F.coalesce(F.col(kind), F.lit("unknown")).alias(kind)), kind))
    more = counts.agg(F.greatest(F.count(F.lit(1)) - top, F.lit(0)))
    return counts.orderBy(F.col("n").desc(), kind).limit(top).withColumn("more_kinds", more.scalar())


def graph_metadata(nodes: DataFrame, edges: DataFrame, layout: str, kind: str = "d3") -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).withColumn(
        "edge_count", edges.agg(F.count(F.lit(1))).scalar()).withColumn("layout", F.lit(layout)).withColumn("type", F.lit(kind))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in, out and total degree of every node, 0 without edges; a hub's edges combine map-side."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    filled = nodes.join(counted, "id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("in_degree", "out_degree")})
    return filled.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def node_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    base = F.coalesce(F.lit(None).cast("int"), *[F.when(F.col("depth") == d, s) for d, s in DEPTH_SIZE.items()],
                      F.when(F.col("depth").isNull(), 1), F.lit(10))
    return degrees(nodes, edges).withColumn("size", base + 10 * F.col("degree"))


def degree_scale(with_degree: DataFrame) -> DataFrame:
    """Degree mapped to [0, 1] over the graph; 0 when all degrees are equal."""
    span = with_degree.agg(F.struct(F.min("degree").alias("lo"), F.max("degree").alias("hi"))).scalar()
    scaled = (F.col("degree") - F.col("__s.lo")) / F.nullif(F.col("__s.hi") - F.col("__s.lo"), F.lit(0))
    return with_degree.withColumn("__s", span).withColumn("scale", F.coalesce(scaled, F.lit(0.0))).drop("__s")


def classify_diagnostic(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("file not found"), "missing_header").when(
        low.contains("unknown type"), "unknown_type").otherwise("other")


def diagnostics_summary(diagnostics: DataFrame) -> DataFrame:
    kind = classify_diagnostic(F.col("message"))
    return diagnostics.agg(
        *[F.count_if(kind == k).alias(k) for k in ("missing_header", "unknown_type", "other")],
        F.countDistinct("file").alias("files_with_warnings"))


def worst_files(diagnostics: DataFrame, top: int = 5) -> DataFrame:
    return diagnostics.groupBy("file").agg(F.count(F.lit(1)).alias("errors")).orderBy(F.col("errors").desc(), "file").limit(top)


def member_counts(decls: DataFrame) -> DataFrame:
    """Fields per struct, constants per enum, parameters per function; 0 without members."""
    counts = decls.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(
        F.count_if(F.col("kind") == "field").alias("fields"), F.count_if(F.col("kind") == "enum_constant").alias("constants"),
        F.count_if(F.col("kind") == "parameter").alias("parameters"))
    owners = decls.where(F.col("kind").isin("struct", "enum", "function")).select("id", "kind")
    joined = owners.join(counts, "id", "left")
    n = F.when(F.col("kind") == "struct", F.col("fields")).when(F.col("kind") == "enum", F.col("constants")).otherwise(F.col("parameters"))
    return joined.select("id", "kind", F.coalesce(n, F.lit(0)).alias("members"))


def token_index(tokens: DataFrame, chunk: int = 10_000) -> DataFrame:
    """token -> sorted distinct contexts, in chunks of bounded size."""
    context = F.struct("kind", "layer_ordinal", "layer_name", "group", "role", "since")
    return chunked_lists(tokens.select("token", context.alias("context")).distinct(), ["token"], "context", chunk)


def tokens_by_standard(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("kind", "since").agg(F.count(F.lit(1)).alias("n"))


def group_by_parent(nodes: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Ids by parent ('Unknown' without one), in chunks of bounded size."""
    return chunked_lists(nodes.select(F.coalesce("parent", F.lit("Unknown")).alias("parent"), "id"), ["parent"], "id", chunk)


def distinct_files(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.countDistinct(F.nullif("file", F.lit(""))).alias("n_files"))


def extent(nodes: DataFrame) -> DataFrame:
    """Bounding box and centroid of positions, one row."""
    return nodes.agg(*[f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])


# direction -> (axis, aggregate)
ALIGNMENTS = {"left": ("x", F.min), "right": ("x", F.max), "center": ("x", F.avg),
              "top": ("y", F.min), "bottom": ("y", F.max), "middle": ("y", F.avg)}


def align(nodes: DataFrame, direction: str) -> DataFrame:
    """All positions moved to one edge or the middle of the selection."""
    axis, aggregate = ALIGNMENTS[direction]
    target = nodes.agg(aggregate(F.coalesce(F.col(axis), F.lit(0.0))))
    return nodes.withColumn(axis, target.scalar())


def category_code(nodes: DataFrame, prop: str, palette_size: int = 10) -> DataFrame:
    """Palette slot of a property's value, in order of the values; NULL keeps its own colour."""
    return dense_codes(nodes, prop, "code").withColumn("slot", F.col("code") % palette_size)


def group_bounds(files: DataFrame, symbol_parents: DataFrame, dirs: DataFrame, file_parents: DataFrame,
                 padding: float = 40.0, node_size_: float = 4.0) -> DataFrame:
    """Bounding circles of files (round their symbols) and directories (round their files).

    Parents come as (id, x, y, parent, px, py, dist), see `nearest_parent`.
    """
    file_r = symbol_parents.groupBy(F.col("parent").alias("id")).agg(
        (F.max("dist") + node_size_ + padding * 0.5).alias("radius"))
    inner = file_parents.join(file_r, "id", "left").withColumn(
        "reach", F.col("dist") + F.coalesce("radius", F.lit(node_size_ * 1.8)))
    dir_r = inner.groupBy(F.col("parent").alias("id")).agg((F.max("reach") + padding).alias("radius"))
    circles = [nodes.join(r, "id").select("id", "x", "y", "radius", F.lit(d).alias("depth"))
               for nodes, r, d in ((dirs, dir_r, 0), (files, file_r, 1))]
    return circles[0].unionByName(circles[1])
