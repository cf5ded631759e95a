"""A graph built from arriving files: structure and symbols per batch, cross-file edges when all are in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import extract, filters, graph, layout, pyast
from graphloom.session import delete_dir, shuffles_dropped
from graphloom.sources import files as tree
from graphloom.streaming import sinks

C_EXTENSIONS = [".c", ".h"]


def start_graph_stream(files: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Per micro-batch: folders, files, pattern symbols and Python parse rows, each under `out`."""
    def write(batch: DataFrame, number: int) -> None:
        # Read once for all parts, and dealt anew: files of one language arrive together, and would be parsed by a task or two.
        # The dealt files are kept in a packed folder until the batch is done, not in a shuffle and a cache beside it.
        dealt = f"{checkpoint.rstrip('/')}-dealt/batch={number}"
        spark = batch.sparkSession
        with shuffles_dropped(spark):
            batch.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").write.mode("overwrite").option("compression", "zstd").parquet(dealt)
        batch = spark.read.schema(batch.schema).parquet(dealt)
        parts = {
            "files": batch.withColumn("raw", F.lit(None).cast("string")),  # the text is not needed again
            "symbols": extract.extract_symbols(batch).drop("meta"),
            "parsed": pyast.parse_python(batch),
            "progress": batch.groupBy("path").agg(F.count(F.lit(1)).alias("seen")),
        }
        try:
            for name, rows in parts.items():
                with shuffles_dropped(spark):
                    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/batch={number}")
        finally:
            delete_dir(spark, dealt)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress_by_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols found per file so far, 0 for files without any."""
    found = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    ids = files.select(graph.file_id(F.col("path")).alias("file_id"))
    return ids.join(found, "file_id", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))


def assemble(spark: SparkSession, out: str, files_schema, root_name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of everything that has arrived, cross-file edges resolved over all files."""
    files = sinks.read_batches(spark, f"{out}/files", files_schema)
    symbols = spark.read.option("basePath", f"{out}/symbols").parquet(f"{out}/symbols").drop("batch")
    parsed = spark.read.option("basePath", f"{out}/parsed").parquet(f"{out}/parsed").drop("batch")
    return whole_graph(files, symbols, parsed, root_name)


@dataclass(frozen=True)
class CTables:
    """What a C front end says of the whole tree: declared symbols, call sites (src, dst) and errors (file, a stem)."""

    decls: DataFrame
    call_sites: DataFrame
    diagnostics: DataFrame


def c_graph(c: CTables, files: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes of declared C symbols, marked where their file had errors, and all their edges.

    Depth-2 symbols hang below the file their `file` stem names, the last of that stem; members hang
    below their type only. Files for one platform own no symbols.
    """
    own = filters.platform_filter(files.where(F.lower("ext").isin(C_EXTENSIONS)))
    nodes = graph.normalise_c_decls(c.decls, depth)
    marked = graph.flag_parse_warnings(nodes, c.diagnostics)
    between = graph.union_edges(graph.field_of(c.decls), graph.calls(c.call_sites, nodes), graph.points_to(c.decls), graph.aliases(c.decls))
    return marked, graph.union_edges(
        filters.known_endpoints(graph.map_edge_kinds(between), nodes.select("id")), graph.attach_by_stem(nodes, graph.file_by_stem(own, seq="path")))


def whole_graph(files: DataFrame, symbols: DataFrame, parsed: DataFrame, root_name: str, depth: int = 2,
                folders: DataFrame | None = None, c: CTables | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges down to `depth`; `folders` may hold more than those of the files.

    With the tables of a C front end its symbols and edges are part of the graph, and nodes tell
    `has_parse_warning`.
    """
    folders = tree.folders_of(files, root_name) if folders is None else folders
    py_nodes = pyast.python_nodes(parsed, depth)
    py_edges = pyast.python_edges_to(parsed, depth)
    stems = graph.file_by_stem(files.where(F.lower("ext") == ".py"), seq="path")
    imports = pyast.python_imports(parsed)
    ext_nodes, dependencies = graph.dependencies(imports, stems)
    columns = ["id", "depth", "language", "kind", "label", "file", "line", "shape", "color"]
    node_parts = [graph.dir_nodes(folders), graph.file_nodes(files), symbols, py_nodes, ext_nodes]
    parts = [p.select(columns) for p in node_parts]
    if c is not None:
        c_nodes, c_edges = c_graph(c, files, depth)
        parts.append(c_nodes.select(*columns, F.col("has_parse_warning")))
    nodes = graph.merge_nodes(*parts, apart=True)
    if c is not None:
        nodes = nodes.withColumn("has_parse_warning", F.coalesce("has_parse_warning", F.lit(False)))
    edge_parts = [
        graph.dir_edges(folders), graph.file_edges(files),
        symbols.select(*graph.edge(F.col("file_id"), F.col("id"), "contains")),
        py_edges.drop("file_id"), graph.attach_roots(py_nodes, py_edges),
        dependencies,
    ]
    if c is not None:
        edge_parts.append(c_edges)
    return nodes, graph.dedupe_edges(graph.union_edges(*edge_parts), apart=True)


def reposition(nodes: DataFrame, edges: DataFrame, layout_name: str = "Circular") -> DataFrame:
    """Final positions over the complete graph, replacing the placeholders of the stream."""
    return layout.Layouts().positions(nodes, edges, layout_name)
