"""From a file table to the unified graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import extract, filters, graph, pyast
from graphloom.session import stored
from graphloom.sources import files as tree
from graphloom.streaming.graph import CTables, whole_graph


def build_graph(files: DataFrame, root_name: str, depth: int = 2, extensions: list[str] | None = None,
                c: CTables | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): directories at depth 0, files at 1, symbols and dependencies at 2, parts of functions (calls, arguments, names) and members at 3.

    `c` holds what a C front end says of the tree; its symbols are resolved over all files at once.
    Branches beyond `depth` are simply not planned, so a directory graph never reads text.
    """
    folders = tree.folders_of(files, root_name)
    kept = filters.ext_filter(files, extensions)
    if depth < 1:
        return graph.dir_nodes(folders).drop("legacy_id"), graph.dir_edges(folders)
    if depth < 2:
        nodes = graph.union_nodes(graph.dir_nodes(folders), graph.file_nodes(kept)).drop("legacy_id")
        return nodes, graph.union_edges(graph.dir_edges(folders), graph.file_edges(kept))
    # One parse and one extraction feed nodes, edges and imports; both are far smaller than the text.
    parsed = stored(pyast.parse_python(kept, depth), "parsed")
    symbols = stored(extract.extract_symbols(kept).drop("meta", "legacy_id"), "symbols")
    return whole_graph(kept.drop("raw"), symbols, parsed, root_name, depth, folders, c)


def graph_of_folder(spark: SparkSession, path: str, mode: str = "ast", depth: int = 2, **scan) -> tuple[DataFrame, DataFrame]:
    files = tree.scan_tree(spark, path, **scan)
    return build_graph(files, path.rstrip("/").rsplit("/", 1)[-1], filters.mode_to_depth(mode, depth))


