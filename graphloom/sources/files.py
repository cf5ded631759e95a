"""Source trees: scanning, listings, folder hierarchies, size tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import filters
from graphloom.operators.skew import own_shuffle

CONTENT_LIMIT_KB, STRUCTURE_LIMIT_KB = 5_000, 50_000   # fixed values: size tiers


def decode_capped(content: Column, length: Column, max_bytes: int | None = None) -> Column:
    """UTF-8 text; '' when not decodable, or larger than `max_bytes` if that is given."""
    ok = F.is_valid_utf8(content.cast("string"))
    if max_bytes is not None:
        ok = (length <= max_bytes) & ok
    return F.when(ok, content.cast("string")).otherwise("")


def textless_files(files: DataFrame) -> DataFrame:
    """(repo, path, size) of scanned files that have bytes but no text: not decodable, or above the limit asked for."""
    return files.where((F.col("size") > 0) & (F.col("raw") == "")).select("repo", "path", "size")


def scan_tree(spark: SparkSession, root: str, extensions: list[str] | None = None,
              excluded: list[str] | None = None, repo: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """`files` below a folder. Extension and directory filters see paths only, so skipped files are never read.

    With `max_bytes`, larger files keep no text; `textless_files` lists them.
    """
    # The folder's qualified form is the prefix of the paths Spark reports for the files below it.
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(f"Path does not exist: {root}")
    if not fs.getFileStatus(hadoop).isDirectory():
        raise NotADirectoryError(f"Path is not a directory: {root}")
    prefix = fs.getFileStatus(hadoop).getPath().toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    name = paths.base_name(F.col("__rel"))
    listed = found.withColumn("__rel", relative).withColumn("folder", paths.parent(F.col("__rel"))).withColumn("ext", paths.suffix(name))
    kept = filters.exclude_dirs(filters.ext_filter(listed, extensions), excluded)

    def rows(part: DataFrame, raw: Column) -> DataFrame:
        return part.select(
            F.lit(repo or prefix.rstrip("/").rsplit("/", 1)[-1]).alias("repo"), F.col("__rel").alias("path"), "folder",
            name.alias("name"), paths.stem(name).alias("stem"), "ext", F.col("path").alias("url"), F.col("length").alias("size"),
            raw.alias("raw"))

    text = decode_capped(F.col("content"), F.col("length"), max_bytes)
    if max_bytes is None:
        return rows(kept, text)
    # The length test is pushed into the listing: bytes of oversized files are not read at all.
    return rows(kept.where(F.col("length") <= max_bytes), text).unionByName(rows(kept.where(F.col("length") > max_bytes), F.lit("")))


def files_from_paths(rows: DataFrame) -> DataFrame:
    """Complete (repo, path, url, size, raw) to the `files` columns."""
    name = paths.base_name(F.col("path"))
    return rows.select("repo", "path", paths.parent(F.col("path")).alias("folder"), name.alias("name"), paths.stem(name).alias("stem"),
                       paths.suffix(name).alias("ext"), "url", "size", "raw")


def tree_from_listing(listing: DataFrame, root_name: str) -> tuple[DataFrame, DataFrame]:
    """(folders, files) of (path, type, url) rows; missing ancestors are created, the root has path ''."""
    is_tree = F.col("type") == "tree"
    own = F.when(is_tree, F.array("path")).otherwise(F.array().cast("array<string>"))
    found = listing.select(F.explode(F.concat(F.array(F.lit("")), paths.ancestors(F.col("path")), own)).alias("path")).distinct()
    folders = describe_folders(found, root_name)
    files = listing.where(F.col("type") == "blob").select("path", paths.base_name(F.col("path")).alias("name"),
                                                           paths.parent(F.col("path")).alias("parent_path"), "url")
    return folders, files


def describe_folders(found: DataFrame, root_name: str) -> DataFrame:
    is_root = F.col("path") == ""
    return found.select(
        "path", F.when(is_root, root_name).otherwise(paths.base_name(F.col("path"))).alias("name"),
        F.when(~is_root, paths.parent(F.col("path"))).alias("parent_path"), paths.tree_depth(F.col("path")).alias("tree_depth"))


def folders_of(files: DataFrame, root_name: str) -> DataFrame:
    """All folders at or above any file; folders collapse map-side before they meet."""
    own = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.array("folder"))
    found = files.select("folder").distinct().select(
        F.explode(F.concat(F.array(F.lit("")), paths.ancestors(F.col("folder")), own)).alias("path")).distinct()
    return describe_folders(found, root_name)


def list_level(folders: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """(name, path, is_file) one level below a folder; empty segments of the path are ignored."""
    at = "/".join(s for s in path.split("/") if s)
    subs = folders.where(F.col("parent_path") == at).select("name", "path", F.lit(False).alias("is_file"))
    return subs.unionByName(files.where(F.col("folder") == at).select("name", "path", F.lit(True).alias("is_file")))


def find_folder(folders: DataFrame, path: str) -> DataFrame:
    """The folder row at a path, or no row."""
    return folders.where(F.col("path") == "/".join(s for s in path.split("/") if s))


def list_to_depth(folders: DataFrame, files: DataFrame, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Folders to a depth, with the files of those above it; the deepest folders are stubs."""
    shown = folders.where(F.col("tree_depth") <= max_depth).withColumn("is_stub", F.col("tree_depth") == max_depth)
    return shown, files.where(paths.tree_depth(F.col("folder")) < max_depth)


def size_tiers(files: DataFrame, truncated: DataFrame | None = None, content_kb: int = CONTENT_LIMIT_KB,
               structure_kb: int = STRUCTURE_LIMIT_KB) -> DataFrame:
    """Per repository: size in KB, tier (content, structure, shallow) and whether it stays partial."""
    sizes = files.groupBy("repo").agg((F.sum("size") / 1000).alias("size_kb"))
    if truncated is not None:
        cut = truncated.select("repo").distinct().withColumn("__cut", F.lit(True))
        sizes = sizes.join(cut, "repo", "left")
    else:
        sizes = sizes.withColumn("__cut", F.lit(None).cast("boolean"))
    shallow = (F.col("size_kb") >= structure_kb) | F.coalesce("__cut", F.lit(False))
    tier = F.when(shallow, "shallow").when(F.col("size_kb") < content_kb, "content").otherwise("structure")
    return sizes.select("repo", "size_kb", tier.alias("tier"), shallow.alias("is_partial"))


def apply_tiers(files: DataFrame, tiers: DataFrame) -> DataFrame:
    """Files as their repository's tier allows: with text, without, or only those at the root.

    This drops content and is a choice of the caller; no other operator applies it.
    """
    joined = files.join(own_shuffle(tiers.select("repo", "tier")), "repo")
    kept = joined.where((F.col("tier") != "shallow") | (F.col("folder") == ""))
    return kept.withColumn("raw", F.when(F.col("tier") == "content", F.col("raw")).otherwise("")).drop("tier")
