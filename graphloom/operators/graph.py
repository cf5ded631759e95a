"""Building the graph: containment, imports, calls, type edges, merging, styling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.fixed import styles as S
from graphloom.functions import numbers, paths, text
from graphloom.operators import filters
from graphloom.operators.ranking import last_wins
from graphloom.operators.skew import own_shuffle
from graphloom.session import cut_lineage, stored


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    found = F.try_element_at(_literal_map(table), key)
    return found if default is None else F.coalesce(found, default)


def _node(id_: Column, depth: int, language: Column, kind: Column, label: Column, file: Column, *extra: Column) -> list[Column]:
    return [
        id_.alias("id"), F.lit(depth).alias("depth"), language.alias("language"), kind.alias("kind"),
        label.alias("label"), file.alias("file"), F.lit(0).alias("line"),
        F.create_map().cast("map<string,string>").alias("meta"), *extra,
    ]


def _unstyled() -> list[Column]:
    return [F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("color")]


def edge(src: Column, dst: Column, kind: str | Column, weight: float | Column = 1.0) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return [src.alias("src"), dst.alias("dst"), kind.alias("kind"), weight.alias("weight")]


def dir_id(path: Column) -> Column:
    return F.concat(F.lit("dir::"), path)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file::"), path)


def dir_nodes(folders: DataFrame) -> DataFrame:
    """Depth-0 nodes. `legacy_id` is the id by bare name, under which equal names merge."""
    return folders.select(
        *_node(dir_id(F.col("path")), 0, F.lit("unknown"), F.lit("directory"), F.col("name"), F.lit(""), *_unstyled()),
        F.concat(F.lit("dir::"), F.col("name")).alias("legacy_id"))


def dir_edges(folders: DataFrame) -> DataFrame:
    return folders.where(F.col("parent_path").isNotNull()).select(
        *edge(dir_id(F.col("parent_path")), dir_id(F.col("path")), "contains"))


def file_nodes(files: DataFrame) -> DataFrame:
    """Depth-1 nodes; the file attribute is the url, or the name when there is none."""
    return files.select(
        *_node(file_id(F.col("path")), 1, filters.ext_to_language(F.col("ext")), F.lit("file"), F.col("name"),
               text.or_else(F.col("url"), F.col("name")), *_unstyled()),
        F.concat(F.lit("file::"), paths.base_name(F.col("folder")), F.lit("/"), F.col("name")).alias("legacy_id"))


def file_edges(files: DataFrame) -> DataFrame:
    return files.select(*edge(dir_id(F.col("folder")), file_id(F.col("path")), "contains"))


def attach_roots(symbols: DataFrame, symbol_edges: DataFrame) -> DataFrame:
    """File -> each symbol that has no incoming edge within its own file.

    Symbols and the targets of edges meet in one aggregate, which no wrong guess of a size turns into a broadcast.
    """
    ends = symbols.select("file_id", "id", F.lit(False).alias("__below")).unionByName(
        symbol_edges.select("file_id", F.col("dst").alias("id"), F.lit(True).alias("__below")))
    roots = ends.groupBy("file_id", "id").agg(F.max("__below").alias("__below")).where(~F.col("__below"))
    return roots.select(*edge(F.col("file_id"), F.col("id"), "contains"))


def file_by_stem(files: DataFrame, seq: str = "seq") -> DataFrame:
    """stem -> file_id, the last file in listing order winning."""
    table = files.select("stem", file_id(F.col("path")).alias("file_id"), F.col(seq).alias("__seq"))
    return last_wins(table, ["stem"], "__seq").drop("__seq")


def attach_by_stem(symbols: DataFrame, stems: DataFrame) -> DataFrame:
    """File -> depth-2 symbol whose `file` attribute is the file's stem."""
    return symbols.where(F.col("depth") == 2).join(own_shuffle(stems.withColumnRenamed("stem", "file")), "file").select(
        *edge(F.col("file_id"), F.col("id"), "contains"))


def _resolved(imports: DataFrame, stems: DataFrame) -> DataFrame:
    """Distinct (file, module) pairs with the file their last segment names, if any."""
    # Repeats of one statement collapse map-side before the join meets a popular module.
    pairs = imports.select("file_id", "module").distinct()
    return pairs.withColumn("stem", F.substring_index("module", ".", -1)).join(
        own_shuffle(stems.withColumnRenamed("file_id", "target")).hint("merge"), "stem", "left")  # as many stems as files


def resolve_imports(imports: DataFrame, stems: DataFrame) -> DataFrame:
    """file -> file `depends_on` edges, one per pair."""
    return _internal(_resolved(imports, stems))


def _internal(resolved: DataFrame) -> DataFrame:
    hit = resolved.where(F.col("target") != F.col("file_id"))
    return hit.select(*edge(F.col("file_id"), F.col("target"), "depends_on")).dropDuplicates(["src", "dst"])


def external_refs(imports: DataFrame, stems: DataFrame) -> DataFrame:
    """(file, top-level package) of imports that name no other known file."""
    return _outside(_resolved(imports, stems))


def _outside(resolved: DataFrame) -> DataFrame:
    miss = resolved.where(F.col("target").isNull() | (F.col("target") == F.col("file_id")))
    return miss.select("file_id", F.substring_index("module", ".", 1).alias("top_level")).distinct()


def _external(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    id_ = F.concat(F.lit("external::"), F.col("top_level"))
    nodes = refs.select("top_level").distinct().select(
        *_node(id_, 1, F.lit("external"), F.lit("external_module"), F.col("top_level"), F.lit(""),
               F.lit(S.EXTERNAL_SHAPE).alias("shape"), F.lit(S.EXTERNAL_COLOR).alias("color")))
    return nodes, refs.select(*edge(F.col("file_id"), id_, "depends_on"))


def external_modules(imports: DataFrame, stems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and `depends_on` edges of packages outside the tree."""
    return _external(external_refs(imports, stems))


def dependencies(imports: DataFrame, stems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of outside packages, and all `depends_on` edges, to files and to packages: imports meet the files once."""
    resolved = cut_lineage(_resolved(imports, stems))
    nodes, edges = _external(_outside(resolved))
    return nodes, union_edges(_internal(resolved), edges)


# ---- declared C symbols -------------------------------------------------------------------

C_DEPTH_3 = ["field", "enum_constant"]
C_EDGE_KINDS = {"FIELD_OF": "field_of", "CALLS": "calls", "POINTS_TO": "type_of", "ALIASES": "aliases"}


def normalise_c_decls(decls: DataFrame, max_depth: int = 3) -> DataFrame:
    """Declared symbols as unified nodes with their meta map, shape and colour."""
    kind = F.col("kind")
    sides = F.when(kind.isin("struct", "union"),
                   numbers.clamp(F.coalesce(F.col("field_count"), F.lit(4)), 3, 10))
    meta = {
        "qualifiers": F.array_join(F.coalesce(F.col("qualifiers"), F.array().cast("array<string>")), ","),
        "type_str": F.coalesce(F.col("type_str"), F.lit("")),
        "field_count": F.col("field_count").cast("string"), "member_count": F.col("member_count").cast("string"),
        "param_count": F.col("param_count").cast("string"), "is_definition": F.col("is_definition").cast("string"),
        "sides": sides.cast("string"),
    }
    meta_map = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)])
    return decls.select(
        "id", F.when(kind.isin(C_DEPTH_3), 3).otherwise(2).alias("depth"), F.lit("c").alias("language"),
        text.or_else(kind, F.lit("symbol")).alias("kind"), F.coalesce(F.col("name"), F.col("id")).alias("label"),
        F.coalesce(F.col("file"), F.lit("")).alias("file"), F.coalesce(F.col("line"), F.lit(0)).alias("line"),
        F.map_filter(meta_map, lambda k, v: v.isNotNull()).alias("meta"),
        _lookup({k: v[0] for k, v in S.C_STYLE.items()}, kind).alias("shape"),
        _lookup({k: v[1] for k, v in S.C_STYLE.items()}, kind).alias("color"),
    ).where(F.col("depth") <= max_depth)


def field_of(decls: DataFrame) -> DataFrame:
    """Parent -> member edges; anonymous parents have no members of their own."""
    members = decls.where(F.col("kind").isin(C_DEPTH_3)).select("id", F.col("parent_id"), F.col("kind").alias("k"))
    parents = decls.where(~F.col("name").contains("unnamed")).select(F.col("id").alias("parent_id"), F.col("kind").alias("pk"))
    hit = members.join(parents, "parent_id").where((F.col("k") == "field") | (F.col("pk") == "enum"))
    return hit.select(*edge(F.col("parent_id"), F.col("id"), "FIELD_OF")).where("src <> dst").distinct()


def calls(call_sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call edges weighted by their number of call sites; counted before any join, so hot callees shrink first.

    Sites are dealt by pair before they are counted: a task holds its share of the pairs, not those of a whole split of the input.
    """
    counted = call_sites.repartition("src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return filters.known_endpoints(counted, nodes).where("src <> dst").select(
        *edge(F.col("src"), F.col("dst"), "CALLS", numbers.call_weight(F.col("n"))))


def _word_ends(word: Column, tails: bool) -> Column:
    """All non-empty suffixes (or prefixes) of a word."""
    n = F.length(word)
    pick = (lambda i: F.substring(word, i, n)) if tails else (lambda i: F.substring(word, F.lit(1), i))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), pick)).otherwise(F.array().cast("array<string>"))


def points_to(decls: DataFrame, substring: bool = False) -> DataFrame:
    """Field or variable -> struct named before a ' *' in its type.

    An equi-join on the extracted name. With `substring`, a name that only ends the pointed-to
    word counts too: the word's suffixes are joined instead of testing every pair.
    """
    users = decls.where(F.col("kind").isin("field", "variable"))
    named = users.select("id", F.explode(F.regexp_extract_all("type_str", F.lit(r"(\w+) \*"), F.lit(1))).alias("name"))
    if substring:
        named = named.select("id", F.explode(_word_ends(F.col("name"), tails=True)).alias("name"))
    structs = decls.where(F.col("kind") == "struct").select("name", F.col("id").alias("struct_id"))
    return named.distinct().join(structs, "name").select(*edge(F.col("id"), F.col("struct_id"), "POINTS_TO", 0.6)).where(
        "src <> dst").distinct()


def aliases(decls: DataFrame, substring: bool = False) -> DataFrame:
    """Typedef -> the struct, enum or union its type names; `substring` accepts a name that begins the tag."""
    users = decls.where(F.col("kind") == "typedef")
    tags = F.regexp_extract_all("type_str", F.lit(r"(?:struct|enum|union) (\w+)"), F.lit(1))
    named = users.select("id", F.explode(tags).alias("name"))
    if substring:
        named = named.select("id", F.explode(_word_ends(F.col("name"), tails=False)).alias("name"))
    tagged = decls.where(F.col("kind").isin("struct", "enum", "union")).select("name", F.col("id").alias("tag_id"))
    return named.distinct().join(tagged, "name").select(*edge(F.col("id"), F.col("tag_id"), "ALIASES", 0.8)).where(
        "src <> dst").distinct()


def map_edge_kinds(edges: DataFrame) -> DataFrame:
    """C edge kinds to unified ones; unknown kinds become `contains`."""
    return edges.withColumn("kind", _lookup(C_EDGE_KINDS, F.col("kind"), F.lit("contains")))


def map_python_edge_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`imports` into import nodes, else `contains`."""
    targets = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    return edges.drop("kind").join(targets, "dst").withColumn(
        "kind", F.when(F.col("dst_kind") == "import", "imports").otherwise("contains")).drop("dst_kind")


def flag_parse_warnings(nodes: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Mark nodes whose file (by stem) produced an error."""
    bad = diagnostics.select("file").distinct().withColumn("__w", F.lit(True))
    return nodes.join(own_shuffle(bad), "file", "left").withColumn("has_parse_warning", F.col("__w").isNotNull()).drop("__w")


# ---- lexicon ------------------------------------------------------------------------------

def lexicon_tokens(lexicons: DataFrame) -> DataFrame:
    """Nested lexicon documents as one row per token and context."""
    def side(name: str) -> DataFrame:
        return (
            lexicons.select("language", F.coalesce(F.nullif("display_name", F.lit("")), "language").alias("display_name"),
                            F.lit(name).alias("kind"), F.explode(f"{name}.layers").alias("l"))
            .select("*", F.explode("l.groups").alias("g")).select("*", F.explode("g.tokens").alias("t"))
        )
    return side("keywords").unionByName(side("operators")).select(
        "language", "display_name", "kind", F.col("l.ordinal").alias("layer_ordinal"), F.col("l.name").alias("layer_name"),
        F.trim(F.coalesce("l.gloss", F.lit(""))).alias("gloss"), F.col("g.name").alias("group"), "t.token",
        F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.since", F.lit("")).alias("since"))


def lexicon_graph(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """language -> kind -> layer -> group -> token, with one relation kind per step."""
    with_ids = tokens.select(
        "*", F.concat(F.lit("lang:"), F.col("language")).alias("id0"),
        F.concat_ws(":", F.lit("kind"), "language", "kind").alias("id1"),
    ).withColumn("id2", F.concat(F.col("id1"), F.lit(":L"), F.col("layer_ordinal").cast("string"))).withColumn(
        "id3", F.concat_ws(":", "id2", "group")).withColumn("id4", F.concat_ws(":", "id3", "token"))
    ordinal, kind = F.col("layer_ordinal"), F.col("kind")
    levels = [
        ("id0", F.col("display_name"), "language", F.lit(-1), F.lit("root")),
        ("id1", kind, "kind", F.lit(-1), kind),
        ("id2", F.concat(F.lit("L"), ordinal.cast("string"), F.lit(" "), F.col("layer_name")), "layer", ordinal, kind),
        ("id3", F.col("group"), "group", ordinal, kind),
        ("id4", F.col("token"), "token", ordinal, kind),
    ]
    # All levels leave in one pass over the tokens; duplicates combine map-side.
    node_rows = F.array(*[
        F.struct(F.col(i).alias("id"), label.alias("label"), F.lit(t).alias("type"), o.cast("int").alias("layer_ordinal"), k.alias("kind"))
        for i, label, t, o, k in levels])
    relations = ["has_kind", "has_layer", "has_group", "has_token"]
    edge_rows = F.array(*[
        F.struct(F.col(f"id{i}").alias("src"), F.col(f"id{i + 1}").alias("dst"), F.lit(r).alias("relation"))
        for i, r in enumerate(relations)])
    nodes = with_ids.select(F.inline(node_rows)).groupBy("id").agg(
        *[F.min(c).alias(c) for c in ("label", "type", "layer_ordinal", "kind")])
    return nodes, with_ids.select(F.inline(edge_rows)).distinct()


def enrich_tokens(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each token with every context its spelling has in the lexicon."""
    contexts = lexicon.select(
        "token", F.when(F.col("kind") == "keywords", "keyword").when(F.col("kind") == "operators", "operator")
        .otherwise(F.col("kind")).alias("kind"), "layer_ordinal", "layer_name", "group", "role", "since")
    return tokens.join(contexts, "token")


# ---- whole graphs -------------------------------------------------------------------------

def union_nodes(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


union_edges = union_nodes


MOST_REPEATED = 1_000_000  # repeated keys that are broadcast, eight bytes each


def _apart(rows: DataFrame, keys: list[str], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`merge` of the rows whose keys come again, with the others as they are; the keys are read first, once.

    Only hashes of the keys are dealt out to tell them apart, a fraction of the rows' disk. Equal hashes of other keys are no harm:
    such rows are merged by their keys. If very many come again, all rows are merged.
    """
    keyed = rows.withColumn("__key", F.xxhash64(*keys))
    seen = keyed.select("__key").repartition("__key").groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    again = stored(seen.where("n > 1").select("__key"), "repeated")
    if again.count() > MOST_REPEATED:
        return merge(rows)
    merged = merge(keyed.join(F.broadcast(again), "__key", "left_semi").drop("__key"))
    return merged.unionByName(keyed.join(F.broadcast(again), "__key", "left_anti").select(merged.columns))


def merge_nodes(*parts: DataFrame, apart: bool = False) -> DataFrame:
    """Union by id; per attribute the last part that has a value wins.

    Within a part the row with the least (file, line, label), as text, wins, whatever the order of the input.
    Ids hardly repeat, so rows are dealt by id before they are merged, and sorted once, by a hash that tells long ids apart at once.
    With `apart` the ids are read first, so that only rows of repeated ids are dealt out at all.
    """
    stacked = union_nodes(*[p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in stacked.columns if c not in ("id", "__part")]
    tie = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("file", "line", "label") if c in rest]
    place = F.struct((-F.col("__part")).alias("part"), *tie)
    latest = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest]

    def merged(rows: DataFrame) -> DataFrame:
        return rows.repartition("id").groupBy(F.xxhash64("id").alias("__hash"), "id").agg(*latest).drop("__hash")

    return _apart(stacked, ["id"], merged) if apart else merged(stacked)


def replace_subtree(files: DataFrame, replacement: DataFrame, folder: str) -> DataFrame:
    """Swap everything at or below a folder for another listing."""
    below = (F.col("path") == folder) | F.col("path").startswith(folder.rstrip("/") + "/")
    return files.where(~below).unionByName(replacement)


def dedupe_edges(edges: DataFrame, keys: list[str] | None = None, apart: bool = False) -> DataFrame:
    """One edge per key; of several the heaviest, then the first kind in alphabetical order, is kept.

    With `apart` the keys are read first, so that only edges of repeated keys are dealt out.
    """
    keys = keys or ["src", "dst", "kind"]
    if apart:
        return _apart(edges, keys, lambda repeated: dedupe_edges(repeated, keys))
    rest = [c for c in edges.columns if c not in keys]
    if not rest:
        return edges.distinct()
    if rest == ["weight"]:
        # A plain number needs no sorting of the edges, as a struct does.
        return edges.groupBy(*keys).agg((-F.min(-F.col("weight"))).alias("weight")).select(edges.columns)
    order = [(-F.col(c)).alias(f"k{i}") if c == "weight" else F.col(c).alias(f"k{i}") for i, c in enumerate(rest)]
    return edges.groupBy(*keys).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in rest]).select(edges.columns)


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the columns of both end nodes, prefixed src_ and dst_."""
    def side(p: str) -> DataFrame:
        return nodes.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in nodes.columns if c != "id"])

    return edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")


def attach_by_label(symbols: DataFrame, files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, parent) of symbols without a parent: by the stem of their file attribute, else by the attribute itself.

    Sub-symbols (depth 3 and more) go to the first symbol, by id, of the same file.
    """
    labels = files.groupBy("label").agg(F.max("id").alias("parent"))
    todo = symbols if known is None else symbols.join(known.select("id").distinct(), "id", "left_anti")
    todo = todo.where(F.coalesce("file", F.lit("")) != "").withColumn(
        "__stem", F.regexp_replace(paths.base_name(F.col("file")), r"\.[^.]*$", ""))
    by_stem = labels.select(F.col("label").alias("__stem"), F.col("parent").alias("p1"))
    by_attr = labels.select(F.col("label").alias("file"), F.col("parent").alias("p2"))
    found = todo.join(own_shuffle(by_stem), "__stem", "left").join(own_shuffle(by_attr), "file", "left")
    syms = found.where((F.col("depth") == 2) & (F.col("p1").isNotNull() | F.col("p2").isNotNull())).select(
        "id", F.coalesce("p1", "p2").alias("parent"))
    placed = syms if known is None else syms.unionByName(known.select("id", "parent").join(
        symbols.where("depth = 2").select("id"), "id", "left_semi"))
    first_symbol = placed.groupBy(F.col("parent").alias("p1")).agg(F.min("id").alias("first"))
    subs = found.where((F.col("depth") >= 3) & F.col("p1").isNotNull()).select("id", "p1").join(first_symbol, "p1").select(
        "id", F.col("first").alias("parent"))
    return syms.unionByName(subs)


# ---- styles -------------------------------------------------------------------------------

def palette(spark) -> DataFrame:
    """The fixed type palette: one row per known type (about 80 rows)."""
    return spark.createDataFrame(
        S.palette_rows(), "type string, base string, label string, alpha double, size int, shape string, color string")


def style_by_type(nodes: DataFrame, type_col: str = "type") -> DataFrame:
    """base, label, alpha, size, shape and colour of each node's type; unknown types get the Unknown style."""
    p = palette(nodes.sparkSession)
    known = F.broadcast(p.select(F.col("type").alias(type_col), *[F.col(c).alias(f"p_{c}") for c in p.columns if c != "type"]))
    unknown = {r["base"]: r for r in [dict(zip(p.columns, row)) for row in S.palette_rows()]}["unknown"]
    out = nodes.join(known, type_col, "left")
    for c in ("base", "label", "alpha", "size", "shape", "color"):
        out = out.withColumn(f"p_{c}", F.coalesce(F.col(f"p_{c}"), F.lit(unknown[c])))
    return out


def default_style(nodes: DataFrame, degrees: DataFrame | None = None, theme: dict[str, str] | None = None) -> DataFrame:
    """Fill missing shape and colour: by depth, then kind, then (colour only) by degree."""
    theme = theme or {}
    kind, depth = F.col("kind"), F.col("depth")
    themed = {k: theme.get(key, default) for k, key, default in S.THEME_KINDS}
    if degrees is None:
        styled = nodes.withColumn("__degree", F.lit(0))
    else:
        styled = nodes.join(degrees.select("id", F.col("degree").alias("__degree")), "id", "left")
    hue = F.concat(F.lit("hsl("), ((F.coalesce("__degree", F.lit(0)) * 30) % 360).cast("string"), F.lit(", 70%, 60%)"))
    own_color = F.when((F.col("color") != "") & (F.col("color") != S.UNSET_COLOR), F.col("color"))
    return styled.withColumn("shape", F.coalesce(
        F.nullif("shape", F.lit("")), _lookup(S.DEPTH_SHAPE, depth), _lookup(S.KIND_SHAPE, kind), F.lit("circle"))
    ).withColumn("color", F.coalesce(
        own_color, _lookup(S.DEPTH_COLOR, depth), _lookup(themed, kind), _lookup(S.KIND_COLOR, kind), hue)).drop("__degree")
