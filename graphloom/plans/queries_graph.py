"""Queries over the containment tree, call sites, imports and declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.fixed import styles as S
from graphloom.operators import filters, graph, ranking, stats, traverse
from graphloom.plans import inputs as I
from graphloom.plans.registry import query, table
from graphloom.sources import files as tree

W = I.with_inputs
MID = "SELECT id FROM tree_nodes WHERE depth = 2 AND kind = 'machinery'"


def _selection(spark, sf):
    return I.tree_nodes(spark, sf).where("depth = 2 and kind = 'machinery'").select("id")


# ---- filters on nodes and edges -----------------------------------------------------------

@query(W("tree_nodes", "tree_edges") + """
    SELECT src, dst FROM tree_edges WHERE src IN (SELECT id FROM tree_nodes WHERE depth <= 2) AND dst IN (SELECT id FROM tree_nodes WHERE depth <= 2)""")
def b6_b10_depth_and_endpoints(spark, sf):
    kept = filters.depth_filter(I.tree_nodes(spark, sf), filters.mode_to_depth("ast"))
    return filters.known_endpoints(I.tree_edges(spark, sf), kept).select("src", "dst")


@query(W("call_nodes", "call_sites") + "SELECT id FROM call_nodes WHERE id IN (SELECT src FROM call_sites UNION SELECT dst FROM call_sites)")
def b11_connected_only(spark, sf):
    return filters.connected_only(I.call_nodes(spark, sf), I.call_sites(spark, sf)).select("id")


@query(W("tree_nodes", "tree_edges") + f"""
    SELECT 'node' AS part, id, '' AS other FROM tree_nodes WHERE id NOT IN ({MID})
    UNION ALL SELECT 'edge', src, dst FROM tree_edges WHERE src NOT IN ({MID}) AND dst NOT IN ({MID})""")
def b12_drop_nodes(spark, sf):
    nodes, edges = filters.drop_nodes(I.tree_nodes(spark, sf), I.tree_edges(spark, sf), _selection(spark, sf))
    return nodes.select(F.lit("node").alias("part"), "id", F.lit("").alias("other")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("dst").alias("other")))


# 'directory' mode stops at files.
@query(W("tree_nodes") + "SELECT kind, count(*) AS n FROM tree_nodes WHERE depth <= 1 GROUP BY kind")
def b13_mode_to_depth(spark, sf):
    return stats.kind_counts(filters.depth_filter(I.tree_nodes(spark, sf), filters.mode_to_depth("directory")))


@query(W("tree_nodes") + f"SELECT id FROM tree_nodes WHERE id NOT IN ({MID})")
def b14_invert_selection(spark, sf):
    return filters.invert_selection(I.tree_nodes(spark, sf), _selection(spark, sf))


@query(W("tree_nodes") + "SELECT id FROM tree_nodes")
def b14_select_all(spark, sf):
    return filters.select_all(I.tree_nodes(spark, sf))


@query(W("c_decls") + "SELECT id, name FROM c_decls WHERE NOT contains(name, 'unnamed') AND NOT contains(name, 'anonymous')")
def b15_drop_anonymous(spark, sf):
    return filters.drop_anonymous(I.c_decls(spark, sf)).select("id", "name")


# Attributes at the top and in the metadata; a key of both comes from the metadata.
@query("""
    SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS kind, p_name AS label, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS size FROM part""")
def b17_flatten_metadata(spark, sf):
    top = F.create_map(F.lit("kind"), F.col("p_brand"), F.lit("label"), F.col("p_name"))
    meta = F.when(F.col("p_size") > 25, F.create_map(F.lit("kind"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")))
    flat = filters.flatten_metadata(table(spark, sf, "part").select("p_partkey", top.alias("attrs"), meta.alias("metadata")))
    return flat.select("p_partkey", *[F.try_element_at("attrs", F.lit(k)).alias(k) for k in ("kind", "label", "size")])


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL")
def b19_no_self_loops(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return filters.no_self_loops(rows).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(W("c_decls") + "SELECT id FROM c_decls WHERE file IN (SELECT 's' || n_nationkey FROM nation WHERE n_regionkey <= 2)")
def b21_in_target(spark, sf):
    stems = table(spark, sf, "nation").where("n_regionkey <= 2").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("stem"))
    return filters.in_target(I.c_decls(spark, sf), stems).select("id")


@query(W("tree_edges", "tree_nodes") + f"SELECT id FROM tree_nodes WHERE id NOT IN (SELECT dst FROM tree_edges WHERE src IN ({MID}))")
def g2_except(spark, sf):
    gone = I.tree_edges(spark, sf).join(_selection(spark, sf).withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    return filters.except_ids(I.tree_nodes(spark, sf).select("id"), gone)


# ---- building -----------------------------------------------------------------------------

@query(W("page_folders") + """
    SELECT 'dir::' || path AS id, CAST(0 AS BIGINT) AS depth, 'directory' AS kind, 'unknown' AS language, name AS label, 'dir::' || name AS legacy_id FROM page_folders
    UNION ALL SELECT DISTINCT 'file::' || path, CAST(1 AS BIGINT), 'file', CASE WHEN lower(ext) = '.html' THEN 'html' ELSE 'unknown' END, name,
           'file::' || string_split(folder, '/')[-1] || '/' || name FROM page_files""")
def d1_d2_structure_nodes(spark, sf):
    files = I.page_files(spark, sf)
    nodes = graph.union_nodes(graph.dir_nodes(I.page_folders(spark, sf)), graph.file_nodes(files))
    return nodes.select("id", F.col("depth").cast("long").alias("depth"), "kind", "language", "label", "legacy_id").distinct()


@query(W("page_folders") + """
    SELECT 'dir::' || parent_path AS src, 'dir::' || path AS dst, 'contains' AS kind FROM page_folders WHERE parent_path IS NOT NULL
    UNION ALL SELECT DISTINCT 'dir::' || folder, 'file::' || path, 'contains' FROM page_files""")
def d1_d2_structure_edges(spark, sf):
    files = I.page_files(spark, sf)
    return graph.dedupe_edges(graph.union_edges(graph.dir_edges(I.page_folders(spark, sf)), graph.file_edges(files))).select("src", "dst", "kind")


@query(W("import_stems", "c_decls") + """
    SELECT s.file_id AS src, 'part::' || p_partkey AS dst, 'contains' AS kind FROM part JOIN import_stems s ON s.stem = lower(replace(p_brand, '#', '_')) WHERE p_size < 30""")
def d4_attach_by_stem(spark, sf):
    symbols = table(spark, sf, "part").select(
        F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("file"),
        F.when(F.col("p_size") < 30, 2).otherwise(3).alias("depth"))
    return graph.attach_by_stem(symbols, graph.file_by_stem(I.import_files(spark, sf))).select("src", "dst", "kind")


_RESOLVED = W("import_rows", "import_stems") + ", r AS (SELECT DISTINCT i.file_id AS src, s.file_id AS dst, i.module FROM import_rows i LEFT JOIN import_stems s ON s.stem = string_split(module, '.')[-1])"


@query(_RESOLVED + "SELECT DISTINCT src, dst FROM r WHERE dst IS NOT NULL AND dst <> src")
def d5_resolve_imports(spark, sf):
    return graph.resolve_imports(I.import_rows(spark, sf), graph.file_by_stem(I.import_files(spark, sf))).select("src", "dst")


@query(_RESOLVED + """
    SELECT DISTINCT 'edge' AS part, src AS id, 'external::' || string_split(module, '.')[1] AS other FROM r WHERE dst IS NULL OR dst = src
    UNION ALL SELECT DISTINCT 'node', 'external::' || string_split(module, '.')[1], string_split(module, '.')[1] FROM r WHERE dst IS NULL OR dst = src""")
def d6_external_modules(spark, sf):
    nodes, edges = graph.external_modules(I.import_rows(spark, sf), graph.file_by_stem(I.import_files(spark, sf)))
    return edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(
        nodes.select(F.lit("node").alias("part"), "id", F.col("label").alias("other")))


@query(W("c_decls") + """
    SELECT m.parent_id AS src, m.id AS dst FROM c_decls m JOIN c_decls p ON p.id = m.parent_id
    WHERE (m.kind = 'field' OR (m.kind = 'enum_constant' AND p.kind = 'enum')) AND NOT contains(p.name, 'unnamed')""")
def d7_field_of(spark, sf):
    return graph.field_of(I.c_decls(spark, sf)).select("src", "dst")


@query(W("call_sites", "call_nodes") + """
    SELECT src, dst, CAST(round(least(3.0, 0.5 + 0.4 * count(*)), 6) AS DOUBLE) AS weight FROM call_sites
    WHERE src IN (SELECT id FROM call_nodes) AND dst IN (SELECT id FROM call_nodes) GROUP BY src, dst""")
def d8_calls(spark, sf):
    return graph.calls(I.call_sites(spark, sf), I.call_nodes(spark, sf)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(W("c_decls") + """
    SELECT u.id AS src, s.id AS dst FROM c_decls u JOIN c_decls s ON s.kind = 'struct' AND regexp_extract(u.type_str, '(\\w+) \\*', 1) = s.name
    WHERE u.kind IN ('field', 'variable')""".replace("\\\\", "\\"))
def d9_points_to(spark, sf):
    return graph.points_to(I.c_decls(spark, sf)).select("src", "dst")


@query(W("c_decls") + "SELECT u.id AS src, s.id AS dst FROM c_decls u JOIN c_decls s ON s.kind = 'struct' AND contains(u.type_str, s.name || ' *') WHERE u.kind IN ('field', 'variable')")
def d9_points_to_substring(spark, sf):
    return graph.points_to(I.c_decls(spark, sf), substring=True).select("src", "dst")


@query(W("c_decls") + """
    SELECT u.id AS src, s.id AS dst FROM c_decls u JOIN c_decls s ON s.kind IN ('struct', 'enum', 'union') AND u.type_str = 'struct ' || s.name WHERE u.kind = 'typedef'""")
def d10_aliases(spark, sf):
    return graph.aliases(I.c_decls(spark, sf)).select("src", "dst")


@query(W("c_decls") + """
    SELECT u.id AS src, s.id AS dst FROM c_decls u JOIN c_decls s ON s.kind IN ('struct', 'enum', 'union')
      AND (contains(u.type_str, 'struct ' || s.name) OR contains(u.type_str, 'enum ' || s.name) OR contains(u.type_str, 'union ' || s.name)) WHERE u.kind = 'typedef'""")
def d10_aliases_substring(spark, sf):
    return graph.aliases(I.c_decls(spark, sf), substring=True).select("src", "dst")


@query(W("c_decls") + """
    SELECT 'type_of' AS kind, count(*) AS n FROM c_decls u JOIN c_decls s ON s.kind = 'struct' AND u.type_str = 'const struct ' || s.name || ' *' WHERE u.kind IN ('field', 'variable')
    UNION ALL SELECT 'aliases', count(*) FROM c_decls u JOIN c_decls s ON s.kind IN ('struct', 'enum', 'union') AND u.type_str = 'struct ' || s.name WHERE u.kind = 'typedef'
    UNION ALL SELECT 'field_of', count(*) FROM c_decls m JOIN c_decls p ON p.id = m.parent_id WHERE m.kind = 'field' OR (m.kind = 'enum_constant' AND p.kind = 'enum')""")
def d11_edge_kinds(spark, sf):
    decls = I.c_decls(spark, sf)
    return stats.kind_counts(graph.map_edge_kinds(graph.union_edges(graph.points_to(decls), graph.aliases(decls), graph.field_of(decls))))


@query(W("c_decls") + """
    SELECT u.id AS src, s.id AS dst, 'type_of' AS kind FROM c_decls u JOIN c_decls s ON s.kind = 'struct' AND u.type_str = 'const struct ' || s.name || ' *' WHERE u.kind IN ('field', 'variable')
    UNION ALL SELECT u.id, s.id, 'aliases' FROM c_decls u JOIN c_decls s ON s.kind IN ('struct', 'enum', 'union') AND u.type_str = 'struct ' || s.name WHERE u.kind = 'typedef'
    UNION ALL SELECT m.parent_id, m.id, 'field_of' FROM c_decls m JOIN c_decls p ON p.id = m.parent_id WHERE m.kind = 'field' OR (m.kind = 'enum_constant' AND p.kind = 'enum')""")
def d11_edge_kind_rows(spark, sf):
    decls = I.c_decls(spark, sf)
    return graph.map_edge_kinds(graph.union_edges(graph.points_to(decls), graph.aliases(decls), graph.field_of(decls))).select("src", "dst", "kind")


@query(W("tree_edges", "tree_nodes") + """
    SELECT CASE WHEN n.kind = 'machinery' THEN 'imports' ELSE 'contains' END AS kind, count(*) AS n FROM tree_edges JOIN tree_nodes n ON n.id = dst GROUP BY 1""")
def d11_python_edge_kinds(spark, sf):
    nodes = I.tree_nodes(spark, sf).withColumn("kind", F.when(F.col("kind") == "machinery", "import").otherwise(F.col("kind")))
    return stats.kind_counts(graph.map_python_edge_kinds(I.tree_edges(spark, sf), nodes))


@query("""SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_parse_warning FROM documents""")
def d12_flag_parse_warnings(spark, sf):
    nodes = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file"))
    errors = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("file"))
    return graph.flag_parse_warnings(nodes, errors).select("doc_id", "has_parse_warning")


_C_SIDES = "CASE WHEN kind IN ('struct', 'union') THEN CAST(least(greatest(coalesce(field_count, 4), 3), 10) AS VARCHAR) END"


@query(W("c_decls") + f"""
    SELECT id, CAST(CASE WHEN kind IN ('field', 'enum_constant') THEN 3 ELSE 2 END AS BIGINT) AS depth, kind, name AS label, file, CAST(line AS BIGINT) AS line,
           {_C_SIDES} AS sides, type_str, CASE kind {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in S.C_STYLE.items())} END AS shape,
           CASE kind {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in S.C_STYLE.items())} END AS color FROM c_decls""")
def c4_normalise_c_decls(spark, sf):
    decls = I.c_decls(spark, sf).withColumns({
        "qualifiers": F.array().cast("array<string>"), "member_count": F.lit(None).cast("int"), "param_count": F.lit(None).cast("int"),
        "is_definition": F.lit(None).cast("boolean")})
    nodes = graph.normalise_c_decls(decls)
    return nodes.select("id", F.col("depth").cast("long").alias("depth"), "kind", "label", "file", F.col("line").cast("long").alias("line"),
                        F.try_element_at("meta", F.lit("sides")).alias("sides"), F.try_element_at("meta", F.lit("type_str")).alias("type_str"), "shape", "color")


@query(W("tree_nodes") + """
    SELECT id, CASE WHEN depth = 2 AND line > 100 THEN 'renamed ' || label ELSE label END AS label, kind, CASE WHEN depth = 2 AND line > 100 THEN 'new' END AS extra FROM tree_nodes""")
def d15_merge_graphs(spark, sf):
    nodes = I.tree_nodes(spark, sf).select("id", "label", "kind")
    later = I.tree_nodes(spark, sf).where("depth = 2 and line > 100").select("id", F.concat(F.lit("renamed "), F.col("label")).alias("label"), F.lit("new").alias("extra"))
    return graph.merge_nodes(nodes, later)


@query(W("page_files") + """, h AS (SELECT min(repo) AS h FROM page_files)
    SELECT path FROM page_files, h WHERE path <> h AND NOT starts_with(path, h || '/') UNION ALL SELECT h || '/new/' || page_id FROM page_files, h WHERE starts_with(path, h || '/')""")
def d15_replace_subtree(spark, sf):
    files = I.page_files(spark, sf)
    host = files.agg(F.min("repo")).first()[0]
    new = files.where(F.col("path").startswith(host + "/")).select(F.concat(F.lit(host + "/new/"), F.col("page_id").cast("string")).alias("path"))
    return graph.replace_subtree(files.select("path"), new, host)


@query(W("call_sites") + "SELECT DISTINCT src, dst FROM call_sites")
def d16_dedupe_edges(spark, sf):
    return graph.dedupe_edges(I.call_sites(spark, sf), ["src", "dst"])


@query(W("tree_edges", "tree_nodes") + """
    SELECT src, dst, s.label AS src_label, d.label AS dst_label, d.kind AS dst_kind FROM tree_edges LEFT JOIN tree_nodes s ON s.id = src LEFT JOIN tree_nodes d ON d.id = dst""")
def d17_resolve_endpoints(spark, sf):
    found = graph.resolve_endpoints(I.tree_edges(spark, sf), I.tree_nodes(spark, sf))
    return found.select("src", "dst", "src_label", "dst_label", "dst_kind")


@query(W("tree_nodes") + """, f AS (SELECT label, max(id) AS id FROM tree_nodes WHERE depth = 1 GROUP BY label)
    SELECT n.id, f.id AS parent FROM tree_nodes n JOIN f ON f.label = n.file WHERE depth = 2""")
def d19_attach_by_label(spark, sf):
    nodes = I.tree_nodes(spark, sf)
    return graph.attach_by_label(nodes.where("depth >= 2"), nodes.where("depth = 1")).select("id", "parent")


# All branches: by the stem of a path, by the attribute itself, and members to the first symbol of their file (those without a stem stay out).
@query("""
    WITH f AS (SELECT n_name AS label, 'file::' || n_name AS id FROM nation UNION ALL SELECT 'R.' || n_nationkey || '.c', 'file::R' || n_nationkey FROM nation),
    s AS (SELECT 'sym::' || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'file::' || n_name WHEN 1 THEN 'file::' || n_name ELSE 'file::R' || n_nationkey END AS parent
      FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT id, parent FROM s UNION ALL SELECT 'sub::' || o_orderkey, (SELECT min(id) FROM s WHERE s.parent = 'file::' || n_name)
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM s WHERE s.parent = 'file::' || n_name)""")
def d19_attach_by_any_label(spark, sf):
    nation = table(spark, sf, "nation")
    plain, dotted = F.col("n_name"), F.concat(F.lit("R."), F.col("n_nationkey").cast("string"), F.lit(".c"))
    files = nation.select(F.concat(F.lit("file::"), plain).alias("id"), plain.alias("label")).unionByName(
        nation.select(F.concat(F.lit("file::R"), F.col("n_nationkey").cast("string")).alias("id"), dotted.alias("label")))
    people = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation.select("n_nationkey", "n_name"), "n_nationkey")
    third = F.col("c_custkey") % 3
    symbols = people.select(F.concat(F.lit("sym::"), F.col("c_custkey").cast("string")).alias("id"), F.lit(2).alias("depth"),
                            F.when(third == 0, F.concat(F.lit("src/"), plain, F.lit(".c"))).when(third == 1, plain).otherwise(dotted).alias("file"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(people, "c_custkey")
    members = orders.select(F.concat(F.lit("sub::"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(3).alias("depth"),
                            F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("lib/"), plain, F.lit(".h"))).otherwise(dotted).alias("file"))
    return graph.attach_by_label(symbols.unionByName(members), files).select("id", "parent")


# Each order contains its lines: depth 4, climbing two steps to the customer.
@query("""
    SELECT 'line::' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS id, min('sym::' || o_custkey) AS parent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    UNION ALL SELECT 'sub::' || o_orderkey, 'sym::' || o_custkey FROM orders""")
def d20_nearest_symbol_ancestor(spark, sf):
    line = F.concat(F.lit("line::"), F.concat_ws(".", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]))
    # Lines of one id are one node: the operator takes every id once.
    rows = table(spark, sf, "lineitem").select(line.alias("dst"), F.concat(F.lit("sub::"), F.col("l_orderkey").cast("string")).alias("src"))
    nodes = I.tree_nodes(spark, sf).select("id", "depth").unionByName(rows.select(F.col("dst").alias("id"), F.lit(4).alias("depth")))
    edges = I.tree_edges(spark, sf).select("src", "dst").unionByName(rows.select("src", "dst"))
    return traverse.nearest_symbol_ancestor(nodes, edges)


_STYLE = {r[0]: r for r in S.palette_rows()}
_AS_TYPE = "CASE p_type WHEN 'PROMO' THEN 'ClassDef' WHEN 'ECONOMY' THEN 'Import' WHEN 'SMALL' THEN 'While' WHEN 'MEDIUM' THEN 'BinOp' ELSE 'Other' END"


@query(f"SELECT p_partkey, t.base, t.label, CAST(t.alpha AS DOUBLE) AS alpha, CAST(t.size AS BIGINT) AS size, t.shape, t.color FROM (SELECT p_partkey, {_AS_TYPE} AS type FROM part) JOIN (VALUES "
       + ", ".join(str((a,) + _STYLE[b][1:]) for a, b in (("ClassDef", "ClassDef"), ("Import", "Import"), ("While", "While"), ("BinOp", "BinOp"), ("Other", "Unknown")))
       + ") t(type, base, label, alpha, size, shape, color) USING (type)")
def d21_style_by_type(spark, sf):
    kind = F.col("p_type")
    as_type = F.when(kind == "PROMO", "ClassDef").when(kind == "ECONOMY", "Import").when(kind == "SMALL", "While").when(kind == "MEDIUM", "BinOp").otherwise("Other")
    styled = graph.style_by_type(table(spark, sf, "part").select("p_partkey", as_type.alias("type")))
    return styled.select("p_partkey", *[F.col(f"p_{c}").alias(c) for c in ("base", "label", "alpha", "shape", "color")], F.col("p_size").cast("long").alias("size"))


@query(W("tree_nodes", "tree_edges") + """, d AS (SELECT id, count(e) AS degree FROM (SELECT id, unnest([1]) AS one FROM tree_nodes) n LEFT JOIN (SELECT src AS e FROM tree_edges UNION ALL SELECT dst FROM tree_edges) x ON x.e = n.id GROUP BY id)
    SELECT id, CASE WHEN depth = 0 THEN 'diamond' WHEN depth = 1 THEN 'square' ELSE 'circle' END AS shape,
           CASE WHEN depth = 0 THEN '#7f8c8d' WHEN depth = 1 THEN '#9b59b6' ELSE 'hsl(' || (degree * 30) % 360 || ', 70%, 60%)' END AS color FROM tree_nodes JOIN d USING (id)""")
def d21_default_style(spark, sf):
    nodes = I.tree_nodes(spark, sf).withColumns({"shape": F.lit(None).cast("string"), "color": F.lit(None).cast("string")})
    degrees = stats.degrees(nodes, I.tree_edges(spark, sf))
    return graph.default_style(nodes, degrees).select("id", "shape", "color")


# ---- statistics ---------------------------------------------------------------------------

I.CTE["tree_degrees"] = (["tree_nodes", "tree_edges"], """
    SELECT n.*, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree FROM tree_nodes n
    LEFT JOIN (SELECT dst AS id, count(*) AS i FROM tree_edges GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM tree_edges GROUP BY 1) USING (id)""")


@query(W("tree_nodes", "tree_edges") + "SELECT (SELECT count(*) FROM tree_nodes) AS node_count, (SELECT count(*) FROM tree_edges) AS edge_count, 'Spring' AS layout, 'd3' AS type")
def e5_graph_metadata(spark, sf):
    return stats.graph_metadata(I.tree_nodes(spark, sf), I.tree_edges(spark, sf), "Spring")


@query(W("tree_degrees") + "SELECT id, in_degree, out_degree, degree FROM tree_degrees")
def e6_degrees(spark, sf):
    return stats.degrees(I.tree_nodes(spark, sf), I.tree_edges(spark, sf)).select("id", "in_degree", "out_degree", "degree")


@query(W("tree_degrees") + "SELECT id, CASE depth WHEN 0 THEN 40 WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 6 ELSE 10 END + 10 * degree AS size FROM tree_degrees")
def e7_node_size(spark, sf):
    return stats.node_size(I.tree_nodes(spark, sf), I.tree_edges(spark, sf)).select("id", "size")


@query(W("tree_degrees") + "SELECT id, round((degree - min(degree) OVER ()) / CAST(max(degree) OVER () - min(degree) OVER () AS DOUBLE), 6) AS scale FROM tree_degrees")
def e8_degree_scale(spark, sf):
    degrees = stats.degrees(I.tree_nodes(spark, sf), I.tree_edges(spark, sf))
    return stats.degree_scale(degrees).select("id", F.round("scale", 6).alias("scale"))


@query(W("c_decls") + """
    SELECT o.id, o.kind, count(*) FILTER (WHERE m.kind = CASE o.kind WHEN 'struct' THEN 'field' ELSE 'enum_constant' END) AS members
    FROM c_decls o LEFT JOIN c_decls m ON m.parent_id = o.id WHERE o.kind IN ('struct', 'enum') GROUP BY o.id, o.kind
    UNION ALL SELECT id, kind, 0 FROM c_decls WHERE kind = 'function'""")
def e13_member_counts(spark, sf):
    return stats.member_counts(I.c_decls(spark, sf))


@query(W("tree_edges", "tree_nodes") + """
    SELECT parent, CAST(floor((rn - 1) / 1000) AS BIGINT) AS chunk, count(*) AS n, min(id) AS first, max(id) AS last
    FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY id) AS rn FROM (SELECT id, coalesce(src, 'Unknown') AS parent FROM tree_nodes LEFT JOIN tree_edges ON dst = id)) GROUP BY ALL""")
def e18_group_by_parent(spark, sf):
    parents = I.tree_edges(spark, sf).select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    grouped = stats.group_by_parent(I.tree_nodes(spark, sf).select("id").join(parents, "id", "left"), chunk=1000)
    return grouped.select("parent", "chunk", F.size("items").cast("long").alias("n"), F.get("items", F.lit(0)).alias("first"), F.element_at("items", -1).alias("last"))


@query(W("tree_nodes") + "SELECT count(DISTINCT nullif(file, '')) AS n_files FROM tree_nodes")
def e19_distinct_files(spark, sf):
    return stats.distinct_files(I.tree_nodes(spark, sf))


@query(W("tree_nodes") + "SELECT id, row_number() OVER (PARTITION BY file ORDER BY line, id) AS rn, count(*) OVER (PARTITION BY file) AS n FROM tree_nodes WHERE depth = 2")
def e21_f2_file_clusters(spark, sf):
    return ranking.source_order(I.tree_nodes(spark, sf).where("depth = 2")).select("id", "rn", "n")


@query(W("tree_nodes") + "SELECT id, kind, dense_rank() OVER (ORDER BY kind) - 1 AS code, (dense_rank() OVER (ORDER BY kind) - 1) % 4 AS slot FROM tree_nodes")
def e22_category_code(spark, sf):
    return stats.category_code(I.tree_nodes(spark, sf).select("id", "kind"), "kind", 4)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1".replace("(o_orderdate, o_orderkey)", "epoch(o_orderdate) * 1000000000 + o_orderkey"))
def f5_last_wins(spark, sf):
    return ranking.last_wins(table(spark, sf, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


@query(W("tree_nodes") + "SELECT id, row_number() OVER (ORDER BY depth, id) AS seq FROM tree_nodes")
def f10_emit_order(spark, sf):
    return ranking.emit_order(I.tree_nodes(spark, sf)).select("id", "seq")


@query("SELECT 'part::' || l_partkey AS id, min(l_orderkey) AS file_seq FROM lineitem GROUP BY 1")
def f18_first_declaring_file(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_orderkey").alias("file_seq"))
    return ranking.first_declaring_file(rows)


@query(W("tree_nodes", "call_nodes") + "SELECT count(*) AS nodes, count(DISTINCT id) AS ids FROM (SELECT id FROM tree_nodes UNION ALL SELECT id FROM call_nodes)")
def g1_union_nodes(spark, sf):
    return graph.union_nodes(I.tree_nodes(spark, sf), I.call_nodes(spark, sf)).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("id").alias("ids"))


@query(W("tree_nodes", "call_nodes") + "SELECT id, label, depth FROM tree_nodes UNION ALL SELECT id, label, NULL FROM call_nodes")
def g1_union_rows(spark, sf):
    """Rows of both parts; a column that one part lacks is null there."""
    return graph.union_nodes(I.tree_nodes(spark, sf), I.call_nodes(spark, sf)).select("id", "label", F.col("depth").cast("int").alias("depth"))


@query(W("call_sites") + "SELECT src AS id FROM call_sites UNION SELECT dst FROM call_sites")
def g3_distinct_endpoints(spark, sf):
    return filters.endpoints(I.call_sites(spark, sf))


# ---- traversal ----------------------------------------------------------------------------

_ROOT = "dir::ASIA"


@query(W("tree_edges") + f", d AS (SELECT '{_ROOT}' AS id UNION SELECT dst FROM tree_edges JOIN d ON src = d.id) SELECT id FROM d WHERE id <> '{_ROOT}'")
def h1_descendants(spark, sf):
    edges = I.tree_edges(spark, sf)
    return traverse.descendants(edges, I.tree_nodes(spark, sf).where(F.col("id") == _ROOT))


@query(W("tree_nodes", "tree_edges") + """, d AS (SELECT 'file::NATION_3' AS id UNION SELECT dst FROM tree_edges JOIN d ON src = d.id)
    SELECT 'node' AS part, id, kind AS other FROM tree_nodes WHERE id IN (SELECT id FROM d) UNION ALL SELECT 'edge', src, dst FROM tree_edges WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)
    UNION ALL SELECT 'meta', CAST((SELECT count(*) FROM d) AS VARCHAR), CAST((SELECT count(*) FROM tree_edges WHERE src IN (SELECT id FROM d)) AS VARCHAR)""")
def h2_expand_node(spark, sf):
    nodes, edges, meta = traverse.expand_node(I.tree_nodes(spark, sf), I.tree_edges(spark, sf), "file::NATION_3")
    return nodes.select(F.lit("node").alias("part"), "id", F.col("kind").alias("other")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("dst").alias("other"))).unionByName(
        meta.select(F.lit("meta").alias("part"), F.col("node_count").cast("string").alias("id"), F.col("edge_count").cast("string").alias("other")))


@query(W("call_sites") + "SELECT dst AS id FROM call_sites WHERE src = 'supplier::1' UNION SELECT src FROM call_sites WHERE dst = 'supplier::1'")
def h3_neighbors(spark, sf):
    return traverse.neighbors(I.call_sites(spark, sf), "supplier::1")


@query(W("tree_nodes", "tree_edges") + f"""
    {MID} UNION SELECT dst FROM tree_edges WHERE src IN ({MID}) UNION SELECT src FROM tree_edges WHERE dst IN ({MID})""")
def h4_g4_grow_selection(spark, sf):
    return filters.union_selection(_selection(spark, sf), traverse.grow_selection(I.tree_edges(spark, sf), _selection(spark, sf)))


# Two suppliers with common parts: the path goes through the least of them.
@query(W("call_sites") + """
    SELECT unnest([0, 1, 2]) AS step, unnest(['supplier::0', m, 'supplier::3']) AS id FROM
      (SELECT min(dst) AS m FROM (SELECT dst FROM call_sites WHERE src = 'supplier::0' INTERSECT SELECT dst FROM call_sites WHERE src = 'supplier::3'))""")
def h5_shortest_path_calls(spark, sf):
    return traverse.shortest_path(I.call_sites(spark, sf), "supplier::0", "supplier::3")


# From customer 0 to the last customer of its region, up and down the containment tree.
@query(W("tree_edges") + """, other AS (SELECT max(b.c_custkey) AS k FROM customer a JOIN nation m ON m.n_nationkey = a.c_nationkey JOIN nation n ON n.n_regionkey = m.n_regionkey
                                         JOIN customer b ON b.c_nationkey = n.n_nationkey WHERE a.c_custkey = 0),
    up AS (SELECT 0 AS side, 0 AS k, 'sym::0' AS id UNION ALL SELECT 1, 0, 'sym::' || k FROM other UNION ALL SELECT side, k + 1, src FROM up JOIN tree_edges ON dst = up.id),
    meet AS (SELECT a.k AS ka, b.k AS kb FROM up a JOIN up b USING (id) WHERE a.side = 0 AND b.side = 1 ORDER BY a.k + b.k LIMIT 1)
    SELECT CAST(k AS INTEGER) AS step, id FROM up, meet WHERE side = 0 AND k <= ka UNION ALL SELECT CAST(ka + kb - k AS INTEGER), id FROM up, meet WHERE side = 1 AND k < kb""")
def h5_shortest_path_tree(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    placed = table(spark, sf, "customer").join(nation, "c_nationkey")
    region = placed.where("c_custkey = 0").first()["n_regionkey"]
    last = placed.where(F.col("n_regionkey") == region).agg(F.max("c_custkey")).first()[0]
    return traverse.shortest_path(I.tree_edges(spark, sf), "sym::0", f"sym::{last}")


@query(W("call_sites") + """
    SELECT src, dst, count(*) AS n FROM call_sites WHERE src IN ('supplier::0', 'supplier::3') AND dst =
      (SELECT min(dst) FROM (SELECT dst FROM call_sites WHERE src = 'supplier::0' INTERSECT SELECT dst FROM call_sites WHERE src = 'supplier::3')) GROUP BY ALL""")
def h5_path_edges(spark, sf):
    sites = I.call_sites(spark, sf)
    return traverse.path_edges(sites, traverse.shortest_path(sites, "supplier::0", "supplier::3")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(W("tree_edges") + """
    SELECT src AS ancestor, dst AS descendant FROM tree_edges UNION ALL SELECT a.src, b.dst FROM tree_edges a JOIN tree_edges b ON b.src = a.dst
    UNION ALL SELECT a.src, c.dst FROM tree_edges a JOIN tree_edges b ON b.src = a.dst JOIN tree_edges c ON c.src = b.dst""")
def h6_children_map(spark, sf):
    edges = I.tree_edges(spark, sf)
    tiers = [edges.where(F.col("dst").startswith(p)).select(F.col("dst").alias("id"), F.col("src").alias("parent")) for p in ("file::", "sym::", "sub::")]
    return traverse.children_map(*tiers)


@query(W("tree_nodes", "tree_edges") + "SELECT id FROM tree_nodes WHERE id NOT IN (SELECT dst FROM tree_edges)")
def h7_roots(spark, sf):
    return traverse.roots(I.tree_nodes(spark, sf), I.tree_edges(spark, sf))


# Every region is a component, named by its directory, the least of its ids.
@query(W("tree_nodes") + """, r AS (SELECT n_nationkey, 'dir::' || r_name AS component, n_name FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT id, id AS component FROM tree_nodes WHERE depth = 0 UNION ALL SELECT 'file::' || n_name, component FROM r
    UNION ALL SELECT 'sym::' || c_custkey, component FROM customer JOIN r ON n_nationkey = c_nationkey
    UNION ALL SELECT 'sub::' || o_orderkey, component FROM orders JOIN customer ON o_custkey = c_custkey JOIN r ON n_nationkey = c_nationkey""")
def h7_components(spark, sf):
    return traverse.components(I.tree_nodes(spark, sf), I.tree_edges(spark, sf))
