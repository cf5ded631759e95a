"""Queries over listings, folders and text lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.fixed import languages as L
from graphloom.functions import keys, paths, text, urls
from graphloom.operators import extract, filters, graph, pyast, ranking, stats
from graphloom.plans import inputs as I
from graphloom.plans.registry import query, table
from graphloom.session import cut_lineage
from graphloom.sources import documents, files as tree

W = I.with_inputs


@query(W("page_files") + """
    SELECT DISTINCT 'page' || page_id AS url, octet_length(encode(raw)) AS size,
           length(raw) AS chars FROM page_files""")
def a2_decode_capped(spark, sf):
    content = F.encode("raw", "UTF-8")
    return I.page_files(spark, sf).select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("url"), F.octet_length(content).cast("long").alias("size"),
        F.length(tree.decode_capped(content, F.octet_length(content))).cast("long").alias("chars"))


@query(W("page_folders") + "SELECT path, name, parent_path, CAST(tree_depth AS BIGINT) AS tree_depth FROM page_folders")
def a3_tree_from_listing(spark, sf):
    listing = I.page_files(spark, sf).select("path", F.lit("blob").alias("type"), "url")
    folders, _ = tree.tree_from_listing(listing, "web")
    return folders.withColumn("tree_depth", F.col("tree_depth").cast("long"))


# The level shown is that of the alphabetically first host.
@query(W("page_folders") + """, host AS (SELECT min(repo) AS h FROM page_files)
    SELECT name, path, FALSE AS is_file FROM page_folders, host WHERE parent_path = h
    UNION ALL SELECT name, path, TRUE FROM page_files, host WHERE folder = h""")
def a4_list_level(spark, sf):
    files = I.page_files(spark, sf)
    host = files.agg(F.min("repo")).first()[0]
    return tree.list_level(tree.folders_of(files, "web"), files, f"/{host}//")


@query(W("page_folders") + """
    SELECT path, tree_depth = 2 AS is_stub, CAST((SELECT count(*) FROM page_files f WHERE f.folder = d.path AND d.tree_depth < 2) AS BIGINT) AS files
    FROM page_folders d WHERE tree_depth <= 2""")
def a5_list_to_depth(spark, sf):
    folders, files = tree.list_to_depth(I.page_folders(spark, sf), I.page_files(spark, sf), 2)
    n = files.groupBy(F.col("folder").alias("path")).agg(F.count(F.lit(1)).alias("files"))
    return folders.select("path", "is_stub").join(n, "path", "left").withColumn("files", F.coalesce("files", F.lit(0)))


@query("""
    SELECT source AS repo, round(sum(strlen(text) * 1000) / 1000.0, 3) AS size_kb,
           CASE WHEN sum(strlen(text) * 1000) / 1000.0 >= 50000 THEN 'shallow' WHEN sum(strlen(text) * 1000) / 1000.0 < 5000 THEN 'content' ELSE 'structure' END AS tier,
           sum(strlen(text) * 1000) / 1000.0 >= 50000 AS is_partial FROM documents GROUP BY source""")
def a6_size_tier(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("repo"), (F.octet_length("text") * F.lit(1000).cast("long")).alias("size"))
    return tree.size_tiers(docs).withColumn("size_kb", F.round("size_kb", 3))


@query(W("page_files") + """, t AS (SELECT repo, CASE WHEN sum(size) / 1000.0 >= 50000 THEN 'shallow' WHEN sum(size) / 1000.0 < 5000 THEN 'content' ELSE 'structure' END AS tier
                                   FROM page_files GROUP BY repo)
    SELECT tier, count(*) AS files, CAST(sum(CASE WHEN tier = 'content' THEN length(raw) ELSE 0 END) AS BIGINT) AS chars
    FROM page_files JOIN t USING (repo) WHERE tier <> 'shallow' OR folder = '' GROUP BY tier""")
def a6_apply_tiers(spark, sf):
    files = I.page_files(spark, sf)
    kept = tree.apply_tiers(files, tree.size_tiers(files)).join(tree.size_tiers(files).select("repo", "tier"), "repo")
    return kept.groupBy("tier").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("raw")).alias("chars"))


@query(W("page_files") + "SELECT page_id, ext FROM page_files WHERE lower(ext) IN ('.html', '.com')")
def b1_ext_filter(spark, sf):
    return filters.ext_filter(I.page_files(spark, sf), ["HTML", ".com"]).select("page_id", "ext")


@query(W("page_files") + """
    SELECT page_id, path FROM page_files
    WHERE len(list_filter(string_split(folder, '/'), lambda s: s = 'de' OR regexp_matches(s, '^.*\\.example\\.org$'))) = 0""".replace("\\\\", "\\"))
def b2_exclude_dirs(spark, sf):
    return filters.exclude_dirs(I.page_files(spark, sf), ["de", "*.example.org"]).select("page_id", "path")


@query(W("page_files") + "SELECT page_id, regexp_matches(lower(url), '" + "|".join(L.PLATFORM_FRAGMENTS) + "') AS skipped FROM page_files")
def b3_platform_filter(spark, sf):
    files = I.page_files(spark, sf)
    return filters.platform_filter(files, "url").select("page_id", F.lit(False).alias("skipped")).unionByName(
        filters.platform_skipped(files, "url").select("page_id", F.lit(True).alias("skipped")))


@query(W("page_files") + "SELECT page_id, path FROM page_files WHERE contains(path, 'blog.')")
def b4_subsystem_filter(spark, sf):
    files = I.page_files(spark, sf).withColumn("file", F.col("path"))
    return filters.subsystem_filter(files, "blog.").select("page_id", "path")


@query("SELECT path FROM (SELECT DISTINCT url AS path FROM pages) ORDER BY path LIMIT 20")
def b5_max_files(spark, sf):
    return filters.max_files(table(spark, sf, "pages").select(F.col("url").alias("path")).distinct(), 20)


@query(W("page_files") + "SELECT folder, name, url FROM page_files WHERE lower(ext) IN ('.html', '.htm', '.xhtml') AND url <> ''")
def b20_parseable_files(spark, sf):
    return filters.parseable_files(I.page_files(spark, sf), [".html", ".htm", ".xhtml"])


@query(W("code_files") + "SELECT ext, CASE ext " + " ".join(
    f"WHEN '{e}' THEN '{lang}'" for lang, (exts, _) in L.SYMBOL_RULES.items() for e in exts) + " ELSE 'unknown' END AS language, count(*) AS n FROM code_files GROUP BY ALL")
def b18_ext_to_language(spark, sf):
    return I.code_files(spark, sf).groupBy("ext", filters.ext_to_language(F.col("ext")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(W("page_folders") + """
    SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size, count(*) FILTER (WHERE name LIKE '%.py') AS python_files,
           (SELECT count(*) FROM page_folders WHERE parent_path IS NOT NULL) AS folders FROM page_files""")
def e1_file_stats(spark, sf):
    return stats.file_stats(I.page_files(spark, sf), I.page_folders(spark, sf))


@query(W("page_files") + """
    SELECT a AS path, CAST(sum(size) AS BIGINT) AS size FROM
      (SELECT size, unnest(list_concat([''], list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))) AS a FROM page_files)
    GROUP BY a""")
def e2_folder_size_rollup(spark, sf):
    return stats.folder_size_rollup(I.page_files(spark, sf))


@query(W("page_folders") + """, rows AS (
      SELECT path, name, FALSE AS is_file FROM page_folders UNION ALL SELECT DISTINCT path, name, TRUE FROM page_files)
    SELECT path, is_file, row_number() OVER (ORDER BY is_file, lower(name), path) AS pos FROM rows""")
def f11_listing_order(spark, sf):
    folders = I.page_folders(spark, sf).select("path", "name", F.lit(False).alias("is_file"))
    rows = folders.unionByName(I.page_files(spark, sf).select("path", "name", F.lit(True).alias("is_file")).distinct())
    return ranking.ranked(rows, [], ["is_file", ("n", F.lower("name")), "path"], rn="pos").select("path", "is_file", "pos")


@query("""
    SELECT page_id, CASE WHEN regexp_matches(u, '^https?://github\\.com/([^/]+)/([^/]+?)(?:\\.git)?(?:/.*)?$') THEN regexp_extract(u, '^https?://github\\.com/([^/]+)/([^/]+?)(?:\\.git)?(?:/.*)?$', 1) END AS owner,
           CASE WHEN regexp_matches(u, '^https?://github\\.com/([^/]+)/([^/]+?)(?:\\.git)?(?:/.*)?$') THEN regexp_extract(u, '^https?://github\\.com/([^/]+)/([^/]+?)(?:\\.git)?(?:/.*)?$', 2) END AS repo,
           CASE WHEN u LIKE 'http%://github.com/%' AND string_split(u, '/')[5] <> '' THEN string_split(u, '/')[4] || '-' || string_split(u, '/')[5] ELSE substr(sha256(u), 1, 16) END AS repo_key
    FROM (SELECT page_id, regexp_replace(url, '//[^/]*\\.example\\.(com|org)/', '//github.com/') AS u FROM pages)""".replace("\\\\", "\\"))
def j_url_keys(spark, sf):
    u = F.regexp_replace("url", r"//[^/]*\.example\.(com|org)/", "//github.com/")
    pages = table(spark, sf, "pages").select("page_id", u.alias("u"))
    found = pages.withColumn("o", urls.owner_repo(F.col("u")))
    return found.select("page_id", "o.owner", "o.repo", keys.repo_key(F.col("u")).alias("repo_key"))


@query("""
    SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS size,
           substr(text, 1, 500) AS head, length(text) AS whole FROM (SELECT doc_id, text, CAST(strlen(text) * 37 AS DOUBLE) AS b FROM documents)""")
def j_human_size_and_truncate(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.human_size(F.octet_length("text") * 37).alias("size"), text.truncate(F.col("text"), 500).alias("head"), F.length("text").cast("long").alias("whole"))


# ---- lines and symbols --------------------------------------------------------------------

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _lines_sql(source: str, columns: str) -> str:
    """Numbered, stripped lines of a text column `raw`."""
    return f"""(SELECT {columns}, line, regexp_replace(rawline, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text
      FROM (SELECT {columns}, unnest(parts) AS rawline, unnest(range(1, len(parts) + 1)) AS line
            FROM (SELECT *, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS parts
                  FROM (SELECT *, regexp_split_to_array(raw, '{_END}') AS p FROM {source} WHERE raw <> ''))))"""


_CODE_SQL = "text <> '' AND NOT (text LIKE '#%' OR text LIKE '//%' OR text LIKE '/*%' OR text LIKE '*%' OR text LIKE '--%')"


def _match_sql(rules: list[tuple[str, str]], what: str) -> str:
    """CASE giving the kind or label of the first matching rule."""
    arms = []
    for kind, pattern in rules:
        p = pattern.replace("'", "''")
        arms.append(f"WHEN regexp_matches(text, '{p}') THEN " + (f"'{kind}'" if what == "kind" else f"regexp_extract(text, '{p}', 1)"))
    return "CASE " + " ".join(arms) + " END"


def _by_language(what: str) -> str:
    arms = [f"WHEN ext = '{exts[0] if exts[0] != '.asm' else '.s'}' THEN {_match_sql(rules, what)}" for exts, rules in L.SYMBOL_RULES.values()]
    return "CASE " + " ".join(arms) + " END"


@query("SELECT doc_id, CAST(line AS BIGINT) AS line, text FROM " + _lines_sql("(SELECT doc_id, text AS raw FROM documents)", "doc_id"))
def c0_explode_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw"))
    return extract.explode_lines(docs).withColumn("line", F.col("line").cast("long"))


@query("SELECT doc_id, count(*) AS code_lines FROM " + _lines_sql("(SELECT doc_id, text AS raw FROM documents)", "doc_id") + f" WHERE {_CODE_SQL} GROUP BY doc_id")
def b7_code_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw"))
    return filters.code_lines(extract.explode_lines(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("code_lines"))


@query(W("code_files") + f"""
    SELECT id, kind, label, CAST(line AS BIGINT) AS line FROM
      (SELECT *, CASE ext {" ".join(f"WHEN '{e}' THEN '{lang}'" for lang, (exts, _) in L.SYMBOL_RULES.items() for e in exts)} END
                 || '::' || path || '::' || kind || '::' || label || '::' || line AS id
       FROM (SELECT *, {_by_language("kind")} AS kind, {_by_language("label")} AS label FROM {_lines_sql("code_files", "ext, name, path")} WHERE {_CODE_SQL}))
    WHERE kind IS NOT NULL""")
def c1_symbols_code(spark, sf):
    """All 20 pattern languages on rendered source text."""
    return extract.extract_symbols(I.code_files(spark, sf)).select("id", "kind", "label", F.col("line").cast("long").alias("line"))


@query(W("code_files") + f"""
    SELECT ext, kind, count(*) AS n FROM
      (SELECT *, {_by_language("kind")} AS kind FROM {_lines_sql("code_files", "ext, name, path")}
       WHERE text <> '' AND NOT CASE WHEN ext IN ('.rb', '.sh', '.dockerfile', '.toml') THEN text LIKE '#%' WHEN ext = '.md' THEN FALSE
         WHEN ext = '.s' THEN text LIKE '#%' OR text LIKE '//%' OR text LIKE '/*%' WHEN ext = '.sql' THEN text LIKE '--%' OR text LIKE '/*%' OR text LIKE '*%'
         WHEN ext = '.lua' THEN text LIKE '--%' WHEN ext = '.html' THEN text LIKE '<!--%' WHEN ext = '.css' THEN text LIKE '/*%' OR text LIKE '*%'
         WHEN ext = '.php' THEN text LIKE '#%' OR text LIKE '//%' OR text LIKE '/*%' OR text LIKE '*%' ELSE text LIKE '//%' OR text LIKE '/*%' OR text LIKE '*%' END)
    WHERE kind IS NOT NULL GROUP BY ext, kind""")
def c1_symbols_own_comments(spark, sf):
    """With comment openers by language: Markdown headings and CSS ids are found too."""
    symbols = extract.extract_symbols(I.code_files(spark, sf), legacy_comments=False)
    ext = paths.suffix(paths.base_name(F.col("file_id")))
    return symbols.groupBy(ext.alias("ext"), "kind").agg(F.count(F.lit(1)).alias("n"))


_HTML = L.SYMBOL_RULES["html"][1]
_PAGE_LINES = _lines_sql(r"(SELECT page_id, replace(replace(html, '><', '>' || chr(10) || '<'), 'class=', 'id=') AS raw FROM pages)", "page_id")


@query(f"""SELECT page_id, CAST(line AS BIGINT) AS line, kind, label FROM
    (SELECT *, {_match_sql(_HTML, "kind")} AS kind, {_match_sql(_HTML, "label")} AS label FROM {_PAGE_LINES} WHERE {_CODE_SQL}) WHERE kind IS NOT NULL""")
def c1_symbols_html(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.lit("html").alias("language"), 
                                             F.replace(F.replace("html", F.lit("><"), F.lit(">\n<")), F.lit("class="), F.lit("id=")).alias("raw"))
    found = extract.match_symbols(filters.code_lines(extract.explode_lines(pages)))
    return found.select("page_id", F.col("line").cast("long").alias("line"), "kind", "label")


# Rules met line by line: several may match, the first counts.
@query(W("code_files") + f"SELECT ext, kind, count(*) AS n FROM (SELECT ext, {_by_language('kind')} AS kind FROM {_lines_sql('code_files', 'ext, name')}"
       + f" WHERE {_CODE_SQL}) WHERE kind IS NOT NULL GROUP BY ext, kind")
def f1_first_rule_wins(spark, sf):
    symbols = extract.extract_symbols(I.code_files(spark, sf))
    ext = paths.suffix(paths.base_name(F.col("file_id")))
    return symbols.groupBy(ext.alias("ext"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(W("py_files") + """, found AS (
    SELECT path, unnest([n || '.' || n, n || '.' || b || '.helper', n || '.' || b || '.Other', n || '.None.sibling', n || '.C_' || n, n || '.run', n || '.f_' || n, n || '.Other']) AS id,
           unnest(['module', 'import', 'import', 'import', 'class', 'function', 'function', 'import']) AS kind FROM py_files)
    SELECT path, path || '::' || id AS id, kind FROM found""")
def c2_python_symbols(spark, sf):
    parsed = pyast.parse_python(I.py_files(spark, sf))
    return pyast.python_nodes(parsed).select(F.substring("file_id", 7, 1 << 20).alias("path"), "id", "kind")


@query(W("py_files") + """
    SELECT kind, count(*) AS n FROM (SELECT unnest(['imports', 'imports', 'imports', 'contains', 'contains', 'contains', 'imports']) AS kind FROM py_files) GROUP BY kind""")
def c2_python_edges(spark, sf):
    return stats.kind_counts(pyast.python_edges_to(pyast.parse_python(I.py_files(spark, sf))))


@query(W("py_files") + """
    SELECT path, path || '::' || unnest([n || '.' || n, n || '.' || n, n || '.' || n, n || '.' || n, n || '.C_' || n, n || '.' || n, n || '.' || n]) AS src,
      path || '::' || unnest([n || '.' || b || '.helper', n || '.' || b || '.Other', n || '.None.sibling', n || '.C_' || n, n || '.run', n || '.f_' || n, n || '.Other']) AS dst,
      unnest(['imports', 'imports', 'imports', 'contains', 'contains', 'contains', 'imports']) AS kind FROM py_files""")
def c2_python_edge_rows(spark, sf):
    edges = pyast.python_edges_to(pyast.parse_python(I.py_files(spark, sf)))
    return edges.select(F.substring("file_id", 7, 1 << 20).alias("path"), "src", "dst", "kind")


@query(W("py_files") + """
    SELECT path, coalesce(nullif(regexp_extract(text, '^import ([\\w.]+)', 1), ''), regexp_extract(text, '^from (\\w[\\w.]*) import', 1)) AS module
    FROM """.replace("\\\\", "\\") + _lines_sql("py_files", "path") + " WHERE regexp_matches(text, '^(import|from) ?\\w') AND NOT text LIKE 'from .%'".replace("\\\\", "\\"))
def c3_python_imports(spark, sf):
    parsed = pyast.parse_python(I.py_files(spark, sf))
    return pyast.python_imports(parsed).select(F.substring("file_id", 7, 1 << 20).alias("path"), "module")


@query(W("py_files") + """
    SELECT path, path AS src, path || '::' || n || '.' || n AS root FROM py_files""")
def d3_attach_roots(spark, sf):
    parsed = cut_lineage(pyast.parse_python(I.py_files(spark, sf)))
    nodes = pyast.python_nodes(parsed)
    found = graph.attach_roots(nodes, pyast.python_edges_to(parsed))
    path = F.substring("src", 7, 1 << 20)
    return found.select(path.alias("path"), path.alias("src"), F.col("dst").alias("root"))


@query(W("code_files") + "SELECT language, string_agg(DISTINCT ext, ',' ORDER BY ext) AS extensions FROM (SELECT *, CASE ext " + " ".join(
    f"WHEN '{e}' THEN '{lang}'" for lang, (exts, _) in L.SYMBOL_RULES.items() for e in exts) + " END AS language FROM code_files) GROUP BY language")
def e15_languages(spark, sf):
    """Extensions in use by language; the distinct pairs are few before they are listed."""
    pairs = I.code_files(spark, sf).select(filters.ext_to_language(F.col("ext")).alias("language"), "ext").distinct()
    return pairs.groupBy("language").agg(F.array_join(F.array_sort(F.collect_list("ext")), ",").alias("extensions"))


@query(W("code_files") + f"SELECT kind, count(*) AS n FROM (SELECT {_by_language('kind')} AS kind FROM {_lines_sql('code_files', 'ext, name')} WHERE {_CODE_SQL}) WHERE kind IS NOT NULL GROUP BY kind")
def e3_kind_counts(spark, sf):
    return stats.kind_counts(extract.extract_symbols(I.code_files(spark, sf)))


@query(W("code_files") + f""", c AS (SELECT kind, count(*) AS n FROM (SELECT {_by_language('kind')} AS kind FROM {_lines_sql('code_files', 'ext, name')} WHERE {_CODE_SQL})
       WHERE kind IS NOT NULL GROUP BY kind)
    SELECT kind, n, (SELECT greatest(count(*) - 10, 0) FROM c) AS more_kinds FROM c ORDER BY n DESC, kind LIMIT 10""")
def e4_type_breakdown(spark, sf):
    return stats.type_breakdown(extract.extract_symbols(I.code_files(spark, sf)))


# Tokens of the documents met by the reserved words and operators of C.
@query("""
    SELECT kind, layer, "group", count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z&*]+', ' ', 'g'), ' ')) AS token FROM documents)
    JOIN (VALUES ('for', 'keyword', 3, 'iteration'), ('do', 'keyword', 3, 'iteration'), ('while', 'keyword', 3, 'iteration'), ('if', 'keyword', 3, 'selection'),
      ('else', 'keyword', 3, 'selection'), ('switch', 'keyword', 3, 'selection'), ('case', 'keyword', 3, 'selection'), ('default', 'keyword', 3, 'selection'),
      ('break', 'keyword', 3, 'jump'), ('continue', 'keyword', 3, 'jump'), ('goto', 'keyword', 3, 'jump'), ('return', 'keyword', 3, 'jump'),
      ('auto', 'keyword', 0, 'storage class'), ('register', 'keyword', 0, 'storage class'), ('static', 'keyword', 0, 'storage class'), ('extern', 'keyword', 0, 'storage class'),
      ('volatile', 'keyword', 0, 'access qualifier'), ('restrict', 'keyword', 0, 'access qualifier'), ('void', 'keyword', 1, 'core primitive'), ('char', 'keyword', 1, 'core primitive'),
      ('int', 'keyword', 1, 'core primitive'), ('float', 'keyword', 1, 'core primitive'), ('double', 'keyword', 1, 'core primitive'), ('short', 'keyword', 1, 'size/sign modifier'),
      ('long', 'keyword', 1, 'size/sign modifier'), ('signed', 'keyword', 1, 'size/sign modifier'), ('unsigned', 'keyword', 1, 'size/sign modifier'),
      ('struct', 'keyword', 2, 'aggregate'), ('union', 'keyword', 2, 'aggregate'), ('enum', 'keyword', 2, 'aggregate'), ('typedef', 'keyword', 2, 'alias'),
      ('sizeof', 'keyword', 4, 'size & alignment'), ('inline', 'keyword', 4, 'optimization hint / immutability'), ('const', 'keyword', 4, 'optimization hint / immutability'),
      ('&', 'operator', 0, 'indirection & address'), ('*', 'operator', 0, 'indirection & address'), ('&', 'operator', 1, 'logical-bit'), ('*', 'operator', 2, 'binary arithmetic'),
      ('&&', 'operator', 3, 'short-circuit logic')) l(token, kind, layer, "group") USING (token) GROUP BY ALL""")
def d13_enrich_tokens(spark, sf):
    word = F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z&*]+", " "), " "))
    tokens = table(spark, sf, "documents").select(word.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    lexicon = graph.lexicon_tokens(documents.load_lexicon(spark, "c"))
    return graph.enrich_tokens(tokens, F.broadcast(lexicon)).groupBy("kind", F.col("layer_ordinal").alias("layer"), "group").agg(
        F.sum("uses").alias("n"))


@query(W("lexicon_tokens") + """
    SELECT DISTINCT 'lang:parts' AS id, 'Parts' AS label, 'language' AS type, -1 AS layer_ordinal, 'root' AS kind FROM lexicon_tokens
    UNION ALL SELECT DISTINCT 'kind:parts:' || kind, kind, 'kind', -1, kind FROM lexicon_tokens
    UNION ALL SELECT DISTINCT 'kind:parts:' || kind || ':L' || layer_ordinal, 'L' || layer_ordinal || ' ' || layer_name, 'layer', layer_ordinal, kind FROM lexicon_tokens
    UNION ALL SELECT DISTINCT 'kind:parts:' || kind || ':L' || layer_ordinal || ':' || "group", "group", 'group', layer_ordinal, kind FROM lexicon_tokens
    UNION ALL SELECT DISTINCT 'kind:parts:' || kind || ':L' || layer_ordinal || ':' || "group" || ':' || token, token, 'token', layer_ordinal, kind FROM lexicon_tokens""")
def d14_lexicon_nodes(spark, sf):
    return graph.lexicon_graph(I.lexicon_tokens(spark, sf))[0]


@query(W("lexicon_tokens") + """, r AS (SELECT DISTINCT 'kind:parts:' || kind AS k, 'kind:parts:' || kind || ':L' || layer_ordinal AS l,
        'kind:parts:' || kind || ':L' || layer_ordinal || ':' || "group" AS g, 'kind:parts:' || kind || ':L' || layer_ordinal || ':' || "group" || ':' || token AS t FROM lexicon_tokens)
    SELECT DISTINCT 'lang:parts' AS src, k AS dst, 'has_kind' AS relation FROM r UNION ALL SELECT DISTINCT k, l, 'has_layer' FROM r
    UNION ALL SELECT DISTINCT l, g, 'has_group' FROM r UNION ALL SELECT DISTINCT g, t, 'has_token' FROM r""")
def d14_lexicon_edges(spark, sf):
    return graph.lexicon_graph(I.lexicon_tokens(spark, sf))[1]


@query(W("lexicon_tokens") + """
    SELECT token, CAST(floor((rn - 1) / 100) AS BIGINT) AS chunk, count(*) AS contexts, string_agg(role || '/' || "group" || '/' || layer_ordinal, ',' ORDER BY rn) AS listed
    FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY kind, layer_ordinal, layer_name, "group", role, since) AS rn FROM lexicon_tokens) GROUP BY ALL""")
def e14_token_index(spark, sf):
    index = stats.token_index(I.lexicon_tokens(spark, sf), chunk=100)
    listed = F.array_join(F.transform("items", lambda c: F.concat_ws("/", c["role"], c["group"], c["layer_ordinal"].cast("string"))), ",")
    return index.select("token", "chunk", F.size("items").cast("long").alias("contexts"), listed.alias("listed"))


@query(W("lexicon_tokens") + "SELECT kind, since, count(*) AS n FROM lexicon_tokens GROUP BY ALL")
def e20_tokens_by_standard(spark, sf):
    return stats.tokens_by_standard(I.lexicon_tokens(spark, sf))
