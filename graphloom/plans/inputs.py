"""Inputs rendered from the given tables, as DataFrames and as the same SQL.

Each input has a function (spark, sf_dir) -> DataFrame and a common table expression in `CTE`.
`with_inputs` puts the needed expressions before a query text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths, times
from graphloom.operators import auth
from graphloom.plans.registry import table
from graphloom.sources import files as tree

CTE: dict[str, tuple[list[str], str]] = {}


def with_inputs(*names: str) -> str:
    """'WITH [RECURSIVE] a AS (...), ...' of the named inputs and what they build on, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTE[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in ordered) + "\n"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a table of few splits one task per core before its rows fan out; larger ones stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


# ---- listing of web pages -----------------------------------------------------------------

CTE["page_files"] = ([], r"""
    SELECT page_id, url, string_split(path, '/')[1] AS repo, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder,
           string_split(path, '/')[-1] AS name, regexp_extract(string_split(path, '/')[-1], '^.+(\.[^.]+)$', 1) AS ext,
           strlen(html) AS size, html AS raw
    FROM (SELECT *, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'),
                                                lambda s: s <> ''), '/') AS path FROM pages)""")
CTE["page_folders"] = (["page_files"], r"""
    SELECT path, CASE WHEN path = '' THEN 'web' ELSE string_split(path, '/')[-1] END AS name,
           CASE WHEN path <> '' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent_path,
           CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS tree_depth
    FROM (SELECT DISTINCT unnest(list_concat([''], list_transform(range(1, len(string_split(path, '/'))),
                 lambda i: array_to_string(string_split(path, '/')[1:i], '/')))) AS path FROM page_files)""")


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    rows = pages.select("page_id", "url", paths.normalise(bare).alias("path"), F.octet_length("html").cast("long").alias("size"),
                        F.col("html").alias("raw"))
    name = paths.base_name(F.col("path"))
    return rows.select("page_id", F.substring_index("path", "/", 1).alias("repo"), "path", paths.parent(F.col("path")).alias("folder"),
                       name.alias("name"), paths.stem(name).alias("stem"), paths.suffix(name).alias("ext"), "url", "size", "raw")


def page_folders(spark: SparkSession, sf: str) -> DataFrame:
    return tree.folders_of(page_files(spark, sf), "web")


# ---- rendered source text -----------------------------------------------------------------

# One small file per language; {n} is the part's name and key.
TEMPLATES = {
    ".js": "// {n}\nexport default function f_{n}(a) {\n  let g_{n} = async (b) => b\n}\nclass K_{n} {\nexport const x = 1\n",
    ".ts": "interface I_{n} {\ntype T_{n}<A> = A\nexport const enum E_{n} {\n@Deco_{n}()\nfunction f_{n}(a: A) {\n* note\n",
    ".rs": "pub fn f_{n}<T>(x: T) {\n  pub struct S_{n};\nenum E_{n} {\ntrait R_{n} {\nimpl<T> R_{n} for S_{n} {\nmod m_{n} {\ntype A_{n} = u8;\nmacro_rules! mac_{n} {\n",
    ".go": "func (s *S) F_{n}(a int) {\ntype S_{n} struct {\ntype I_{n} interface {\ntype A_{n} int\nvar v_{n} = 1\n-- odd\n",
    ".java": "public static abstract class C_{n} {\nprivate interface I_{n} {\nenum E_{n} {\npublic @interface A_{n} {\n  void m();\n",
    ".cs": "namespace N.{n}\npublic sealed class C_{n}\ninternal interface I_{n}\npublic enum E_{n}\nreadonly struct S_{n}\nrecord R_{n}\n",
    ".kt": "data class C_{n}(val a: Int)\nfun interface I_{n} {\nsuspend fun <T> f_{n}(a: T)\ntypealias T_{n} = Int\n",
    ".swift": "public class C_{n} {\nstruct S_{n} {\nprotocol P_{n} {\nindirect enum E_{n} {\nstatic func f_{n}() {\nextension X_{n} {\n",
    ".rb": "module M_{n}\n  class C_{n}\n    def f_{n}\n# class No_{n}\n",
    ".php": "final class C_{n} {\ninterface I_{n} {\ntrait T_{n} {\nenum E_{n} {\npublic static function f_{n}() {\n",
    ".scala": "case class C_{n}(a: Int)\nobject O_{n}\ntrait T_{n}\noverride def f_{n}(a: Int)\ntype A_{n} = Int\n",
    ".sh": "#!/bin/sh\nf_{n}() {\nfunction g_{n} {\necho {n}\n",
    ".lua": "local function M.f_{n}(a)\nM.g_{n} = function(b)\n-- function no_{n}()\n",
    ".s": ".text\nmain_{n}:\n  mov eax, 1\n.L_{n}:\n",
    ".sql": "create table if not exists t_{n} (a int);\nCREATE OR REPLACE VIEW v_{n} AS\nCREATE FUNCTION f_{n}()\ncreate unique index i_{n} on t\n",
    ".md": "# Title {n}\ntext {n}\n",
    ".html": "<div class=\"a\" id=\"a_{n}\">\n<my-el-{n} x>\n<p>{n}</p>\n",
    ".css": ".c_{n} {\n#i_{n} {\n@keyframes k_{n} {\n@mixin m_{n}\n@function f_{n}\n",
    ".dockerfile": "FROM base AS s_{n}\nARG A_{n}\nenv E_{n} 1\n",
    ".toml": "[s_{n}]\nkey = 1\n[[a_{n}]]\n",
}
PY_TEMPLATE = (
    "import os.path\nimport {b}.{n}\nfrom {b} import helper as h, Other\nfrom . import sibling\n\n"
    "class C_{n}(Other):\n    def run(self, a):\n        for i in a:\n            print(i)\n        return f\"{i}\"\n\n"
    "def f_{n}(x):\n    h.go(x, 1)\n    return x\n"
)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CTE["parts"] = ([], "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_partkey AS n, 'b' || regexp_extract(p_brand, '[0-9]+') AS b FROM part")
CTE["code_files"] = (["parts"], """
    SELECT 'src/' || b || '/' || n || ext AS path, n || ext AS name, ext, replace(body, '{n}', n) AS raw
    FROM parts, (VALUES """ + ", ".join(f"({_sql_text(e)}, {_sql_text(t)})" for e, t in TEMPLATES.items()) + ") t(ext, body)")
CTE["py_files"] = (["parts"], "SELECT 'src/' || b || '/' || n || '.py' AS path, n AS stem, b, n, replace(replace("
                   + _sql_text(PY_TEMPLATE) + ", '{n}', n), '{b}', b) AS raw FROM parts")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey").select(
        "p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("n"),
        F.concat(F.lit("b"), F.regexp_extract("p_brand", "[0-9]+", 0)).alias("b"))


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """About 20 small files per part, one per pattern language."""
    options = F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(t).alias("body")) for e, t in TEMPLATES.items()])
    rows = _parts(spark, sf).select("n", "b", F.inline(options))
    path = F.concat(F.lit("src/"), F.col("b"), F.lit("/"), F.col("n"), F.col("ext"))
    return tree.files_from_paths(rows.select(
        F.lit("code").alias("repo"), path.alias("path"), F.lit("").alias("url"), F.lit(0).cast("long").alias("size"),
        F.replace("body", F.lit("{n}"), F.col("n")).alias("raw")))


def py_files(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.col("b"), F.lit("/"), F.col("n"), F.lit(".py"))
    raw = F.replace(F.replace(F.lit(PY_TEMPLATE), F.lit("{n}"), F.col("n")), F.lit("{b}"), F.col("b"))
    return tree.files_from_paths(_parts(spark, sf).select(
        F.lit("code").alias("repo"), path.alias("path"), F.lit("").alias("url"), F.length(raw).cast("long").alias("size"), raw.alias("raw")))


# ---- auth log -----------------------------------------------------------------------------

CTE["log_lines"] = ([], r"""
    SELECT event_id AS line_no, strftime(ts, '%b %d %H:%M:%S') || ' host ' ||
      CASE WHEN event_type = 'purchase' THEN 'crond' WHEN event_type = 'click' AND value < 10 THEN 'sssd' ELSE 'sshd' END
      || '[' || user_id || ']: ' ||
      CASE event_type
        WHEN 'signup' THEN CASE WHEN value < 15 THEN 'Accepted password for u' || user_id || ' from 10.0.0.' || user_id || ' port 22 ssh2'
                                WHEN value < 25 THEN 'pam_start() called for user u' || user_id
                                ELSE 'PAM_SUCCESS pam_end() user=u' || user_id END
        WHEN 'error' THEN CASE WHEN value < 10 THEN 'Failed password for u' || user_id || ' from 10.0.0.' || user_id || ' port 22 ssh2'
                               WHEN value < 25 THEN 'Invalid user u' || user_id || ' from 10.0.0.' || user_id
                               ELSE 'pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=10.0.0.' || user_id || '  user=u' || user_id END
        WHEN 'click' THEN CASE WHEN value < 5 THEN 'pam_sss.so: cache hit for user u' || user_id
                               WHEN value < 10 THEN 'backend request for user u' || user_id
                               WHEN value < 20 THEN 'krb5 AS-REQ sent'
                               ELSE 'pam_unix.so(sshd:account): checking (user=u' || user_id || ')' END
        WHEN 'view' THEN CASE WHEN value < 20 THEN 'session opened for user u' || user_id || ' by (uid=0)'
                              ELSE 'session closed for user u' || user_id END
        ELSE '(CRON) INFO (pidfile fd = 3)' END AS value
    FROM events""")
CTE["auth_events"] = (["log_lines"], r"""
    SELECT line_no AS seq, ts, service, pid, module, phase, success, result, body AS detail, service || ':' || pid AS session_id,
           CASE WHEN ok AND (ended OR contains(low, 'granted') OR contains(low, 'accepted')) THEN 'access_granted'
                WHEN NOT ok AND bad AND (ended OR contains(low, 'failed password')) THEN 'access_denied' ELSE base END AS event_type,
           usr AS "user", rhost, tty
    FROM (SELECT *,
        CASE WHEN (opened OR closed) AND NOT (started OR ended) THEN 'session'
             WHEN regexp_matches(low, '\bauth(entication)?\b') THEN 'auth' WHEN regexp_matches(low, '\baccount\b') THEN 'account'
             WHEN regexp_matches(low, '\bsession\b') THEN 'session' WHEN regexp_matches(low, '\bpassword\b') THEN 'password' END AS phase,
        CASE WHEN ok THEN TRUE WHEN bad THEN FALSE WHEN cache AND NOT (started OR ended OR opened OR closed) THEN contains(low, 'hit') END AS success,
        CASE WHEN ok THEN 'PAM_SUCCESS' WHEN bad THEN 'PAM_AUTH_ERR' ELSE '' END AS result,
        CASE WHEN started THEN 'pam_start' WHEN ended THEN 'pam_end' WHEN opened THEN 'session_open' WHEN closed THEN 'session_close'
             WHEN cache THEN 'sssd_cache'
             WHEN contains(low, 'sssd') OR contains(lower(service), 'sssd') THEN CASE WHEN ok OR bad THEN 'sssd_result' ELSE 'sssd_call' END
             WHEN regexp_matches(low, 'kerberos|krb5|tgt|as-req|kinit') THEN CASE WHEN contains(low, 'request') OR contains(body, 'AS-REQ') THEN 'krb_call' ELSE 'krb_result' END
             WHEN module <> '' THEN 'module_call' ELSE 'unknown' END AS base
      FROM (SELECT *, lower(body) AS low, contains(lower(body), 'pam_start()') AS started, contains(lower(body), 'pam_end()') AS ended,
              regexp_matches(lower(body), 'session opened|pam_open_session') AS opened, regexp_matches(lower(body), 'session closed|pam_close_session') AS closed,
              regexp_matches(lower(body), 'pam_success|accepted|succeeded|success') AS ok,
              regexp_matches(lower(body), 'pam_(auth_err|acct_expired|cred_err|user_unknown|maxtries|perm_denied)|failed|failure|authentication fail|invalid user') AS bad,
              regexp_matches(lower(body), 'cache\s*(hit|miss)') AS cache,
              CASE WHEN regexp_matches(body, '(?i)pam_(\w+)\.so') THEN 'pam_' || regexp_extract(body, '(?i)pam_(\w+)\.so', 1) || '.so' ELSE '' END AS module,
              rtrim(regexp_extract(body, '(?i)\buser[=\s](\S+)', 1), ')') AS usr, regexp_extract(body, '(?i)\brhost[=\s](\S+)', 1) AS rhost,
              regexp_extract(body, '(?i)\btty[=\s](\S+)', 1) AS tty
            FROM (SELECT line_no, strptime('2024 ' || regexp_extract(value, '^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})', 1), '%Y %b %d %H:%M:%S') AS ts,
                         regexp_extract(value, '^\w{3}\s+\d+\s+\S+\s+\S+\s+(\w[\w/-]*)\[', 1) AS service,
                         CAST(regexp_extract(value, '\[(\d+)\]:', 1) AS INTEGER) AS pid, regexp_extract(value, '\[\d+\]:\s+(.+)$', 1) AS body FROM log_lines))
      WHERE contains(low, 'pam') OR contains(low, 'sssd') OR contains(lower(service), 'sssd') OR ok OR bad OR opened OR closed
            OR service IN ('sshd', 'login', 'su', 'sudo', 'gdm', 'lightdm', 'polkit'))""")


def _month_stamp(ts: Column) -> Column:
    """'Jan 01 10:20:30' of a zone-less timestamp, whatever the session zone."""
    from graphloom.fixed.auth import MONTHS

    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts))
    text = ts.cast("string")
    return F.concat(month, F.lit(" "), F.substring(text, 9, 11))


def render_lines(events: DataFrame) -> DataFrame:
    """Auth-log lines (value, file, line_no) out of the events table."""
    user, value, kind = F.col("user_id").cast("string"), F.col("value"), F.col("event_type")
    service = F.when(kind == "purchase", "crond").when((kind == "click") & (value < 10), "sssd").otherwise("sshd")
    host = F.concat(F.lit("10.0.0."), user)
    u = F.concat(F.lit("u"), user)

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    signup = F.when(value < 15, say("Accepted password for ", u, " from ", host, " port 22 ssh2")).when(
        value < 25, say("pam_start() called for user ", u)).otherwise(say("PAM_SUCCESS pam_end() user=", u))
    error = F.when(value < 10, say("Failed password for ", u, " from ", host, " port 22 ssh2")).when(
        value < 25, say("Invalid user ", u, " from ", host)).otherwise(
        say("pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=", host, "  user=", u))
    click = F.when(value < 5, say("pam_sss.so: cache hit for user ", u)).when(value < 10, say("backend request for user ", u)).when(
        value < 20, F.lit("krb5 AS-REQ sent")).otherwise(say("pam_unix.so(sshd:account): checking (user=", u, ")"))
    view = F.when(value < 20, say("session opened for user ", u, " by (uid=0)")).otherwise(say("session closed for user ", u))
    body = F.when(kind == "signup", signup).when(kind == "error", error).when(kind == "click", click).when(
        kind == "view", view).otherwise("(CRON) INFO (pidfile fd = 3)")
    line = say(_month_stamp(F.col("ts")), " host ", service, "[", user, "]: ", body)
    return events.select(line.alias("value"), F.lit("auth.log").alias("file"), F.col("event_id").alias("line_no"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return render_lines(spread(events, "event_id"))


def auth_events(spark: SparkSession, sf: str) -> DataFrame:
    return auth.parse_auth_lines(log_lines(spark, sf), 2024).withColumnRenamed("line_no", "seq")


# ---- containment hierarchy ----------------------------------------------------------------

CTE["tree_nodes"] = ([], """
    SELECT 'dir::' || r_name AS id, 0 AS depth, 'directory' AS kind, r_name AS label, '' AS file, 0 AS line FROM region
    UNION ALL SELECT 'file::' || n_name, 1, 'file', n_name, n_name, 0 FROM nation
    UNION ALL SELECT 'sym::' || c_custkey, 2, lower(c_mktsegment), c_name, 'NATION_' || c_nationkey, CAST(c_custkey AS INTEGER) FROM customer
    UNION ALL SELECT 'sub::' || o_orderkey, 3, 'order_' || lower(o_orderstatus), o_orderpriority, '', CAST(o_orderkey AS INTEGER) FROM orders""")
CTE["tree_edges"] = ([], """
    SELECT 'dir::' || r_name AS src, 'file::' || n_name AS dst, 'contains' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'file::NATION_' || c_nationkey, 'sym::' || c_custkey, 'contains' FROM customer
    UNION ALL SELECT 'sym::' || o_custkey, 'sub::' || o_orderkey, 'contains' FROM orders""")
CTE["call_sites"] = ([], "SELECT 'supplier::' || l_suppkey AS src, 'part::' || l_partkey AS dst FROM lineitem")
CTE["call_nodes"] = ([], "SELECT 'supplier::' || s_suppkey AS id, s_name AS label FROM supplier UNION ALL SELECT 'part::' || p_partkey, p_name FROM part")


def _named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    def rows(df: DataFrame, id_: Column, depth: int, kind: Column, label: str, file: Column, line: Column) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(depth).alias("depth"), kind.alias("kind"), F.col(label).alias("label"),
                         file.alias("file"), line.cast("int").alias("line"))

    t = lambda name: table(spark, sf, name)
    return (
        rows(t("region"), _named("dir::", "r_name"), 0, F.lit("directory"), "r_name", F.lit(""), F.lit(0))
        .unionByName(rows(t("nation"), _named("file::", "n_name"), 1, F.lit("file"), "n_name", F.col("n_name"), F.lit(0)))
        .unionByName(rows(t("customer"), _named("sym::", "c_custkey"), 2, F.lower("c_mktsegment"), "c_name",
                          _named("NATION_", "c_nationkey"), F.col("c_custkey")))
        .unionByName(rows(t("orders"), _named("sub::", "o_orderkey"), 3, F.concat(F.lit("order_"), F.lower("o_orderstatus")),
                          "o_orderpriority", F.lit(""), F.col("o_orderkey")))
    )


def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    top = table(spark, sf, "nation").join(regions, "n_regionkey").select(_named("dir::", "r_name").alias("src"), _named("file::", "n_name").alias("dst"))
    mid = table(spark, sf, "customer").select(_named("file::NATION_", "c_nationkey").alias("src"), _named("sym::", "c_custkey").alias("dst"))
    low = table(spark, sf, "orders").select(_named("sym::", "o_custkey").alias("src"), _named("sub::", "o_orderkey").alias("dst"))
    return top.unionByName(mid).unionByName(low).withColumn("kind", F.lit("contains"))


def call_sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(_named("supplier::", "l_suppkey").alias("src"), _named("part::", "l_partkey").alias("dst"))


def call_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(_named("supplier::", "s_suppkey").alias("id"), F.col("s_name").alias("label")).unionByName(
        table(spark, sf, "part").select(_named("part::", "p_partkey").alias("id"), F.col("p_name").alias("label")))


# ---- imports, declarations, lexicon, positions, runs --------------------------------------

CTE["import_rows"] = ([], """
    SELECT 'file::order_' || l_orderkey AS file_id,
           'pkg.' || lower(replace(p_brand, '#', '_')) || CASE WHEN l_linenumber > 4 THEN '.' || lower(p_type) ELSE '' END AS module
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
CTE["import_stems"] = ([], """
    SELECT lower(replace(p_brand, '#', '_')) AS stem, 'file::brands/' || max(lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS file_id
    FROM part GROUP BY 1""")


def import_rows(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    module = F.concat(F.lit("pkg."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))),
                      F.when(F.col("l_linenumber") > 4, F.concat(F.lit("."), F.lower("p_type"))).otherwise(""))
    return table(spark, sf, "lineitem").join(part, "l_partkey").select(_named("file::order_", "l_orderkey").alias("file_id"), module.alias("module"))


def import_files(spark: SparkSession, sf: str) -> DataFrame:
    """Brand files; several share a stem, the greatest key comes last and wins."""
    key = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    return table(spark, sf, "part").select(
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("stem"), F.concat(F.lit("brands/"), key).alias("path"), key.alias("seq"))


CTE["c_decls"] = ([], """
    SELECT 'supplier::' || s_suppkey AS id, CASE WHEN s_acctbal < 3000 THEN 'enum' WHEN s_acctbal < 8000 THEN 'struct' ELSE 'union' END AS kind,
           'T' || s_suppkey AS name, 's' || s_nationkey AS file, CAST(s_suppkey AS INTEGER) AS line, '' AS type_str, CAST(NULL AS VARCHAR) AS parent_id,
           CAST(s_nationkey AS INTEGER) AS field_count FROM supplier
    UNION ALL
    SELECT 'part::' || p_partkey, CASE WHEN p_size < 20 THEN 'field' WHEN p_size < 30 THEN 'variable' WHEN p_size < 40 THEN 'typedef'
                                       WHEN p_size < 45 THEN 'enum_constant' ELSE 'function' END,
           CASE WHEN p_size = 7 THEN '(unnamed at ' || p_partkey || ')' ELSE replace(p_name, ' ', '_') END, 'p' || p_size, p_size,
           CASE WHEN p_size < 30 THEN 'const struct T' || ps || ' *' WHEN p_size < 40 THEN 'struct T' || ps ELSE 'int' END,
           CASE WHEN p_size < 20 OR p_size BETWEEN 40 AND 44 THEN 'supplier::' || ps END, NULL
    FROM (SELECT *, CAST(floor(p_retailprice) AS BIGINT) % (SELECT count(*) FROM supplier) AS ps FROM part)""")


def c_decls(spark: SparkSession, sf: str) -> DataFrame:
    """Declared symbols: suppliers are types, parts are members, variables, typedefs and functions."""
    supplier = table(spark, sf, "supplier")
    owners = supplier.select(
        _named("supplier::", "s_suppkey").alias("id"),
        F.when(F.col("s_acctbal") < 3000, "enum").when(F.col("s_acctbal") < 8000, "struct").otherwise("union").alias("kind"),
        _named("T", "s_suppkey").alias("name"), _named("s", "s_nationkey").alias("file"), F.col("s_suppkey").cast("int").alias("line"),
        F.lit("").alias("type_str"), F.lit(None).cast("string").alias("parent_id"), F.col("s_nationkey").cast("int").alias("field_count"))
    size, n = F.col("p_size"), supplier.agg(F.count(F.lit(1)))
    part = table(spark, sf, "part").withColumn("__n", n.scalar()).withColumn("ps", (F.floor("p_retailprice") % F.col("__n")).cast("string"))
    kind = F.when(size < 20, "field").when(size < 30, "variable").when(size < 40, "typedef").when(size < 45, "enum_constant").otherwise("function")
    members = part.select(
        _named("part::", "p_partkey").alias("id"), kind.alias("kind"),
        F.when(size == 7, F.concat(F.lit("(unnamed at "), F.col("p_partkey").cast("string"), F.lit(")"))).otherwise(
            F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"),
        _named("p", "p_size").alias("file"), size.cast("int").alias("line"),
        F.when(size < 30, F.concat(F.lit("const struct T"), F.col("ps"), F.lit(" *"))).when(
            size < 40, F.concat(F.lit("struct T"), F.col("ps"))).otherwise("int").alias("type_str"),
        F.when((size < 20) | size.between(40, 44), F.concat(F.lit("supplier::"), F.col("ps"))).alias("parent_id"),
        F.lit(None).cast("int").alias("field_count"))
    return owners.unionByName(members)


def full_c_decls(spark: SparkSession, sf: str) -> DataFrame:
    """`c_decls` with the columns that only some front ends fill."""
    return c_decls(spark, sf).withColumns({
        "qualifiers": F.array().cast("array<string>"), "member_count": F.lit(None).cast("int"), "param_count": F.lit(None).cast("int"),
        "is_definition": F.lit(None).cast("boolean")})


def c_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by nation, headers by part size, some sizes with a source or a header for one platform of the same stem."""
    size = table(spark, sf, "part").select("p_size").distinct()
    key = F.col("p_size").cast("string")
    paths = table(spark, sf, "nation").select(F.concat(F.lit("c/s"), F.col("n_nationkey").cast("string"), F.lit(".c")).alias("path")).unionByName(
        size.select(F.concat(F.lit("h/p"), key, F.lit(".h")).alias("path"))).unionByName(
        size.where("p_size % 3 > 0").select(F.concat(F.lit("a/p"), key, F.lit(".c")).alias("path"))).unionByName(
        size.where("p_size % 2 = 0").select(F.concat(F.lit("os/winnt/p"), key, F.lit(".h")).alias("path")))
    return tree.files_from_paths(paths.select(F.lit("tree").alias("repo"), "path", F.lit("").alias("url"), F.lit(0).cast("long").alias("size"), F.lit("").alias("raw")))


CTE["diagnostics"] = ([], """
    SELECT doc_id, source AS file, CASE WHEN toxic = 1 THEN 'fatal: x.h File Not Found' WHEN quality = 0 THEN 'Unknown type name u8' ELSE 'expected ;' END AS message
    FROM labels JOIN documents USING (doc_id)""")


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"))
    message = F.when(F.col("toxic") == 1, "fatal: x.h File Not Found").when(F.col("quality") == 0, "Unknown type name u8").otherwise("expected ;")
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "file", message.alias("message"))


CTE["lexicon_tokens"] = ([], """
    SELECT DISTINCT 'parts' AS language, 'Parts' AS display_name, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'keywords' ELSE 'operators' END AS kind,
           p_size AS layer_ordinal, 'size ' || p_size AS layer_name, '' AS gloss, p_brand AS "group", p_name AS token, lower(p_type) AS role,
           CASE WHEN p_type = 'PROMO' THEN 'c99' ELSE '' END AS since FROM part""")


def lexicon_tokens(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "keywords").otherwise("operators")
    return table(spark, sf, "part").select(
        F.lit("parts").alias("language"), F.lit("Parts").alias("display_name"), kind.alias("kind"), F.col("p_size").alias("layer_ordinal"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("layer_name"), F.lit("").alias("gloss"), F.col("p_brand").alias("group"),
        F.col("p_name").alias("token"), F.lower("p_type").alias("role"), F.when(F.col("p_type") == "PROMO", "c99").otherwise("").alias("since")).distinct()


CTE["points"] = ([], """
    SELECT 'v' || vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings""")
CTE["point_parents"] = (["points"], """
    SELECT 'L' || label AS id, arg_min(x, CAST(substr(id, 2) AS BIGINT)) AS x, arg_min(y, CAST(substr(id, 2) AS BIGINT)) AS y FROM points GROUP BY label""")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        _named("v", "vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"),
        F.get("embedding", F.lit(1)).cast("double").alias("y"), "label")


def point_parents(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    first = F.min_by("embedding", "vec_id")
    return e.groupBy("label").agg(first.alias("e")).select(
        _named("L", "label").alias("id"), F.get("e", F.lit(0)).cast("double").alias("x"), F.get("e", F.lit(1)).cast("double").alias("y"))


NOW = "2002-01-01 00:00:00"
CTE["run_rows"] = ([], """
    SELECT 'repo-' || c_nationkey || '::' || o_custkey AS key, o_orderpriority AS label, 'https://example.org/' || c_nationkey AS url,
           o_orderdate + to_microseconds(o_orderkey) AS ts, CAST(round(o_totalprice) AS BIGINT) AS size_bytes
    FROM orders JOIN customer ON o_custkey = c_custkey""")


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue rows: customers are runs, their orders the stored versions."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    at = F.timestamp_micros(F.unix_micros(times.as_utc(F.col("o_orderdate").cast("timestamp_ntz"))) + F.col("o_orderkey"))
    return table(spark, sf, "orders").join(customer, "o_custkey").select(
        F.concat(_named("repo-", "c_nationkey"), F.lit("::"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_orderpriority").alias("label"), _named("https://example.org/", "c_nationkey").alias("url"), F.lit("").alias("mode"),
        F.lit("").alias("layout"), at.alias("ts"), F.round("o_totalprice").cast("long").alias("size_bytes"))


def now() -> Column:
    return F.lit(NOW + "+00:00").cast("timestamp")
