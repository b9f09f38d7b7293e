"""Queries over sources, reports and text functions, each with its SQL.

Rows become files in the folder that the cluster shares; sources read them back, and the SQL says which must be found.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalint.operators import packages
from stratalint.plans import api, report, score
from stratalint.sources import files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which must be mounted; a temporary one only where that is unset and the session local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if shared and not shared.startswith(("file:", "/")):
        raise ValueError(f"source trees need a mounted folder, not {shared}")
    at = f"{shared.removeprefix('file:').rstrip('/')}/tree-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tree-")
    at = "/" + at.lstrip("/")
    os.makedirs(at, exist_ok=True)
    return at


def _write(df: DataFrame, root: str) -> None:
    """Write the files of df (path below root, content) from the tasks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, made = 0, set()
        for b in it:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                at = f"{root}/{path}"
                if (above := os.path.dirname(at)) not in made:
                    os.makedirs(above, exist_ok=True)
                    made.add(above)
                with open(f"{at}.{uuid.uuid4().hex}~", "wb") as f:
                    f.write(content)
                os.replace(f.name, at)  # a task run again writes the same
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # a file costs far more to write than its row to move, and a table of few bytes is one partition
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    df.select(F.expr("path"), F.expr("cast(content as binary) as content")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """What a function on the driver gave: a row for each package, argument or printed line."""
    return spark.createDataFrame(rows, schema)


# The directory of a part: hidden, an egg, a noise name or plain; and its file's kind.
_DIR = "concat(case p_size % 10 when 0 then '.' else '' end, replace(p_brand, 'Brand#', 'b'), 's', p_size, case p_size % 10 when 1 then '.egg-info' else '' end)"
_DIR_SQL = _DIR


def _tree(spark: SparkSession, sf_dir: str) -> str:
    root = f"{_folder(spark)}/ws"
    part = _table(spark, sf_dir, "part")
    _write(part.select(F.expr(f"concat({_DIR}, '/in/p', p_partkey, if(p_partkey % 2 = 0, '.py', '.txt')) as path"), F.lit("x = 1\n").alias("content")), root)
    for name in ("build", "node_modules"):
        os.makedirs(f"{root}/{name}", exist_ok=True)
        with open(f"{root}/{name}/a.py", "w") as f:
            f.write("x = 1\n")
    with open(f"{root}/loose.py", "w") as f:
        f.write("x = 1\n")
    return root


def discover_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages of a working directory: every directory that holds Python, but for hidden and noise ones, and loose files."""
    root = _tree(spark, sf_dir)
    return _rows(spark, [(n, os.path.relpath(p, root), deep) for n, (p, deep) in files.discover(root).items()], "package string, path string, recursive boolean")


_DISCOVER = f"SELECT DISTINCT {_DIR_SQL} AS package, {_DIR_SQL} AS path, true AS recursive FROM part WHERE p_partkey % 2 = 0 AND p_size % 10 > 1 UNION ALL SELECT 'ws', '.', false"


def yaml_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages, stems and libraries of a registry file, which names every supplier."""
    root = _folder(spark)
    keys = [r[0] for r in _table(spark, sf_dir, "supplier").select("s_suppkey").orderBy("s_suppkey").toLocalIterator()]
    with open(f"{root}/registry.yaml", "w") as f:
        f.write("# packages of the suppliers\npackages:\n" + "".join(f"  \"s{k}\": 'src/{k}'  # number {k}\n" for k in keys) + "\nstems:\n" + "".join(f"  s{k}: stem.s{k}\n" for k in keys if k % 3 == 0))
        f.write("libraries: [" + ", ".join(f"s{k}" for k in keys if k % 5 == 0) + "]\n")
    config = files.read_settings(f"{root}/registry.yaml")
    found = files.read_registry(f"{root}/registry.yaml")
    return _rows(spark, [(n, os.path.relpath(p, root), deep, config.stems.get(n), n in config.libraries) for n, (p, deep) in found.items()], "package string, path string, recursive boolean, stem string, library boolean")


_REGISTRY = "SELECT 's' || s_suppkey AS package, 'src/' || s_suppkey AS path, true AS recursive, CASE WHEN s_suppkey % 3 = 0 THEN 'stem.s' || s_suppkey END AS stem, s_suppkey % 5 = 0 AS library FROM supplier"


def named_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAME=PATH arguments, one for each nation, relative to the working directory."""
    names = [(r["n_name"], r["n_nationkey"]) for r in _table(spark, sf_dir, "nation").collect()]
    found = files.named([f" {n} = sub/../at/{k} " for n, k in names], "/cwd")
    return _rows(spark, [(n, p, deep) for n, (p, deep) in found.items()], "package string, path string, recursive boolean")


_NAMED = "SELECT n_name AS package, '/cwd/at/' || n_nationkey AS path, true AS recursive FROM nation"


def workspace_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspace root above each nation's directory: its region's, where that has a workspace table, else the outer one."""
    root = _folder(spark)
    for path, text in [("", "[tool.uv.workspace]\nmembers = []\n"), *[(f"r{r}", "[tool.uv.workspace]\n" if r % 2 == 0 else "[tool.other]\n") for r in range(5)]]:
        os.makedirs(f"{root}/{path}", exist_ok=True)
        with open(f"{root}/{path}/pyproject.toml", "w") as f:
            f.write(text)
    rows = []
    for r in _table(spark, sf_dir, "nation").collect():
        at = f"{root}/r{r['n_regionkey']}/a/n{r['n_nationkey']}"
        os.makedirs(at, exist_ok=True)
        found = files.workspace_root(at)
        rows.append((r["n_nationkey"], None if found is None else os.path.relpath(found, root)))
    return _rows(spark, rows, "n_nationkey int, root string")


_ROOTS = "SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey ELSE '.' END AS root FROM nation"

_SKIPPED = [x.strip("/") for x in files.DEFAULT_EXCLUDES]


def _written_parts(spark: SparkSession, sf_dir: str, path: str, content: str) -> str:
    root = _folder(spark)
    _write(_table(spark, sf_dir, "part").select(F.expr(f"{path} as path"), F.expr(f"{content} as content")), root)
    return root


def walk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Python file of a package's tree, names with leading underscores and dots among them, and no other file."""
    root = _written_parts(spark, sf_dir, "concat('d', p_size, case p_partkey % 3 when 0 then '/__pycache__/' when 1 then '/_in/' else '/' end, case p_partkey % 4 when 0 then '_p' when 1 then '.p' else 'p' end, p_partkey, if(p_partkey % 5 = 0, '.pyi', '.py'))", "''")
    return files.read_packages(spark, {"w": (root, True)}).select("package", F.expr(f"substring(path, {len(root) + 2})").alias("path"))


_WALK = """SELECT 'w' AS package, concat('d', p_size, CASE p_partkey % 3 WHEN 1 THEN '/_in/' ELSE '/' END, CASE p_partkey % 4 WHEN 0 THEN '_p' WHEN 1
  THEN '.p' ELSE 'p' END, p_partkey, '.py') AS path
FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0"""


def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of files, line ends as they are; a file that isn't UTF-8 counts, with no text."""
    root = _written_parts(spark, sf_dir, "concat('p', p_partkey, '.py')", "case p_size % 3 when 0 then unhex('ff41') when 1 then cast(concat('é = 1\\r\\n', repeat('x\\n', p_size)) as binary) else cast(p_name as binary) end")
    x = files.read_packages(spark, {"w": (root, True)})
    return x.select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), F.char_length("source").cast("long").alias("n"), F.sha2("source", 256).alias("sha256"))


_READ = r"""WITH t AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'é = 1' || chr(13) || chr(10) || repeat('x' || chr(10),
  p_size) ELSE p_name END AS t FROM part)
SELECT 'p' || p_partkey || '.py' AS path, length(t) AS n, sha256(t) AS sha256 FROM t"""


def default_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare scan leaves out every noise directory, and takes files in all others."""
    names = ", ".join(f"'{'x' if n.startswith('.egg') else ''}{n}'" for n in _SKIPPED)
    root = _written_parts(spark, sf_dir, f"concat('pkg/', element_at(array({names}, 'src', 'venvs', 'git'), cast(p_size % {len(_SKIPPED) + 3} as int) + 1), '/p', p_partkey, '.py')", "''")
    found = files.discover(root)
    return files.read_packages(spark, found, files.DEFAULT_EXCLUDES).select("package", F.expr(f"substring(path, {len(root) + 2})").alias("path"))


_EXCLUDES = f"SELECT 'pkg' AS package, 'pkg/' || ['src', 'venvs', 'git'][p_size % {len(_SKIPPED) + 3} - {len(_SKIPPED)} + 1] || '/p' || p_partkey || '.py' AS path FROM part WHERE p_size % {len(_SKIPPED) + 3} >= {len(_SKIPPED)}"

# Reports: a complex function, a suppressed or open star import and a mutable global, in a package of the part's brand.
_SOURCE = r"""concat('def f(x: int) -> int:\n', repeat('    if x:\n        x = 1\n', p_size), '    return x_', p_partkey, '\n', if(p_size % 2 = 0, concat('from m import *', if(p_size % 3 = 0, '  # lint-ignore[star-import]: known\n', '\n')), ''), if(p_size % 5 = 0, 'g = []\n', ''))"""
_PATH = "'/w/' || p_brand || '/p' || p_partkey || '.py'"
_ISSUES = f"""WITH i AS (SELECT p_brand AS package, {_PATH} AS path, 1 AS line, CASE WHEN p_size + 1 > 15 THEN 'error' ELSE 'warning' END AS severity,
  'high-complexity' AS rule, 5 AS rule_no, false AS ignored,
  'f() has cyclomatic complexity ' || (p_size + 1) || ' (max 10)' AS message FROM part WHERE p_size + 1 > 10
UNION ALL SELECT p_brand, {_PATH}, 2 * p_size + 3, 'warning', 'star-import', 17, p_size % 3 = 0, 'star import from m' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_brand, {_PATH}, 2 * p_size + 3 + (p_size % 2 = 0)::INT, 'info', 'global-mutable', 18, false, 'module-level g is mutable' FROM part
  WHERE p_size % 5 = 0),
w AS (SELECT *, CASE severity WHEN 'error' THEN 6.0 WHEN 'warning' THEN 1.5 ELSE 0.3 END AS weight FROM i WHERE NOT ignored),
n AS (SELECT count(*) AS n_files, sum(2 * p_size + 2 + (p_size % 2 = 0)::INT + (p_size % 5 = 0)::INT) AS n_lines FROM part),
"""


def _reported(spark: SparkSession, sf_dir: str) -> api.ScanResult:
    part = _table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    source = part.select(F.col("p_brand").alias("package"), F.expr("concat('/w/', p_brand)").alias("root"), F.expr("concat('/w/', p_brand, '/p', p_partkey, '.py')").alias("path"), F.expr(_SOURCE).alias("source"))
    return api.scan_sources(source)


def _printed(spark: SparkSession, lines: list[str]) -> DataFrame:
    return _rows(spark, [(i, x) for i, x in enumerate(lines)], "at int, text string")


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the text report, in order, of warnings and worse."""
    with _reported(spark, sf_dir) as r:
        return report.text_table(r, "warning", "/w")


_TEXT = _ISSUES + f"""c AS (SELECT count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS a,
  count(*) FILTER (severity = 'info') AS o, greatest(0.0, 100 - coalesce(sum(weight), 0)::DOUBLE / (any_value(n_lines) / 1000.0)) AS x FROM w, n),
t AS (SELECT 0 AS k, 0 AS j, repeat('=', {report.WIDTH}) AS text UNION ALL SELECT 0, 1, n_files || ' files, ' || n_files || ' functions, ' || n_lines || ' lines' FROM n
UNION ALL SELECT 0, 2, e || ' error, ' || a || ' warning, ' || o || ' info' FROM c UNION ALL SELECT 0, 3, (SELECT count(*) FROM i WHERE ignored)
  || ' suppressed' UNION ALL SELECT 0, 4, '{report.HINT}'
UNION ALL SELECT 0, 5, 'health ' || printf('%.1f', x) || ' (' || CASE WHEN x >= 90 THEN 'A' WHEN x >= 75 THEN 'B' WHEN x >= 60 THEN 'C' WHEN x >= 40
  THEN 'D' ELSE 'F' END || ')' FROM c UNION ALL SELECT 0, 6, repeat('=', {report.WIDTH})
UNION ALL SELECT 1, row_number() OVER (ORDER BY path, line, rule), 'ignored ' || path[4:] || ':' || line || ' ' || rule || ': known' FROM i WHERE ignored
UNION ALL SELECT 2, row_number() OVER (ORDER BY package, path, rule_no, line), path[4:] || ':' || line || ': ' || severity || ' [' || rule || '] '
  || message || ' (' || package || ')' FROM w WHERE severity <> 'info')
SELECT CAST(row_number() OVER (ORDER BY k, j) - 1 AS INTEGER) AS at, text FROM t"""


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the JSON report as it reads back: filtered ones, all suppressed ones, and their number."""
    with _reported(spark, sf_dir) as r:
        t = report.json_table(r, "error", "/w")
    t = t.withColumn("x", F.from_json("text", "file string, line int, severity string, rule string, message string, package string, reason string"))
    return t.select("part", "at", "x.file", F.coalesce("x.line", F.when(F.col("part") == "suppressed", 0)).alias("line"), "x.severity", "x.rule", "x.message", "x.package", "x.reason")


_JSON = _ISSUES + """a AS (SELECT 'issues' AS part, CAST(row_number() OVER (ORDER BY package, path, rule_no, line) - 1 AS INTEGER) AS at, path[4:] AS file,
  CAST(line AS INTEGER) AS line, severity, rule, message, package, NULL::VARCHAR AS reason FROM w WHERE severity = 'error'
UNION ALL SELECT 'ignored', CAST(row_number() OVER (ORDER BY package, path, rule_no, line) - 1 AS INTEGER), path[4:], CAST(line AS INTEGER), severity, rule,
  message, package, 'known' FROM i WHERE ignored
UNION ALL SELECT 'suppressed', CAST(count(*) AS INTEGER), NULL, 0, NULL, NULL, NULL, NULL, NULL FROM i WHERE ignored)
SELECT * FROM a"""


def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the remediation plan, with descriptions, first files and numbers of further ones."""
    with _reported(spark, sf_dir) as r:
        return _printed(spark, report.plan_report(r, root="/w").splitlines())


_PLAN = _ISSUES + f"""g AS (SELECT rule, max(weight) AS weight, count(DISTINCT path) AS n_files, min(path) AS first_file, count(*) AS n_issues,
  arg_min(message, (package, path, line)) AS description FROM w GROUP BY rule),
e AS (SELECT *, CASE weight WHEN 6.0 THEN 'error' WHEN 1.5 THEN 'warning' ELSE 'info' END AS severity, CASE rule WHEN 'high-complexity'
  THEN 3.0 WHEN 'global-mutable' THEN 1.5 ELSE 0.5 END AS cost FROM g),
s AS (SELECT *, CASE WHEN weight * cost >= 12 THEN 'P0' WHEN weight * cost >= 7 THEN 'P1' WHEN weight * cost >= 3 THEN 'P2' ELSE 'P3' END AS p,
  CASE WHEN cost >= 4 THEN 'major' WHEN cost >= 2.5 THEN 'moderate' WHEN cost >= 1 THEN 'minor' ELSE 'trivial' END AS effort,
  row_number() OVER (ORDER BY weight * cost DESC, n_issues DESC, rule) AS i FROM e),
t AS (SELECT 0 AS k, j AS j, x AS text FROM (VALUES (0, repeat('=', {report.WIDTH})), (1, 'Remediation plan'), (2, repeat('=', {report.WIDTH}))) AS v(j,
  x) WHERE (SELECT count(*) FROM s) > 0
UNION ALL SELECT 0, 0, 'All clean: nothing to fix.' WHERE (SELECT count(*) FROM s) = 0
UNION ALL SELECT 1, right(p, 1)::INT, p || ' ' || ['critical', 'high', 'medium', 'low'][right(p, 1)::INT + 1] || ': ' || count(*) || ' rules' FROM s GROUP BY p
UNION ALL SELECT 2, i, lpad(i::VARCHAR, 2, ' ') || '. ' || p || ' ' || rule || ' (' || severity || ', ' || effort || ') x' || n_issues || ' in '
  || first_file[4:] || CASE WHEN n_files > 1 THEN ' +' || (n_files - 1) ELSE '' END || ': ' || description FROM s WHERE i <= 5
UNION ALL SELECT 3, right(p, 1)::INT, p || ': ' || string_agg(rule, ', ' ORDER BY i) FROM s GROUP BY p)
SELECT CAST(row_number() OVER (ORDER BY k, j) - 1 AS INTEGER) AS at, text FROM t"""


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of scans of every part's module: with errors, with warnings at most, with neither, and with all suppressed."""
    part = _table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    rows = []
    for case, source in (("all", _SOURCE), ("warnings", r"if(p_size % 2 = 0, 'from m import *\n', 'x = 1\n')"), ("infos", r"concat('g = []  # ', p_partkey, '\n')"), ("suppressed", r"'from m import *  # lint-ignore\n'")):
        x = part.select(F.col("p_brand").alias("package"), F.lit("/w").alias("root"), F.expr("concat('/w/p', p_partkey, '.py')").alias("path"), F.expr(source).alias("source"))
        with api.scan_sources(x) as r:
            rows.append((case, report.exit_code(r)))
    return _rows(spark, rows, "scan string, code int")


_EXIT = """SELECT 'all' AS scan, CASE WHEN count(*) FILTER (p_size + 1 > 15) > 0 THEN 2 WHEN count(*) FILTER (p_size + 1 > 10 OR p_size % 6 IN (2, 4)) > 0
  THEN 1 ELSE 0 END AS code FROM part
UNION ALL SELECT 'warnings', CASE WHEN count(*) FILTER (p_size % 2 = 0) > 0 THEN 1 ELSE 0 END FROM part UNION ALL SELECT 'infos', 0 UNION ALL SELECT 'suppressed', 0"""


def merge_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans as one: issues and counters add up."""
    part = _table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    x = part.select(F.lit("other").alias("package"), F.lit("/o").alias("root"), F.expr("concat('/o/p', p_partkey, '.py')").alias("path"), F.expr(r"concat(repeat('g = {}\n', p_size % 4), 'def f(', if(p_size % 2 = 0, 'a=[]', ''), ') -> int: pass\n')").alias("source"))
    r = api.hold(lambda: _reported(spark, sf_dir).merge(api.scan_sources(x)))
    n = r.issues.groupBy("rule").agg(F.count("*").alias("n"))
    return n.union(r.stats.select(F.lit("files"), "n_files")).union(r.stats.select(F.lit("lines"), "n_lines")).union(r.stats.select(F.lit("functions"), "n_functions"))


_MERGE = _ISSUES + """m AS (SELECT rule FROM w UNION ALL SELECT 'global-mutable' FROM part, unnest(generate_series(1, p_size % 4)) UNION ALL
  SELECT 'mutable-default' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT 'missing-param-type' FROM part WHERE p_size % 2 = 0)
SELECT rule, count(*) AS n FROM m GROUP BY rule UNION ALL SELECT 'files', 2 * n_files FROM n UNION ALL SELECT 'lines', CAST(n_lines + (
  SELECT sum(p_size % 4 + 1) FROM part) AS BIGINT) FROM n UNION ALL SELECT 'functions', 2 * n_files FROM n"""


def issue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with its priority score and level: its severity's weight times its rule's effort."""
    s = score.issue_score(F.col("severity"), F.col("rule"))
    return api.hold(lambda: _reported(spark, sf_dir)).issues.select("path", "line", "rule", s.alias("score"), score.priority(s).alias("priority"))


_SCORES = _ISSUES + """e AS (SELECT *, CAST(weight * CASE rule WHEN 'high-complexity' THEN 3.0 WHEN 'global-mutable' THEN 1.5 ELSE 0.5 END AS DOUBLE) AS score FROM w)
SELECT path, CAST(line AS INTEGER) AS line, rule, round(score, 6) AS score, CASE WHEN score >= 12 THEN 'P0' WHEN score >= 7 THEN 'P1' WHEN score >= 3
  THEN 'P2' ELSE 'P3' END AS priority FROM e"""

# Every rule with its effort to fix, written out once more, and one that has none of its own.
_RULES = {r: cost for cost, names in [
    (0.5, "dead-code missing-param-type missing-else magic-string magic-number todo-marker untyped-dict mutable-default unused-import star-import"),
    (1.0, "pass-through-method another-rule missing-return-type duplicate-branch message-chain encapsulation-violation syntax-error excessive-decorators bare-except"),
    (1.5, "global-mutable swallowed-exception boolean-flag-params excessive-returns lazy-class"),
    (2.0, "deep-nesting scope-mutation too-many-params"),
    (2.5, "long-file long-function potential-circular-import"),
    (3.0, "deep-inheritance sync-async-duplication duplicate-function-body high-complexity"),
    (4.0, "god-module high-coupling layer-violation transport-in-library"),
    (5.0, "import-cycle god-class"),
] for r in names.split()}


def fix_efforts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effort, label, score and priority of a finding for each part, over all rules and severities."""
    names = ", ".join(f"'{r}'" for r in _RULES)
    x = _table(spark, sf_dir, "part").select("p_partkey", F.expr(f"element_at(array({names}), cast(p_partkey % {len(_RULES)} as int) + 1)").alias("rule"), F.expr("element_at(array('error', 'warning', 'info'), p_size % 3 + 1)").alias("severity"))
    e, s = score.effort(F.col("rule")), score.issue_score(F.col("severity"), F.col("rule"))
    return x.select("p_partkey", "rule", "severity", e.alias("effort"), score.effort_label(e).alias("label"), s.alias("score"), score.priority(s).alias("priority"))


_EFFORTS = f"""WITH r(i, rule, cost) AS (VALUES {", ".join(f"({i}, '{r}', {c}::DOUBLE)" for i, (r, c) in enumerate(_RULES.items()))}),
w(j, severity, weight) AS (VALUES (0, 'error', 6.0::DOUBLE), (1, 'warning', 1.5::DOUBLE), (2, 'info', 0.3::DOUBLE)),
s AS (SELECT p_partkey, rule, severity, cost, round(weight * cost, 6) AS score FROM part JOIN r ON i = p_partkey % {len(_RULES)} JOIN w ON j = p_size % 3)
SELECT p_partkey, rule, severity, cost AS effort, CASE WHEN cost >= 4 THEN 'major' WHEN cost >= 2.5 THEN 'moderate' WHEN cost >= 1 THEN 'minor' ELSE 'trivial' END AS label, score,
CASE WHEN score >= 12 THEN 'P0' WHEN score >= 7 THEN 'P1' WHEN score >= 3 THEN 'P2' ELSE 'P3' END AS priority FROM s"""

_TWIN = r"""concat('def load(k):\n    a = 1\n    b = 2\n    return \'', repeat('x', p_size), '\'\nasync def aload(k):\n    a = 1\n    b = 2\n    return \'', repeat('x', cast(p_partkey % 60 as int)), '\'\n')"""


def similarity_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity of each function and its twin, in both orders. The two have equal heads, and texts of x of other lengths."""
    part = _table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    x = part.select(F.lit("g").alias("package"), F.lit("/w").alias("root"), F.expr("concat('/w/p', p_partkey, '.py')").alias("path"), F.expr(_TWIN).alias("source"))
    return api.shred_sources(x, packages.TWINS).select("path", F.explode("twins").alias("t")).select("path", "t.name", "t.other", F.bround("t.ratio", 12).alias("ratio"))


# Equal: "def ", the name without its a to the texts' common x, and the closing quote; where both texts are equal, all but "async " and "a".
_RATIOS = f"""WITH t AS (SELECT p_partkey, p_size AS x, p_partkey % 60 AS y, length('def load(k):\n    a = 1\n    b = 2\n    return ''''') AS h FROM part),
r AS (SELECT p_partkey, 2.0 * (h + least(x, y)) / (2 * h + 7 + x + y) AS ratio FROM t)
SELECT '/w/p' || p_partkey || '.py' AS path, name, CASE name WHEN 'load' THEN 'aload' ELSE 'load' END AS other, round(CAST(ratio AS DOUBLE), 12) AS ratio
  FROM r, (VALUES ('load'), ('aload')) AS n(name)"""


def unparsed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of each function, whatever its spaces, quotes, parentheses and comments."""
    part = _table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    source = r"""concat('@ d ( ', p_size, ' )\ndef  f( a ,b = "', p_brand, '" ):  # ', p_name, '\n', repeat(' \n', p_size % 3), '  if( a ):\n\n        return ( a+b )\n  else : return   not(a)\nx = f\n')"""
    x = part.select(F.lit("g").alias("package"), F.lit("/w").alias("root"), F.expr("concat('/w/p', p_partkey, '.py')").alias("path"), F.expr(source).alias("source"))
    return api.unparse_functions(x)


_UNPARSED = r"""SELECT '/w/p' || p_partkey || '.py' AS path, 'f' AS name, CAST(2 AS INTEGER) AS line, '@d(' || p_size || ')' || chr(10) || 'def f(a, b=''' || p_brand || '''):' || chr(10) || '    if a:' || chr(10) || '        return a + b' || chr(10) || '    else:' || chr(10) || '        return not a' AS text FROM part"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "discover_packages": (discover_packages, _DISCOVER), "yaml_registry": (yaml_registry, _REGISTRY), "named_paths": (named_paths, _NAMED), "workspace_roots": (workspace_roots, _ROOTS),
    "walk_tree": (walk_tree, _WALK), "read_files": (read_files, _READ), "default_excludes": (default_excludes, _EXCLUDES),
    "text_report": (text_report, _TEXT), "json_report": (json_report, _JSON), "plan_report": (plan_report, _PLAN), "exit_codes": (exit_codes, _EXIT),
    "merge_scans": (merge_scans, _MERGE), "issue_scores": (issue_scores, _SCORES), "fix_efforts": (fix_efforts, _EFFORTS), "similarity_ratios": (similarity_ratios, _RATIOS), "unparsed_functions": (unparsed_functions, _UNPARSED),
}
