"""Queries over generated modules, and for each an independent closed form in SQL.

The tables hold no Python, so every row of part (or of other tables) becomes a module whose facts follow from its columns.
The Spark side writes, parses and judges the modules; the SQL side computes what must come out from the columns alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalint.functions.config import ScanConfig
from stratalint.operators import packages, rules, suppress
from stratalint.plans import api, score
from stratalint.tree_queries import QUERIES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _modules(df: DataFrame, source: str, path: str = "concat('/w/g/p', p_partkey, '.py')", package: str = "'g'", root: str = "'/w/g'") -> DataFrame:
    # a module costs far more to parse than its row to move, and a table of few bytes is one partition
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df.select(F.expr(package).alias("package"), F.expr(root).alias("root"), F.expr(path).alias("path"), F.expr(source).alias("source"))


def _each(k: str, item: str) -> str:
    """SQL of item, over i from 1 to k, concatenated."""
    return f"concat_ws('', transform(if({k} > 0, sequence(1, {k}), array()), i -> {item}))"


def _some(k: str, item: str, between: str = ", ") -> str:
    return f"array_join(transform(if({k} > 0, sequence(1, {k}), array()), i -> {item}), '{between}')"


_PATH = "'/w/g/p' || p_partkey || '.py'"


def _rows(line: str, severity: str, where: str, more: str = "") -> str:
    return f"SELECT {_PATH} AS path, CAST({line} AS INTEGER) AS line, {severity} AS severity FROM part{more} WHERE {where}"


_UPTO = ", unnest(generate_series(1, {})) AS t(i)"
_CONFIG = ScanConfig(libraries=("g",), layers={"g": [("", ["app."])]})

#: Query -> (rule, source of a part's module in Spark SQL, what must come out in DuckDB SQL).
FILE_RULES: dict[str, tuple[str, str, str]] = {
    "high_complexity": ("high-complexity", r"concat('def f(x):\n', repeat('    if x:\n        x = 1\n', p_size), '    return x\n')", _rows("1", "CASE WHEN p_size + 1 > 15 THEN 'error' ELSE 'warning' END", "p_size + 1 > 10")),
    "deep_nesting": ("deep-nesting", r"concat('def f(x):\n', " + _each("p_size % 9", r"concat(repeat('    ', i), 'if x:\n')") + r", repeat('    ', p_size % 9 + 1), 'pass\n')", _rows("1", "'warning'", "p_size % 9 > 5")),
    "long_function": ("long-function", r"concat('def f(x):\n    if x:\n        if x:\n            if x:\n', repeat('                x = 1\n', p_size + 20))", _rows("1", "'warning'", "p_size + 24 > 50")),
    "long_file": ("long-file", r"repeat('x = 1\n', p_size * 16)", _rows("1", "'warning'", "p_size * 16 > 400")),
    "too_many_params": ("too-many-params", "concat('def f(', " + _some("p_size % 12", "concat('a', i)") + r", '):\n    pass\n')", _rows("1", "'warning'", "p_size % 12 > 6")),
    "excessive_returns": ("excessive-returns", r"concat('def f(x):\n', repeat('    if x:\n        if x:\n            return 1\n', p_size % 7), '    return 0\n')", _rows("1", "'info'", "p_size % 7 > 3")),
    "boolean_flag_params": ("boolean-flag-params", "concat('def f(', " + _some("p_size % 6", "concat('a', i, '=True')") + r", '):\n    pass\n')", _rows("1", "'info'", "p_size % 6 >= 3")),
    "missing_return_type": ("missing-return-type", r"concat('def ', if(p_size % 3 = 0, '_', ''), 'f()', if(p_size % 2 = 0, ' -> int', ''), ':\n    return 1\n')", _rows("1", "'warning'", "p_size % 3 <> 0 AND p_size % 2 <> 0")),
    "missing_param_type": ("missing-param-type", "concat('def f(self, ', " + _some("p_size % 5 + 1", "concat('a', i, if(i % 2 = 0, ': int', ''))") + r", ') -> None:\n    pass\n')", _rows("1", "'info'", "i % 2 = 1", _UPTO.format("p_size % 5 + 1"))),
    "mutable_default": ("mutable-default", r"concat('def f(a=', element_at(array('[]', '{}', 'None', '()'), p_size % 4 + 1), '):\n    pass\n')", _rows("1", "'warning'", "p_size % 4 < 2")),
    "bare_except": ("bare-except", r"concat('try:\n    x = 1\nexcept', if(p_size % 2 = 0, ' ValueError', ''), ':\n    raise\n')", _rows("3", "'warning'", "p_size % 2 = 1")),
    "swallowed_exception": ("swallowed-exception", r"concat('try:\n    x = 1\nexcept ValueError:\n    ', element_at(array('pass', '...', 'raise', 'x = 2'), p_size % 4 + 1), '\n')", _rows("3", "'warning'", "p_size % 4 < 2")),
    # the last statement of the block: of 18 kinds, five make the rule speak
    "missing_else": (
        "missing-else",
        r"concat('def f(a, x):\n    for q in x:\n        if a:\n', repeat('            y = 1\n', p_size % 3), '            ', element_at(array('z = 1', 'return', 'raise x', 'break', 'continue', 'if x: z = 1', 'a()', 'yield q', 'yield from q', "
        r"'for z in x: pass', 'while x: pass', 'a.b = 1', 'a[0] = 1', 'a.b += 1', 'z, a.b = 1, 2', 'z += 1', 'assert x', 'if x: z = 1\n            else: z = 2'), cast(p_partkey % 18 as int) + 1), '\n', if(p_size % 5 = 0, '        else:\n            y = 2\n', ''))",
        _rows("3", "'info'", "p_size % 3 >= 1 AND p_size % 5 <> 0 AND p_partkey % 18 IN (0, 14, 15, 16, 17)"),
    ),
    "unused_import": ("unused-import", "concat(" + _each("p_size % 5", r"concat('import m', i, '\n')") + ", " + _each("p_size % 5", r"if(i % 2 = 0, concat('m', i, '.f()\n'), '')") + ")", _rows("i", "'warning'", "i % 2 = 1", _UPTO.format("p_size % 5"))),
    "star_import": ("star-import", "concat(" + _each("p_size % 5", r"concat('from m import ', if(i % 2 = 0, '*', 'a'), '\n')") + ")", _rows("i", "'warning'", "i % 2 = 0", _UPTO.format("p_size % 5"))),
    "global_mutable": ("global-mutable", _each("p_size % 5", r"concat(if(i = 2, '_', ''), 'g', i, ' = ', if(i % 2 = 0, '[]', '{}'), '\n')"), _rows("i", "'info'", "i <> 2", _UPTO.format("p_size % 5"))),
    "scope_mutation": ("scope-mutation", r"concat('n = 0\ndef f():\n    ', if(p_size % 2 = 0, 'global n\n', 'n = 5\n'), if(p_size % 3 = 0, '    if n is None:\n        n = 1\n', '    n = 1\n'))", _rows("4", "'info'", "p_size % 2 = 0 AND p_size % 3 <> 0")),
    "dead_code": ("dead-code", r"concat('def f():\n    return 1\n', repeat('    x = 1\n', p_size % 6))", _rows("2 + i", "'warning'", "true", _UPTO.format("p_size % 6"))),
    "excessive_decorators": ("excessive-decorators", r"concat(repeat('@d\n', p_size % 7), if(p_size % 2 = 0, 'def f():\n    pass\n', 'class C:\n    pass\n'))", _rows("p_size % 7 + 1", "'info'", "p_size % 7 > 3")),
    # of 17 kinds of class, three aren't exempt
    "lazy_class": (
        "lazy-class",
        r"concat(element_at(array('class C:', 'class C(Base):', 'class C(Errors):', 'class C(ValueError):', 'class C(BaseModel):', 'class C(BaseSettings):', 'class C(NamedTuple):', 'class C(Protocol):', 'class C(a.Enum):', 'class C(StrEnum):', 'class C(IntFlag):', "
        r"'class C(OwnException):', 'class C(a.OwnWarning):', '@dataclass\nclass C:', '@a.dataclass(frozen=True)\nclass C:', 'class C:\n    y: Mapped[int]', 'class C:\n    y = Column(1)'), cast(p_partkey % 17 as int) + 1), '\n    x = 1\n', repeat('    def m(self):\n        return self\n', p_size % 4))",
        _rows("1", "'info'", "p_size % 4 < 2 AND p_partkey % 17 < 3"),
    ),
    # of 12 forms, seven are unnamed numbers; nine different ones are a table
    "magic_number": (
        "magic-number",
        r"concat('def f():\n    pass\n', if(p_size % 4 = 3, " + _each("9", r"concat('    x = ', 1000 + i, '\n')") + ", " + _each("p_size % 13", r"concat('    ', element_at(array('x = 1001', 'x = 404', 'x = 0x1F', 'x = 8080', 'x = 0.75', 'x = 1.0', 'x = -1', 'f(a=42)', 'f(a=[43])', 'f(44)', 'x = 1_000', 'x = 0o17'), i), '\n')") + "))",
        _rows("2 + i", "'info'", "p_size % 4 <> 3 AND i IN (1, 3, 5, 9, 10, 11, 12)", _UPTO.format("p_size % 13")),
    ),
    # compared with a name, with a field of syntax trees, from the left, and a single character
    "magic_string": (
        "magic-string",
        _each("p_size % 9", r"concat(element_at(array(concat('x == \'', p_brand, '\''), concat('x.id == \'', p_brand, '\''), concat('\'', p_brand, '\' != x'), 'x == \'B\''), (i - 1) % 4 + 1), '\n')"),
        _rows("i", "'info'", "(p_size % 9 + 1) // 2 >= 2 AND i % 2 = 1", _UPTO.format("p_size % 9")),
    ),
    "untyped_dict": ("untyped-dict", _each("p_size % 5", r"concat('x', i, ': ', if(i % 2 = 0, 'dict', 'dict[str, int]'), '\n')"), _rows("i", "'info'", "i % 2 = 0", _UPTO.format("p_size % 5"))),
    "duplicate_branch": ("duplicate-branch", r"concat('if x:\n    a = ', p_size % 3, '\nelse:\n    a = ', p_size % 2, '\n')", _rows("1", "'warning'", "p_size % 3 = p_size % 2")),
    "encapsulation_violation": ("encapsulation-violation", r"concat('def f(own, other):\n', " + _each("p_size % 6", r"concat('    ', element_at(array('own._a', 'other._a', 'other.__a__'), i % 3 + 1), '\n')") + r", '    return 1\n')", _rows("1 + i", "'info'", "i % 3 = 1", _UPTO.format("p_size % 6"))),
    # many methods, many attributes, or much complexity
    "god_class": (
        "god-class",
        "concat('class C:\n', case p_partkey % 3 when 0 then " + _each("p_size", r"concat('    def m', i, '(self):\n        return 1\n')") + r" when 1 then concat('    def __init__(self):\n', " + _each("p_size", r"concat('        self.a', i, ' = 1\n')") + r") else concat('    def m(self):\n', repeat('        if self:\n            pass\n', p_size * 2)) end)",
        _rows("1", "CASE WHEN p_partkey % 3 = 0 AND p_size > 37.5 OR p_partkey % 3 = 1 AND p_size > 30 OR p_partkey % 3 = 2 AND 2 * p_size + 1 > 75 THEN 'error' ELSE 'warning' END", "CASE p_partkey % 3 WHEN 0 THEN p_size > 25 WHEN 1 THEN p_size > 20 ELSE 2 * p_size + 1 > 50 END"),
    ),
    "god_module": ("god-module", _each("p_size", r"concat('def ', if(i % 5 = 0, '_', ''), 'f', i, '(): pass\n')"), _rows("1", "'warning'", "p_size - p_size // 5 > 15")),
    "deep_inheritance": ("deep-inheritance", r"concat('class C0: pass\n', " + _each("p_size % 8", r"concat('class C', i, '(C', i - 1, '): pass\n')") + ")", _rows("1 + i", "'warning'", "i >= 4", _UPTO.format("p_size % 8"))),
    "pass_through_method": ("pass-through-method", r"concat('def f(a, b):\n    return g(a, ', element_at(array('b', 'b + 1', '*b', '2'), p_size % 4 + 1), ')\n')", _rows("1", "'info'", "p_size % 4 IN (0, 2)")),
    "message_chain": ("message-chain", r"concat(if(p_size % 4 = 0, 'import a\n', 'a = 1\n'), 'x = a', repeat('.b', p_size % 7), '\n')", _rows("2", "'info'", "p_size % 7 > 3 AND p_size % 4 <> 0")),
    "transport_in_library": ("transport-in-library", r"concat('from ', element_at(array('httpx', 'flask.views', 'json', 'httpxx'), p_size % 4 + 1), ' import a\n')", _rows("1", "'error'", "p_size % 4 < 2")),
    "layer_violation": ("layer-violation", r"concat(if(p_size % 2 = 0, 'import ', 'from '), element_at(array('app.x', 'lib.x', 'apps'), p_size % 3 + 1), if(p_size % 2 = 0, '', ' import a'), '\n')", _rows("1", "'error'", "p_size % 3 = 0")),
    "potential_circular_import": ("potential-circular-import", r"concat('from ', element_at(array('g', 'h', 'g.other'), p_size % 3 + 1), ' import a\n')", _rows("1", "'warning'", "p_size % 3 = 0")),
    "syntax_error": ("syntax-error", r"concat('def f(', if(p_size % 2 = 0, '', '):'), '\n    pass\n')", _rows("1", "'error'", "p_size % 2 = 0")),
    "todo_marker": ("todo-marker", _each("p_size % 6", r"concat('x = 1  # ', element_at(array('TODO', 'fine', 'HACK'), i % 3 + 1), ' later\n')"), _rows("i", "'info'", "i % 3 <> 1", _UPTO.format("p_size % 6"))),
}


def _file_rule(rule: str, source: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = api.shred_sources(_modules(_table(spark, sf_dir, "part"), source), rules.needs(_CONFIG, frozenset([rule])))
        return rules.file_issues(facts, _CONFIG, frozenset([rule])).select("path", "line", "severity")

    return run


def duplicate_function_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies by brand, packages by type."""
    source = r"concat('def f', p_partkey, '():\n    a = \'', p_brand, '\'\n    b = 1\n    c = 2\n    return a\n')"
    facts = api.shred_sources(_modules(_table(spark, sf_dir, "part"), source, package="p_type"), packages.BODIES)
    return packages.duplicate_functions(facts, _CONFIG).select("package", "path", "line")


_DUPLICATES = f"SELECT p_type AS package, min({_PATH}) AS path, CAST(1 AS INTEGER) AS line FROM part GROUP BY p_type, p_brand HAVING count(*) > 1"


def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = r"concat('def f', p_partkey, '():\n    a = \'', p_brand, '\'\n    b = 1\n    c = 2\n    return a\n')"
    facts = api.shred_sources(_modules(_table(spark, sf_dir, "part"), source, package="p_type"), packages.BODIES)
    return packages.duplicate_members(facts, _CONFIG).select("package", "path", "line", "name")


_MEMBERS = f"SELECT package, path, CAST(1 AS INTEGER) AS line, name FROM (SELECT p_type AS package, {_PATH} AS path, 'f' || p_partkey AS name, count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM part) WHERE n > 1"


def sync_async_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function and its asynchronous twin, of the same body, in a package of their own."""
    body = r"repeat('    x = x + 1\n', p_size % 6 + 1)"
    source = rf"concat('def load(x):\n', {body}, 'async def aload(x):\n', {body})"
    facts = api.shred_sources(_modules(_table(spark, sf_dir, "part"), source, package="concat('g', p_partkey)"), packages.TWINS)
    return packages.twins(facts, _CONFIG).select("package", "path", "line", "severity")


_TWINS = f"SELECT 'g' || p_partkey AS package, {_PATH} AS path, CAST(1 AS INTEGER) AS line, 'warning' AS severity FROM part WHERE p_size % 6 + 2 >= 4"


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's suppliers import each other in a ring; module sN of package gM."""
    at = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    nxt = F.coalesce(F.lead("s_suppkey").over(at), F.min("s_suppkey").over(W.partitionBy("s_nationkey")))
    x = _table(spark, sf_dir, "supplier").withColumn("next", nxt)
    return _modules(x, r"concat('import g', s_nationkey, '.s', next, '\n')", "concat('/w/g', s_nationkey, '/s', s_suppkey, '.py')", "concat('g', s_nationkey)", "concat('/w/g', s_nationkey)")


_NATIONS = ScanConfig(stems={f"g{i}": f"g{i}" for i in range(25)})


def import_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = api.shred_sources(_ring(spark, sf_dir), packages.GRAPH)
    return packages.import_cycles(facts, _NATIONS).select("package", "path", "line", "severity")


_CYCLES = "SELECT 'g' || s_nationkey AS package, '/w/g' || s_nationkey || '/s' || arg_min(s_suppkey, 's' || s_suppkey) || '.py' AS path, CAST(1 AS INTEGER) AS line, 'error' AS severity FROM supplier GROUP BY s_nationkey"


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.import_edges(api.shred_sources(_ring(spark, sf_dir), packages.GRAPH), _NATIONS)


_EDGES = """SELECT 'g' || s_nationkey AS package, 'g' || s_nationkey || '.s' || s_suppkey AS src,
'g' || s_nationkey || '.s' || coalesce(lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey),
  min(s_suppkey) OVER (PARTITION BY s_nationkey)) AS dst FROM supplier"""


def high_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key is a module; that of a supplier imports the modules of the parts that it sells."""
    sold = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    g = sold.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("keys"))  # a supplier's parts: a file's imports
    facts = api.shred_sources(_modules(g, r"concat_ws('', transform(keys, p -> concat('import g.m', p, '\n')))", "concat('/w/g/m', l_suppkey, '.py')"), packages.GRAPH)
    return packages.high_coupling(facts, ScanConfig(stems={"g": "g"})).select("path", "line", "severity")


_COUPLING = """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), o AS (SELECT s AS m, count(*) AS n FROM e GROUP BY 1), i AS (
  SELECT p AS m, count(*) AS n FROM e GROUP BY 1)
SELECT '/w/g/m' || o.m || '.py' AS path, CAST(1 AS INTEGER) AS line, 'warning' AS severity FROM o JOIN i USING (m) WHERE o.n > 8 AND i.n > 8"""

_MARKED = r"""concat('try:\n    x = 1\n', element_at(array('', '# lint-ignore[bare-except]: known\n', '', '', '', '# lint-ignore[other]\n'), p_size % 6 + 1), 'except:',
element_at(array('', '', '  # lint-ignore', '  # lint-ignore[other]', '  # own-ignore[x, bare-except]:  two words ', ''), p_size % 6 + 1), '\n    raise\n')"""


def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No marker; one on the line before, on the line, for another rule, or for several; and one for another rule on the line before."""
    facts = api.shred_sources(_modules(_table(spark, sf_dir, "part"), _MARKED))
    return suppress.suppress(rules.file_issues(facts, _CONFIG, frozenset(["bare-except"])), facts, _CONFIG).select("path", "line", "suppressed", "reason")


_SUPPRESSION = f"SELECT {_PATH} AS path, CAST(CASE WHEN p_size % 6 IN (1, 5) THEN 4 ELSE 3 END AS INTEGER) AS line, p_size % 6 IN (1, 2, 4) AS suppressed, CASE p_size % 6 WHEN 1 THEN 'known' WHEN 4 THEN 'two words' END AS reason FROM part"

_MIXED = r"""concat('def f(x: int) -> int:\n', repeat('    if x:\n        x = 1\n', p_size), '    return x\n', if(p_size % 3 = 0, 'g = []\n', ''), if(p_size % 2 = 0, 'from m import *\n', ''))"""


def _mixed(spark: SparkSession, sf_dir: str) -> api.ScanResult:
    """A scan with all limits at their defaults, repeated bodies included. Its facts are given up when the next one begins."""
    return api.hold(lambda: api.scan_sources(_modules(_table(spark, sf_dir, "part"), _MIXED, package="p_type")))


# a body is the same within a type and size, and its function has 2 * p_size + 2 lines
_MIXED_SQL = f"""WITH i AS (SELECT p_type AS package, {_PATH} AS path, 1 AS line, CASE WHEN p_size + 1 > 15 THEN 'error' ELSE 'warning' END AS severity,
  'high-complexity' AS rule FROM part WHERE p_size + 1 > 10
UNION ALL SELECT p_type, {_PATH}, 2 * p_size + 3, 'info', 'global-mutable' FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_type, {_PATH}, 2 * p_size + 3 + (p_size % 3 = 0)::INT, 'warning', 'star-import' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_type, min({_PATH}), 1, 'warning', 'duplicate-function-body' FROM part WHERE 2 * p_size + 2 >= 5 GROUP BY p_type, p_size HAVING count(*) > 1),
w AS (SELECT *, CASE severity WHEN 'error' THEN 6.0 WHEN 'warning' THEN 1.5 ELSE 0.3 END AS weight FROM i)
"""


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).counts()


def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).at_least("warning").groupBy("rule", "severity").agg(F.count("*").alias("n"))


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).health().select(F.bround("score", 6).alias("score"), "grade")


def remediation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.remediation(_mixed(spark, sf_dir).issues).select("priority", "rule", "severity", "effort", "n_files", "first_file", "n_issues", "score")


def top_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's first two steps: the limit is the feature."""
    return remediation_plan(spark, sf_dir).limit(2).select("rule", "score")


def priority_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.breakdown(remediation_plan(spark, sf_dir))


def plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.plan_files(_mixed(spark, sf_dir).issues)


_LINES_SQL = "2 * p_size + 2 + (p_size % 3 = 0)::INT + (p_size % 2 = 0)::INT"
_PLAN_SQL = (
    _MIXED_SQL
    + """, g AS (SELECT rule, max(weight) AS weight, count(DISTINCT path) AS n_files, min(path) AS first_file, count(*) AS n_issues FROM w GROUP BY rule),
e AS (SELECT *, CASE weight WHEN 6.0 THEN 'error' WHEN 1.5 THEN 'warning' ELSE 'info' END AS severity, CASE rule WHEN 'high-complexity'
  THEN 3.0 WHEN 'duplicate-function-body' THEN 3.0 WHEN 'global-mutable' THEN 1.5 ELSE 0.5 END AS cost FROM g),
plan AS (SELECT CASE WHEN weight * cost >= 12 THEN 'P0' WHEN weight * cost >= 7 THEN 'P1' WHEN weight * cost >= 3 THEN 'P2' ELSE 'P3' END AS priority, rule, severity,
CASE WHEN cost >= 4 THEN 'major' WHEN cost >= 2.5 THEN 'moderate' WHEN cost >= 1 THEN 'minor' ELSE 'trivial' END AS effort, n_files, first_file, n_issues,
  CAST(weight * cost AS DOUBLE) AS score FROM e)
"""
)


def whole_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).issues.select("package", "path", "line", "severity", "rule")


def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's package: files and lines."""
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.lit("/d").alias("root"), F.concat(F.lit("/d/"), "doc_id", F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("source"))
    f = api.shred_sources(d, frozenset())
    return f.groupBy("package").agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"))


_COUNTERS = """SELECT source AS package, count(*) AS n_files, CAST(sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END) AS BIGINT) AS n_lines FROM documents GROUP BY source"""


def function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared metrics of each generated function."""
    source = r"concat('def f(x):\n', repeat('    if x and x:\n        for y in [z for z in x]:\n            return 1\n', p_size % 9), '    return x\n')"
    f = api.shred_sources(_modules(_table(spark, sf_dir, "part"), source)).select("path", F.explode("functions").alias("f"))
    return f.select("path", "f.cc", "f.nesting", "f.nested_returns", "f.span")


_METRICS = f"SELECT {_PATH} AS path, CAST(1 + 4 * (p_size % 9) AS INTEGER) AS cc, CAST(CASE WHEN p_size % 9 > 0 THEN 2 ELSE 0 END AS INTEGER) AS nesting, CAST(p_size % 9 AS INTEGER) AS nested_returns, CAST(3 * (p_size % 9) + 2 AS INTEGER) AS span FROM part"

_OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "duplicate_function_body": (duplicate_function_body, _DUPLICATES), "duplicate_members": (duplicate_members, _MEMBERS), "sync_async_duplication": (sync_async_duplication, _TWINS),
    "import_cycle": (import_cycle, _CYCLES), "import_edges": (import_edges, _EDGES), "high_coupling": (high_coupling, _COUPLING), "suppression": (suppression, _SUPPRESSION),
    "severity_counts": (severity_counts, _MIXED_SQL + "SELECT severity, count(*) AS n FROM w GROUP BY severity"),
    "severity_filter": (severity_filter, _MIXED_SQL + "SELECT rule, severity, count(*) AS n FROM w WHERE severity <> 'info' GROUP BY rule, severity"),
    "health_score": (health_score, _MIXED_SQL + f", s AS (SELECT greatest(0.0, 100 - sum(weight) / ((SELECT sum({_LINES_SQL}) FROM part) / 1000.0)) AS x FROM w) SELECT CAST(round(x, 6) AS DOUBLE) AS score, CASE WHEN x >= 90 THEN 'A' WHEN x >= 75 THEN 'B' WHEN x >= 60 THEN 'C' WHEN x >= 40 THEN 'D' ELSE 'F' END AS grade FROM s"),
    "remediation_plan": (remediation_plan, _PLAN_SQL + "SELECT * FROM plan"),
    "top_steps": (top_steps, _PLAN_SQL + "SELECT rule, score FROM plan ORDER BY score DESC, n_issues DESC, rule LIMIT 2"),
    "priority_breakdown": (priority_breakdown, _PLAN_SQL + "SELECT priority, count(*) AS n_rules FROM plan GROUP BY priority"),
    "plan_files": (plan_files, _MIXED_SQL + "SELECT rule, path, count(*) AS n FROM w GROUP BY rule, path"),
    "whole_scan": (whole_scan, _MIXED_SQL + "SELECT package, path, CAST(line AS INTEGER) AS line, severity, rule FROM i"),
    "scan_counters": (scan_counters, _COUNTERS), "function_metrics": (function_metrics, _METRICS),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _file_rule(rule, source) for name, (rule, source, _) in FILE_RULES.items()} | {name: f for name, (f, _) in (_OTHERS | QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in FILE_RULES.items()} | {name: sql for name, (_, sql) in (_OTHERS | QUERIES).items()}
