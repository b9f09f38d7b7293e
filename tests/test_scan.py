"""Sources, suppression, score, plan, reports and the command line."""

import ast
import json
import subprocess
import sys

import pytest

from stratalint.__main__ import main
from stratalint.functions.shred import is_test_path, split_lines, twin_names
from stratalint.plans import api, report, score
from stratalint.sources import files
from stratalint.streaming import rescan


def _tree(root, tree):
    for path, text in tree.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_discovery(tmp_path):
    _tree(tmp_path, {"a/x.py": "", "a/__init__.py": "", "docs/r.md": "", "node_modules/b.py": "", ".git/c.py": "", "build/d.py": "", "e.egg-info/f.py": ""})
    assert files.discover(str(tmp_path)) == {"a": (str(tmp_path / "a"), True)}
    (tmp_path / "loose.py").write_text("")
    assert files.discover(str(tmp_path))[tmp_path.name] == (str(tmp_path), False)
    (tmp_path / tmp_path.name).mkdir()
    (tmp_path / tmp_path.name / "g.py").write_text("")
    assert f"{tmp_path.name} (root)" in files.discover(str(tmp_path))
    empty = tmp_path / "docs"
    assert files.discover(str(empty)) == {}


def test_registry(tmp_path):
    (tmp_path / "r.yaml").write_text("# all\nother: 1\npackages:\n  a: src/a  # first\n  'b': ../b\n")
    assert files.read_registry(str(tmp_path / "r.yaml")) == {"a": (str(tmp_path / "src/a"), True), "b": (str(tmp_path.parent / "b"), True)}
    assert files.named([" c = d "], "/w") == {"c": ("/w/d", True)}
    for bad in ("packages:\n  a\n", "x: 1\n"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            files.read_registry(str(tmp_path / "bad.yaml"))
    with pytest.raises(ValueError):
        files.named(["a"], "/w")


def test_workspace(tmp_path):
    _tree(tmp_path, {"pyproject.toml": "[tool.uv.workspace]\nmembers = []\n", "a/pyproject.toml": "not toml [", "a/b/c.py": ""})
    assert files.workspace_root(str(tmp_path / "a/b")) == str(tmp_path)


def test_source_reads_every_file(spark, tmp_path):
    _tree(tmp_path, {"__init__.py": "a", "_x.py": "b", "_p/z.py": "c", "a/y.py": "d", "a/__pycache__/q.py": "", "skip/s.py": "", "n.txt": ""})
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "dir.py").mkdir()
    got = {r["path"][len(str(tmp_path)) + 1 :]: r["source"] for r in files.read_packages(spark, {"p": (str(tmp_path), True)}, ["/skip/"], 2).collect()}
    assert got == {"__init__.py": "a", "_x.py": "b", "_p/z.py": "c", "a/y.py": "d", "bad.py": "", "dir.py": ""}
    assert {r["path"] for r in files.read_packages(spark, {"p": (str(tmp_path), False)}).collect()} == {str(tmp_path / x) for x in ("__init__.py", "_x.py", "bad.py", "dir.py")}
    assert files.read_packages(spark, {"p": (str(tmp_path / "none"), True)}).count() == 0


def test_helpers():
    assert split_lines("a\r\nb\n\n") == ["a", "b", ""] and split_lines("") == []
    assert is_test_path("/a/tests/b.py") and is_test_path("conftest.py") and not is_test_path("/a/testsx/b.py")
    assert twin_names("load_sync") == sorted(["aload_sync", "load_sync_async", "async_load_sync", "_async_load_sync", "load", "load_async"])
    assert "load" in twin_names("aload") and "load" in twin_names("_async_load") and "a" not in twin_names("a")


SOURCE = "try:\n    x\nexcept:  # lint-ignore\n    raise\n# any-ignore[bare-except, other]: we know \ntry:\n    x\nexcept:\n    raise\n# lint-ignore[bare-except]\nfrom a import *  # lint-ignore[ , ]: all\nfrom b import *  # lint-ignore[other]\n"


def test_suppression(spark):
    r = api.scan_sources(spark.createDataFrame([("p", "/p", "/p/a.py", SOURCE)], "package string, root string, path string, source string"), persist=False)
    got = {(x["rule"], x["line"]): (x["suppressed"], x["reason"]) for x in r.all.collect()}
    assert got[("bare-except", 3)] == (True, None)
    assert got[("bare-except", 8)] == (False, None)  # two lines off
    assert got[("star-import", 11)] == (True, "all")
    assert got[("star-import", 12)] == (False, None)  # its own line's marker decides, though the line before has one for all


def test_scores(spark):
    rows = [("error", "import-cycle", 30.0), ("warning", "long-function", 3.75), ("info", "magic-number", 0.15), ("warning", "god-module", 6.0)]
    issues = spark.createDataFrame([("p", f"/f{i}", 1, s, r, "m", 0) for i, (s, r, _) in enumerate(rows)], "package string, path string, line int, severity string, rule string, message string, pos int")
    plan = score.remediation(issues).collect()
    assert {x["rule"]: x["score"] for x in plan} == {r: w for _, r, w in rows}
    assert [x["priority"] for x in plan] == ["P0", "P2", "P2", "P3"] and [x["rule"] for x in plan][1] == "god-module"
    h = lambda n: tuple(score.health(issues, spark.createDataFrame([(n,)], "n_lines long")).first())
    assert h(0) == (100.0, "A") and h(100) == (100 - 9.3 / 0.1, "F") and h(1000)[1] == "A"


@pytest.fixture
def project(tmp_path, monkeypatch):
    _tree(tmp_path, {"pkg/a.py": "def f(a=[]) -> int:\n    return 1\n", "pkg/b.py": "try:\n    x\nexcept:  # lint-ignore: fine\n    raise\n", "clean/c.py": "x = 1\n"})
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_command_line(spark, project, capsys):
    assert main(["--json"], spark) == 1
    out = json.loads(capsys.readouterr().out)
    assert {x["rule"] for x in out["issues"]} == {"mutable-default", "missing-param-type"} and out["suppressed"] == 1
    assert out["ignored"][0]["reason"] == "fine"
    assert main(["--packages", "clean"], spark) == 0 and "health 100.0 (A)" in capsys.readouterr().out
    assert main(["--packages", "none"], spark) == 2
    assert main(["x=missing"], spark) == 2
    assert main(["--plan", "--severity", "warning", "p=pkg"], spark) == 1
    assert "mutable-default" in capsys.readouterr().out
    assert main(["--plan", "--severity", "error"], spark) == 1 and "All clean" in capsys.readouterr().out


def test_empty_registry(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert main([], spark) == 2


def test_order_and_partitions_do_not_matter(spark, project):
    reg = files.discover(str(project))
    one, many = (api.scan_sources(files.read_packages(spark, reg, [], b), persist=False) for b in (1, 100))
    rows = lambda r: [tuple(x) for x in api.in_scan_order(r.issues).collect()]
    assert rows(one) == rows(many) and rows(one) == rows(one)
    both = one.merge(many)
    assert both.stats.first()["n_files"] == 6 and both.issues.count() == 2 * one.issues.count()


def test_stream(spark, project, tmp_path):
    files.read_packages(spark, files.discover(str(project))).write.parquet(str(tmp_path / "table"))
    s = spark.readStream.schema("package string, root string, path string, source string").parquet(str(tmp_path / "table"))
    q = rescan.rescan(s, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("not suppressed").count() == 2


def test_text_report(spark, project):
    r = api.scan(spark, files.discover(str(project)))
    text = report.text_report(r, "warning", str(project))
    assert "pkg/a.py:1: warning [mutable-default]" in text and "missing-param-type" not in text and "ignored pkg/b.py:3" in text
    r.facts.unpersist()


def test_registry_settings_reach_the_rules(spark, tmp_path, monkeypatch, capsys):
    """Stems, layers and libraries of a registry file bring the rules over import graphs, layers and transports to the command line."""
    many = "".join(f"import core.m{i}\n" for i in range(9))
    _tree(tmp_path, {
        "src/core/a.py": "import core.b\n", "src/core/b.py": "import core.a\nfrom httpx import get\n", "src/core/domain/c.py": "import core.web.views\n", "src/core/hub.py": many,
        **{f"src/core/m{i}.py": "import core.hub\n" for i in range(9)},
        "reg.yaml": "# known packages\npackages:\n  \"core\": src/core  # relative\nstems: {core: core}\nlibraries: [core]\nlayers:\n  core:\n    domain/: [core.web, other]\n",
    })
    monkeypatch.chdir(tmp_path)
    config = files.read_settings("reg.yaml")
    assert config.stems == {"core": "core"} and config.libraries == ("core",) and config.layers == {"core": [("domain/", ["core.web", "other"])]} and "httpx" in config.transports
    assert main(["--config", "reg.yaml", "--json"], spark) == 2
    found = {x["rule"] for x in json.loads(capsys.readouterr().out)["issues"]}
    assert {"import-cycle", "high-coupling", "layer-violation", "transport-in-library"} <= found


def test_registry_files(tmp_path):
    def read(text):
        (tmp_path / "r.yaml").write_text(text)
        return files.read_registry(str(tmp_path / "r.yaml"))

    assert read("packages: {a: x, 'b': \"../y\"}\n") == {"a": (f"{tmp_path}/x", True), "b": (str(tmp_path.parent / "y"), True)}
    assert read("other:\n  - 1\n  - 2\npackages:\n    a: x\nstems:\n    a: s\n") == {"a": (f"{tmp_path}/x", True)}
    for bad in ("", "packages:\n", "packages:\n  a:\n", "packages:\n  a\n", "packages: {}\n", "packages:\n  a: x\n      b: y\n"):
        with pytest.raises(ValueError):
            read(bad)


def test_partitions_walk_below(spark, tmp_path, monkeypatch):
    """With few directories listed by the driver, tasks walk the others; the files are the same."""
    _tree(tmp_path, {f"p/a{i}/b{j}/c{k}.py": f"x = {i}\n" for i in range(3) for j in range(3) for k in range(2)} | {"p/top.py": "", "p/a0/__pycache__/x.py": "", "q/flat.py": "", "q/in/deep.py": ""})
    registry = {"p": (str(tmp_path / "p"), True), "q": (str(tmp_path / "q"), False)}
    want = sorted([*files.walk(str(tmp_path / "p")), *files.walk(str(tmp_path / "q"), False)])
    for spread, depth in ((1, 6), (2, 6), (256, 1), (256, 2), (256, 6)):
        monkeypatch.setattr(files, "SPREAD", spread)
        monkeypatch.setattr(files, "DEPTH", depth)
        r = files._Reader([("p", str(tmp_path / "p"), True), ("q", str(tmp_path / "q"), False)], [], 4)
        assert sorted(path for part in r.partitions() for _, _, path, _ in r.read(part)) == want
    assert sorted(x["path"] for x in files.read_packages(spark, registry).collect()) == want and len(want) == 20


def test_ratio_of_matched_characters():
    """Similarity is the share of matched characters, in the order asked."""
    import difflib

    from stratalint.functions.shred import shred

    def ratio(body, other):
        facts = shred("p", "/w", "/w/a.py", f"def load(k):\n{body}async def aload(k):\n{other}")
        return {t["name"]: t["ratio"] for t in facts["twins"]}, difflib.SequenceMatcher(None, ast.unparse(ast.parse(f"def load(k):\n{body}")), ast.unparse(ast.parse(f"async def aload(k):\n{other}"))).ratio()

    same = "    a = 1\n    b = 2\n    return a\n"
    got, want = ratio(same, same)
    assert got["load"] == want == 2 * 45 / (45 + 52) and got["aload"] == want
    got, want = ratio(same, "    await k.first()\n    return await k.second()\n    pass\n")
    assert got["load"] == want < 0.6


def test_only_wanted_facts_cost(monkeypatch):
    """A rule on a file's length needs no syntax tree and no lines; one on classes tells of no others."""
    import ast

    from stratalint.functions.config import ScanConfig
    from stratalint.functions.shred import shred
    from stratalint.operators import rules

    text = "class C:\n    x = 1\n" * 201 + "y = 2"
    wanted = rules.needs(ScanConfig(), frozenset(["god-class"]))
    assert "lines" not in wanted and len(shred("p", "/w", "/w/a.py", text, wanted)["classes"]) == 201
    monkeypatch.setattr(ast, "parse", lambda *_: 1 / 0)
    row = shred("p", "/w", "/w/a.py", text, rules.needs(ScanConfig(), frozenset(["long-file"])))
    assert row["n_lines"] == 403 and row["lines"] == []


def test_equal_files_are_parsed_once(spark):
    """A batch's equal texts are one row of contents; what hangs on the path is each file's own."""
    from stratalint.functions.shred import Memo

    m = Memo(None, most=300)
    assert m.get("x = 1\n") is m.get("x = 1\n") and m.get(None)["n_lines"] == 0
    for i in range(20):
        m.get(f"x = {i}\n")
    assert len(m.young) + len(m.old) < 10
    files = [("p", "/w/p", f"/w/p/{d}/m{i}.py", "from . import a\nx = b.c.d.e.f\n" if i % 2 else "from") for d in ("s", "tests") for i in range(50)]
    got = {x["path"]: x for x in api.shred_sources(spark.createDataFrame(files, "package string, root string, path string, source string").coalesce(1)).collect()}
    assert len(got) == 100 and got["/w/p/tests/m1.py"]["is_test"] and not got["/w/p/s/m1.py"]["is_test"]
    assert got["/w/p/s/m3.py"]["edges"] == ["p.s.a"] and got["/w/p/tests/m3.py"]["edges"] == ["p.tests.a"]
    assert got["/w/p/s/m2.py"]["parse_error"].startswith("SyntaxError") and got["/w/p/s/m2.py"]["chains"] is None and got["/w/p/s/m5.py"]["chains"][0]["depth"] == 4


def test_report_tables_need_no_driver(spark, sf, monkeypatch):
    """The tables of the reports are the streamed reports; no finding passes through the driver."""
    from stratalint import tree_queries

    with tree_queries._reported(spark, sf) as r:
        lines = list(report.text_lines(r, "info", "/w"))
        parsed = json.loads(report.json_report(r, "info", "/w"))
        monkeypatch.setattr(type(r.all), "toLocalIterator", lambda *_: 1 / 0)
        t = report.text_table(r, "info", "/w").toPandas().sort_values("at")
        assert list(t["at"]) == list(range(len(lines))) and list(t["text"]) == lines
        j = report.json_table(r, "info", "/w").toPandas().sort_values("at")
        for part in ("issues", "ignored"):
            assert [json.loads(x) for x in j[j["part"] == part]["text"]] == parsed[part]
        assert list(j[j["part"] == "suppressed"]["at"]) == [parsed["suppressed"]] and len(parsed["issues"]) > 100
    assert tree_queries.text_report(spark, sf).columns == ["at", "text"]
    assert len(tree_queries.json_report(spark, sf).columns) == 9


def test_partitions_of_many_files_are_few(tmp_path, monkeypatch):
    """A flat directory of many files, and directories that the driver leaves to tasks: every file once, in a bounded number of partitions."""
    want = set()
    for d in ("", "a", "a/b", "c", "_d"):
        (tmp_path / d).mkdir(exist_ok=True)
        for i in range(300 if d == "" else 20):
            (tmp_path / d / f"m{i}.py").write_text("x = 1\n")
            want.add(str(tmp_path / d / f"m{i}.py"))
    monkeypatch.setattr(files, "PARTS", 5, raising=False)
    reader = files._Reader([("p", str(tmp_path), True), ("q", str(tmp_path), False)], [], 2)
    for listed in (10**6, 310, 1):
        monkeypatch.setattr(files, "LISTED", listed, raising=False)
        parts = reader.partitions()
        got = [(x[0], x[2]) for part in parts for x in reader.read(part)]
        assert len(got) == len(set(got)) and {f for p, f in got if p == "p"} == want and sum(p == "q" for p, _ in got) == 300
        assert len(parts) <= 11


def test_functions_are_measured_in_one_walk(monkeypatch):
    """Where expressions are visited anyway, a function is measured on the way, as it is by walks of its own; a scan sends no line without a number sign."""
    from stratalint.functions import shred

    text = (
        "@d(7)\ndef f(a=3, *, b: int = 4) -> g[5]:\n    if a and b or c:\n        for x in [y for y in (8, 9)]:\n            return k(10, n=11, m=[12])\n    class C:\n        def m(self, q=13):\n            while q:\n                with q:\n                    if q:\n                        return 14\n"
        "    def inner(z=15):\n        assert z, 16\n        try:\n            if z:\n                return lambda w=17: 18\n        except E:\n            pass\n        return 19\n    return 20  # a 'é' 21\n"
    )
    tree = ast.parse(text)
    defs = [x for x in ast.walk(tree) if isinstance(x, ast.FunctionDef)]
    want = {x.name: (shred.complexity(x), shred.nesting(x), shred.nested_returns(x)) for x in defs}
    s = shred._Shredder(text, None)
    numbers = [n for name in ("f", "m", "inner") for x in defs if x.name == name for n in shred._numbers(x, s.text)]
    for name in ("complexity", "nesting", "nested_returns", "_numbers"):
        monkeypatch.setattr(shred, name, lambda *_: 1 / 0)
    row = shred.shred("p", "/w", "/w/a.py", text, api.needed(api.ScanConfig()))
    assert {f["name"]: (f["cc"], f["nesting"], f["nested_returns"]) for f in row["functions"]} == want and want["f"][1] == 3
    assert row["literals"] == numbers and [n["display"] for n in numbers if n["line"] > 13] != [] and row["classes"][0]["wmc"] == want["m"][0]
    assert row["lines"] == [] and row["n_lines"] == 20 and row["hashes"] == [{"line": 20, "text": "    return 20  # a 'é' 21"}]


def test_one_scan_is_kept(spark, sf):
    """What a query's scan keeps is given up when the next one begins."""
    from stratalint import queries, tree_queries

    kept = spark.sparkContext._jsc.getPersistentRDDs
    for query in (queries.health_score, tree_queries.issue_scores, tree_queries.merge_scans):
        query(spark, sf).collect()
    before = kept().size()
    for query in (tree_queries.merge_scans, tree_queries.issue_scores, tree_queries.merge_scans):
        query(spark, sf).collect()
    assert kept().size() == before


def test_coupling_reads_facts_once(spark):
    """Fan-in, fan-out and path come from one reading of the files; files of one module name count once, and the last of them is told."""
    from stratalint.functions.config import ScanConfig
    from stratalint.operators import packages

    hub = "".join(f"import p.m{i}\n" for i in range(9)) + "import q.other\nimport px\n"
    texts = {"hub.py": hub, "hub/__init__.py": hub, "low.py": "import p.hub\n" + "".join(f"import p.m{i}\n" for i in range(7))} | {f"m{i}.py": "import p.hub\nimport p.low\n" for i in range(9)} | {"bad.py": "import p.hub\n("}
    files = [("p", "/w/p", f"/w/p/{k}", v) for k, v in texts.items()] + [("none", "/w/none", f"/w/none/{k}", v) for k, v in texts.items()]
    found = packages.high_coupling(api.shred_sources(spark.createDataFrame(files, "package string, root string, path string, source string"), packages.GRAPH), ScanConfig(stems={"p": "p"}))
    assert found._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    assert [(x["path"], x["message"]) for x in found.collect()] == [("/w/p/hub/__init__.py", "p.hub has fan-in 10 and fan-out 9 (max 8/8)")]


def test_a_scan_is_kept_though_an_equal_one_was(spark, sf):
    """A query's scan is kept when the one before it, of the same or another query, read the same modules: it is parsed once, not by each branch."""
    from stratalint import queries, tree_queries

    for query in (queries.severity_counts, queries.severity_counts, queries.health_score, tree_queries.merge_scans, tree_queries.issue_scores, tree_queries.issue_scores):
        query(spark, sf).collect()
        assert len(api._held) == 1 and all(x.storageLevel.useMemory for x in (api._held[0].kept[:2] if query is tree_queries.merge_scans else (api._held[0].facts, *api._held[0].kept)))


def test_a_scan_is_held_past_the_end_of_its_session(sf):
    """The next session's scan gives up one that went with its session; a session ends all others of its process, so this is another process."""
    code = """if True:
        import sys
        from pyspark.sql import SparkSession
        from stratalint import queries
        for _ in range(2):
            s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
            n = queries.severity_counts(s, sys.argv[1]).count()
            s.stop()
        print("severities", n)
    """
    r = subprocess.run([sys.executable, "-c", code, sf], capture_output=True, text=True, timeout=300)
    assert r.stdout.endswith("severities 3\n"), r.stderr[-2000:]


def test_files_alike_but_for_numbers_in_names_are_parsed_twice(monkeypatch):
    """Contents by a template are those of the text itself, hashes, order of names and comments included; texts where it isn't plain which words are names are parsed."""
    from stratalint.functions import shred

    alike = [
        "from m{0} import a{1}, b as c{0}\nimport p.q{1}.r\n__all__ = ['n', \"o\"]\n@d{0}\nclass C{1}(B{0}, D{1}):\n    '''Of it's'''\n    def m_{0}(self, k{1}=[], *, z9=1{0}):  # own{0}-ignore[x{1}]: {0}\n        if k{1}:\n            return self.a{0}.b{1}.c.d.e(k{1})\n        else:\n            return g._h{0}\n"
        "def load{0}(x):\n    global n{1}\n    n{1} = x or {0}\n    if x == 'aa':\n        y = b{1}[1_0:0x1f] + 1.5\n    else:\n        y = b{1}[1_0:0x1f] + 1.5\n    return y == 'aa'\n",
        "def f(x: int) -> int:\n    if x:\n        x = 1\n    return x_{0}\nz10 = a9 = z_{1}\n",
        "def f{0}_async(x, async_f{0}):\n    return x{1}(x, async_f{0})\n",
    ]
    parsed = [
        "x{0} = 1.e{0}\n", "x{0} = 1..e{1}\n", "x{0} = '\\x{0}'\n", "x{0} = f'{{x{0}}}'\n", "x{0} = 'x{0}'\n", "x{0} = '''a 'b' {0}'''\n", "x{0} = \"\"\"a \"b{0}\" c\"\"\"\n", "x{0} = f\"{{d[\"a{0}\"]}}\"\n", "x{0} = \\\n  1\n", "é{0} = 1\n", "x{0} = = 1\n", "a = {0}\n", "x{0} = 1\r\n",
        "def load{0}(k):\n    a = 1\n    b = 2\n    return a\nasync def aload{0}(k):\n    a = 1\n    b = 2\n    return a\n", "x{0} = y\n  z = 1\n", "x{0} = 1if{1}\n", "x{0} = '\n",
    ]
    pairs = [(10, 11), (12, 13), (45, 44), (44, 45), (77, 77), (10, 99), (99, 10), (98, 97)]
    for wanted in (None, api.needed(api.ScanConfig()), frozenset(["edges"]), frozenset(["functions", "body_hash"])):
        for text in alike + parsed:
            want = [shred.contents(text.format(*p), wanted) for p in pairs]
            memo = shred.Memo(wanted)
            assert [memo.get(text.format(*p)) for p in pairs] == want
            assert [memo.get(text.format(*p)) for p in pairs[::-1]] == want[::-1]
    memo, texts, n = shred.Memo(None), [alike[2].format(i, i + 1) for i in range(100, 140)], []
    parse = ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a: n.append(1) or parse(*a))
    for t in texts:
        memo.get(t)
    assert len(n) == 2
    small = shred.Memo(None, most=500)
    for t in texts + [f"x{i} = {i}  # {i}\n" for i in range(50)]:
        small.get(t)
    assert len(small.templates) + len(small.elder) < 20
    assert shred._relative("/a/b/c.py", "/a") == "b/c.py" and shred._relative("/a/../b", "/a") == "../b" and shred._relative("/ab/c", "/a") == "../ab/c"
