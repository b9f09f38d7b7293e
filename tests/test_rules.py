"""Rules on snippets: each case is a module and the (rule, line) pairs that it must have, among the rules that it names."""

import random

import pytest

from stratalint.functions.config import ScanConfig
from stratalint.operators import packages
from stratalint.plans import api

DEEP = "".join("    " * (i + 1) + "if x:\n" for i in range(6)) + "    " * 7 + "pass\n"
CASES = {
    "long": ("def f(x):\n    if x:\n        if x:\n            if x:\n" + "                x = 1\n" * 50, "f.py", {("long-function", 1)}, "long-function"),
    "long but flat": ("def f(x):\n" + "    x = 1\n" * 60, "f.py", set(), "long-function"),
    "complex": ("def f(x):\n" + "    if x and x:\n        pass\n" * 5, "f.py", {("high-complexity", 1)}, "high-complexity"),
    "complexity of comprehensions": ("def f(x):\n" + "    [a if b else c for a in x if a if b]\n" * 9, "f.py", set(), "high-complexity"),
    "nested": ("def f(x):\n" + DEEP, "f.py", {("deep-nesting", 1)}, "deep-nesting"),
    "elif chain nests": ("def f(x):\n    if x:\n        pass\n" + "    elif x:\n        pass\n" * 5, "f.py", {("deep-nesting", 1)}, "deep-nesting"),
    "async with doesn't nest": ("async def f(x):\n" + "".join("    " * (i + 1) + "async with x:\n" for i in range(7)) + "    " * 8 + "pass\n", "f.py", set(), "deep-nesting"),
    "nested returns": ("def f(x):\n" + "    if x:\n        if x:\n            return 1\n" * 4, "f.py", {("excessive-returns", 1)}, "excessive-returns"),
    "guard returns": ("def f(x):\n" + "    if x:\n        return 1\n" * 5, "f.py", set(), "excessive-returns"),
    "types": ("def f(a, b: int, *c): pass\ndef _g(a): pass\ndef test_h(a): pass\ndef __i__(a): pass\n", "f.py", {("missing-return-type", 1), ("missing-param-type", 1)}, "missing-return-type missing-param-type"),
    "types in tests": ("def f(a): pass\n", "tests/helper.py", set(), "missing-return-type missing-param-type"),
    "params": ("def f(p, /, a, b, c, *d, e, **g): pass\ndef h(a, b, c, *d, e, g, **i): pass\n", "f.py", {("too-many-params", 2)}, "too-many-params"),
    "flags": ("def f(a=True, b=False, *, c=True): pass\ndef g(a=True, b=1, c=False): pass\n", "f.py", {("boolean-flag-params", 1)}, "boolean-flag-params"),
    "mutable default": ("def f(a=[], /): pass\ndef g(a=None, *, b={1}): pass\ndef h(a=()): pass\n", "f.py", {("mutable-default", 1), ("mutable-default", 2)}, "mutable-default"),
    "excepts": ("try:\n    x\nexcept:\n    pass\ntry:\n    x\nexcept (A, B):\n    ...\n", "f.py", {("bare-except", 3), ("swallowed-exception", 3), ("swallowed-exception", 7)}, "bare-except swallowed-exception"),
    "else": ("if x:\n    a = 1\n    b = 2\nif x:\n    a = 1\n    return_(1)\nif x:\n    a = 1\n    o.b = 2\nif x:\n    a = 1\n    o.b = c = 2\nif x:\n    a = 1\n    await_ = 3\nelse:\n    pass\n", "f.py", {("missing-else", 1), ("missing-else", 10)}, "missing-else"),
    "else after nested if": ("if x:\n    a = 1\n    if y:\n        b = 1\nif x:\n    a = 1\n    if y:\n        b = 1\n    else:\n        b = 2\n", "f.py", {("missing-else", 5)}, "missing-else"),
    "unused imports": ("import a\nimport b.c\nimport d as e\nfrom f import g, h\nfrom __future__ import annotations\nimport _\n__all__ = ['h']\nb.x\n", "f.py", {("unused-import", 1), ("unused-import", 3), ("unused-import", 4)}, "unused-import"),
    "last import counts": ("import a\nimport a\n", "f.py", {("unused-import", 2)}, "unused-import"),
    "package file": ("import a\n", "__init__.py", set(), "unused-import"),
    "star": ("from a import *\ndef f():\n    import b\n", "f.py", {("star-import", 1)}, "star-import"),
    "globals": ("a = []\n_b = {}\nc: list = []\nd = e = {1}\ndef f():\n    g = []\n", "f.py", {("global-mutable", 1), ("global-mutable", 4)}, "global-mutable"),
    "outer writes": ("def f():\n    global a\n    b = 1\n    a = 2\n    a = 3\ndef g():\n    global a\n    if a is None:\n        a = 1\ndef h():\n    global a\n    if a is None:\n        b = 1\n        if x:\n            a += 1\n", "f.py", {("scope-mutation", 4), ("scope-mutation", 15)}, "scope-mutation"),
    "dead": ("def f():\n    return 1\n    a\n    b\ndef g():\n    try:\n        raise x\n        a\n    except E:\n        return\n        b\n    finally:\n        return\n        c\n", "f.py", {("dead-code", 3), ("dead-code", 4), ("dead-code", 8), ("dead-code", 11)}, "dead-code"),
    "decorators": ("@a\n@b\n@c\n@d\ndef f(): pass\n@a\n@b\n@c\nclass C: pass\n", "f.py", {("excessive-decorators", 5)}, "excessive-decorators"),
    "lazy": ("class A: pass\nclass B(BaseModel): pass\nclass C(MyError): pass\n@dataclasses.dataclass\nclass D: pass\nclass E(Base):\n    id: Mapped[int] = mapped_column()\nclass F:\n    def a(self): pass\n    def b(self): pass\n", "f.py", {("lazy-class", 1)}, "lazy-class"),
    "numbers": ("def f(a=42):\n    x = 47 + 0x1F - 5\n    g(k=12)\n    g(k=[13])\n    return 200, 8080, -1, 200.0, True\ndef __init__(s):\n    s = 99\ny = 77\n", "f.py", {("magic-number", 2), ("magic-number", 4), ("magic-number", 5)}, "magic-number"),
    "many numbers": ("def f():\n    return 11, 12, 13, 14, 15, 16, 17, 18\n", "f.py", set(), "magic-number"),
    "strings": ("x == 'ab'\n'ab' != y\nz == 'cd'\na.id == 'ef'\nb == 'ef'\nx == '____'\nx == '____'\n'q1' == 'q1'\n", "f.py", {("magic-string", 1), ("magic-string", 2), ("magic-string", 6), ("magic-string", 7)}, "magic-string"),
    "dicts": ("def f(a: dict, b: dict[str, dict]) -> list[dict]: pass\nx: dict[str, int] = dict()\n", "f.py", {("untyped-dict", 1)}, "untyped-dict"),
    "branches": ("if a:\n    x = 1\nelse:\n    x = 1\nif a:\n    x = 1\nelif b:\n    x = 1\nelse:\n    x = 2\n", "f.py", {("duplicate-branch", 1)}, "duplicate-branch"),
    "privates": ("class C:\n    def m(self, o):\n        self._a\n        C._b\n        super()._c\n        o._d\n        o._e = 1\n        getattr(o, '_f')\n        o.__g__\ndef f(p):\n    p._h\n    def g():\n        p._i\n", "f.py", {("encapsulation-violation", 6), ("encapsulation-violation", 8), ("encapsulation-violation", 13)}, "encapsulation-violation"),
    "god class": ("class C:\n" + "".join(f"    def m{i}(self):\n        self.a{i} = 1\n" for i in range(28)), "f.py", {("god-class", 1)}, "god-class"),
    "wmc": ("class C:\n    def m(self, x):\n" + "        if x: pass\n" * 51, "f.py", {("god-class", 1)}, "god-class"),
    "god module": ("".join(f"def f{i}(): pass\n" for i in range(16)), "f.py", {("god-module", 1)}, "god-module"),
    "data classes don't count": ("".join(f"def f{i}(): pass\n" for i in range(15)) + "class D(BaseModel): pass\n", "f.py", set(), "god-module"),
    "inheritance": ("class A(X): pass\nclass B(A): pass\nclass C(B): pass\nclass D(C): pass\nif x:\n    class E(D): pass\n", "f.py", {("deep-inheritance", 4)}, "deep-inheritance"),
    "pass through": ("def f(a, *b):\n    'doc'\n    return g.h(a, *b, k=a)\ndef i(a):\n    return g(a + 1)\nasync def j(a):\n    await g(a)\ndef __k__(a):\n    return g(a)\ndef l(a):\n    return super().l(a)\n", "f.py", {("pass-through-method", 1), ("pass-through-method", 6)}, "pass-through-method"),
    "chains": ("import m\nx = a.b.c().d.e\ny = m.b.c.d.e\nz = a.b.c.d\n", "f.py", {("message-chain", 2)}, "message-chain"),
    "parent import": ("from pkg import a\nfrom pkg.f import a\nfrom . import b\ndef g():\n    from pkg import c\n", "f.py", {("potential-circular-import", 1)}, "potential-circular-import"),
    "transport": ("import httpx\nfrom flask.views import a\n", "f.py", {("transport-in-library", 2)}, "transport-in-library"),
    "layers": ("import app.x, b\nimport b, app.y\nfrom app.z import a\n", "routes/f.py", {("layer-violation", 1), ("layer-violation", 3)}, "layer-violation"),
    "match arms": ("def f(x):\n    match x:\n        case 1:\n            if x: pass\n" + "            if x: pass\n" * 9, "f.py", {("high-complexity", 1)}, "high-complexity"),
    "syntax": ("def f(:\n  # TODO later\n", "f.py", {("syntax-error", 1), ("todo-marker", 2)}, "syntax-error todo-marker"),
    "nul byte": ("x = 1\0", "f.py", {("syntax-error", 1)}, "syntax-error"),
    "todo": ("x  # TODO a FIXME b\ny  # todoist TODOS\n# XXX\r\n", "f.py", {("todo-marker", 1), ("todo-marker", 3)}, "todo-marker"),
    "long file": ("x = 1\n" * 401, "f.py", {("long-file", 1)}, "long-file"),
    "not long": ("x = 1\n" * 400, "f.py", set(), "long-file"),
    "empty": ("", "f.py", set(), "syntax-error long-file god-module"),
}
CONFIG = ScanConfig(libraries=("pkg",), layers={"pkg": [("routes/", ["app."])]}, stems={"cyc": "cyc", "hub": "hub"})


@pytest.fixture(scope="module")
def found(spark):
    rows = [("pkg", f"/w{i}/pkg", f"/w{i}/pkg/{path}", source) for i, (source, path, _, _) in enumerate(CASES.values())]
    r = api.scan_sources(spark.createDataFrame(rows, "package string, root string, path string, source string"), CONFIG)
    out = {}
    for x in r.all.collect():
        out.setdefault(int(x["path"].split("/")[1][1:]), []).append((x["rule"], x["line"], x["message"], x["severity"]))
    r.facts.unpersist()
    return out


@pytest.mark.parametrize("name", CASES)
def test_rule(found, name):
    _, _, want, about = CASES[name]
    got = [(r, n) for r, n, _, _ in found.get(list(CASES).index(name), []) if r in about.split()]
    assert set(got) == want


def test_details(found):
    at = lambda name, rule: [x for x in found[list(CASES).index(name)] if x[0] == rule]
    assert at("god class", "god-class")[0][3] == "warning"
    assert "FIXME" in at("todo", "todo-marker")[0][2]  # the last marker of the line
    assert [x[2].split()[-1] for x in sorted(at("numbers", "magic-number"))][:3] == ["0x1F", "47", "5"]
    assert len(at("dead", "dead-code")) == 4
    assert "ValueError" not in at("excepts", "swallowed-exception")[0][2]


def _scan(spark, files, config=CONFIG):
    return api.shred_sources(spark.createDataFrame(files, "package string, root string, path string, source string"))


def test_cycles(spark):
    files = [("cyc", "/w/cyc", f"/w/cyc/{a}.py", f"from . import {b}\nif TYPE_CHECKING:\n    import cyc.z\ndef f():\n    import cyc.y\n") for a, b in ("ab", "bc", "ca")]
    files += [("cyc", "/w/cyc", "/w/cyc/z.py", "import cyc.a\nimport cyc.z\n"), ("other", "/w/other", "/w/other/a.py", "import other.a\n")]
    got = sorted((x["path"], x["message"]) for x in packages.import_cycles(_scan(spark, files), CONFIG).collect())
    assert [p for p, _ in got] == ["/w/cyc/a.py", "/w/cyc/z.py"]
    assert "cyc.a -> cyc.b -> cyc.c -> cyc.a" in got[0][1]


def test_cycles_are_cycles():
    rng = random.Random(3)
    for _ in range(200):
        edges = {(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(rng.randint(0, 12))}
        found = packages.cycles_of(list(edges))
        for c in found:
            assert all((a, b) in edges for a, b in zip(c, [*c[1:], c[0]]))
        reach = {a: {b for x, b in edges if x == a} for a in "abcdef"}
        for _ in range(6):
            reach = {a: r.union(*[reach[b] for b in r]) for a, r in reach.items()}
        assert bool(found) == any(a in r for a, r in reach.items())


def test_coupling(spark):
    files = [("hub", "/w/hub", f"/w/hub/m{i}.py", "import hub.core\n") for i in range(9)]
    files.append(("hub", "/w/hub", "/w/hub/core.py", "".join(f"import hub.t{i}\n" for i in range(9))))
    got = packages.high_coupling(_scan(spark, files), CONFIG).collect()
    assert [x["path"] for x in got] == ["/w/hub/core.py"]
    assert packages.high_coupling(_scan(spark, files[:9]), CONFIG).count() == 0


def test_duplicates_and_twins(spark):
    body = "    # {}\n    x = 1\n    y = x + 1\n    z = y\n    return z\n"
    files = [("p", "/w/p", f"/w/p/{n}.py", f"def {n}():\n" + body.format(n)) for n in "ab"] + [("p", "/w/p", "/w/p/t.py", "class C:\n    def load(self):\n        x = 1\n        y = 2\n        return x\n    async def load_async(self):\n        x = 1\n        y = 2\n        return x\n")]
    facts = _scan(spark, files)
    assert [(x["path"], x["line"]) for x in packages.duplicate_functions(facts, CONFIG).collect()] == [("/w/p/a.py", 1)]
    assert packages.duplicate_members(facts, CONFIG).count() == 2
    assert [(x["path"], x["line"]) for x in packages.twins(facts, CONFIG).collect()] == [("/w/p/t.py", 2)]
