"""One pass over a module's syntax tree gives all facts that the rules need; the only place that knows the ast module.

Facts are counts, names, lines and hashes. Thresholds, severities and choices among facts belong to the rules.
"""

from __future__ import annotations

import ast
import difflib
import hashlib
import os
import re
import sys
import warnings
from collections import Counter, deque

from stratalint.functions.schema import FAMILIES

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_DEFS, ast.ClassDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_NESTS = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.Try, ast.ExceptHandler)
_BRANCHES = frozenset([ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.Assert, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp])
_NESTING = frozenset(_NESTS)
_LEAVES = frozenset([ast.Name, ast.Constant])
#: Fields that, where they are lists, hold nodes alone.
_NODES = frozenset("body orelse finalbody handlers targets decorator_list bases keywords elts values items generators ifs cases comparators args posonlyargs kwonlyargs defaults".split())
#: Statements whose blocks a function's dead lines are looked for in.
_BLOCKS = frozenset([ast.If, *_LOOPS, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, *_DEFS, ast.ClassDef])
#: Nodes that give facts of their own, but for names.
_TELLING = frozenset([*_DEFS, ast.ClassDef, ast.arguments, ast.AnnAssign, ast.If, ast.ExceptHandler, ast.Assign, ast.Compare, ast.Attribute, ast.Call])
_MUTABLE = (ast.List, ast.Dict, ast.Set)
_ENDS = {ast.Return: "return", ast.Raise: "raise", ast.Break: "break", ast.Continue: "continue"}
_DATA_BASES = frozenset("BaseModel BaseSettings NamedTuple Protocol Enum StrEnum IntEnum IntFlag Flag".split())
_TWIN_LINES = 4


def split_lines(source: str) -> list[str]:
    """Lines end at a line feed; one carriage return before it goes too; no empty last line."""
    lines = source.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def is_test_path(path: str) -> bool:
    name = os.path.basename(path)
    return name == "conftest.py" or name.startswith("test_") or name.endswith("_test.py") or "tests" in os.path.dirname(path).split("/")


def _fields(cls: type) -> tuple[str, ...]:
    """The fields of a kind of node that may hold nodes, but contexts and operators."""
    return () if cls in (ast.Name, ast.Constant) else tuple(f for f in cls._fields if f not in ("ctx", "op", "ops", "id", "attr", "arg", "kind", "type_comment"))


_FIELDS: dict[type, tuple[str, ...]] = {}
#: Statements that hold none.
_FLAT = frozenset([ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr, ast.Return, ast.Raise, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.Delete, ast.Assert, ast.alias, ast.Name, ast.Constant])


def kids(x: ast.AST) -> list[ast.AST]:
    """The child nodes but contexts and operators, kept on the node: several measures walk the same subtree."""
    if x.__class__ is ast.Name or x.__class__ is ast.Constant:
        return []
    if (out := getattr(x, "_kids", None)) is None:
        out = []
        if (fields := _FIELDS.get(x.__class__)) is None:
            fields = _FIELDS[x.__class__] = _fields(x.__class__)
        for name in fields:
            v = getattr(x, name, None)
            if v.__class__ is list:
                if v:
                    out += v if name in _NODES else [y for y in v if isinstance(y, ast.AST)]
            elif isinstance(v, ast.AST):
                out.append(v)
        x._kids = out
    return out


def blocks(x: ast.AST) -> list[ast.AST]:
    """The child nodes that may hold statements, or are some."""
    if x.__class__ in _FLAT:
        return []
    if (out := getattr(x, "_blocks", None)) is None:
        x._blocks = out = [y for y in kids(x) if not isinstance(y, ast.expr)]
    return out


def complexity(node: ast.AST) -> int:
    """1 and each branch, loop, handler, assertion and comprehension; a boolean operation counts its operators."""
    total, stack = 1, [node]
    while stack:
        x = stack.pop()
        if x.__class__ in _BRANCHES:
            total += 1
        elif x.__class__ is ast.BoolOp:
            total += len(x.values) - 1
        stack += [y for y in kids(x) if y.__class__ not in _LEAVES]
    return total


def nesting(node: ast.AST) -> int:
    """The deepest chain of blocks; an elif is one deeper than its if."""
    deepest, stack = 0, [(node, 0)]
    while stack:
        x, d = stack.pop()
        d += isinstance(x, _NESTS)
        deepest = max(deepest, d)
        stack += [(c, d) for c in blocks(x)]
    return deepest


def nested_returns(node: ast.AST) -> int:
    """Returns at least two blocks deep, not those of inner functions."""
    total, stack = 0, [(c, 0) for c in blocks(node)]
    while stack:
        x, d = stack.pop()
        if isinstance(x, _DEFS):
            continue
        d += isinstance(x, _NESTS)
        total += isinstance(x, ast.Return) and d >= 2
        stack += [(c, d) for c in blocks(x)]
    return total


def _write(x: ast.AST, out: list[str]) -> None:
    """A node's kind and fields in order, without places and contexts; a context follows from where a node is."""
    cls = x.__class__
    if cls is ast.Name:
        out.append(f"{x.id}:")
        return
    if cls is ast.Constant:
        v, kind = x.value, x.kind
        out.append(f"Constant({'-' if v is None else repr(v)},{'-' if kind is None else repr(kind)},)")
        return
    if (told := _TOLD.get(cls)) is None:
        told = _TOLD[cls] = (f"{cls.__name__}(", tuple(f for f in cls._fields if f not in ("ctx", "type_comment")))
    out.append(told[0])
    for name in told[1]:
        v = getattr(x, name, None)
        if v is None:
            out.append("-,")
        elif v.__class__ is list:
            _write_list(v, out)
        elif v.__class__ is ast.Name:
            out.append(f"{v.id}:")
        elif isinstance(v, ast.AST):
            _write(v, out)
        else:
            out.append(f"{v!r},")
    out.append(")")


def _write_list(x: list, out: list[str]) -> None:
    out.append("[")
    for y in x:
        if isinstance(y, ast.AST):
            _write(y, out)
        else:
            out.append(f"{y!r},")
    out.append("]")


_TOLD: dict[type, tuple[str, tuple[str, ...]]] = {}


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _is_str(x: ast.AST) -> bool:
    return isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)


def _is_trivial(body: list[ast.stmt]) -> bool:
    rest = [x for x in body if not _is_str(x)]
    if len(rest) != 1:
        return not rest
    x = rest[0]
    return isinstance(x, (ast.Pass, ast.Raise)) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and x.value.value is ...


def _name(x: ast.AST | None) -> str | None:
    return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None


def _bases(node: ast.ClassDef) -> list[str]:
    return [n for n in map(_name, node.bases) if n]


def _is_data_class(node: ast.ClassDef) -> bool:
    """Classes that are right to have few methods: tables, models, enumerations, protocols, errors, dataclasses."""
    column = lambda v: isinstance(v, ast.Call) and _name(v.func) in ("mapped_column", "Column")
    for x in node.body:
        if isinstance(x, ast.AnnAssign):
            kind = x.annotation.value if isinstance(x.annotation, ast.Subscript) else x.annotation
            if _name(kind) == "Mapped" or column(x.value):
                return True
        elif isinstance(x, ast.Assign) and column(x.value):
            return True
    if any(b in _DATA_BASES or b.endswith(("Error", "Exception", "Warning")) for b in _bases(node)):
        return True
    return any(_name(d.func if isinstance(d, ast.Call) else d) == "dataclass" for d in node.decorator_list)


def _call_text(x: ast.AST) -> str:
    if isinstance(x, ast.Name):
        return x.id
    return f"{_call_text(x.value)}.{x.attr}" if isinstance(x, ast.Attribute) else "<expr>"


def _delegate(node: ast.FunctionDef) -> str | None:
    """What a function does nothing but call, with its own names as arguments."""
    rest = [x for x in node.body if not _is_str(x)]
    if len(rest) != 1 or not isinstance(rest[0], (ast.Return, ast.Expr)):
        return None
    call = rest[0].value
    call = call.value if isinstance(call, ast.Await) else call
    if not isinstance(call, ast.Call):
        return None
    f = call.func
    if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name) and f.value.func.id == "super":
        return None
    pure = all(isinstance(a, (ast.Name, ast.Starred)) for a in call.args) and all(isinstance(k.value, ast.Name) for k in call.keywords)
    return _call_text(f) if pure else None


def _default(x: ast.expr | None) -> str | None:
    if x is None:
        return None
    if isinstance(x, ast.Constant) and isinstance(x.value, bool):
        return "bool"
    return "mutable" if isinstance(x, _MUTABLE) else "other"


def _params(a: ast.arguments) -> list[dict]:
    plain = [(x, "posonly") for x in a.posonlyargs] + [(x, "arg") for x in a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    rows = [(x, k, d) for (x, k), d in zip(plain, defaults)]
    rows += [(x, "kwonly", d) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    rows += [(x, k, None) for x, k in ((a.vararg, "vararg"), (a.kwarg, "kwarg")) if x]
    return [{"name": x.arg, "kind": k, "annotated": x.annotation is not None, "default": _default(d)} for x, k, d in rows]


def _last_kind(body: list[ast.stmt]) -> str:
    """How the last statement of a block leaves it."""
    x = body[-1]
    if type(x) in _ENDS:
        return _ENDS[type(x)]
    if isinstance(x, ast.If):
        return "if" if not x.orelse else "if-else"
    if isinstance(x, ast.Expr) and isinstance(x.value, (ast.Call, ast.Yield, ast.YieldFrom)):
        return "call"
    if isinstance(x, _LOOPS):
        return "loop"
    targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, (ast.AugAssign, ast.AnnAssign)) else []
    return "store" if targets and all(isinstance(t, (ast.Attribute, ast.Subscript)) for t in targets) else "other"


def _dead(body: list[ast.stmt]) -> list[int]:
    if len(body) > 1:
        for i, x in enumerate(body):
            if x.__class__ in _ENDS:
                return [y.lineno for y in body[i + 1 :]]
    return []


def _dead_lines(node: ast.FunctionDef) -> list[int]:
    """Statements after a terminator in a function's body and the blocks of its own statements."""
    out = _dead(node.body)
    for x in node.body:
        if x.__class__ in _BLOCKS:
            out += _dead(x.body) + _dead(getattr(x, "orelse", []))
        if x.__class__ is ast.Try:
            for h in x.handlers:
                out += _dead(h.body)
    return out


def _none_guard(test: ast.expr) -> str | None:
    if isinstance(test, ast.Compare) and isinstance(test.left, ast.Name) and len(test.ops) == 1 and isinstance(test.ops[0], ast.Is):
        c = test.comparators[0]
        return test.left.id if isinstance(c, ast.Constant) and c.value is None else None
    return None


def _outer_writes(node: ast.FunctionDef, seq: int) -> list[dict]:
    """Assignments in a function's own scope to names that it declares global or nonlocal, in order."""
    declared: dict[str, set[str]] = {"global": set(), "nonlocal": set()}
    found: list[tuple[str, int, bool]] = []

    def note(x: ast.stmt, guard: str | None) -> bool:
        targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AugAssign) else None
        for t in targets or []:
            if isinstance(t, ast.Name):
                found.append((t.id, x.lineno, t.id == guard))
        return targets is not None

    def visit(x: ast.AST) -> None:
        if isinstance(x, (*_DEFS, ast.ClassDef)):
            return
        if isinstance(x, (ast.Global, ast.Nonlocal)):
            declared["global" if isinstance(x, ast.Global) else "nonlocal"].update(x.names)
        if isinstance(x, ast.If) and (guard := _none_guard(x.test)):
            for y in x.body:
                if not note(y, guard):
                    visit(y)
            for y in x.orelse:
                visit(y)
            return
        note(x, None) if isinstance(x, ast.stmt) else None
        for y in blocks(x):
            visit(y)

    for x in node.body:
        visit(x)
    via = lambda n: "/".join(k for k in ("global", "nonlocal") if n in declared[k])
    return [{"func": seq, "name": node.name, "line": line, "target": n, "via": via(n), "guarded": g} for n, line, g in found if via(n)]


def _number(x: ast.Constant, text) -> dict:
    try:
        value = repr(x.value)
    except ValueError:  # more digits than Python converts
        value = hex(x.value)
    return {"line": x.lineno, "display": text(x), "value": value, "is_int": type(x.value) is int}


def _numbers(node: ast.FunctionDef, text) -> list[dict]:
    """Numbers in a function's body, but for signatures and direct keyword arguments."""
    out, stack = [], node.body[::-1]
    while stack:
        x = stack.pop()
        if x.__class__ is ast.Constant:
            if type(x.value) in (int, float):
                out.append(_number(x, text))
        elif x.__class__ is not ast.arguments and not (x.__class__ is ast.keyword and isinstance(x.value, ast.Constant)):
            stack += [y for y in reversed(kids(x)) if y.__class__ is not ast.Name]
    return out


def _string_compare(x: ast.Compare) -> dict | None:
    if len(x.ops) != 1 or not isinstance(x.ops[0], (ast.Eq, ast.NotEq)):
        return None
    sides = [x.left, x.comparators[0]]
    text = [s.value if isinstance(s, ast.Constant) and isinstance(s.value, str) and len(s.value) >= 2 else None for s in sides]
    if (text[0] is None) == (text[1] is None):
        return None
    v, other = (text[0], sides[1]) if text[0] is not None else (text[1], sides[0])
    dunder = len(v.encode("utf-8", "replace")) > 4 and v.startswith("__") and v.endswith("__")
    return {"line": x.lineno, "value": v, "excluded": dunder or isinstance(other, ast.Attribute) and other.attr in ("arg", "id", "attr")}


def _bare_dicts(annotation: ast.AST) -> list[int]:
    out, stack = [], [annotation]
    while stack:
        x = stack.pop()
        if isinstance(x, ast.Subscript) and isinstance(x.value, ast.Name) and x.value.id == "dict":
            stack.append(x.slice)
            continue
        if isinstance(x, ast.Name) and x.id == "dict":
            out.append(x.lineno)
        stack += kids(x)
    return out


def _private(name: str) -> bool:
    return name.startswith("_") and not (len(name) >= 4 and name.startswith("__") and name.endswith("__"))


def _chain(x: ast.AST) -> tuple[int, str | None]:
    depth = 0
    while isinstance(x, (ast.Call, ast.Attribute)):
        depth += isinstance(x, ast.Attribute)
        x = x.func if isinstance(x, ast.Call) else x.value
    return depth, x.id if isinstance(x, ast.Name) else None


def twin_names(name: str) -> list[str]:
    """The names that an asynchronous or synchronous twin of a function may have."""
    out = {f"a{name}", f"{name}_async", f"async_{name}", f"_async_{name}"}
    if name.startswith("a") and len(name) > 1:
        out.add(name[1:])
    out |= {name.removeprefix(p) for p in ("_async_", "async_") if name.startswith(p)}
    if name.endswith("_async"):
        out.add(name.removesuffix("_async"))
    if name.endswith("_sync"):
        out |= {name.removesuffix("_sync"), name.removesuffix("_sync") + "_async"}
    return sorted(out - {name})


def _imports(tree: ast.Module, told: bool = True) -> tuple[list[dict], list[tuple[str | None, int, list[str]]]]:
    """All imports in order, if they are to be told, and those that run when the module is imported: module, level, names."""
    rows, at_import, stack = [], [], [(tree, False, True)]
    while stack:
        x, top, runs = stack.pop()
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            module = x.module if isinstance(x, ast.ImportFrom) else None
            for i, a in enumerate(x.names) if told else ():
                bound = a.asname or (a.name.split(".")[0] if isinstance(x, ast.Import) else a.name)
                if bound in ("_", "*") or module == "__future__":
                    bound = None
                rows.append({"line": x.lineno, "kind": "import" if isinstance(x, ast.Import) else "from", "module": module, "name": a.name, "bound": bound, "top": top, "alias": i})
            if runs:
                at_import.extend([(a.name, 0, []) for a in x.names] if isinstance(x, ast.Import) else [(module, x.level, [a.name for a in x.names])])
            continue
        if isinstance(x, _DEFS) or isinstance(x, ast.If) and _name(x.test) == "TYPE_CHECKING":
            runs = False
        top = isinstance(x, ast.Module)
        stack += [(y, top, runs) for y in reversed(blocks(x))]
    return rows, at_import


def _targets(package: str, module: str | None, level: int, names: list[str]) -> list[str]:
    """The modules that an import names, absolute."""
    if level == 0:
        return [module] if module else []
    parts = package.split(".") if package else []
    base = ".".join(parts[: max(0, len(parts) - (level - 1))])
    return [f"{base}.{n}" if base else n for n in ([module] if module else names)]


def module_names(root: str, path: str) -> tuple[str, str, list[str]]:
    """Module and package of a file, and the parts of its dotted path from the root's parent."""
    anchor = os.path.dirname(root.rstrip("/"))
    rel = _relative(path, anchor) if path.startswith(f"{anchor}/") or not anchor else path.lstrip("/")
    parts = rel.removesuffix(".py").split("/")
    if parts[-1] == "__init__":
        return ".".join(parts[:-1]), ".".join(parts[:-1]), parts
    return ".".join(parts), ".".join(parts[:-1]), parts


class _Shredder:
    def __init__(self, source: str, wanted: frozenset[str] | None, written: dict[str, str] | None = None) -> None:
        self.wanted, self.written = wanted, written
        self.statements_only = not self.need("used", "dicts", "compares", "privates")
        self.source, self.texts, self.attributes = source, None, False
        #: Of the functions around a node, the outer first: complexity, nesting, nested returns and the depth outside; the numbers so far; and how many signatures are around it.
        self.frames: list[list[int]] = []
        self.numbers: list[list[dict]] = []
        self.signatures = 0
        self.methods: list[tuple[dict, list[ast.FunctionDef]]] = []
        self.declares = "global" in source or "nonlocal" in source
        self.out: dict[str, list] = {k: [] for k in ("functions", "classes", "ifs", "handlers", "writes", "literals", "compares", "privates", "chains", "assigns", "twins", "dead")}
        self.used: set[str] = set()
        self.dicts: set[int] = set()
        self.scopes: dict[str | None, dict[str, ast.FunctionDef]] = {}
        self.named: list[tuple[str, list[str], dict]] = []

    def need(self, *names: str) -> bool:
        return self.wanted is None or not self.wanted.isdisjoint(names)

    def hash(self, body: list[ast.stmt]) -> str:
        out: list[str] = []
        _write_list(body, out)
        digest = _digest(text := "".join(out))
        if self.written is not None:
            self.written[digest] = text
        return digest

    def text(self, x: ast.Constant) -> str:
        if self.texts is None:
            self.texts = self.source.split("\n") if "\r" not in self.source else re.split(r"\r\n|\r|\n", self.source)
        line = self.texts[x.lineno - 1]
        if line.isascii():
            return line[x.col_offset : x.end_col_offset]
        return line.encode("utf-8", "replace")[x.col_offset : x.end_col_offset].decode("utf-8", "replace")

    def run(self, tree: ast.Module) -> None:
        for x in tree.body:
            self.visit(x, None, None, True, True, 0)
            if isinstance(x, ast.Assign):
                self.out["assigns"] += [{"line": x.lineno, "name": t.id, "is_mutable": isinstance(x.value, _MUTABLE)} for t in x.targets if isinstance(t, ast.Name)]
        for row in self.out["functions"]:  # an outer function's numbers before those of the functions in it
            self.out["literals"] += row.pop("numbers", ())
        for row, methods in self.methods:
            row["wmc"] = sum(m._cc for m in methods)
        for i, x in enumerate(tree.body if self.need("chains") and (self.attributes or self.statements_only) else ()):
            queue = deque([x])
            while queue:  # nearer to the statement first
                y = queue.popleft()
                if isinstance(y, (ast.Call, ast.Attribute)):
                    depth, root = _chain(y)
                    if depth > 1:
                        self.out["chains"].append({"stmt": i, "line": y.lineno, "depth": depth, "root": root})
                queue.extend(kids(y))
        by_name: dict[str, list[list[str]]] = {}
        for name, bases, _ in self.named:
            by_name.setdefault(name, []).append(bases)
        for name, bases, row in self.named if self.need("ancestors") else ():
            seen, queue = set(), deque(bases)
            while queue:
                b = queue.popleft()
                if b not in seen and b != name:
                    seen.add(b)
                    for more in by_name.get(b, []):
                        queue.extend(more)
            row["ancestors"] = len(seen)
        self.mark()
        if self.need("twins"):
            self.twins()

    def mark(self) -> None:
        """What rules ask of a fact's place among its like, so that none compares each with all."""
        seen: set[int] = set()
        for w in self.out["writes"]:
            w["first"] = not w["guarded"] and w["func"] not in seen
            if w["first"]:
                seen.add(w["func"])
        times = Counter(c["value"] for c in self.out["compares"] if not c["excluded"])
        for c in self.out["compares"]:
            c["times"] = times[c["value"]]

    def twins(self) -> None:
        place, texts = 0, {}

        def text(f: ast.FunctionDef) -> str:
            if id(f) not in texts:
                texts[id(f)] = ast.unparse(f)
            return texts[id(f)]

        for cls, funcs in self.scopes.items():
            for name, f in funcs.items():
                if f.end_lineno - f.lineno + 1 < _TWIN_LINES:
                    continue
                for other in twin_names(name):
                    if g := funcs.get(other):
                        ratio = difflib.SequenceMatcher(None, text(f), text(g)).ratio()
                        self.out["twins"].append({"name": name, "other": other, "class_name": cls, "line": min(f.lineno, g.lineno), "ratio": ratio, "place": place})
                        place += 1

    def visit(self, x: ast.AST, cls: str | None, first: str | None, top: bool, in_defs: bool, depth: int) -> None:
        """cls: the nearest class; first: the nearest function's first parameter; in_defs: reached through bodies of classes and functions alone; depth: of blocks. Functions around are measured on the way, if expressions are visited too."""
        kind, out = x.__class__, self.out
        if kind is ast.Name:
            self.used.add(x.id)
            return
        if kind not in _TELLING:
            pass
        elif kind in _DEFS:
            row = self.function(x, cls, top)
            a = x.args
            first = next((p.arg for p in [*a.posonlyargs, *a.args]), None)
            if x.returns:
                self.dicts.update(_bare_dicts(x.returns))
            if not self.statements_only:
                self.inside(x, row, cls, first, in_defs, depth)
                return
        elif isinstance(x, ast.ClassDef):
            self.klass(x, top, in_defs)
            cls = x.name
        elif isinstance(x, ast.arguments):
            for p in [*x.posonlyargs, *x.args, *x.kwonlyargs, x.vararg, x.kwarg]:
                if p and p.annotation:
                    self.dicts.update(_bare_dicts(p.annotation))
        elif isinstance(x, ast.AnnAssign):
            self.dicts.update(_bare_dicts(x.annotation))
        elif isinstance(x, ast.If):
            if self.need("ifs"):
                hashed = bool(x.orelse) and self.need("else_hash")
                else_if = len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If)
                out["ifs"].append({"line": x.lineno, "n_body": len(x.body), "n_else": len(x.orelse), "last": _last_kind(x.body), "else_if": else_if, "body_hash": self.hash(x.body) if hashed else None, "else_hash": self.hash(x.orelse) if hashed else None})
        elif isinstance(x, ast.ExceptHandler):
            silent = len(x.body) == 1 and (isinstance(x.body[0], ast.Pass) or isinstance(x.body[0], ast.Expr) and isinstance(x.body[0].value, ast.Constant) and x.body[0].value.value is ...)
            out["handlers"].append({"line": x.lineno, "type_name": None if x.type is None else x.type.id if isinstance(x.type, ast.Name) else "Exception", "silent": silent})
        elif isinstance(x, ast.Assign):
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, (ast.List, ast.Tuple)):
                self.used.update(e.value for e in x.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str))
        elif isinstance(x, ast.Compare):
            if row := _string_compare(x):
                out["compares"].append(row)
        elif isinstance(x, ast.Attribute):
            self.attributes = True
            if isinstance(x.ctx, ast.Load) and _private(x.attr):
                out["privates"].append({"line": x.lineno, "form": "attribute", "attr": x.attr, "allowed": self.own(x.value, cls, first)})
        elif isinstance(x, ast.Call):
            f, a = x.func, x.args
            if isinstance(f, ast.Name) and f.id in ("getattr", "setattr", "hasattr") and len(a) > 1 and isinstance(a[1], ast.Constant) and isinstance(a[1].value, str) and _private(a[1].value):
                out["privates"].append({"line": x.lineno, "form": f.id, "attr": a[1].value, "allowed": self.own(a[0], cls, first)})
        inner = in_defs and kind in _SCOPES
        if self.statements_only:
            for y in blocks(x):
                if y.__class__ not in _LEAVES:
                    self.visit(y, cls, first, False, inner and y.__class__ in _SCOPES, depth)
            return
        if frames := self.frames:
            more = 1 if kind in _BRANCHES else len(x.values) - 1 if kind is ast.BoolOp else 0
            if more:
                for f in frames:
                    f[0] += more
            if kind in _NESTING:
                depth += 1
                for f in frames:
                    f[1] = max(f[1], depth - f[3])
            elif kind is ast.Return and depth - frames[-1][3] >= 2:
                frames[-1][2] += 1
        if kind is ast.arguments:
            self.signatures += 1
            self.each(kids(x), kind, cls, first, inner, depth)
            self.signatures -= 1
        else:
            self.each(kids(x), kind, cls, first, inner, depth)

    def each(self, nodes: list[ast.AST], kind: type, cls: str | None, first: str | None, inner: bool, depth: int) -> None:
        """Visit child nodes of a node of some kind."""
        for y in nodes:
            below = y.__class__
            if below is ast.Name:
                self.used.add(y.id)
            elif below is not ast.Constant:
                self.visit(y, cls, first, False, inner and below in _SCOPES, depth)
            elif self.numbers and kind is not ast.keyword and not self.signatures and type(y.value) in (int, float):
                row = _number(y, self.text)
                for n in self.numbers:
                    n.append(row)

    def inside(self, x: ast.FunctionDef, row: dict, cls: str | None, first: str | None, in_defs: bool, depth: int) -> None:
        """Visit a function's child nodes, and measure it by them."""
        nodes, n, frame = kids(x), len(x.body), [1, 0, 0, depth]
        self.frames.append(frame)
        self.each(nodes[:1], x.__class__, cls, first, in_defs, depth)  # the signature
        if "numbers" in row:
            self.numbers.append(row["numbers"])
        self.each(nodes[1 : n + 1], x.__class__, cls, first, in_defs, depth)
        if "numbers" in row:
            self.numbers.pop()
        self.each(nodes[n + 1 :], x.__class__, cls, first, in_defs, depth)
        self.frames.pop()
        for name, value in zip(("cc", "nesting", "nested_returns"), frame):
            row[name] = value
        x._cc = frame[0]

    @staticmethod
    def own(base: ast.expr, cls: str | None, first: str | None) -> bool:
        if isinstance(base, ast.Name):
            return base.id in ("self", "cls", cls, first)
        return isinstance(base, ast.Call) and isinstance(base.func, ast.Name) and base.func.id == "super"

    def function(self, x: ast.FunctionDef, cls: str | None, top: bool) -> dict:
        out, seq = self.out, len(self.out["functions"])
        self.scopes.setdefault(cls, {})[x.name] = x
        get = lambda name, f: f(x) if self.need(name) else None
        now = lambda name, f: get(name, f) if self.statements_only else None  # noqa: E731, otherwise measured on the way
        row = {
            "seq": seq, "name": x.name, "class_name": cls, "line": x.lineno, "span": x.end_lineno - x.lineno + 1, "cc": now("cc", complexity), "nesting": now("nesting", nesting), "nested_returns": now("nested_returns", nested_returns),
            "has_return": x.returns is not None, "params": _params(x.args) if self.need("params") else None, "n_decorators": len(x.decorator_list), "trivial": _is_trivial(x.body),
            "body_hash": self.hash(x.body) if self.need("body_hash") else None, "target": get("target", _delegate), "top": top,
        }
        out["functions"].append(row)
        if self.need("dead"):
            out["dead"] += _dead_lines(x)
        if self.declares and self.need("writes"):
            out["writes"] += _outer_writes(x, seq)
        if x.name != "__init__" and self.need("literals"):
            if self.statements_only:
                out["literals"] += _numbers(x, self.text)
            else:
                row["numbers"] = []
        return row

    def klass(self, x: ast.ClassDef, top: bool, in_defs: bool) -> None:
        methods = [m for m in x.body if isinstance(m, _DEFS)]
        attrs = {a.attr for m in (methods if self.need("n_attrs") else ()) for a in ast.walk(m) if isinstance(a, ast.Attribute) and isinstance(a.ctx, ast.Store) and isinstance(a.value, ast.Name) and a.value.id == "self"}
        wmc = sum(map(complexity, methods)) if self.need("wmc") and self.statements_only else None
        row = {"name": x.name, "line": x.lineno, "n_methods": len(methods), "n_attrs": len(attrs), "wmc": wmc, "n_decorators": len(x.decorator_list), "exempt": _is_data_class(x), "top": top, "ancestors": 0}
        self.out["classes"].append(row)
        if not self.statements_only:
            self.methods.append((row, methods))
        if in_defs:
            self.named.append((x.name, _bases(x), row))


def unparsed(source: str | None) -> list[tuple[str, int, str]]:
    """Name, line and canonical text of every function; nothing of a file that doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return [(x.name, x.lineno, ast.unparse(x)) for x in ast.walk(tree) if isinstance(x, _DEFS)]


#: What a syntax tree is needed for.
_TREE = frozenset([*FAMILIES, "parse_error", "used", "dead", "dicts", "edges"]) - {"hashes"}
#: Fields that a file's text alone gives, whatever its path.
CONTENT = ("n_lines", "lines", "parse_error", *FAMILIES, "used", "dead", "dicts")


def _plain(source: str, wanted: frozenset[str] | None) -> dict:
    """What a text tells without being parsed."""
    n = source.count("\n") + (source != "" and not source.endswith("\n"))
    row = {"n_lines": n, "parse_error": None, "lines": split_lines(source) if wanted is None or "lines" in wanted else [], "hashes": []}
    if (wanted is None or "hashes" in wanted) and "#" in source:
        row["hashes"] = [{"line": i, "text": x} for i, x in enumerate(split_lines(source), 1) if "#" in x]
    return row


def contents(source: str | None, wanted: frozenset[str] | None = None, written: dict[str, str] | None = None) -> dict:
    """What a file's text tells, whatever its path, and its imports as at_import, which become edges by its path. Nothing is parsed if no wanted field asks for it. written: takes the text of each hash."""
    source = source or ""
    row = _plain(source, wanted)
    if wanted is not None and wanted.isdisjoint(_TREE):
        return row
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 8000))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        s = _Shredder(source, wanted, written)
        if s.need(*s.out, "ancestors", "used", "dicts", "functions", "classes"):
            s.run(tree)
        told = s.need("imports", "chains")
        imports, at_import = _imports(tree, told) if "import" in source and (told or s.need("edges")) else ([], [])
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return row | {"parse_error": f"{type(e).__name__}: {e}"[:200]}
    finally:
        sys.setrecursionlimit(limit)
    bound = {m["bound"]: m for m in imports}  # the last import of a name
    for m in imports:
        m["final"] = m["bound"] is not None and bound[m["bound"]] is m
    for c in s.out["chains"]:
        c["imported"] = c["root"] is not None and c["root"] in bound
    return row | s.out | {"imports": imports, "used": sorted(s.used), "dicts": sorted(s.dicts), "at_import": at_import}


def _relative(path: str, base: str) -> str:
    """os.path.relpath, which takes long, of a path that may plainly be below base."""
    if base and path.startswith(base) and path[len(base) : len(base) + 1] == "/" and "//" not in path and "/." not in path and path[-1] != "/" and base[0] == "/":
        return path[len(base) + 1 :]
    return os.path.relpath(path, base)


def places(package: str, root: str, path: str, told: dict) -> dict:
    """What a file's path tells, and the modules that it imports. told: its contents()."""
    module, of, parts = module_names(root, path)
    row = {"package": package, "root": root, "path": path, "rel_path": _relative(path, root), "module": module, "is_test": is_test_path(path), "is_init": os.path.basename(path) == "__init__.py", "parts": parts}
    if "at_import" in told:
        row["edges"] = sorted({t for m, level, names in told["at_import"] for t in _targets(of, m, level, names)})
    return row


def shred(package: str, root: str, path: str, source: str | None, wanted: frozenset[str] | None = None) -> dict:
    """The row of facts of a file. A file that doesn't parse has its lines and an error, and no other facts. Of the families and fields, those not in `wanted` may stay empty."""
    told = contents(source, wanted)
    row = places(package, root, path, told) | told
    row.pop("at_import", None)
    return row


#: A word, and a quote if it is right after it; a number; a text in quotes that has neither digits nor escapes; a comment; and what is not told apart: other texts and escapes.
_TOKEN = re.compile(r"""[^\w"'\#\\]*+([A-Za-z_]\w*+["']?|\d[\w.]*|\"{3}[^"\\\d]*\"{3}|'{3}[^'\\\d]*'{3}|\"{3}|'{3}|"[^"\\\d\n]*"|'[^'\\\d\n]*'|\#[^\n]*|["'\\]|\Z)""", re.ASCII)
_NUMBERED = re.compile(r"\b[A-Za-z_]++\d\w*", re.ASCII)
_UNTOLD = re.compile(r"[^\n\t -~]")
_DIGITS = re.compile(r"\d+", re.ASCII)


def renumbered(source: str) -> tuple[str, dict[str, str]] | None:
    """A text with the numbers in its names counted from 0, in as many digits, and each new name's old one. Nothing if no name has a number, or if it isn't plain which words are names.

    The new names are as different as the old, as long, and alike but for digits, and no text in quotes has any; so both texts
    parse to the same tree but for these names, and no rule knows a name with a digit."""
    if _UNTOLD.search(source):
        return None
    words = []
    for x in dict.fromkeys(_TOKEN.findall(source)):
        c = x[:1]
        if c == "#" or c == "":
            continue
        if c.isdigit():
            if "." in x and not x.replace(".", "").replace("_", "").isdigit():  # an attribute's name may be in it
                return None
        elif c in "\"'":
            if len(x) in (1, 3) and x == c * len(x):
                return None
        elif c == "\\" or x[-1] in "\"'":  # a prefix tells what is in the quotes
            return None
        elif _DIGITS.search(x):
            words.append(x)
    if not words:
        return None
    runs: dict[str, str] = {}
    counts: Counter = Counter()
    for w in words:
        for d in _DIGITS.findall(w):
            if d not in runs:
                runs[d] = f"{counts[len(d)]:0{len(d)}}"
                counts[len(d)] += 1
    new = {w: _DIGITS.sub(lambda m: runs[m[0]], w) for w in words}
    return _NUMBERED.sub(lambda m: new.get(m[0], m[0]), source), {n: w for w, n in new.items()}


class _Template:
    """The contents of a renumbered text, from which those of each text that it comes from follow."""

    def __init__(self, key: str, wanted: frozenset[str] | None) -> None:
        self.written: dict[str, str] = {}
        self.told = contents(key, wanted, self.written)
        #: Errors may quote the text, and the likeness of twins depends on each letter.
        self.usable = self.told["parse_error"] is None and not self.told.get("twins")
        self.written = {h: t for h, t in self.written.items() if _NUMBERED.search(t)}
        self.named = [f for f, v in self.told.items() if f not in ("lines", "hashes") and self._filled(v, None) is not v]

    def _filled(self, v, old: dict[str, str] | None):
        """v with old names for new, in its hashes too; v itself if it has none. old: None to tell whether it has."""
        if v.__class__ is str:
            if (text := self.written.get(v)) is not None:
                return "" if old is None else _digest(_NUMBERED.sub(lambda m: old.get(m[0], m[0]), text))
            if not _NUMBERED.search(v):
                return v
            return v + " " if old is None else _NUMBERED.sub(lambda m: old.get(m[0], m[0]), v)
        if v.__class__ is dict:
            out = {k: self._filled(x, old) for k, x in v.items()}
            return v if all(out[k] is x for k, x in v.items()) else out
        if v.__class__ is list or v.__class__ is tuple:
            out = v.__class__([self._filled(x, old) for x in v])
            return v if all(a is b for a, b in zip(out, v)) else out
        return v

    def of(self, source: str, old: dict[str, str], wanted: frozenset[str] | None) -> dict:
        row = self.told | _plain(source, wanted)
        for f in self.named:
            row[f] = self._filled(self.told[f], old)
        if "used" in self.named:
            row["used"].sort()
        return row


class Memo:
    """Contents of texts seen before, in two generations: when the younger is full, the elder is forgotten. Files that are alike are parsed once, and those that are alike but for the numbers in their names twice."""

    def __init__(self, wanted: frozenset[str] | None, most: int = 1 << 18) -> None:
        self.wanted, self.most = wanted, most
        self.young: dict[str | None, dict] = {}
        self.old: dict[str | None, dict] = {}
        self.size = 0
        self.parses = wanted is None or not wanted.isdisjoint(_TREE)
        #: By renumbered text: None when met once, then its template.
        self.templates: dict[str, _Template | None] = {}
        self.elder: dict[str, _Template | None] = {}
        self.weight = 0

    def alike(self, source: str | None) -> dict | None:
        """Contents by those of a text that differs by the numbers in its names, if there was one."""
        if not self.parses or not source or (found := renumbered(source)) is None:
            return None
        key, old = found
        t = self.templates.get(key, 0)
        if t == 0:
            t = self.elder.get(key, 0)
            if self.weight > self.most:
                self.templates, self.elder, self.weight = {}, self.templates, 0
            self.templates[key] = None if t == 0 else t
            self.weight += len(key) + 100
            if t == 0:
                return None
        if t is None:
            t = self.templates[key] = _Template(key, self.wanted)
        return t.of(source, old, self.wanted) if t.usable else None

    def get(self, source: str | None) -> dict:
        if (told := self.young.get(source)) is None:
            told = self.old.get(source) or self.alike(source) or contents(source, self.wanted)
            if self.size > self.most:
                self.young, self.old, self.size = {}, self.young, 0
            self.young[source] = told
            self.size += len(source or "") + 100
        return told
