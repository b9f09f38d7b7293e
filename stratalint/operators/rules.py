"""The per-file rules, as expressions over one file's facts: a file's issues are one array, built without a shuffle.

Each rule maps a fact family to issues: which facts, the line, severity, rule and message. All are Catalyst higher-order
functions over the arrays of a row, so adding a rule adds no pass over the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalint.functions.config import ScanConfig
from stratalint.functions.schema import ISSUE

HTTP_CODES = "100,101,200,201,202,204,301,302,304,400,401,403,404,405,409,410,422,429,500,502,503,504"
PORTS = "80,443,3306,5432,6379,8080,8200,27017"
_ALLOWED = "(" + ",".join(f"'{n}'" for n in f"0,1,{HTTP_CODES},{PORTS}".split(",")) + ")"


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _issue(no: int, severity: str, rule: str, message: str, line: str) -> str:
    return f"named_struct('line', cast({line} as int), 'severity', {severity}, 'rule', '{rule}', 'message', {message}, 'rule_no', {no}, 'pos', i)"


def _rule(no: int, family: str, where: str, severity: str, rule: str, message: str, line: str = "x.line") -> str:
    """SQL for a rule's issues. where, severity, line and message are SQL over x, an element of the family."""
    return f"transform(filter({family}, x -> coalesce({where}, false)), (x, i) -> {_issue(no, severity, rule, message, line)})"


def file_rules(c: ScanConfig) -> list[str]:
    """SQL of each rule's array of issues; facts of families that a rule doesn't name aren't read for it."""
    info, warn, error = "'info'", "'warning'", "'error'"
    named = lambda text: f"concat(x.name, {_text(text)})"
    typed = "not is_test and not startswith(x.name, '_') and not startswith(x.name, 'test_')"
    n_params = "size(filter(x.params, q -> q.kind <> 'posonly'))"
    flags = "transform(filter(x.params, q -> q.kind in ('arg', 'kwonly') and q.default = 'bool'), q -> q.name)"
    bare = "filter(x.params, q -> q.kind = 'arg' and q.name not in ('self', 'cls') and not q.annotated)"
    param = "concat(x.name, '() leaves parameter ', q.name, ' unannotated')"
    number = f"not (x.is_int and x.value in {_ALLOWED}) and not (not x.is_int and x.value in ('0.0', '1.0', '-1.0'))"
    unnamed = "concat('unnamed number ', x.display)"
    over = lambda col, most: f"x.{col} > {most * c.escalation}"
    god = f"x.n_methods > {c.class_methods} or x.n_attrs > {c.class_attrs} or x.wmc > {c.class_wmc}"
    worse = " or ".join(over(a, b) for a, b in (("n_methods", c.class_methods), ("n_attrs", c.class_attrs), ("wmc", c.class_wmc)))
    public_classes = "size(filter(classes, k -> k.top and not k.exempt and not startswith(k.name, '_')))"
    public_functions = "size(filter(functions, k -> k.top and not startswith(k.name, '_')))"
    one = "array(named_struct('line', 1))"
    # bound once as a: of neighbours in a statement, the first
    chained = f"filter(chains, h -> h.depth > {c.chain} and not h.imported)"
    first_chain = f"flatten(transform(array({chained}), a -> filter(a, (h, j) -> j = 0 or a[j - 1].stmt <> h.stmt)))"
    todo = r"(?U)#.*\\b(TODO|FIXME|XXX|HACK)\\b"
    trim = r"regexp_replace(x.text, '(?U)^\\s+|\\s+$', '')"
    out = [
        _rule(1, one, f"n_lines > {c.file_lines}", warn, "long-file", f"concat('File has ', n_lines, ' lines (max {c.file_lines})')"),
        _rule(2, "hashes", f"x.text rlike '{todo}'", info, "todo-marker", f"concat(regexp_extract(x.text, '{todo}', 1), ' left in: ', if(char_length({trim}) > 90, concat(substring({trim}, 1, 87), '...'), {trim}))"),
        _rule(3, one, "parse_error is not null", error, "syntax-error", "concat('Cannot be parsed: ', parse_error)"),
        _rule(4, "functions", f"x.span > {c.function_lines} and x.nesting > {c.flat_nesting}", warn, "long-function", f"concat(x.name, '() spans ', x.span, ' lines (max {c.function_lines}); extract helpers')"),
        _rule(5, "functions", f"x.cc > {c.complexity}", f"if(x.cc > {c.complexity * c.escalation}, 'error', 'warning')", "high-complexity", f"concat(x.name, '() has cyclomatic complexity ', x.cc, ' (max {c.complexity})')"),
        _rule(6, "functions", f"{typed} and not x.has_return", warn, "missing-return-type", named("() has no return annotation")),
        f"flatten(transform(filter(functions, x -> {typed}), (x, i) -> transform({bare}, q -> {_issue(7, info, 'missing-param-type', param, 'x.line')})))",
        _rule(8, "functions", f"{n_params} > {c.params}", warn, "too-many-params", f"concat(x.name, '() takes ', {n_params}, ' parameters (max {c.params})')"),
        _rule(9, "functions", f"x.nested_returns > {c.returns}", info, "excessive-returns", f"concat(x.name, '() returns from ', x.nested_returns, ' nested places (max {c.returns})')"),
        _rule(10, "functions", f"size({flags}) >= {c.bool_flags}", info, "boolean-flag-params", f"concat(x.name, '() has ', size({flags}), ' boolean flags: ', array_join({flags}, ', '))"),
        _rule(11, "functions", f"x.nesting > {c.nesting}", warn, "deep-nesting", f"concat(x.name, '() nests ', x.nesting, ' blocks (max {c.nesting})')"),
        _rule(12, "functions", "exists(x.params, q -> q.default = 'mutable')", warn, "mutable-default", named("() has a mutable default argument")),
        _rule(13, "handlers", "x.type_name is null", warn, "bare-except", "'except without an exception type'"),
        _rule(14, "ifs", "x.n_else = 0 and x.n_body >= 2 and x.last not in ('return', 'raise', 'break', 'continue', 'if', 'call', 'loop', 'store')", info, "missing-else", "concat('if with ', x.n_body, ' statements has no else')"),
        _rule(15, "filter(imports, m -> m.final)", "not is_init and not array_contains(used, x.bound)", warn, "unused-import", "concat(x.bound, ' is imported and not used')"),
        _rule(16, "handlers", "x.silent", warn, "swallowed-exception", "concat(coalesce(x.type_name, 'Exception'), ' is discarded silently')"),
        _rule(17, "imports", "x.kind = 'from' and x.name = '*'", warn, "star-import", "concat('star import from ', coalesce(x.module, ''))"),
        _rule(18, "assigns", "x.is_mutable and not startswith(x.name, '_')", info, "global-mutable", "concat('module-level ', x.name, ' is mutable')"),
        _rule(19, "writes", "x.first", info, "scope-mutation", "concat(x.name, '() assigns outer variable ', x.target, ' (', x.via, ')')"),
        _rule(20, "dead", "true", warn, "dead-code", "'unreachable statement'", "x"),
        _rule(21, "functions", f"x.n_decorators > {c.decorators}", info, "excessive-decorators", f"concat(x.name, '() has ', x.n_decorators, ' decorators (max {c.decorators})')"),
        _rule(21, "classes", f"x.n_decorators > {c.decorators}", info, "excessive-decorators", f"concat('class ', x.name, ' has ', x.n_decorators, ' decorators (max {c.decorators})')"),
        _rule(22, "classes", f"not x.exempt and x.n_methods < {c.min_methods}", info, "lazy-class", "concat('class ', x.name, ' has ', x.n_methods, ' method(s)')"),
        f"if(size(array_distinct(transform(filter(literals, x -> {number}), x -> x.display))) >= {c.dense_numbers}, cast(array() as array<{ISSUE}>), {_rule(23, 'literals', number, info, 'magic-number', unnamed)})",
        _rule(24, "filter(compares, m -> not m.excluded)", "not is_test and x.times >= 2", info, "magic-string", "concat('string ', x.value, ' is compared ', x.times, ' times')"),
        _rule(25, "dicts", "true", info, "untyped-dict", "'dict annotation without key and value types'", "x"),
        _rule(26, "ifs", "x.n_else > 0 and not x.else_if and x.body_hash = x.else_hash", warn, "duplicate-branch", "'both branches of the if are the same'"),
        _rule(27, "privates", "not x.allowed", info, "encapsulation-violation", "if(x.form = 'attribute', concat('reads private .', x.attr, ' of another object'), concat(x.form, '() reaches private ', x.attr))"),
        _rule(28, "classes", god, f"if({worse}, 'error', 'warning')", "god-class", f"concat('class ', x.name, ' has ', x.n_methods, ' methods, ', x.n_attrs, ' attributes, complexity ', x.wmc, ' (max {c.class_methods}/{c.class_attrs}/{c.class_wmc})')"),
        _rule(30, one, f"{public_classes} + {public_functions} > {c.public_symbols}", warn, "god-module", f"concat('module has ', {public_classes} + {public_functions}, ' public symbols (', {public_classes}, ' classes, ', {public_functions}, ' functions)')"),
        _rule(31, "classes", f"x.ancestors >= {c.inheritance}", warn, "deep-inheritance", f"concat('class ', x.name, ' has ', x.ancestors, ' ancestors (max {c.inheritance})')"),
        _rule(32, "functions", "x.target is not null and not (startswith(x.name, '__') and endswith(x.name, '__'))", info, "pass-through-method", "concat(x.name, '() only calls ', x.target, '()')"),
        _rule(33, first_chain, "true", info, "message-chain", f"concat('attribute chain of depth ', x.depth, ' (max {c.chain})')"),
        _rule(35, "imports", "x.kind = 'from' and x.alias = 0 and x.top and x.module is not null and size(split(x.module, '[.]')) < size(parts) and slice(parts, 1, size(split(x.module, '[.]'))) = split(x.module, '[.]')", warn, "potential-circular-import", "concat('imports its parent package ', x.module)"),
    ]
    if c.libraries:
        known, banned = (", ".join(map(_text, x)) for x in (c.libraries, c.transports))
        out.append(_rule(29, "imports", f"package in ({known}) and x.kind = 'from' and x.alias = 0 and split(x.module, '[.]')[0] in ({banned})", error, "transport-in-library", "concat('library imports transport module ', split(x.module, '[.]')[0])"))
    for package, layers in c.layers.items():
        for prefix, banned in layers:
            imported = "if(x.kind = 'import', x.name, x.module)"
            starts = " or ".join(f"startswith({imported}, {_text(b)})" for b in banned)
            out.append(_rule(34, "imports", f"package = {_text(package)} and startswith(rel_path, {_text(prefix)}) and x.alias = 0 and ({starts})", error, "layer-violation", f"concat(rel_path, ' may not import ', {imported})"))
    return out


def _chosen(config: ScanConfig, only: frozenset[str]) -> list[str]:
    return [r for r in file_rules(config) if not only or any(f"'rule', '{name}'" in r for name in only)]


def needs(config: ScanConfig, only: frozenset[str]) -> frozenset[str]:
    """The families and fields that some rules read, for shredding no others: the words of their SQL outside of its texts."""
    return frozenset(w for r in _chosen(config, only) for w in re.findall(r"\w+", re.sub(r"'(?:[^'\\]|\\.)*'", "", r)))


def issues_of(config: ScanConfig, only: frozenset[str] = frozenset()) -> str:
    """SQL over a file's facts: the array of its issues."""
    empty = f"cast(array() as array<{ISSUE}>)"
    return "flatten(array(" + ", ".join(f"coalesce({r}, {empty})" for r in _chosen(config, only)) + "))"


def file_issues(facts: DataFrame, config: ScanConfig, only: frozenset[str] = frozenset()) -> DataFrame:
    """package, path, and the columns of an issue; one row for each issue of the per-file rules, or of some of them."""
    return facts.select("package", "path", F.explode(F.expr(issues_of(config, only))).alias("issue")).select("package", "path", "issue.*")
