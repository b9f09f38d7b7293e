"""Sources: registries of packages, and a DataSource that reads their Python files.

Spark's own file sources skip names that start with an underscore or a dot, so `__init__.py` among them; this one reads
every file of a tree. The driver lists the upper directories, until they hold many directories or files; an input partition is
a batch of their files, or some directories below, which its task walks. There are PARTS partitions of each kind at most, unless
a partition's names would grow too long. The walk prunes before any file is opened.
"""

from __future__ import annotations

import itertools
import os
import tomllib
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratalint.functions.config import ScanConfig
from stratalint.functions.schema import SOURCE

#: Directories that a driver lists before it leaves them to tasks, and levels of them.
SPREAD, DEPTH = 256, 6
#: Files that a driver lists before it leaves further directories to tasks; partitions of files, or of directories; files in a partition, however many there are.
LISTED, PARTS, MOST = 100_000, 1024, 20_000

#: Directories that aren't packages of their own.
NOISE = frozenset("build dist node_modules site-packages __pycache__".split())
#: Parts of paths that a bare scan of a working directory leaves out.
DEFAULT_EXCLUDES = [f"/{d}/" for d in (*sorted(NOISE), ".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "venv")] + [".egg-info"]


def _has_python(path: str) -> bool:
    return any(f.endswith(".py") for _, _, files in os.walk(path) for f in files)


def discover(cwd: str) -> dict[str, tuple[str, bool]]:
    """Package -> (root, recursive): each subdirectory that holds Python files, and loose files as one flat package."""
    out, loose = {}, False
    for e in sorted(os.scandir(cwd), key=lambda e: e.name):
        if e.is_dir():
            if not e.name.startswith(".") and e.name not in NOISE and not e.name.endswith(".egg-info") and _has_python(e.path):
                out[e.name] = (e.path, True)
        elif e.name.endswith(".py"):
            loose = True
    if loose:
        base = os.path.basename(os.path.abspath(cwd)) or "root"
        out[f"{base} (root)" if base in out else base] = (cwd, False)
    return dict(sorted(out.items()))


def _scalar(x: str) -> str:
    x = x.strip()
    return x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else x


def _inline(x: str) -> str | list | dict:
    """A value on one line: a scalar, [a, b] or {a: b}."""
    x = x.strip()
    if x[:1] == "[" and x[-1:] == "]":
        return [_scalar(v) for v in x[1:-1].split(",") if v.strip()]
    if x[:1] == "{" and x[-1:] == "}":
        return dict(_pair(v) for v in x[1:-1].split(",") if v.strip())
    return _scalar(x)


def _pair(line: str) -> tuple[str, str]:
    k, sep, v = line.strip().partition(":")
    if not sep:
        raise ValueError(f"not a pair: {line.strip()}")
    return _scalar(k), _scalar(v)


def _block(lines: list[tuple[int, str]], i: int) -> tuple[dict | list, int]:
    """The mapping or list whose first line is i, and the line after it."""
    indent, items, out = lines[i][0], [], {}
    while i < len(lines) and lines[i][0] == indent:
        line = lines[i][1]
        i += 1
        if line.startswith("- "):
            items.append(_scalar(line[2:]))
            continue
        k, sep, v = line.partition(":")
        if not sep:
            raise ValueError(f"not a pair: {line}")
        if v.strip():
            out[_scalar(k)] = _inline(v)
        elif i < len(lines) and lines[i][0] > indent:
            out[_scalar(k)], i = _block(lines, i)
        else:
            out[_scalar(k)] = None
    if i < len(lines) and lines[i][0] > indent:
        raise ValueError(f"unexpected indent: {lines[i][1]}")
    return items or out, i


def read_yaml(path: str) -> dict:
    """The subset of YAML that registries need: nested mappings, lists of scalars, and both inline."""
    with open(path, encoding="utf-8") as f:
        rows = [x.split(" #")[0].rstrip() for x in f]
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in rows if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]
    out, i = {}, 0
    while i < len(lines):
        block, i = _block(lines, i)
        if not isinstance(block, dict):
            raise ValueError(f"{path} isn't a mapping")
        out |= block
    return out


def read_registry(path: str) -> dict[str, tuple[str, bool]]:
    """The packages of a YAML file of the form packages: {name: path}; paths are relative to the file."""
    found, base = read_yaml(path).get("packages"), os.path.dirname(os.path.abspath(path))
    if not found:
        raise ValueError(f"{path} names no packages")
    if not isinstance(found, dict) or (bad := [k for k, v in found.items() if not isinstance(v, str) or not v]):
        raise ValueError(f"not a package: {found if not isinstance(found, dict) else bad[0]}")
    return {k: (os.path.normpath(os.path.join(base, v)), True) for k, v in sorted(found.items())}


def read_settings(path: str, config: ScanConfig = ScanConfig()) -> ScanConfig:
    """config with what a registry file says of its packages: stems: {package: stem}, libraries: [package, ...], transports: [module, ...] and layers: {package: {path prefix: [forbidden import prefix, ...]}}."""
    x = read_yaml(path)
    listed = lambda v: [v] if isinstance(v, str) else list(v or [])
    layers = {p: [(prefix, listed(banned)) for prefix, banned in (own or {}).items()] for p, own in (x.get("layers") or {}).items()}
    more = {k: tuple(listed(x[k])) for k in ("libraries", "transports") if x.get(k)}
    return replace(config, stems={**config.stems, **(x.get("stems") or {})}, layers={**config.layers, **layers}, **more)


def named(args: list[str], cwd: str) -> dict[str, tuple[str, bool]]:
    """Packages given as NAME=PATH, paths relative to cwd."""
    out = {}
    for a in args:
        k, sep, v = a.partition("=")
        if not sep:
            raise ValueError(f"not NAME=PATH: {a}")
        out[k.strip()] = (os.path.normpath(os.path.join(cwd, v.strip())), True)
    return out


def workspace_root(start: str) -> str | None:
    """The nearest directory upwards whose pyproject.toml has a workspace table."""
    at = os.path.abspath(start)
    while True:
        try:
            with open(os.path.join(at, "pyproject.toml"), "rb") as f:
                if "workspace" in tomllib.load(f).get("tool", {}).get("uv", {}):
                    return at
        except (OSError, tomllib.TOMLDecodeError, AttributeError):
            pass
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def _entries(root: str, excludes: list[str]) -> list[tuple[str, bool, bool]]:
    """Path, whether it is named *.py, and whether it is a directory, of a directory's entries by name."""
    try:
        found = sorted(os.scandir(root), key=lambda e: e.name)
    except OSError:
        return []
    return [(e.path, os.path.splitext(e.name)[1] == ".py", e.is_dir(follow_symlinks=False)) for e in found if "__pycache__" not in e.path and not any(x in e.path for x in excludes)]


def walk(root: str, recursive: bool = True, excludes: list[str] = ()) -> Iterator[str]:
    """Paths named *.py, each directory's entries by name; a directory of such a name counts as an unreadable file."""
    for path, python, deep in _entries(root, excludes):
        if python:
            yield path
        if recursive and deep:
            yield from walk(path, True, excludes)


class _Part(InputPartition):
    """Files to read, as names of a directory, and directories to walk, of package and root."""

    def __init__(self, files: list[tuple[str, str, str, str]], trees: list[tuple[str, str, str]]) -> None:
        super().__init__(0)
        self.files, self.trees = files, trees


def _batches(found: list[tuple[str, str, str, str]], batch: int) -> Iterator[list[tuple[str, str, str, str]]]:
    """Package, root, directory and its names, joined by NUL, in lots of batch names at most."""
    lot, n = [], 0
    for package, root, at, joined in found:
        names = joined.split("\0")
        i = 0
        while i < len(names):
            some = names[i : i + batch - n]
            lot.append((package, root, at, "\0".join(some)))
            i, n = i + len(some), n + len(some)
            if n == batch:
                yield lot
                lot, n = [], 0
    if lot:
        yield lot


class _Reader(DataSourceReader):
    def __init__(self, packages: list[tuple[str, str, bool]], excludes: list[str], batch: int, parts: int | None = None) -> None:
        self.packages, self.excludes, self.batch, self.most = packages, excludes, batch, parts or PARTS

    def partitions(self) -> list[InputPartition]:
        """The driver lists the upper directories, until there are SPREAD of them or DEPTH levels; tasks walk those below."""
        files, n, level = [], 0, [(p, root, root, deep) for p, root, deep in self.packages]
        for _ in range(DEPTH):
            if not level or len(level) >= SPREAD or n >= LISTED:
                break
            below = []
            for p, root, at, deep in level:
                if n >= LISTED and deep:  # the rest of this level is left to tasks
                    below.append((p, root, at, deep))
                    continue
                names, prefix = [], at if at.endswith("/") else f"{at}/"
                for path, python, is_dir in _entries(at, self.excludes):
                    if python:
                        names.append(path[len(prefix) :])
                    if deep and is_dir:
                        below.append((p, root, path, True))
                if names:
                    files.append((p, root, prefix, "\0".join(names)))
                    n += len(names)
            level = below
        # a directory that wasn't listed: its own files and all below
        trees = [(p, root, at) for p, root, at, deep in level if deep]
        for p, root, at, deep in level:
            if not deep:
                prefix = at if at.endswith("/") else f"{at}/"
                if names := [f[len(prefix) :] for f in walk(at, False, self.excludes)]:
                    files.append((p, root, prefix, "\0".join(names)))
                    n += len(names)
        batch = max(self.batch, min(MOST, -(-n // self.most)))
        some = -(-len(trees) // self.most) or 1
        parts = [_Part(x, []) for x in _batches(files, batch)] + [_Part([], trees[i : i + some]) for i in range(0, len(trees), some)]
        return parts or [_Part([], [])]

    def read(self, part: _Part) -> Iterator[tuple[str, str, str, str]]:
        found = ((p, root, f) for p, root, at in part.trees for f in walk(at, True, self.excludes))
        listed = ((p, root, at + name) for p, root, at, joined in part.files for name in joined.split("\0"))
        for package, root, path in itertools.chain(listed, found):
            try:
                with open(path, encoding="utf-8", newline="") as f:
                    text = f.read()
            except (OSError, UnicodeDecodeError):
                text = ""  # it still counts as a file
            yield package, root, path, text


class PySource(DataSource):
    """format("pysource"); options: packages, a line for each: name, root and 1 or 0 for recursive, tab-separated; excludes, a line each; batch, files in a partition, if there are fewer than parts partitions."""

    @classmethod
    def name(cls) -> str:
        return "pysource"

    def schema(self) -> str:
        return SOURCE

    def reader(self, schema) -> DataSourceReader:
        packages = [x.split("\t") for x in self.options["packages"].split("\n") if x]
        return _Reader([(n, r, d == "1") for n, r, d in packages], [x for x in self.options.get("excludes", "").split("\n") if x], int(self.options.get("batch", 64)), int(self.options.get("parts", PARTS)))


def read_packages(spark: SparkSession, registry: dict[str, tuple[str, bool]], excludes: list[str] = (), batch: int = 64) -> DataFrame:
    """package, root, path, source of every Python file of the packages."""
    spark.dataSource.register(PySource)
    lines = "\n".join(f"{n}\t{r}\t{int(d)}" for n, (r, d) in registry.items())
    return spark.read.format("pysource").option("packages", lines).option("excludes", "\n".join(excludes)).option("batch", batch).option("parts", 4 * spark.sparkContext.defaultParallelism).load()
