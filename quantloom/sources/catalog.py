"""What lies in a folder: data sets by their names, runs by their time, and registries of rules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

# Tokens of schemas in the names of data folders.
SCHEMAS = {"statistics": "statistics", "definition": "definition", "tbbo": "quotes", "mbp-1": "quotes", "mbo": "orders", "ohlcv-1m": "bars", "trades": "trades"}


def names(spark: SparkSession, folder: str) -> list[tuple[str, bool, int]]:
    """(name, folder?, time of change in ms) of what a folder of any file system holds; nothing if it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return sorted((f.getPath().getName(), f.isDirectory(), f.getModificationTime()) for f in files.listStatus(path))


def schema_of(name: str) -> str | None:
    """The layout that a folder's or file's name tells by a token between its separators; the longest token holds."""
    tokens = re.split(r"[._ ]+", name.lower())
    hits = [t for t in SCHEMAS if t in tokens]
    return SCHEMAS[max(hits, key=len)] if hits else None


def version_of(name: str) -> int:
    """The version number (v1, v3) in a name, 1 if there is none."""
    m = re.search(r"(?:^|[._ -])v(\d+)(?=$|[._ -])", name.lower())
    return int(m.group(1)) if m else 1


def siblings(spark: SparkSession, folder: str, schema: str) -> dict[int, list[str]]:
    """Paths of the data sets of one layout beside each other, by version."""
    out: dict[int, list[str]] = {}
    for name, _, _ in names(spark, folder):
        if not name.startswith((".", "_")) and schema_of(name) == schema:
            out.setdefault(version_of(name), []).append(f"{folder}/{name}")
    return out


def catalogued(spark: SparkSession, roots: list[str]) -> dict[str, str]:
    """label -> path of the data sets of several roots; a label of more than one root bears its root's name."""
    found: dict[str, list[tuple[str, str]]] = {}
    for root in roots:
        for name, _, _ in names(spark, root):
            if not name.startswith((".", "_")):
                found.setdefault(name, []).append((root, f"{root}/{name}"))
    out = {}
    for name, places in found.items():
        for root, path in places:
            out[name if len(places) == 1 else f"{name} ({root.rstrip('/').rsplit('/', 1)[-1]})"] = path
    return out


def free_path(spark: SparkSession, path: str) -> str:
    """path, or with the first of the suffixes _2, _3, ... that nothing bears yet."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    taken = {n for n, _, _ in names(spark, folder)}
    n = 1
    while (name if n == 1 else f"{name}_{n}") in taken:
        n += 1
    return path if n == 1 else f"{folder}/{name}_{n}"


def newest_first(spark: SparkSession, folder: str) -> list[str]:
    """Names of the runs in a folder, the last changed first."""
    return [n for n, is_dir, _ in sorted(names(spark, folder), key=lambda x: (-x[2], x[0])) if is_dir and not n.startswith((".", "_"))]


class Registry:
    """Rules by name with their parameters: what a sweep, a sizer or a detector may be called with.

    A rule is a callable with a dictionary of default parameters, each a bool,
    int, float or str, and for some the values allowed.
    """

    def __init__(self) -> None:
        self.rules: dict[str, tuple[Callable, dict, dict]] = {}

    def add(self, name: str, run: Callable, params: dict, options: dict | None = None) -> None:
        if not callable(run):
            raise TypeError(f"{name} cannot be called")
        for k, v in params.items():
            if type(v) not in (bool, int, float, str):
                raise TypeError(f"parameter {k} of {name} is no bool, int, float or str")
        for k, allowed in (options or {}).items():
            if k not in params or params[k] not in allowed:
                raise ValueError(f"option {k} of {name} does not allow its default")
        if name in self.rules:
            raise ValueError(f"{name} is taken")
        self.rules[name] = run, dict(params), dict(options or {})

    def call(self, name: str, *args, **given):
        """Runs a rule; an unknown parameter, one of another type, or a value that is not allowed is an error."""
        run, params, options = self.rules[name]
        for k, v in given.items():
            if k not in params:
                raise KeyError(f"{name} has no parameter {k}")
            kind = type(params[k])
            if not (type(v) is kind or (kind is float and type(v) is int)):
                raise TypeError(f"parameter {k} of {name} is a {kind.__name__}")
            if k in options and v not in options[k]:
                raise ValueError(f"parameter {k} of {name} may be {options[k]}")
        return run(*args, **(params | given))
