"""Projections of nested rows from a specification: prune, rename, cut lists and drop what is empty, at any depth.

A specification is a dict from output names to what they hold: ``ALL`` of the field of that name, ``Path``
or ``First`` for fields elsewhere, ``Most`` for the head of a list, a dict for the parts of a struct or of a list's structs,
or a column.  The row's schema is walked when the plan is built, so the outcome is one column expression, fields that
a document lacks are left out, and only the leaves that are named are read from the files."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from rentgrid.functions import text as T

ALL: Any = "ALL"


@dataclass(frozen=True)
class Path:
    """The field at a dotted path, and what is kept of it: so a field gets another name."""

    path: str
    inner: Any = ALL


@dataclass(frozen=True)
class Most:
    """The first ``n`` entries of a list."""

    n: int
    inner: Any = ALL


@dataclass(frozen=True, init=False)
class First:
    """The first of several paths that holds something (neither null, empty, 0 nor false), else ``default``."""

    paths: tuple[str, ...]
    default: Any = None

    def __init__(self, *paths: str, default: Any = None) -> None:
        object.__setattr__(self, "paths", paths)
        object.__setattr__(self, "default", default)


def at(c: Column | None, kind: S.DataType, path: str) -> tuple[Column, S.DataType] | None:
    """The column and type at a dotted path below a struct (below the row, if ``c`` is None), or None."""
    for name in path.split("."):
        if not isinstance(kind, S.StructType) or name not in kind.fieldNames():
            return None
        c, kind = (F.col(f"`{name}`") if c is None else c.getField(name)), kind[name].dataType
    return (c, kind) if c is not None else None


def truthy(c: Column, kind: S.DataType) -> Column:
    """Null for everything that counts as nothing."""
    if isinstance(kind, S.StringType):
        return F.when(c != "", c)
    if isinstance(kind, (S.ArrayType, S.MapType)):
        return F.when(F.size(c) > 0, c)
    if isinstance(kind, S.BooleanType):
        return F.when(c, c)
    return F.when(c != 0, c) if isinstance(kind, S.NumericType) else c


def _first(c: Column | None, kind: S.DataType, rule: First) -> Column | None:
    found = [truthy(*x) for p in rule.paths if (x := at(c, kind, p))]
    if rule.default is not None:
        found.append(F.lit(rule.default))
    return F.coalesce(*found) if found else None


def _any(c: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | c.getField(n).isNotNull()
    return out


def _struct(c: Column | None, kind: S.StructType, spec: Any) -> dict[str, Column]:
    rules = spec if isinstance(spec, dict) else dict.fromkeys(kind.fieldNames(), ALL)
    out: dict[str, Column] = {}
    for name, rule in rules.items():
        if isinstance(rule, Column):
            made: Column | None = rule
        elif isinstance(rule, First):
            made = _first(c, kind, rule)
        else:
            path, inner = (rule.path, rule.inner) if isinstance(rule, Path) else (name, rule)
            found = at(c, kind, path)
            made = pruned(*found, inner) if found else None
        if made is not None:
            out[name] = made
    return out


def pruned(c: Column, kind: S.DataType, spec: Any = ALL) -> Column | None:
    """What a specification keeps of a column; null for empty texts, lists and structs; None if it names nothing there is."""
    if isinstance(spec, Most):
        if isinstance(kind, S.ArrayType):
            return pruned(F.slice(c, 1, spec.n), kind, spec.inner)
        return pruned(c, kind, spec.inner)
    if isinstance(kind, S.ArrayType):
        inner = kind.elementType
        if isinstance(inner, S.StructType) and isinstance(spec, dict):
            named = {n: r.path if isinstance(r, Path) else n for n, r in spec.items()}
            there = {n: p for n, p in named.items() if "." not in p and p in inner.fieldNames()}
            if not there:
                return None
            # the list's wanted fields as lists, zipped again: so the scan reads no other field
            c = F.arrays_zip(*[c.getField(p).alias(n) for n, p in there.items()])
            inner = S.StructType([S.StructField(n, inner[p].dataType) for n, p in there.items()])
            spec = {n: spec[n].inner if isinstance(spec[n], Path) else spec[n] for n in there}
        if isinstance(inner, (S.StructType, S.ArrayType)):
            made = F.filter(F.transform(c, lambda x: pruned(x, inner, spec)), lambda x: x.isNotNull())  # type: ignore[arg-type, return-value]
        else:
            made = c
        return T.bind(made, lambda x: F.when(F.size(x) > 0, x))
    if isinstance(kind, S.StructType):
        parts = _struct(c, kind, spec)
        if not parts:
            return None
        return T.bind(F.struct(*[p.alias(n) for n, p in parts.items()]), lambda s: F.when(_any(s, list(parts)), s))
    return F.when(c != "", c) if isinstance(kind, S.StringType) else c


def columns(df: DataFrame, spec: dict[str, Any]) -> list[Column]:
    """The columns of a projection; a column given as such or with a fallback keeps its empty values."""
    return [c.alias(n) for n, c in _struct(None, df.schema, spec).items()]


def project(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    return df.select(*columns(df, spec))


def document(df: DataFrame, spec: dict[str, Any]) -> Column:
    """The projection as a JSON document, without what is null."""
    return F.to_json(F.struct(*columns(df, spec)))
