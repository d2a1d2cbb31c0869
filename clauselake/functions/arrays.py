"""Helpers for per-document array work.

Per-document operators (sentences, sections, rankings) keep a document's
pieces in an array column and use built-in higher-order functions: the work
stays inside the task that read the document, so no shuffle is needed.
A document is bounded by the admission limit (10 MB).

``with_arrays`` adds computed columns behind a Generate node.  Without it,
Catalyst's CollapseProject may inline an expensive array expression into a
lambda that references it, which re-evaluates it for every element.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_built: dict = {}


def by_name(build, *names: str) -> Column:
    """``build(F.col(name), ...)``, put together once for each application.  Large
    expression trees take longer to build than a small batch to run.  They hold
    plain column names only, which each query resolves against its own rows."""
    context = SparkContext._active_spark_context
    key = (context.applicationId if context else None, build, names)
    if key[0] is None:
        return build(*map(F.col, names))
    if key not in _built:
        _built[key] = build(*map(F.col, names))
    return _built[key]


def with_arrays(df: DataFrame, **exprs: Column) -> DataFrame:
    """``df`` plus the given columns, each evaluated exactly once per row."""
    packed = F.inline(F.array(F.struct(*[e.alias(k) for k, e in exprs.items()])))
    keep = [c for c in df.columns if c not in exprs]
    return df.select(*keep, packed)


def empty_array(element_type: str) -> Column:
    return F.expr(f"CAST(array() AS array<{element_type}>)")


def indices(arr: Column) -> Column:
    """0-based positions of ``arr`` (empty for an empty array)."""
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(
        F.expr("CAST(array() AS array<int>)"))


def let_(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a
    one-element ``transform``).  Higher-order functions and generators get
    no common-subexpression elimination, so repeated references to one
    expression would otherwise be evaluated each time."""
    return F.get(F.transform(F.array(value), body), 0)
