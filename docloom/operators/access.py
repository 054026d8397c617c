"""Row filters by scope and role, and pagination."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_scope(kind: Column, scope: Column, departments: Sequence | None, projects: Sequence | None = ()) -> Column:
    """What an identity sees: global rows, and those of its departments and projects.  None is no limit, an empty list none of them."""
    if departments is None:
        return F.lit(True)
    seen = kind == "global"
    if departments:
        seen = seen | ((kind == "department") & scope.isin(*departments))
    if projects:
        seen = seen | ((kind == "project") & scope.isin(*projects))
    return seen


def out_of_scope(kind: Column, scope: Column, departments: Sequence | None, projects: Sequence | None = ()) -> Column:
    """Department and project rows that it does not see."""
    return F.lit(False) if departments is None else ~F.coalesce(in_scope(kind, scope, departments, projects), F.lit(False))


def exact_scope(kind: Column, scope: Column, want_kind: str, want: object | None) -> Column:
    return (kind == want_kind) & scope.eqNullSafe(F.lit(want))


def readable(rows: DataFrame, members: DataFrame, key: str, departments: DataFrame) -> DataFrame:
    """Rows of no department, or of one in ``departments`` (dept); ``members`` has (key, dept)."""
    free = rows.join(members.select(key), key, "left_anti")
    return free.unionByName(rows.join(members.join(departments, "dept", "left_semi").select(key), key, "left_semi"))


def allowed(ids: Column, types: Column, allowed_ids: Sequence | None, allowed_types: Sequence | None) -> Column:
    """By id or by type; None for both is no limit, empty lists allow nothing."""
    if allowed_ids is None and allowed_types is None:
        return F.lit(True)
    out = F.lit(False)
    if allowed_ids:
        out = out | ids.isin(*allowed_ids)
    if allowed_types:
        out = out | types.isin(*allowed_types)
    return out


def overlaps(types: Column, wanted: Sequence[str] | None) -> Column:
    """Rows of any wanted type, or of no type."""
    return F.lit(True) if wanted is None else F.arrays_overlap(types, F.array(*map(F.lit, wanted)).cast("array<string>")) | (F.size(types) == 0)


def permission_level(granted: Column, resource: str, action: str) -> Column:
    """all, own_dept, own or none: the widest scope of resource:action among granted permissions."""
    has = lambda s: F.array_contains(granted, f"{resource}:{action}:{s}")
    return F.when(has("all") | F.array_contains(granted, "*"), "all").when(has("own_dept"), "own_dept").when(has("own"), "own").otherwise("none")


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def after(rows: DataFrame, at: str, key: str, cursor: tuple | None, size: int) -> DataFrame:
    """Keyset pagination, newest first: what follows (at, key) of the cursor."""
    if cursor:
        rows = rows.where((F.col(at) < F.lit(cursor[0])) | ((F.col(at) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1]))))
    return rows.orderBy(F.desc(at), F.desc(key)).limit(size)


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_any(query: str, *columns: str) -> Column:
    """Any of the columns contains the text, case aside; % and _ in it stand for what they stand for in LIKE."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.ilike(F.col(name), F.lit(f"%{query}%")), F.lit(False))
    return found


def where_given(rows: DataFrame, **given) -> DataFrame:
    """``rows`` by the arguments that are given: None is no condition, a list any of its values (an empty one none of them)."""
    for name, value in given.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.where(F.col(name).isin(*value) if value else F.lit(False))
        elif value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def searchable(chunk_status: Column, status: Column, verbatim: Column) -> Column:
    """Sources whose text can be searched: their chunks are ready, they are ready in whole or part, or they are kept word for word."""
    return F.coalesce(chunk_status == "ready", F.lit(False)) | F.coalesce(status.isin("ready", "partial"), F.lit(False)) | F.coalesce(verbatim, F.lit(False))


def json_value(column: Column, path: str, kind: str = "string") -> Column:
    """What a JSON text has at a path, null where there is nothing or it is of another type."""
    return F.get_json_object(column, path).try_cast(kind)


def page_with_more(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of ``rows`` and has_more, whether another follows; one row more than the page is read to tell."""
    window = W.orderBy(*order)  # over size + 1 rows at most
    cut = rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size + 1).withColumn("__n", F.row_number().over(window))
    return cut.withColumn("has_more", F.max("__n").over(W.partitionBy(F.lit(1))) > size).where(F.col("__n") <= size).drop("__n")


#: Fixed value: days that a period of a report may have at most.
PERIOD_DAYS = 366


def in_period(at: Column, start: datetime.date, end: datetime.date) -> Column:
    """From the first day up to, not including, the end; a period must have a day, and no more than a leap year."""
    if not 0 < (end - start).days <= PERIOD_DAYS:
        raise ValueError(f"a period has 1 to {PERIOD_DAYS} days")
    return (at >= F.to_timestamp_ntz(F.lit(f"{start} 00:00:00"))) & (at < F.to_timestamp_ntz(F.lit(f"{end} 00:00:00")))


def resolve_scopes(sources: DataFrame, departments: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, kind, scope) where pages of a source go: its project, else each of its departments, else its own scope, else all.

    ``sources`` has (key, kind, scope), ``departments`` (key, dept).
    """
    given = departments.select(key, "dept").distinct()
    met = sources.join(given, key, "left")
    own = F.when(F.col("kind") == "project", F.struct(F.lit("project").alias("kind"), F.col("scope").alias("scope"))).when(
        F.col("dept").isNotNull(), F.struct(F.lit("department").alias("kind"), F.col("dept").alias("scope"))
    ).when((F.col("kind") == "department") & F.col("scope").isNotNull(), F.struct(F.col("kind"), F.col("scope"))).otherwise(
        F.struct(F.lit("global").alias("kind"), F.lit(None).cast(sources.schema["scope"].dataType).alias("scope"))
    )
    return met.select(key, own.alias("s")).distinct().select(key, "s.kind", "s.scope")


def settings(*layers: DataFrame) -> DataFrame:
    """(key, value): each key's value from the first layer (key, value) that has one that is not null."""
    tagged = [layer.select("key", "value", F.lit(i).alias("layer")) for i, layer in enumerate(layers)]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)
    return every.groupBy("key").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("layer"))).alias("value"))
