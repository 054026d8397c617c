"""Read-only SQL over given tables.

Spark's own parser reads the statement, so a keyword inside a string is no matter.  What may run is listed, not what may not:
kinds of plan nodes, functions, and relations.  So commands, scripts, files as tables, table functions, hints and functions that
reach outside the data (such as calls of Java methods) are refused, wherever in the statement they stand; the row limit is set on
the result.  The parser is that of a classic session.

The work of a statement is bounded, too.  Each join needs an equality of its two sides or one side of a few rows, as the optimised
plan has them; joins and uses of tables are few, named queries expanded; nothing is recursive.  Functions that make a value of any
length (repeat, sequence, folds, what gathers a group's values or counts its distinct ones in memory) are not listed, pads have
a bound, and those that make a text longer by a factor may do so by a bounded one in all.  Texts of the result are cut.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator

from py4j.java_gateway import is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx

#: Rows by default and at most.
ROWS, MOST = 50, 100
#: Joins, uses of tables, rows of a side that needs no equality, length of a pad, growth of texts, and characters of a returned one.
JOINS, USES, FEW, PAD, GROWTH, CHARACTERS = 6, 16, 100, 1000, 4096, 100_000
NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Union Distinct Except Intersect SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving "
    "WithWindowDefinition UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedSubqueryColumnAliases Pivot Unpivot".split()
)
FUNCTIONS = frozenset(
    """count sum avg mean min max min_by max_by any_value first last stddev stddev_pop stddev_samp variance var_pop var_samp percentile_approx approx_count_distinct
    count_if bool_and bool_or every some any corr skewness kurtosis grouping
    row_number rank dense_rank percent_rank ntile lag lead first_value last_value nth_value cume_dist
    abs ceil ceiling floor round bround sign sqrt cbrt exp ln log log2 log10 power pow mod pmod greatest least sin cos tan pi div negative positive
    coalesce ifnull nvl nvl2 nullif nullifzero zeroifnull if iff isnull isnotnull isnan decode equal_null
    lower lcase upper ucase trim ltrim rtrim btrim length char_length character_length len concat concat_ws substring substr substring_index left right lpad rpad reverse replace
    translate initcap instr locate position startswith endswith contains split split_part like ilike rlike regexp regexp_like regexp_extract regexp_extract_all regexp_replace regexp_count regexp_substr
    levenshtein format_number to_number try_to_number cast try_cast string int bigint double float decimal boolean date timestamp tinyint smallint binary
    current_date current_timestamp now date_add date_sub dateadd datediff date_diff add_months months_between date_trunc trunc date_format to_date to_timestamp try_to_timestamp year
    quarter month day dayofmonth dayofweek dayofyear weekday weekofyear hour minute second last_day next_day make_date extract date_part unix_timestamp from_unixtime
    array map struct named_struct size cardinality element_at try_element_at get array_contains array_distinct array_except array_intersect array_join array_max array_min array_position
    array_sort sort_array array_union arrays_overlap slice flatten transform filter exists forall map_keys map_values get_json_object to_json
    and or not in when between try_add try_subtract try_multiply try_divide md5 sha1 sha2 crc32 hash xxhash64""".split()
)
_views = threading.Lock()
_CATALYST = "org.apache.spark.sql.catalyst."


class Refused(ValueError):
    """The statement may not run."""


def clean_names(df: DataFrame) -> DataFrame:
    """Column names of letters, digits and underscores, each once."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", c).strip()) or "column"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def table_names(name: str) -> list[str]:
    """A table's safe name and its bare lower-case one."""
    safe = re.sub(r"\W+", "_", name).strip("_") or "sheet"
    bare = "".join(dict(zip(*tx.fold_table())).get(ch, ch) for ch in safe).lower()
    return list(dict.fromkeys([safe, bare]))


def register(df: DataFrame, name: str) -> list[str]:
    """Views of a table under its names, for the session; ``query`` makes none that last."""
    names = table_names(name)
    for n in names:
        clean_names(df).createOrReplaceTempView(f"`{n}`")
    return names


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(gateway, root) -> Iterator[tuple[object, str, bool]]:
    """(node, class, whether it is a plan) of every plan and expression under ``root``, those of subqueries and named queries, too."""
    todo = [root]
    while todo:
        node = todo.pop()
        is_plan = is_instance_of(gateway, node, _CATALYST + "plans.logical.LogicalPlan")
        yield node, node.getClass().getSimpleName(), is_plan
        todo += _items(node.children().toList())
        if is_plan:
            todo += _items(node.expressions().toList()) + [x for x in _items(node.innerChildren().toList()) if is_instance_of(gateway, x, _CATALYST + "plans.logical.LogicalPlan")]
        elif is_instance_of(gateway, node, _CATALYST + "expressions.PlanExpression"):
            todo.append(node.plan())


def check(spark: SparkSession, sql: str, tables: list[str]) -> None:
    if not sql or not sql.strip():
        raise Refused("empty statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"not a statement: {str(e)[:300]}") from None
    found = list(_walk(spark.sparkContext._gateway, plan))
    known = {t.lower() for t in tables}
    for node, kind, _ in found:
        if kind == "UnresolvedWith":
            known |= {x._1().lower() for x in _items(node.cteRelations().toList())}
    uses = _uses(plan, found)
    if uses > USES:
        raise Refused(f"tables may be used {USES} times, named queries expanded")
    growth = 1
    for node, kind, is_plan in found:
        if kind == "UnresolvedFunction":
            growth *= _growth(_items(node.nameParts().toList())[-1].lower(), _items(node.children().toList()))
            if growth > GROWTH:
                raise Refused("texts could grow too long")
    for node, kind, is_plan in found:
        if is_plan and kind not in NODES:
            raise Refused(f"only queries over the tables may run: {kind}")
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier().toList())
            if len(parts) != 1 or parts[0].lower() not in known:
                raise Refused(f"no such table: {'.'.join(parts)}")
        elif kind == "UnresolvedFunction":
            parts = _items(node.nameParts().toList())
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise Refused(f"function may not be called: {'.'.join(parts)}")
        elif not is_plan and ("UnresolvedIdentifier" in kind or "Generator" in kind or "Callable" in kind):
            raise Refused(f"may not be called: {kind}")


def _uses(plan, found: list) -> int:
    """How often tables are read, where each use of a named query counts as all that it uses."""
    withs = [node for node, kind, _ in found if kind == "UnresolvedWith"]
    if any(node.allowRecursion() for node in withs):
        raise Refused("nothing may be recursive")
    if len(withs) > 1 or withs and not withs[0].equals(plan):
        raise Refused("named queries may stand at the beginning only")
    known: dict[str, int] = {}

    def count(root) -> int:
        names = [_items(n.multipartIdentifier().toList())[-1].lower() for n, kind, _ in _walk(SparkSession.active().sparkContext._gateway, root) if kind == "UnresolvedRelation"]
        return sum(known.get(n, 1) for n in names)

    for named in _items(withs[0].cteRelations().toList()) if withs else []:
        known[named._1().lower()] = max(1, count(named._2()))
    return count(withs[0].child() if withs else plan)


def _literal(node) -> str | None:
    return node.toString() if node.getClass().getSimpleName() == "Literal" else None


def _growth(name: str, args: list) -> int:
    """By what factor a function can make a text or an array longer than its longest argument."""
    if name in ("lpad", "rpad"):
        size = _literal(args[1]) if len(args) > 1 else None
        if size is None or not size.isdigit() or int(size) > PAD:
            raise Refused(f"{name} takes a constant of {PAD} at most")
    if name in ("concat", "concat_ws", "array", "array_union", "map", "format_string"):
        return max(1, len(args))
    if name in ("replace", "regexp_replace", "overlay") and len(args) > 2:
        by = _literal(args[2])
        if by is None:
            raise Refused(f"{name} takes a constant replacement")
        return max(1, len(by))
    return 1


def check_plan(spark: SparkSession, df: DataFrame) -> None:
    """Refused if the optimised plan of ``df`` has joins that could make all pairs, or too many joins."""
    gateway, joins = spark.sparkContext._gateway, 0
    for node, kind, is_plan in _walk(gateway, df._jdf.queryExecution().optimizedPlan()):
        if not is_plan or kind != "Join":
            continue
        joins += 1
        left, right = node.left(), node.right()
        few = any(side.maxRows().isDefined() and side.maxRows().get() <= FEW for side in (left, right))
        parts = [node.condition().get()] if node.condition().isDefined() else []
        equal = False
        while parts and not equal:
            part = parts.pop()
            name = part.getClass().getSimpleName()
            if name == "And":
                parts += [part.left(), part.right()]
            elif name in ("EqualTo", "EqualNullSafe"):
                a, b = part.left().references(), part.right().references()
                sides = [(a, left, b, right), (b, left, a, right)]
                equal = any(x.nonEmpty() and y.nonEmpty() and x.subsetOf(p.outputSet()) and y.subsetOf(q.outputSet()) for x, p, y, q in sides)
        if not (few or equal):
            raise Refused("a join needs an equality of columns of its two sides")
    if joins > JOINS:
        raise Refused(f"{JOINS} joins at most")


def _cut(df: DataFrame) -> DataFrame:
    """Texts of at most CHARACTERS; names may repeat."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.select(*(F.substring(f"c{k}", 1, CHARACTERS).alias(f"c{k}") if f.dataType.typeName() == "string" else F.col(f"c{k}") for k, f in enumerate(df.schema))).toDF(*df.columns)


def run(spark: SparkSession, sql: str, tables: list[str], rows: int = ROWS) -> DataFrame:
    """The statement's result over registered tables, of at most ``rows`` rows; Refused if it may not run."""
    check(spark, sql, tables)
    try:
        found = spark.sql(sql)
        check_plan(spark, found)
        return _cut(found.limit(min(MOST, max(1, rows))))
    except PySparkException as e:
        raise Refused(str(e)[:500]) from None


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], rows: int = ROWS) -> DataFrame:
    """Like ``run`` over tables that no other statement sees: their views last for its analysis only, and hide none for longer."""
    with _views:
        hidden = {n: spark.table(f"`{n}`") for name in tables for n in table_names(name) if any(t.isTemporary and t.name.lower() == n.lower() for t in spark.catalog.listTables(pattern=n))}
        names: list[str] = []
        try:
            for name, df in tables.items():
                names += register(df, name)
            return run(spark, sql, names, rows)
        finally:
            for n in names:
                spark.catalog.dropTempView(n)
            for n, df in hidden.items():
                df.createOrReplaceTempView(f"`{n}`")
