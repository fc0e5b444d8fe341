"""The read-only policy for user SQL.

Spark's own parser and analyser do the reading; this module only looks at the plans they
return. Plan nodes are allowed by name, so that a statement type nobody thought of is
rejected. Functions are allowed by the group that Spark documents them in, but for those of a group
that do not give the same result every time; all others are rejected, functions of the user too. They are checked
twice: by name in the parsed plan, and by expression class in the analysed plan, because a bare
``current_date`` is a column name until it is analysed.
All access to Spark's plan objects is in this file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

MAX_SQL_CHARS = 20_000


class PolicyError(ValueError):
    """The statement is not an allowed read-only query."""


# The plan nodes a SELECT or WITH query may consist of.
ALLOWED_NODES = frozenset(
    {
        "Aggregate", "Distinct", "Except", "Filter", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit",
        "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "ResolvedInlineTable", "Sort",
        "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable",
        "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "WithWindowDefinition",
    }
)

# Functions that run foreign code, or tell about the session or its files.
EXTERNAL_FUNCTIONS = frozenset(
    {
        "current_catalog", "current_database", "current_path", "current_schema", "input_file_block_length",
        "input_file_block_start", "input_file_name", "java_method", "reflect", "spark_partition_id", "try_reflect",
        "version",
    }
)

# The groups of functions that depend on their arguments only, but for the exceptions below.
REPEATABLE_GROUPS = frozenset(
    {
        "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs",
        "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs",
        "predicate_funcs", "st_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs",
    }
)

# Functions of other groups that depend on their arguments only.
REPEATABLE_FUNCTIONS = frozenset(
    {
        "aes_decrypt", "assert_true", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "raise_error",
        "try_aes_decrypt", "typeof",
    }
)

# Aggregates of those groups whose result depends on how rows are dealt and merged, or on chance.
UNSTABLE_AGGREGATES = re.compile(r"approx_percentile|percentile_approx|approx_top_k\w*|histogram_numeric|(hll|kll|theta)_\w+")

# Functions whose result differs between two runs of the same query.
VOLATILE_FUNCTIONS = frozenset(
    {
        "curdate", "current_date", "current_time", "current_timestamp", "current_timezone", "current_user",
        "localtimestamp", "monotonically_increasing_id", "now", "rand", "randn", "random", "randstr", "session_user",
        "shuffle", "uniform", "user", "uuid",
    }
)

# The classes that the functions above become when analysed.
EXTERNAL_EXPRESSIONS = frozenset(
    {
        "CallMethodViaReflection", "CurrentCatalog", "CurrentDatabase", "InputFileBlockLength", "InputFileBlockStart",
        "InputFileName", "SparkPartitionID", "SparkVersion", "TryReflect",
    }
)
VOLATILE_EXPRESSIONS = frozenset(
    {
        "CurDateExpressionBuilder", "CurrentDate", "CurrentTime", "CurrentTimestamp", "CurrentTimeZone", "CurrentUser",
        "LocalTimestamp", "MonotonicallyIncreasingID", "Now", "Rand", "Randn", "RandStr", "Shuffle", "Uniform", "Uuid",
    }
)

# Aggregates that depend on the order of their input rows. They are ordinary
# read-only aggregates; whether a result is ordered is reported separately.
ORDER_DEPENDENT = frozenset({"AnyValue", "CollectList", "CollectSet", "First", "Last", "ListAgg", "MaxBy", "MinBy", "Mode"})

# Leaves of an analysed plan that read no table, and words that stand for the clock.
_FREE_LEAVES = ("CTERelationRef", "LocalRelation", "OneRowRelation", "UnionLoopRef")
_CLOCK_WORDS = re.compile(r"(?i)(?<!\w)(now|today|tomorrow|yesterday)(?!\w)")
_DATETIMES = ("date", "timestamp", "timestamp_ntz")

_SUBQUERIES = frozenset({"Exists", "LateralSubquery", "ListQuery", "ScalarSubquery"})
_LEADING_TRIVIA = re.compile(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*", re.DOTALL)


def _items(sequence: Any) -> Iterator[Any]:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _name(node: Any) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk_expression(expression: Any, common: frozenset[str]) -> Iterator[tuple[str, str, Any, frozenset[str]]]:
    name = _name(expression)
    yield "expression", name, expression, common
    if name in _SUBQUERIES:
        yield from _walk(expression.plan(), common)
    for child in _items(expression.children()):
        yield from _walk_expression(child, common)


def _walk(plan: Any, common: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, Any, frozenset[str]]]:
    """Every plan node and expression, inside subqueries and common table expressions too.

    With each come the names of the common table expressions that can be seen there: those of the
    enclosing WITH clauses, inside a WITH clause only the ones before, and its own if it is recursive.
    """
    name = _name(plan)
    yield "node", name, plan, common
    if name == "View":  # a registered table; what it is made of is not the query's doing
        return
    if name == "UnresolvedWith":
        for relation in _items(plan.cteRelations()):
            own = relation.productElement(0).lower()
            yield from _walk(relation.productElement(1), common | {own} if plan.allowRecursion() else common)
            common = common | {own}
    for expression in _items(plan.expressions()):
        yield from _walk_expression(expression, common)
    for child in _items(plan.children()):
        yield from _walk(child, common)


def _clean(sql: str) -> str:
    text = sql.strip()
    if not text:
        raise PolicyError("there is no SQL text")
    if len(text) > MAX_SQL_CHARS:
        raise PolicyError(f"the SQL text has more than {MAX_SQL_CHARS} characters")
    if "\0" in text:
        raise PolicyError("the SQL text has a zero byte in it")
    if text.endswith(";"):
        text = text[:-1].rstrip()
    first = re.match(r"\w+", text[_LEADING_TRIVIA.match(text).end():])
    if not first or first.group().lower() not in ("select", "with"):
        raise PolicyError("a statement must begin with SELECT or WITH")
    return text


def _group_of(session: SparkSession, name: str) -> str | None:
    """The group of a built-in function in Spark's documentation; none for functions of the user and unknown ones."""
    found = session._jsparkSession.sessionState().functionRegistry().lookupFunction(
        session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    )
    return found.get().getGroup() if found.isDefined() and found.get().getSource() == "built-in" else None


def _check_function(session: SparkSession, name: str) -> None:
    if name in EXTERNAL_FUNCTIONS:
        raise PolicyError(f"Function {name} reaches outside the query")
    if name in VOLATILE_FUNCTIONS or UNSTABLE_AGGREGATES.fullmatch(name):
        raise PolicyError(f"Function {name} is volatile or non-reproducible")
    if name not in REPEATABLE_FUNCTIONS and _group_of(session, name) not in REPEATABLE_GROUPS:
        raise PolicyError(f"Function {name} is not known to give the same result every time, so it may be volatile or non-reproducible")


def _parse(session: SparkSession, text: str) -> Any:
    """Parse under the settings of the given session, which the parser takes from the active one."""
    sessions = SparkSession._get_j_spark_session_module(session._jvm)
    active = sessions.getActiveSession()
    sessions.setActiveSession(session._jsparkSession)
    try:
        return session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    finally:
        if active.isDefined():
            sessions.setActiveSession(active.get())
        else:
            sessions.clearActiveSession()


def check_parsed(session: SparkSession, sql: str, tables: set[str]) -> tuple[str, bool]:
    """The statement without its trailing semicolon, and whether its outermost rows are ordered.

    ``session`` must be the one that will run the statement: both must read it alike.
    """
    text = _clean(sql)
    try:
        plan = _parse(session, text)
    except ParseException as error:
        raise PolicyError(f"Not a single valid statement: {str(error).strip().splitlines()[0]}") from None
    registered = {table.lower() for table in tables}
    for kind, name, node, common in _walk(plan):
        if kind == "node":
            if name == "UnresolvedTableValuedFunction" or name == "Generate":
                raise PolicyError("a function cannot stand for a table")
            if name == "Sample" or (name == "GlobalLimit" and _samples_rows(node)):
                raise PolicyError("Sampling is volatile or non-reproducible")
            if name not in ALLOWED_NODES:
                raise PolicyError(f"{name} is no part of a read-only query")
            if name == "UnresolvedRelation":
                parts = [str(part) for part in _items(node.multipartIdentifier())]
                if len(parts) != 1 or parts[0].lower() not in registered | common:
                    raise PolicyError(f"{'.'.join(parts)} is not a registered table")
        elif name == "UnresolvedFunction":
            parts = [str(part).lower() for part in _items(node.nameParts())]
            _check_function(session, parts[-1])
            if parts == ["unix_timestamp"] and not node.children().size():
                raise PolicyError("Function unix_timestamp without arguments is volatile or non-reproducible")
        elif name == "Literal" and _names_the_clock(node):
            raise PolicyError("A date literal names the clock, which is volatile or non-reproducible")
        elif name == "FunctionTableSubqueryArgumentExpression":
            raise PolicyError("a function cannot stand for a table")
    return text, _ordered(plan)


def _samples_rows(limit: Any) -> bool:
    """``TABLESAMPLE (n ROWS)`` is a limit right on a relation; a LIMIT clause is on a query."""
    node = limit.child()
    if _name(node) == "LocalLimit":
        node = node.child()
    return _name(node) in ("UnresolvedRelation", "SubqueryAlias")


def _ordered(plan: Any) -> bool:
    name = _name(plan)
    if name in ("UnresolvedWith", "GlobalLimit", "LocalLimit", "Offset"):
        return _ordered(plan.child())
    return name == "Sort" and getattr(plan, "global")()


def _is_volatile_itself(name: str, expression: Any) -> bool:
    """Whether volatility starts at this expression rather than below it."""
    if expression.deterministic() or name in ORDER_DEPENDENT or name in _SUBQUERIES:
        return False
    return all(child.deterministic() for child in _items(expression.children()))


def _names_the_clock(literal: Any) -> bool:
    """Whether a typed literal was written as ``DATE 'today'`` or the like; parsing has replaced the word."""
    if literal.dataType().typeName() not in _DATETIMES:
        return False
    origin = literal.origin()
    if not (origin.sqlText().isDefined() and origin.startIndex().isDefined() and origin.stopIndex().isDefined()):
        return True
    text = origin.sqlText().get()[origin.startIndex().get() : origin.stopIndex().get() + 1]
    return bool(_CLOCK_WORDS.search(text))


def _reads_the_clock(expression: Any) -> bool:
    """Whether a constant text such as ``'now'`` becomes a date or time."""
    if expression.dataType().typeName() not in _DATETIMES:
        return False
    for child in _items(expression.children()):
        if child.dataType().typeName().startswith("string") and child.foldable():
            value = child.eval(None)
            if value is not None and _CLOCK_WORDS.search(str(value)):
                return True
    return False


def check_analyzed(df: DataFrame, tables: set[str]) -> None:
    """Look at what names turned out to be: the second half of the function and table rules."""
    registered = {table.lower() for table in tables}
    plan = df._jdf.queryExecution().analyzed()
    for kind, name, node, _ in _walk(plan):
        if kind == "node":
            if name == "View" and not (node.isTempView() and node.desc().identifier().table().lower() in registered):
                raise PolicyError(f"{node.desc().identifier().table()} is not a registered table")
            if name not in ("View", *_FREE_LEAVES) and not node.children().size():
                raise PolicyError(f"{name} reads from outside the registered tables")
            continue
        if name.startswith(("Cast", "ParseTo", "GetTimestamp")) and _reads_the_clock(node):
            raise PolicyError("A date text names the clock, which is volatile or non-reproducible")
        if "UDF" in name or name in ("UserDefinedGenerator", "ScalaAggregator"):
            raise PolicyError(f"Expression {name} is not built in, so it may be volatile or non-reproducible")
        if name in EXTERNAL_EXPRESSIONS:
            raise PolicyError(f"Expression {name} reaches outside the query")
        if name in VOLATILE_EXPRESSIONS or _is_volatile_itself(name, node):
            raise PolicyError(f"Expression {name} is volatile or non-reproducible")
