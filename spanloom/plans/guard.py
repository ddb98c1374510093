"""Which SQL a workbench runs: queries over its own relations, as the session's parser reads them."""

from __future__ import annotations

from collections.abc import Collection, Iterator

from pyspark.sql import SparkSession

#: Plan nodes that only read what their children give.
READING = frozenset(
    "Aggregate Distinct Except Expand Filter Generate GlobalLimit GroupingAnalytics Having Intersect Join"
    " LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sample Sort SubqueryAlias Tail Union"
    " UnresolvedHaving UnresolvedInlineTable UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases"
    " UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedUnpivot UnresolvedWith Unpivot Window"
    " WithWindowDefinition UnresolvedOrderedAttribute ResolvedInlineTable UnionLoop".split()
)
#: Table functions that make rows from their arguments alone.
TABLE_FUNCTIONS = frozenset(
    "explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer range stack".split()
)
#: Functions that reach outside the query: they call any Java method or tell where files lie.
REFUSED_FUNCTIONS = frozenset(
    "reflect try_reflect java_method input_file_name input_file_block_start input_file_block_length".split()
)


class RefusedQuery(ValueError):
    """The text is not a query over the workbench's relations."""


def _seq(values) -> Iterator:
    for i in range(values.length()):
        yield values.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _name(parts) -> list[str]:
    return [str(p) for p in _seq(parts)]


def checked(spark: SparkSession, sql: str, relations: Collection[str]) -> str:
    """``sql``, if it parses as one query that reads ``relations`` and nothing else.

    The parsed plan is walked with all its subqueries; every node has to be known to only read, so
    commands and writes are refused whatever clause they stand behind.
    """
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise RefusedQuery("there is no query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise RefusedQuery(f"the query does not parse: {str(error).splitlines()[0]}") from None
    _check_plan(plan, frozenset(r.lower() for r in relations))
    return text


def _check_plan(plan, known: frozenset[str]) -> None:
    kind = _kind(plan)
    if kind not in READING:
        raise RefusedQuery(f"only queries are run here, this has a {kind}")
    if kind == "UnresolvedRelation":
        parts = _name(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in known:
            raise RefusedQuery(f"there is no relation {'.'.join(parts)}; relations are {', '.join(sorted(known))}")
    if kind == "UnresolvedTableValuedFunction":
        parts = _name(plan.name())
        if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS:
            raise RefusedQuery(f"the table function {'.'.join(parts)} is not run here")
    if kind == "UnresolvedWith":
        # A name holds for what follows it.
        for pair in _seq(plan.cteRelations()):
            own = frozenset([str(pair._1()).lower()]) if plan.allowRecursion() else frozenset()
            _check_plan(pair._2(), known | own)
            known |= {str(pair._1()).lower()}
    for expression in _seq(plan.expressions()):
        _check_expression(expression, known)
    for child in _seq(plan.children()):
        _check_plan(child, known)


def _check_expression(expression, known: frozenset[str]) -> None:
    kind = _kind(expression)
    if kind == "UnresolvedFunction":
        parts = _name(expression.nameParts())
        if len(parts) != 1 or parts[0].lower() in REFUSED_FUNCTIONS:
            raise RefusedQuery(f"the function {'.'.join(parts)} is not run here")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _check_plan(expression.plan(), known)
    for child in _seq(expression.children()):
        _check_expression(child, known)
    if kind == "InSubquery":
        _check_expression(expression.query(), known)
