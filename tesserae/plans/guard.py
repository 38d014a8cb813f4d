"""Guarded read-only SQL over named tables.

A statement is parsed by Spark itself; the unresolved plan is walked and must consist of query
operators over the allowed single-part names, with functions from the allow-list. Runs happen in a
session of their own, with file access through SQL off, under a job group that a timer cancels.
"""

from __future__ import annotations

import re
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans.dialect import UnsafeSQLError, rewrite

DEFAULT_LIMIT, MOST_ROWS = 200, 1000
# Plan nodes a read-only query is made of.
NODES = frozenset(
    "Project Aggregate Filter Sort GlobalLimit LocalLimit Limit Offset Join Union Intersect Except Distinct SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedWith CTERelationDef CTERelationRef WithCTE WithWindowDefinition Window "
    "UnresolvedRelation UnresolvedInlineTable OneRowRelation Generate LateralJoin UnresolvedHaving LocalRelation "
    "UnresolvedCTERelationRef UnresolvedOrdinal Pivot Unpivot UnresolvedPivot UnresolvedUnpivot Expand Tail View "
    "UnionLoop UnionLoopRef UnresolvedSubqueryAlias Sample".split()
)
FUNCTIONS = frozenset(
    "abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_size asin "
    "atan avg bool_and bool_or bround cardinality ceil ceiling char_length coalesce collect_list collect_set concat "
    "concat_ws contains corr cos count count_if countif cume_dist current_date current_timestamp date date_add date_diff "
    "date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank element_at endswith "
    "every exp explode extract first first_value floor format_number greatest grouping grouping_id hour if ifnull ilike "
    "initcap instr isnan isnotnull isnull kurtosis lag last last_day last_value lead least left length like listagg ln log "
    "log10 log2 lower lpad ltrim make_date map max max_by md5 mean median min min_by minute mod mode month months_between "
    "named_struct nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx percentile_cont "
    "percentile_disc position posexplode pow power quarter rank regexp_count regexp_extract regexp_like regexp_replace "
    "regr_slope repeat replace reverse right round row_number rpad rtrim second sequence sha2 sign sin size skewness "
    "slice some sort_array split split_part sqrt startswith stddev stddev_pop stddev_samp string_agg struct substr "
    "substring sum tan timestampdiff to_char to_date to_number to_timestamp translate trim trunc try_cast try_divide "
    "try_element_at try_sum unnest upper var_pop var_samp variance week weekday weekofyear when year strftime and or not "
    "between in case cast exists aggregate array_append array_compact array_except array_intersect array_max array_min "
    "array_position array_prepend array_remove array_repeat array_sort array_union arrays_overlap arrays_zip ascii base64 btrim "
    "cbrt char chr crc32 degrees factorial filter flatten forall from_json get get_json_object hash hex inline json_array_length "
    "json_object_keys levenshtein log1p map map_concat map_contains_key map_entries map_filter map_from_arrays map_from_entries "
    "map_keys map_values overlay pi radians reduce regexp_extract_all regr_intercept regr_r2 rint sha signum soundex "
    "space str_to_map substring_index to_json transform transform_keys transform_values try_add try_multiply try_subtract "
    "try_to_date try_to_number try_to_timestamp typeof unhex xxhash64 zip_with".split()
)


class QueryTimeout(TimeoutError):
    """The query ran longer than its sandbox allows."""


def extract_sql(reply: str) -> str:
    """The statement in a model's reply: a fenced block, or the text from SELECT or WITH on."""
    fenced = re.search(r"```(?:sql)?\s*\n(.*?)```", reply, re.S | re.I)
    text = fenced[1] if fenced else reply
    begun = re.search(r"\b(select|with)\b.*", text, re.S | re.I)
    if not begun:
        raise UnsafeSQLError("no query in the reply")
    return begun[0].strip().rstrip(";").strip()


def _items(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _walk(plan, names: set[str], allowed: set[str], columns: set[str]) -> None:
    kind = plan.getClass().getSimpleName()
    if kind not in NODES:
        raise UnsafeSQLError(f"{kind} is not allowed")
    if kind == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            own = names | {str(pair._1()).lower()}
            _walk(pair._2(), own if plan.allowRecursion() else names, allowed, columns)
            names = own
    if kind == "UnresolvedRelation":
        parts = list(_items(plan.multipartIdentifier()))
        if len(parts) != 1 or parts[0].lower() not in allowed | names:
            raise UnsafeSQLError(f"table {'.'.join(parts)} is not allowed")
    for expression in _items(plan.expressions()):
        _expression(expression, names, allowed, columns)
    for child in _items(plan.children()):
        _walk(child, names, allowed, columns)


def _expression(e, names: set[str], allowed: set[str], columns: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name = ".".join(_items(e.nameParts())).lower()
        if name not in FUNCTIONS:
            raise UnsafeSQLError(f"function {name} is not allowed")
    if kind == "UnresolvedAttribute":
        columns.add(list(_items(e.nameParts()))[-1])
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _walk(e.plan(), names, allowed, columns)
    if kind == "InSubquery":
        _expression(e.query(), names, allowed, columns)
    for child in _items(e.children()):
        _expression(child, names, allowed, columns)


def _guarded_session(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def _parsed(sql: str, session: SparkSession):
    """The unresolved plan, parsed under the session's own settings."""
    sessions = session._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(session._jsparkSession)
    try:
        return session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as problem:
        raise UnsafeSQLError(str(problem).splitlines()[0]) from None
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()


def _checked(sql: str, allowed: set[str], session: SparkSession) -> tuple[str, set[str]]:
    sql = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)^(select|with|\()", sql):
        raise UnsafeSQLError("not a query")
    sql = rewrite(sql)
    columns: set[str] = set()
    _walk(_parsed(sql, session), set(), {a.lower() for a in allowed}, columns)
    return sql, columns


def validate_sql(sql: str, allowed: set[str], spark: SparkSession) -> str:
    """The statement with a LIMIT of 200, or its own up to 1000; raises UnsafeSQLError."""
    sql, _ = _checked(sql, allowed, _guarded_session(spark))
    own = re.search(r"(?i)\blimit\s+(\d+)\s*(offset\s+\d+\s*)?$", sql)
    if not own:
        return f"{sql} LIMIT {DEFAULT_LIMIT}"
    if int(own[1]) > MOST_ROWS:
        return sql[: own.start(1)] + str(MOST_ROWS) + sql[own.end(1) :]
    return sql


def referenced_columns(sql: str, allowed: set[str], spark: SparkSession) -> set[str]:
    return _checked(sql, allowed, _guarded_session(spark))[1]


@dataclass
class Sandbox:
    """Tables under bare names in a session of their own; queries are validated and timed."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    timeout_s: float = 30.0

    def __enter__(self) -> Sandbox:
        self.session = _guarded_session(self.spark)
        of_rows = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
        for name, df in self.tables.items():
            plan = df._jdf.queryExecution().analyzed()  # the same plan, bound to the sandbox's own session
            of_rows(self.session._jsparkSession, plan).createOrReplaceTempView(name)
        return self

    def __exit__(self, *_) -> None:
        for name in self.tables:
            self.session.catalog.dropTempView(name)

    def frame(self, sql: str) -> DataFrame:
        """The validated query as a plan, not run."""
        return self.session.sql(validate_sql(sql, set(self.tables), self.spark))

    def run(self, sql: str) -> list[dict]:
        """At most 1000 rows; raises QueryTimeout after ``timeout_s`` seconds."""
        df, context = self.frame(sql), self.spark.sparkContext
        group, out = f"sandbox-{id(self)}-{threading.get_ident()}", {}

        def work() -> None:
            context.setJobGroup(group, "guarded query", True)
            try:
                out["rows"] = [r.asDict() for r in df.collect()]
            except Exception as problem:
                out["error"] = problem

        from pyspark import InheritableThread

        thread = InheritableThread(target=work)
        thread.start()
        thread.join(self.timeout_s)
        if thread.is_alive():
            context.cancelJobGroup(group)
            thread.join(10)
            raise QueryTimeout(f"query took more than {self.timeout_s} s")
        if "error" in out:
            raise out["error"]
        return out["rows"]

    def text_columns(self, table: str) -> list[str]:
        return [n for n, t in self.tables[table].dtypes if t == "string"]

    def distinct_values(self, table: str, column: str, limit: int = 20) -> list[str]:
        rows = self.tables[table].select(f"`{column}`").distinct().orderBy(f"`{column}`").limit(limit)
        return [r[0] for r in rows.collect()]
