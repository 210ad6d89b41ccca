"""SQL over the published tables: registration, checked execution, export."""

from __future__ import annotations

import json
import logging
import os
import re
import threading
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.storage import materialize, shuffles_freed
from tidewatch.sources.tables import (
    SPARK_ERRORS,
    made_from,
    modified,
    outdated,
    publish_csv,
    read_table,
    table_error,
)

log = logging.getLogger(__name__)

# Table names users write in their SQL, with folders below the root.
DEFAULT_TABLES = {
    "rpt_users": "report_users",
    "txn_flg": "transactions_flagged",
    "highmls": "report_high_score_users",
    "maindb": "labeled",
}
ALIASES = {"total_flagged_tx": "txn_flg", "transactions": "maindb"}
REPORT_TABLES = ("rpt_users", "txn_flg", "highmls")
TABLES_ENV = "TIDEWATCH_TABLES"
_PLAN = "org.apache.spark.sql.catalyst.plans.QueryPlan"


@dataclass(frozen=True)
class Result:
    success: bool
    data: DataFrame | None = None
    rows: int | None = None
    error: str | None = None


def clean_sql(text: str) -> str:
    """SQL without code fences and comment lines; a leading WITH is kept."""
    body = re.sub(r"```(sql)?", "", text, flags=re.IGNORECASE)
    lines = [line.strip() for line in body.splitlines()]
    body = " ".join(line for line in lines if line and not line.startswith("--"))
    start = re.search(r"\b(WITH|SELECT)\b", body, flags=re.IGNORECASE)
    return body[start.start() :].strip() if start else body.strip()


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Lower-case names of the tables in a query, common table expressions left out.

    Spark parses the text; nothing is looked up or run.  A name that an inner query defines
    by WITH is not a table inside that query and is one elsewhere.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except SPARK_ERRORS:
        return set()
    found: set[str] = set()
    waiting = [(plan, frozenset())]

    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    while waiting:
        node, defined = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = items(node.multipartIdentifier())
            if len(parts) > 1 or parts[0].lower() not in defined:
                found.add(parts[-1].lower())
            continue
        if kind == "UnresolvedWith":
            for named in items(node.cteRelations()):
                waiting.append((named._2(), defined))
                defined = defined | {named._1().lower()}
        if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            waiting.append((node.plan(), defined))
        waiting.extend((child, defined) for child in items(node.children()))
        if is_instance_of(spark.sparkContext._gateway, node, _PLAN):
            waiting.extend((e, defined) for e in items(node.expressions()))
    return found


def split_export(text: str) -> tuple[str, bool]:
    """SQL and whether it ends in the export mark ``[e]``."""
    body = re.sub(r"^\s*\[query\]", "", text, flags=re.IGNORECASE)
    sql = re.sub(r"\[e\]\s*$", "", body, flags=re.IGNORECASE)
    return sql.strip(), sql != body


def show(result: DataFrame, rows: int, preview: int = 50) -> str:
    """A single value as ``name: value``, anything else as a text table of its first rows."""
    head = result.limit(preview).collect()
    names = result.columns
    if rows == 1 and len(names) == 1:
        value = head[0][0]
        return f"{names[0]}: {value:,}" if isinstance(value, (int, float)) else f"{names[0]}: {value}"
    cells = [names] + [["" if v is None else str(v) for v in row] for row in head]
    widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
    lines = ["  ".join(v.rjust(w) for v, w in zip(r, widths)) for r in cells]
    return f"{rows} rows\n" + "\n".join(lines)


def _store(data: DataFrame) -> DataFrame:
    """The rows as a stored table, whatever the names and types of the columns."""
    plain = data.toDF(*[f"c{i}" for i in range(len(data.columns))])
    empty = {n: F.col(n).cast("string") for n, kind in plain.dtypes if kind == "void"}
    return materialize(plain.withColumns(empty), "query-result").toDF(*data.columns)


class Catalog:
    """Named tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, str] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        if tables is None and os.environ.get(TABLES_ENV):
            try:
                tables = json.loads(os.environ[TABLES_ENV])
            except ValueError:
                log.warning("%s is not valid JSON", TABLES_ENV)
        self.paths: dict[str, str] = {}
        self.registered: set[str] = set()
        self.tables = {n: self._resolve(p) for n, p in (tables or DEFAULT_TABLES).items()}
        for name, path in self.tables.items():
            outcome = self.register_safe(name, path)
            if not outcome.success:
                log.warning("table %s is not registered: %s", name, outcome.error)

    def _resolve(self, path: str) -> str:
        absolute = path.startswith("/") or "://" in path
        return path if absolute else f"{self.root}/{path}"

    def register(self, name: str, path: str, overwrite: bool = False) -> None:
        """Register one table as a view; a registered name is kept unless ``overwrite``."""
        if name in self.registered and not overwrite:
            return
        path = self._resolve(path)
        self.paths[name] = path
        error = table_error(self.spark, path)
        if error:
            raise ValueError(error)
        table = read_table(self.spark, path)
        for view in (name, *(a for a, target in ALIASES.items() if target == name)):
            table.createOrReplaceTempView(view)
        self.registered.add(name)

    def register_safe(self, name: str, path: str, overwrite: bool = False) -> Result:
        try:
            self.register(name, path, overwrite)
        except (ValueError, *SPARK_ERRORS) as e:
            return Result(False, error=f"{type(e).__name__}: {e}")
        return Result(True)

    def register_all(self, tables: Mapping[str, str], overwrite: bool = False) -> None:
        for name, path in tables.items():
            self.register(name, path, overwrite)

    def register_all_safe(
        self, tables: Mapping[str, str], overwrite: bool = False
    ) -> dict[str, Result]:
        return {name: self.register_safe(name, path, overwrite) for name, path in tables.items()}

    def referenced(self, sql: str) -> list[str]:
        """Known tables that the query reads, by its parsed plan; a text that is no query names none."""
        known = {**self.tables, **self.paths}
        targets = {name.lower(): name for name in known}
        targets.update({a: t for a, t in ALIASES.items() if t in known})
        return sorted({targets[n] for n in relations(self.spark, sql) if n in targets})

    def stale(self, name: str) -> str | None:
        """Why a table is older than what it was made from, or None.

        By the recorded runs; by file times for a table without a record.
        """
        path = self.paths.get(name) or self.tables.get(name, "")
        if path.startswith(f"{self.root}/") and made_from(self.spark, path) is not None:
            source = outdated(self.spark, self.root, path[len(self.root) + 1 :])
            step = "features, then reports" if name in REPORT_TABLES else "features"
            return source and f"{name} is older than its data: {source} has a newer run; run {step} again"
        etl = modified(self.spark, f"{self.root}/etl")
        labeled = modified(self.spark, self.paths.get("maindb") or self.tables.get("maindb", ""))
        if name == "maindb":
            if labeled and etl and labeled < etl:
                return "maindb is older than the cleaned transfers; run features again"
        elif name in REPORT_TABLES:
            sources = [t for t in (etl, labeled) if t]
            mine = modified(self.spark, self.paths.get(name) or self.tables[name])
            if mine and sources and mine < max(sources):
                return f"{name} is older than its data; run features, then reports"
        return None

    def preflight(self, sql: str) -> str | None:
        """First problem among the tables of a query, or None."""
        for name in self.referenced(sql):
            error = table_error(self.spark, self.paths.get(name) or self.tables[name])
            if error:
                step = "reports" if name in REPORT_TABLES else "features"
                return f"table {name} is not ready: {error}; run {step} again"
            if stale := self.stale(name):
                return stale
        return None

    def sql(self, query: str) -> DataFrame:
        """Any Spark SQL, lazily."""
        return self.spark.sql(query)

    def sql_safe(self, query: str, count: bool = True, timeout: float | None = None) -> Result:
        """Checked execution; ``timeout`` cancels it after seconds.

        With ``count`` the query runs here, once: its result is stored, and ``data`` reads the
        stored rows.  Otherwise ``data`` is lazy.
        """

        def run() -> Result:
            data = self.spark.sql(query)
            if not count:
                return Result(True, data)
            stored = _store(data)
            return Result(True, stored, stored.count())

        return self._checked(query, run, timeout)

    def _checked(self, query: str, action: Callable[[], Result], timeout: float | None) -> Result:
        """Run an action on a query after the preflight; errors and time-outs become results."""
        problem = self.preflight(query)
        if problem:
            return Result(False, error=problem)
        try:
            return self._guarded(action, timeout)
        except SPARK_ERRORS as e:
            return Result(False, error=self._explain(query, e))
        except TimeoutError as e:
            return Result(False, error=str(e))

    def _guarded(self, action: Callable[[], Result], timeout: float | None) -> Result:
        """Cancel the jobs of ``action`` once it has run for ``timeout`` seconds."""
        if timeout is None:
            return action()
        tag, finished, expired = f"tidewatch-{uuid.uuid4().hex}", threading.Event(), threading.Event()
        context = self.spark.sparkContext

        def watch() -> None:
            wait = timeout
            # again each second: a job may start just after the first try
            while not finished.wait(wait):
                expired.set()
                context.cancelJobsWithTag(tag)
                wait = 1.0

        context.addJobTag(tag)
        threading.Thread(target=watch, daemon=True).start()
        try:
            return action()
        except SPARK_ERRORS as e:
            if expired.is_set():
                raise TimeoutError(f"query ran longer than {timeout:g} s") from e
            raise
        finally:
            finished.set()
            context.removeJobTag(tag)

    def _explain(self, query: str, error: Exception) -> str:
        text = f"{type(error).__name__}: {error}"
        if re.search(r"not a parquet|footer|corrupt|malformed", text, flags=re.IGNORECASE):
            tables = ", ".join(self.referenced(query)) or "the queried table"
            return f"{tables}: damaged or half-written Parquet; run reports again"
        return text

    def save(self, query: str, path: str) -> None:
        """Result as Parquet; never passes through the driver."""
        with shuffles_freed(self.spark):
            self.spark.sql(query).write.mode("overwrite").parquet(path)

    def save_safe(self, query: str, path: str, timeout: float | None = None) -> Result:
        def run() -> Result:
            self.save(query, path)
            return Result(True)

        return self._checked(query, run, timeout)

    def export_csv(self, query: str, now: datetime, timeout: float | None = None) -> str:
        """Result as CSV below ``query/``, named after the time; a failed check is an error."""
        path = f"{self.root}/query/export_{now:%Y%m%d_%H%M%S}"

        def run() -> Result:
            publish_csv(self.spark.sql(query), path)
            return Result(True)

        done = self._checked(query, run, timeout)
        if not done.success:
            raise ValueError(done.error)
        return path
