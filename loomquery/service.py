"""Questions and plans to answers: route, select, plan, validate, compile, run, keep."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from loomquery.config import Config
from loomquery.errors import ExecutionError, PlanError, QueryTimeout, masked
from loomquery.operators.compile import compile_plan
from loomquery.operators.followup import details, eligible, follow_up
from loomquery.operators.relations import Edge, Graph, discover
from loomquery.plans import planner, router, select
from loomquery.plans.cache import JsonCache, PlanCache
from loomquery.plans.ir import Plan
from loomquery.plans.validate import to_contract, validate
from loomquery.sources.catalog import Catalog
from loomquery.sources.session import Sessions


@dataclass
class Answer:
    data: Any
    plan: Plan | None = None
    reference: str | None = None
    warnings: list[str] = field(default_factory=list)


@dataclass
class Engine:
    catalog: Catalog
    client: planner.Client | None = None
    cache: PlanCache | None = None
    sessions: Sessions = field(default_factory=Sessions)
    timeout_s: float = 30.0
    strict: bool = False
    verified: set[str] = field(default_factory=set)  # fingerprints whose declared keys have been counted

    @classmethod
    def of(cls, spark: SparkSession, config: Config, tables: list[str], client: planner.Client | None = None, **keys) -> Engine:
        """An engine by its settings; keys: what Catalog.of takes."""
        if config.jdbc_url:
            catalog = Catalog.jdbc(spark, config.jdbc_url, tables, **keys)
        elif config.data:
            catalog = Catalog.parquet(spark, config.data, tables, **keys)
        else:
            raise PlanError("the settings name no data")
        cache, sessions = (PlanCache(f"{config.cache}/plans.json"), Sessions(f"{config.cache}/conversations")) if config.cache else (None, Sessions())
        return cls(catalog, client, cache, sessions, config.timeout_s, config.strict)

    def learn_relationships(self, cache: JsonCache | None = None) -> list[Edge]:
        """Edges that names propose and data confirm; from then on plans may join along them."""
        return discover(self.catalog, cache)

    def verify(self) -> list[str]:
        """Counts the declared keys once for each state of the catalog and drops those that do not hold, as joins rely on them; returns their tables."""
        shape = self.catalog.fingerprint()
        if shape in self.verified:
            return []
        bad = self.catalog.verify_keys()
        self.verified |= {shape, self.catalog.fingerprint()}
        return bad

    def _checked(self, plan: Plan, table: str | None = None) -> tuple[DataFrame, list[str]]:
        dropped = self.verify() if plan.joins else []
        report = validate(plan, self.catalog, table, self.strict)
        if not report.ok:
            raise PlanError("; ".join(report.errors))
        return compile_plan(self.catalog, plan, table), report.warnings + [f"the declared key of {t} does not hold" for t in dropped]

    def frame(self, plan: Plan, table: str | None = None) -> DataFrame:
        """The lazy result of a valid plan; PlanError lists what is wrong with any other."""
        return self._checked(plan, table)[0]

    def run(self, plan: Plan, table: str | None = None) -> Answer:
        df, warnings = self._checked(plan, table)
        return Answer(self._collect(plan, df), plan, warnings=warnings)

    def _collect(self, plan: Plan, df: DataFrame) -> Any:
        """Runs under a tag that a timer interrupts."""
        spark, tag, late = df.sparkSession, f"query-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            spark.interruptTag(tag)

        timer = threading.Timer(self.timeout_s, stop) if self.timeout_s else None
        spark.addTag(tag)
        try:
            if timer:
                timer.start()
            return to_contract(plan, df)
        except PySparkException as e:
            if late.is_set():
                raise QueryTimeout(f"stopped after {self.timeout_s} s") from e
            raise ExecutionError(masked(str(e).split("\n")[0])) from e
        finally:
            if timer:
                timer.cancel()
            spark.removeTag(tag)

    def ask(self, question: str, session: str = "default") -> Answer:
        if not question.strip():
            raise PlanError("the question is empty")
        kind = router.route(question)
        if kind == "tables":
            return Answer(sorted(t.name for t in self.catalog.items.values()))
        if kind == "row_statistics":
            return Answer([r.asDict() for r in self.catalog.row_counts().orderBy("table_name").collect()])
        if kind == "ambiguous_count":
            return Answer([], warnings=["of which table?"])
        if kind == "relationships":
            edges = {frozenset((f"{e.left_table}.{e.left_column}", f"{e.right_table}.{e.right_column}")) for held in Graph.known(self.catalog).near.values() for e in held}
            return Answer(sorted(" = ".join(sorted(e)) for e in edges))
        if self.client is None:
            raise PlanError("no client is set to read questions; run() takes plans")
        history = self.sessions.context(session)
        shape = self.catalog.fingerprint()
        tables, _ = select.select(question, self.catalog)
        plan = self.cache.get(question, shape) if self.cache and not history else None
        if plan is not None and not validate(plan, self.catalog).ok:
            self.cache.drop(PlanCache.key(question, shape))
            plan = None
        if plan is None:
            raw = planner.parse(self.client.generate_json(planner.prompt(question, self.catalog, tables or [t.name for t in self.catalog.items.values()], [t.question for t in history])))
            turn = self.sessions.find(session, raw.input_result_reference) if raw.input_result_reference else None
            if turn is not None and eligible(raw, turn.result):
                df = follow_up(turn.result, raw)
                reference = self.sessions.save(session, question, raw, df)
                return Answer(self._collect(raw.with_(intent="count" if raw.intent == "count" else "lookup"), df), raw, reference)
            if turn is not None and turn.plan.aggregation and not raw.aggregation and raw.intent in ("lookup", "filter", "distinct"):
                raw = details(turn.plan, raw)  # the rows behind an earlier aggregate
            elif turn is not None and not raw.table and not raw.joins:
                raw = raw.with_(table=turn.plan.table, joins=turn.plan.joins)
            plan = planner.repair(raw.with_(input_result_reference=None), question, self.catalog, tables[0] if tables else None)
            df, warnings = self._checked(plan)
            if self.cache and not history:
                self.cache.keep(question, shape, plan)
        else:
            df, warnings = self._checked(plan)
        data = self._collect(plan, df)
        return Answer(data, plan, self.sessions.save(session, question, plan, df), warnings)
