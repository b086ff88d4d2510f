"""Conversations: each answer's plan and lazy result under a reference, for follow-ups; kept in a table if there is a folder for it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.operators.followup import bounded
from loomquery.plans.ir import Plan

TURNS = 5


@dataclass(frozen=True)
class Turn:
    reference: str
    question: str
    plan: Plan
    result: DataFrame


@dataclass
class Sessions:
    """path: a folder of Parquet, a partition a conversation, to which each turn is appended with its plan and the bounded rows of its result."""

    path: str | None = None
    held: dict[str, list[Turn]] = field(default_factory=dict)

    def save(self, session: str, question: str, plan: Plan, result: DataFrame) -> str:
        """Keeps the turn and makes its result a temporary view; returns the reference. Of turns that no longer count, the views go."""
        reference = f"result_{uuid.uuid4().hex[:12]}"
        result.createOrReplaceTempView(reference)
        turns = self.held.setdefault(session, [])
        turns.append(Turn(reference, question, plan, result))
        for old in turns[:-TURNS]:
            result.sparkSession.catalog.dropTempView(old.reference)
        if self.path:
            rows = bounded(result).select(F.to_json(F.struct("*")).alias("row")).agg(F.collect_list("row").alias("rows"))  # at most 1000
            kept = rows.select(F.lit(session).alias("session"), F.lit(reference).alias("reference"), F.lit(question).alias("question"), F.lit(plan.to_json()).alias("plan"), F.lit(json.dumps(result.columns)).alias("columns"), "rows", F.current_timestamp().alias("at"))
            kept.write.mode("append").partitionBy("session").parquet(self.path)
        return reference

    def stored(self, spark: SparkSession, session: str) -> DataFrame:
        """(reference, question, plan, columns, rows, at) of a conversation's turns, as they were kept."""
        return spark.read.parquet(self.path).where(F.col("session") == session).drop("session").orderBy("at")

    def restore(self, spark: SparkSession, session: str, compiled: Callable[[Plan], DataFrame]) -> list[Turn]:
        """The last turns of a conversation that another process has kept; their results are compiled anew from their plans, so they are whole."""
        rows = self.stored(spark, session).orderBy(F.desc("at")).limit(TURNS).select("reference", "question", "plan").collect()
        plans = [(r["reference"], r["question"], Plan.from_json(json.loads(r["plan"]))) for r in reversed(rows)]
        self.held[session] = [Turn(ref, question, plan, compiled(plan)) for ref, question, plan in plans]
        return self.held[session]

    def close(self, spark: SparkSession, session: str) -> None:
        """Forgets a conversation's turns and drops their views; what was kept stays."""
        for turn in self.held.pop(session, []):
            spark.catalog.dropTempView(turn.reference)

    def context(self, session: str) -> list[Turn]:
        """The last turns, oldest first."""
        return self.held.get(session, [])[-TURNS:]

    def find(self, session: str, reference: str) -> Turn | None:
        return next((t for t in self.held.get(session, []) if t.reference == reference), None)
