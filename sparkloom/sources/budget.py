"""Work budgets of one invocation: what it may ask of a source, charged before it is asked.

A budget counts statements, columns, formula and query sizes, rows, cells and bytes; a
deadline cancels the Spark jobs of the invocation when it passes.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.profile import q

#: fixed values: limits of an invocation, and of a PostgreSQL source; what has none is not limited
INVOCATION = {
    "payload_bytes": 1 << 20, "argument_bytes": 256 << 10, "sql_chars": 100_000, "nodes": 10_000, "depth": 100, "projected_columns": 1_000, "statements": 150,
    "profiled_columns": 100, "seconds": 120.0, "result_bytes": 4 << 20, "response_bytes": 4 << 20,
}
POSTGRES = {"tables": 100, "projected_columns": 1_000, "statements": 1_500, "rows": 10_000, "cells": 100_000, "seconds": 120.0}
#: Counts that add up over an invocation; others are held against the limit one by one.
ADDING = ("statements", "projected_columns", "profiled_columns", "scan_bytes", "rows", "cells", "tables")


class BudgetExceeded(ValueError):
    """What would be asked for is beyond a limit."""


class WorkBudget:
    def __init__(self, limits: dict[str, float] | None = None, clock=time.monotonic):
        self.limits = dict(INVOCATION if limits is None else limits)
        if bad := sorted(k for k, v in self.limits.items() if not v > 0):
            raise ValueError(f"limits must be positive: {bad}")
        self.used: dict[str, float] = {}
        self._clock, self._began = clock, clock()

    def charge(self, **asked: float) -> None:
        """Adds what is asked for, or refuses it and leaves the budget as it was."""
        self.check_time()
        now = {k: n + (self.used.get(k, 0) if k in ADDING else 0) for k, n in asked.items()}
        for k, n in now.items():
            if n > self.limits.get(k, n):
                raise BudgetExceeded(f"{k.replace('_', ' ')}: {n}; at most {self.limits[k]}")
        self.used |= {k: n if k in ADDING else max(n, self.used.get(k, 0)) for k, n in now.items()}

    def left(self) -> float | None:
        """Seconds until the deadline."""
        return None if "seconds" not in self.limits else self.limits["seconds"] - (self._clock() - self._began)

    def check_time(self) -> None:
        if self.left() is not None and self.left() <= 0:
            raise BudgetExceeded(f"seconds: at most {self.limits['seconds']}")

    def charge_scan(self, df: DataFrame) -> None:
        """One statement over df: its columns, and the bytes that the optimiser expects to read."""
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        self.charge(statements=1, projected_columns=len(df.columns), scan_bytes=size)

    @contextmanager
    def running(self, spark: SparkSession) -> Iterator[None]:
        """Spark jobs started inside are cancelled at the deadline."""
        self.check_time()
        group, late = f"budget-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelJobGroup(group)

        timer = threading.Timer(self.left(), stop) if self.left() is not None else None
        spark.sparkContext.setJobGroup(group, "budgeted work", True)
        if timer:
            timer.start()
        try:
            yield
        except Exception as e:
            if late.is_set():
                raise BudgetExceeded(f"seconds: at most {self.limits['seconds']}") from e
            raise
        finally:
            if timer:
                timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def rows(self, df: DataFrame) -> list:
        """The rows of df, if they are within the limits of rows, cells and result bytes: measured where they are, then fetched."""
        bounds = [self.limits["rows"] - self.used.get("rows", 0)] if "rows" in self.limits else []
        bounds += [self.limits["cells"] // max(1, len(df.columns))] if "cells" in self.limits else []
        some = df.limit(int(max(0, min(bounds))) + 1) if bounds else df
        with self.running(df.sparkSession):
            size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*(q(c) for c in df.columns))))), F.lit(0))
            n, n_bytes = some.agg(F.count("*"), size).first()
            self.charge(rows=n, cells=n * len(df.columns), result_bytes=n_bytes)
            return some.collect()
