"""Runs audits over one artifact: each is written once and counted while it is written."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from figmill.plans import rollup

CHECK = "name string, required boolean, applies boolean, ran boolean, failed long, open long, reason string"


@dataclass
class Check:
    """An audit: `make` gives its rows (null where it doesn't apply), `open` tells which only say that something wasn't verified."""

    name: str
    make: Callable[[], DataFrame] | None
    required: bool = True
    open: Column | None = None


def _place(path: str) -> tuple[str, str, str]:
    u = urlsplit(path)
    return ("" if u.scheme == "file" else u.scheme, u.netloc, posixpath.normpath(u.path))


def clashes(out: str, inputs: Iterable[str]) -> list[str]:
    """The inputs that lie at or under the output's path, or over it."""
    scheme, host, path = _place(out)
    under = lambda a, b: a == b or a.startswith(b.rstrip("/") + "/")
    return [i for i in inputs if (p := _place(i))[:2] == (scheme, host) and (under(p[2], path) or under(path, p[2]))]


def run(spark: SparkSession, checks: list[Check], out: str, inputs: Iterable[str] = ()) -> DataFrame:
    """(name, required, status, failed, open, reason, passed) of the checks, whose rows go to out/name as Parquet and the report to out/report.

    Nothing is written over: out must be away from the inputs, and a check's folder must not exist.  An audit passes over
    its tables once, for its rows and both counts.  One that can't be made or run isn't verified, with the reason;
    rows that only say so don't fail it.  passed: every required check passes or doesn't apply.
    """
    if bad := clashes(out, inputs):
        raise ValueError(f"the output would lie on an input: {bad[0]}")
    names = [c.name for c in checks]
    if len(set(names)) < len(names) or "report" in names:
        raise ValueError("names of checks must be distinct, and none may be `report`")
    rows = []
    for c in checks:
        failed = open_ = None
        reason = None
        if c.make is not None:
            try:
                seen, waits = Observation(), c.open if c.open is not None else F.lit(False)
                d = c.make().observe(seen, F.count_if(~F.coalesce(waits, F.lit(False))).alias("failed"), F.count_if(waits).alias("open"))
                d.write.mode("errorifexists").parquet(f"{out}/{c.name}")
                failed, open_ = seen.get["failed"], seen.get["open"]
            except (PySparkException, ValueError) as x:
                if "PATH_ALREADY_EXISTS" in str(x):
                    raise
                reason = f"{type(x).__name__}: {str(x).splitlines()[0][:200]}"
        rows.append((c.name, c.required, c.make is not None, failed is not None, failed, open_, reason))
    report = rollup.report(spark.createDataFrame(rows, CHECK))
    report.write.mode("errorifexists").parquet(f"{out}/report")
    return spark.read.parquet(f"{out}/report")
