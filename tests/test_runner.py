"""The quality runner: one pass an audit, states, refusals."""

import pytest
from pyspark.sql import functions as F

from figmill.plans import runner


def test_states_and_one_pass(spark, tmp_path):
    n = spark.sparkContext.accumulator(0)

    def count(parts):
        for d in parts:
            n.add(len(d))
            yield d

    rows = spark.createDataFrame([("bad", 1), ("not verified: x", 2)], "rule string, subject int").mapInPandas(count, "rule string, subject int")
    waits = F.col("rule").startswith("not verified")
    fail = lambda: spark.table("no_such_table")
    checks = [runner.Check("both", lambda: rows, open=waits), runner.Check("open", lambda: rows.filter(waits), required=False, open=waits), runner.Check("clean", lambda: rows.filter("subject > 5")), runner.Check("absent", None), runner.Check("broken", fail)]
    got = {r["name"]: r for r in runner.run(spark, checks, str(tmp_path / "out"), [str(tmp_path / "in")]).collect()}
    assert n.value == 6  # three audits of two rows, once each
    assert {k: (r.status, r.failed, r.open) for k, r in got.items()} == {"both": ("FAIL", 1, 1), "open": ("NOT_VERIFIED", 0, 1), "clean": ("PASS", 0, 0), "absent": ("NOT_APPLICABLE", None, None), "broken": ("NOT_VERIFIED", None, None)}
    assert not got["both"].passed and "no_such_table" in got["broken"].reason
    assert spark.read.parquet(str(tmp_path / "out" / "both")).count() == 2
    fine = runner.run(spark, [runner.Check("a", lambda: rows.filter("false")), runner.Check("b", lambda: rows, required=False), runner.Check("c", None)], str(tmp_path / "fine"))
    assert all(r.passed for r in fine.collect())


def test_refusals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = [runner.Check("a", lambda: spark.range(1))]
    for out, inputs in ((tmp_path / "in", [tmp_path / "in"]), (tmp_path / "in" / "x", [tmp_path / "in"]), (tmp_path, [f"file://{tmp_path}/in/file.pptx"])):
        with pytest.raises(ValueError, match="on an input"):
            runner.run(spark, one, str(out), map(str, inputs))
    runner.run(spark, one, str(tmp_path / "out"), [str(tmp_path / "in"), f"s3://{tmp_path}/out", str(tmp_path / "output")])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        runner.run(spark, one, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="distinct"):
        runner.run(spark, one * 2, str(tmp_path / "two"))
