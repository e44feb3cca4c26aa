"""The pattern join against trying every pattern on every name."""

import random
import re

from pyspark.sql import functions as F

from figmill.operators import patterns as P

NAMES = ["Flow_r1-segment-2", "flow_r10-segment-2", "n2", "n20", "a.b", "axb", "", " ", "x(y)", "tab\tname", "naïve-été", "日本語-box", "𝒜-long-name-of-more-than-twenty-four-characters", "aaa", "ab", "a|b", "{x}", "Ünder", "line\nbreak", "node[3]"]
PATTERNS = [r"^n2", r"^n2$", r"segment", r"(?i)FLOW_r1", r"a\.b", r"a.b", r"^(flow|bus)_r1\b", r"x\(y\)", r"seg(ment)?-2", r"segx?ment-2", r"segm+ent", r"n{1,2}2", r"[ab]{2}", r"tab\tname", r"été", r"日本", r"long-name-of-more-than-twenty-four-characters$", r"Flow|n20", r"", r".", r"^$", r"\Qa.b\E", r"\x61xb", r"a\|b", r"\{x\}", r"line\nbreak", r"node\[\d\]", r"(?:seg)(?=ment)", r"nothing-like-this", r"[^a-z]ool", r"a(b(c|d)?)?$", r"\p{Lu}nder", r"(f)low_r1\d?-\w+-2"]


def pairs(spark, names, patterns):
    n = spark.createDataFrame([(x, 1) for x in names], "name string, pattern int")
    p = spark.createDataFrame([(x, "k") for x in patterns], "pattern string, name string")
    every = n.select("name").distinct().crossJoin(p.select("pattern").distinct()).filter(F.expr("name rlike pattern"))
    want = sorted((r.pattern, r.name) for r in every.collect())
    return sorted((r.pattern, r.name) for r in P.matches(n, p).collect()), want


def test_patterns_of_every_kind(spark):
    got, want = pairs(spark, [*NAMES, None, "n2"], [*PATTERNS, None, "^n2"])
    assert got == want and len(want) > 60


def test_random_patterns(spark):
    rnd = random.Random(11)
    names = ["".join(rnd.choice("abc-1") for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    piece = lambda: rnd.choice(["ab", "c-", "a", "1", "[ab]", "b?", "c*", "a+", "(ab|c)", "(a(b|-)?)", "b{1,2}", r"\w", r"\-", "."])
    got, want = pairs(spark, names, [rnd.choice(["", "^"]) + "".join(piece() for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "$"]) for _ in range(150)])
    assert got == want


def test_literals(spark):
    want = {"^abc$": "abc", "ab?cd": "cd", "ab+cd": "ab", "x(yz)w12": "w12", "a|b": "", "(?i)abc": "", r"a\.bcd": "bcd", "abc{2}": "ab", "[abc]": "", "": ""}
    df = spark.createDataFrame([(k,) for k in want], "pattern string")
    assert {r.pattern: r.l for r in df.select("pattern", P.literal(F.col("pattern")).alias("l")).collect()} == want


def test_empty_and_plan(spark):
    none = spark.createDataFrame([], "pattern string")
    some = spark.createDataFrame([("abc",), ("b-c",)], "name string")
    assert P.matches(some, none).collect() == [] and P.matches(some.filter("false"), some.select(F.col("name").alias("pattern"))).collect() == []
    plan = P.matches(some, some.select(F.col("name").alias("pattern")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_literals_in_texts(spark):
    rnd = random.Random(13)
    words = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    texts, literals = [words(rnd.randint(0, 40)) for _ in range(150)] + [None, "x" * 50], [words(rnd.randint(0, 9)) for _ in range(120)] + [None, "", "x" * 30, "x" * 51]
    got = {(r.literal, r.text) for r in P.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in literals], "literal string")).collect()}
    assert got == {(a, t) for a in literals if a for t in texts if t is not None and a in t} and len(got) > 500
    assert P.containing(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "literal string")).collect() == []


def test_matches_bring_no_table_to_the_driver(spark, tmp_path):
    spark.range(300).selectExpr("concat('part#', id, '-size') AS name").write.parquet(f"{tmp_path}/names")
    spark.range(300).selectExpr("concat('^part#', id, '-') AS pattern").write.parquet(f"{tmp_path}/patterns")
    names, asked = spark.read.parquet(f"{tmp_path}/names"), spark.read.parquet(f"{tmp_path}/patterns")
    found = P.matches(names, asked)
    assert found.count() == 300
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    held = P.containing(names.selectExpr("name AS text"), asked.selectExpr("substr(pattern, 2) AS literal"))
    assert held.count() == 300
    assert "Broadcast" not in held._jdf.queryExecution().executedPlan().toString()


def test_patterns_go_by_their_rarest_literal(spark, monkeypatch):
    """Not by the longest, which all names may hold, and by whole numbers of digits; beginnings count as beginnings."""
    tried = spark.sparkContext.accumulator(0)
    like = F.udf(lambda name, pattern: (tried.add(1), re.search(pattern, name) is not None)[1], "boolean")
    names = spark.createDataFrame([(f"part#{k}-size{k % 50}",) for k in range(10_000, 12_000)], "name string")
    asked = [f"^part.?{k}" for k in range(10_000, 10_200)] + [f"{k}$" for k in range(10_000, 10_100)] + [f"^part#{k}-" for k in range(11_000, 11_200)] + ["^size4", "^part#11999-size49$"]
    patterns = spark.createDataFrame([(v,) for v in asked], "pattern string")
    want = {(p, n.name) for n in names.collect() for p in asked if re.search(p, n.name)}
    monkeypatch.setattr(P.F, "regexp_like", lambda name, pattern: like(F.col(name), pattern))
    found = P.matches(names, patterns).collect()
    assert len(found) == len(want) == 401 and {tuple(r) for r in found} == want
    assert tried.value <= 600


def test_long_beginnings_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 64)
    monkeypatch.setattr(P, "HELD", 10)
    names = ["https://example.org/a/long/path/of/many/parts/" + f"{k}é{k % 7}" for k in range(300)] + ["", "x", "xx"]
    got, want = pairs(spark, names, [f"^https://example.org/a/long/path/of/many/parts/{k}é" for k in range(0, 300, 7)] + ["^x", "^é", "^x$", "é3$"])
    assert got == want and len(want) > 80
