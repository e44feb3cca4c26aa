"""Joins of many regular expressions with many names.

Each pattern's literals are texts that every match must hold.  Names are indexed by hashes of their grams, stretches
of a few lengths in bytes, and of their beginnings; a pattern looks up the rarest gram of all its literals, and only
the names found there are tried.  A bit set of bounded size, of what is asked for, leaves the other grams unwritten.
Patterns without a literal of use are tried on every name, in blocks that the caller's rows bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.operators.graph import cut, dealt

GRAMS = (1, 2, 3, 4, 5, 6, 8, 12, 16, 24)
BEGINS = tuple(range(1, 33))  # lengths of beginnings; longer ones are looked up by their grams too
BITS = 1 << 26  # of the set of grams that are asked for, at most
CHUNK, HELD = 1 << 20, 1 << 20  # bytes that are hashed at once, grams that are counted at once
BLOCK, NESTING = 200, 6
CUT = "\u0000"

# What a regular expression's text may hold besides literals, in the order in which it is cut away.
_ESCAPE = r"\\(?:x\{[^}]*\}|x..|u....|[pP]\{[^}]*\}|[pP].|k<[^>]*>|N\{[^}]*\}|c.|[0-9]+|.)"
_CLASS = r"\[[^\]]*\]"
_GROUP = r"\([^()]*\)"
_LOOSE = r"(?s).(?:[*?]|\{[^}]*\})[+?]?"  # what stands before may be absent
_PLUS = r"\+[+?]?"
_ODD = r"\\Q|\(\?[a-zA-Z-]+[:)]|\[\]|\[\^\]|&&|[\u0000]"  # quoting, flags, classes that open oddly: no literal is looked for


def _plain(patterns: DataFrame) -> DataFrame:
    """patterns (pattern) with `plain`, the pattern with all but its literals and anchors cut away, null where nothing is known of it; a step a column, so that none runs twice."""
    gone, p = F.lit(CUT), F.col("plain")
    groups = p
    for _ in range(NESTING):
        groups = F.regexp_replace(groups, F.lit(_GROUP), gone)
    d = patterns.withColumn("plain", F.regexp_replace(F.regexp_replace("pattern", F.lit(r"(?s)" + _ESCAPE), gone), F.lit(_CLASS), gone))
    d = d.withColumn("plain", F.when(F.contains(p, F.lit("(")), groups).otherwise(p))
    d = d.withColumn("plain", F.regexp_replace(F.regexp_replace(p, F.lit(_LOOSE), gone), F.lit(_PLUS), gone))
    return d.withColumn("plain", F.when(~(F.col("pattern").rlike(_ODD) | p.rlike(r"[|()\[\]{}\\]")), p))


def _pieces(plain: Column) -> Column:
    return F.split(F.regexp_replace(plain, F.lit(r"[.^$]"), F.lit(CUT)), CUT)


def literal(pattern: Column) -> Column:
    """The longest text that every match of a pattern holds as it stands, or an empty one; it may miss some, it never claims too much."""
    gone = F.lit(CUT)
    p = F.regexp_replace(F.regexp_replace(pattern, F.lit(r"(?s)" + _ESCAPE), gone), F.lit(_CLASS), gone)
    for _ in range(NESTING):
        p = F.regexp_replace(p, F.lit(_GROUP), gone)
    p = F.regexp_replace(F.regexp_replace(p, F.lit(_LOOSE), gone), F.lit(_PLUS), gone)
    open_ = pattern.rlike(_ODD) | p.rlike(r"[|()\[\]{}\\]")
    longest = F.get(F.array_sort(_pieces(p), lambda a, b: F.char_length(b) - F.char_length(a)), F.lit(0))
    return F.when(open_, "").otherwise(longest)


def literals(patterns: DataFrame) -> DataFrame:
    """(pattern, first, rest) of patterns (pattern): what every match begins with, or an empty text, and an array of the other texts that it holds; neither claims too much."""
    d = _plain(patterns.select("pattern")).withColumn("first", F.coalesce(F.regexp_extract("plain", r"\A\^([^\x00.^$]+)", 1), F.lit("")))
    rest = F.filter(_pieces(F.substring("plain", F.char_length("first") + F.when(F.col("first") != "", 2).otherwise(1), F.char_length("plain"))), lambda v: v != "")
    return d.select("pattern", "first", F.coalesce(rest, F.array().cast("array<string>")).alias("rest"))


def _hashed(texts: pa.Array, sizes: tuple[int, ...], begins: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every stretch of the sizes and every beginning of the lengths, chunk by chunk of whole texts; the lowest bit tells beginnings from the rest."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    mixed = lambda h, k, bit: ((v := (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) << np.uint64(1) | np.uint64(bit)
    top, at = max((*sizes, *begins), default=0), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        own = data[ends[at] : ends[to]].astype(np.uint64) + np.uint64(1)
        row = np.repeat(np.arange(at, to), np.diff(ends[at : to + 1]))
        left = ends[row + 1] - ends[at] - np.arange(len(own))
        first = (ends[at:to] - ends[at])[np.diff(ends[at : to + 1]) > 0]
        h = own
        for k in range(1, min(top, len(own)) + 1):
            if k > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + own[k - 1 :]
            if k in sizes:
                fits = left[: len(h)] >= k
                yield row[: len(h)][fits], mixed(h[fits], k, 1)
            if k in begins:
                some = first[left[first] >= k]
                yield row[some], mixed(h[some], k, 0)
        at = to


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, size) for each key, its beginning and its other literals: all grams of the greatest size that a literal has; below 0, the size of a beginning."""
    size = lambda n, known: max(k for k in known if k <= n)
    for d in batches:
        keys, grams, sizes = [], [], []

        def add(rows, texts, own, known, d=d):
            n = np.array([size(len(t), known) for t in texts])
            for k in np.unique(n):
                mine = np.flatnonzero(n == k)
                for at, h in _hashed(pa.array([texts[j] for j in mine], pa.binary()), *(((int(k),), ()) if own > 0 else ((), (int(k),)))):
                    keys.append(np.asarray(rows)[mine[at]])
                    grams.append(h)
                    sizes.append(np.full(len(h), own * k))

        first = [(j, v) for j, v in enumerate(d.column("first").cast(pa.binary()).to_pylist()) if v]
        rest = [(j, v) for j, some in enumerate(d.column("rest").cast(pa.list_(pa.binary())).to_pylist()) for v in some or ()] + [(j, v) for j, v in first if len(v) > BEGINS[-1]]
        for some, own, known in ((first, -1, BEGINS), (rest, 1, GRAMS)):
            if some:
                add(*zip(*some, strict=True), own, known)
        if keys:
            yield pa.RecordBatch.from_arrays([d.column("key").take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32))], ["key", "gram", "size"])


def _index(grams: DataFrame):
    """A function of texts that gives (row, gram) of the grams (gram, size) that they hold, each once, with few others; one small action counts, one brings at most BITS bits."""
    found = grams.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes, begins = tuple(r["size"] for r in found if r["size"] > 0), tuple(-r["size"] for r in found if r["size"] < 0)
    bits = min(BITS, max(1 << 15, 1 << (16 * sum(r["n"] for r in found)).bit_length()))
    at = F.pmod("gram", F.lit(bits)) + 1
    parts = grams.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("p")).groupBy("bucket").agg(F.bitmap_construct_agg("p").alias("b")).collect()
    held = np.zeros(bits // 8, np.uint8)
    for r in parts:
        held[(r["bucket"] - 1) * 4096 :][:4096] = np.frombuffer(r["b"], np.uint8)

    def look(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for row, h in _hashed(texts, sizes, begins):
            p = h & np.uint64(bits - 1)
            some = (held[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            row, h = row[some], h[some].view(np.int64)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            once = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])[: len(row)]
            yield row[once], h[once]

    return look


def _met(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text): of wanted (key, first, rest), each key with the texts (text) that hold the rarest gram of its literals, no pair twice; texts and keys have no repeats."""
    asked = cut(wanted.mapInArrow(_asked, f"key {dict(wanted.dtypes)['key']}, gram long, size int").distinct())
    look = _index(asked)

    def counted(batches):
        held, many = [], 0
        for d in batches:
            for _, h in look(d.column(0)):
                held.append(h)
                many += len(h)
                if many >= HELD:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, np.unique(np.concatenate(held), return_counts=True))], ["gram", "n"])
                    held, many = [], 0
        if many:
            yield pa.RecordBatch.from_arrays([*map(pa.array, np.unique(np.concatenate(held), return_counts=True))], ["gram", "n"])

    count = texts.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    chosen = asked.join(dealt(count), "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "size")).alias("m")).filter("m.n > 0")
    chosen = cut(chosen.select("key", "m.gram", "m.size"))
    find = _index(chosen)

    def held(batches):
        for d in batches:
            for row, h in find(d.column(0)):
                yield pa.RecordBatch.from_arrays([d.column(0).take(pa.array(row)), pa.array(h)], ["text", "gram"])

    return chosen.select("key", "gram").join(dealt(texts.select("text").mapInArrow(held, "text string, gram long")), "gram").select("key", "text")


def containing(texts: DataFrame, literals: DataFrame) -> DataFrame:
    """(literal, text): every literal with every text that holds it, each pair once; an empty literal is in none.

    texts (text) and literals (literal) may repeat and hold nulls.  A text is looked up by the rarest gram of a
    literal, as in matches().
    """
    text = texts.select("text").filter("text IS NOT NULL").distinct()
    p = literals.select(F.col("literal").alias("key")).filter("key <> ''").distinct()
    return _met(text, p.select("key", F.lit("").alias("first"), F.array("key").alias("rest"))).filter(F.contains("text", "key")).select(F.col("key").alias("literal"), "text")


def matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, name): every pattern with every name that it finds (rlike), each pair once.

    names (name) and patterns (pattern) may repeat and hold nulls, which match nothing.  Small actions count the patterns
    without a literal, which are tried on all names, and look at which grams the others ask for.
    """
    name = names.select("name").filter("name IS NOT NULL").distinct()
    p = cut(literals(patterns.select("pattern").filter("pattern IS NOT NULL").distinct()))
    known = (F.col("first") != "") | (F.size("rest") > 0)
    n = p.agg(F.count_if(known).alias("known"), F.count_if(~known).alias("rest")).first()
    out = None
    if n["known"]:
        met = _met(name.select(F.col("name").alias("text")), p.filter(known).withColumnRenamed("pattern", "key"))
        out = met.filter(F.regexp_like("text", F.col("key"))).select(F.col("key").alias("pattern"), F.col("text").alias("name"))
    if n["rest"]:
        # a block holds BLOCK patterns, and every name meets every block once: what has no literal has to be tried on all
        blocks = -(-n["rest"] // BLOCK)
        rest = p.filter(~known).select("pattern", F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int").alias("block")).groupBy("block").agg(F.collect_list("pattern").alias("patterns"))
        tried = name.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(rest) if n["rest"] <= 10 * BLOCK else rest, "block")
        tried = tried.select("name", F.explode("patterns").alias("pattern")).filter(F.regexp_like("name", F.col("pattern"))).select("pattern", "name")
        out = tried if out is None else out.unionByName(tried)
    return patterns.sparkSession.createDataFrame([], "pattern string, name string") if out is None else out
