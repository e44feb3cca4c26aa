"""Text functions on the JVM."""

from __future__ import annotations

import json
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The texts of templates that nobody has filled in, and the traces of wrongly decoded bytes.
PLACEHOLDERS = (r"^click to add(?: title| text| subtitle)?$", r"^lorem ipsum\b", r"^(?:todo|tbd|replace with|placeholder)(?:\b|\s|:)", r"^slide number$")
MOJIBAKE = ("\ufffd", "Ã", "Â", "â€", "锟斤拷", "烫烫烫", "屯屯屯")
CJK = "[\u2e80-\u2fff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
MERMAID_HEADERS = "flowchart|graph|sequenceDiagram|classDiagram|stateDiagram(?:-v2)?|erDiagram|gantt|timeline|mindmap|journey|pie"


def normalised(column: str) -> Column:
    """ASCII lower case, runs of ASCII white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.col(column), string.ascii_uppercase, string.ascii_lowercase), "[ \\t\\n\\r]+", " "))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed characters.  The JVM side has no such function, so texts go through Arrow."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


# Characters that composition may change or join to the one before: marks, Hangul letters, those that stand for others, and what the JVM doesn't know.
UNSTABLE = r"\p{M}\p{Cn}\x{374}\x{37e}\x{387}\x{958}-\x{95f}\x{9dc}-\x{9dd}\x{9df}\x{a33}\x{a36}\x{a59}-\x{a5b}\x{a5e}\x{b5c}-\x{b5d}\x{f43}\x{f4d}\x{f52}\x{f57}\x{f5c}\x{f69}\x{1100}-\x{11ff}\x{1f71}\x{1f73}\x{1f75}\x{1f77}\x{1f79}\x{1f7b}\x{1f7d}\x{1fbb}\x{1fbe}\x{1fc9}\x{1fcb}\x{1fd3}\x{1fdb}\x{1fe3}\x{1feb}\x{1fee}-\x{1fef}\x{1ff9}\x{1ffb}\x{1ffd}\x{2000}-\x{2001}\x{2126}\x{212a}-\x{212b}\x{2329}-\x{232a}\x{2adc}\x{a960}-\x{a97f}\x{d7b0}-\x{d7ff}\x{f900}-\x{fa0d}\x{fa10}\x{fa12}\x{fa15}-\x{fa1e}\x{fa20}\x{fa22}\x{fa25}-\x{fa26}\x{fa2a}-\x{fa6d}\x{fa70}-\x{fad9}\x{fb1d}\x{fb1f}\x{fb2a}-\x{fb36}\x{fb38}-\x{fb3c}\x{fb3e}\x{fb40}-\x{fb41}\x{fb43}-\x{fb44}\x{fb46}-\x{fb4e}\x{1d15e}-\x{1d164}\x{1d1bb}-\x{1d1c0}\x{2f800}-\x{2fa1d}"


def may_change(text: Column) -> Column:
    """Whether a text has a character that composition may change."""
    return text.rlike(f"[{UNSTABLE}]")


def match_key(text: Column) -> Column:
    """A text for comparison: composed, without any white space (all of Unicode's).  Only texts that composition may change go through Python."""
    whole = F.coalesce(text, F.lit(""))
    return F.regexp_replace(F.coalesce(nfc(F.when(may_change(whole), whole)), whole), r"(?U)\s+", "")


def stripped(text: Column) -> Column:
    """A text without white space (all of Unicode's) at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def line_breaks(text: Column) -> Column:
    """Carriage returns and vertical tabs as newlines."""
    return F.regexp_replace(text, "\r\n|\r|\u000b", "\n")


def occurrences(texts: DataFrame, needles: DataFrame, text: str, needle: str, words: int = 3) -> DataFrame:
    """Pairs where the text contains the needle, with `n`, how often (no overlaps).

    Joined by the hash of inner words: every needle has a least one of its inner words (all but the first and
    last, which may be cut in the text), and a text that contains the needle has that word too.  Needles
    of fewer than `words` words are compared with every text, as nothing shorter can be looked up.
    """
    parts = F.split(F.col(needle), " ")
    keyed = needles.withColumn("key_", F.when(F.size(parts) >= words, F.array_min(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(1))), lambda w: F.xxhash64(w)))))
    long, short = keyed.filter("key_ is not null"), keyed.filter("key_ is null").drop("key_")
    found = texts.withColumn("key_", F.explode(F.array_distinct(F.transform(F.split(F.col(text), " "), lambda w: F.xxhash64(w)))))
    contains = F.contains(F.col(text), F.col(needle))
    both = long.join(found, "key_").filter(contains).drop("key_").unionByName(short.join(texts, contains))
    n = (F.length(text) - F.length(F.replace(F.col(text), F.col(needle), F.lit("")))) / F.length(needle)
    return both.withColumn("n", n.cast("long"))


def token_pattern(key: Column) -> Column:
    """A pattern for a match_key() with white space allowed between its characters.

    A token that begins or ends with an ASCII letter or digit must not go on with one, or with `_`; one
    that ends with a digit must not go on as a number.
    """
    spaced = F.array_join(F.transform(F.split(key, ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), r"(?U:\s*)")
    left = F.when(key.rlike("^[A-Za-z0-9]"), r"(?<![A-Za-z0-9_])").otherwise("")
    right = F.when(key.rlike("[A-Za-z0-9]$"), r"(?![A-Za-z0-9_])").otherwise("")
    return F.concat(left, spaced, right, F.when(key.rlike("[0-9]$"), r"(?![.,][0-9])").otherwise(""))


def token_count(text: Column, token: Column) -> Column:
    """How often the token stands in the text, apart from longer words and numbers; an empty token never does."""
    key = match_key(token)
    return F.when(key == "", 0).otherwise(F.regexp_count(nfc(F.coalesce(text, F.lit(""))), token_pattern(key)))


def first_by_key(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """(keys, text) without blank texts and without those whose match key an earlier row has, trimmed."""
    d = df.select(*keys, order, F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias(text)).withColumn("key_", match_key(F.col(text))).filter("key_ <> ''")
    return d.groupBy(*keys, "key_").agg(F.min(F.struct(order, text)).alias("f")).select(*keys, f"f.{order}", f"f.{text}")


def number_prefix(text: Column) -> Column:
    """The number that a text such as `12.5px` begins with, or null; no plus sign, no exponent."""
    return F.nullif(F.regexp_extract(text, r"(?U)^\s*(-?(?:\d+(?:\.\d*)?|\.\d+))", 1), F.lit("")).try_cast("double")


def is_external(url: Column) -> Column:
    return F.coalesce(F.lower(stripped(url)).rlike(r"^(?:https?:)?//"), F.lit(False))


def natural_key(text: Column) -> Column:
    """Sort key by which runs of digits compare as numbers of any length: before other text, then by length without leading zeros, then by digit."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    number = lambda p: F.struct(F.lit(0).alias("kind"), F.length(digits(p)).alias("length"), digits(p).alias("text"))
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("length"), p.alias("text"))))


def placeholder(text: Column) -> Column:
    t = stripped(text)
    return F.array_contains(F.array(*(t.rlike(f"(?i){p}") for p in PLACEHOLDERS)), True)


def mojibake(text: Column) -> Column:
    return F.array_contains(F.array(*(F.contains(text, F.lit(m)) for m in MOJIBAKE)), True)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


# What counts as an edge of a Mermaid or Graphviz text, and how a Graphviz text begins.
MERMAID_EDGES, GRAPHVIZ_EDGES = r"-->|---|==>|-.->|~~~|<-->|--\|", "->|--"
GRAPHVIZ_HEADER = r'(?i)\b(?:strict\s+)?(di)?graph\b\s+[A-Za-z_0-9"]*\s*\{'


def mermaid(text: Column) -> Column:
    """struct(empty, headers, edges, warns) of a graph text without its comments."""
    body = F.regexp_replace(F.regexp_replace(text, "(?m)%%.*$", ""), r"(?U)^\s+|\s+$", "")
    headers = F.regexp_extract_all(body, F.lit(rf"(?im)^\s*({MERMAID_HEADERS})\b"), F.lit(1))
    edges = F.regexp_count(body, F.lit(MERMAID_EDGES))
    plain = F.lower(F.element_at(headers, 1)).isin("pie", "mindmap", "timeline", "gantt", "journey")
    return F.struct((body == "").alias("empty"), headers.alias("headers"), edges.alias("edges"), ((F.size(headers) > 0) & (edges == 0) & ~F.coalesce(plain, F.lit(False))).alias("warns"))


def graphviz(text: Column) -> Column:
    """struct(empty, declared, balanced, edges) of a graph text without its comments."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?ms)//.*$|/\*.*?\*/", ""), r"(?U)^\s+|\s+$", "")
    count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    declared = body.rlike(GRAPHVIZ_HEADER)
    return F.struct((body == "").alias("empty"), declared.alias("declared"), (count("{") == count("}")).alias("balanced"), F.regexp_count(body, F.lit(GRAPHVIZ_EDGES)).alias("edges"))


def canonical_json(form: str):
    """A column function from a JSON text to its canonical form: `plain` (sorted keys, usual separators), `compact` (sorted, no spaces) or `ascii` (compact, \\u escapes)."""
    options = {"plain": {}, "compact": {"separators": (",", ":"), "ensure_ascii": False}, "ascii": {"separators": (",", ":")}}[form]

    @F.pandas_udf(StringType())
    def canonical(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, allow_nan=False, **options))

    return canonical
