"""Layout documents: JSON files with an array of named elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

ELEMENT = "struct<geometry:string,name:string,text:string,bbox:array<double>,rotation:double,resolvedFontSize:double,resolvedTextStyle:struct<fontSize:double>,runs:array<struct<text:string,fontSize:double,baseline:double>>,endpoints:array<array<double>>,source_name:string,target_name:string>"


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, element...): one row per element of every *.layout.json under the path."""
    docs = spark.read.schema(f"elements array<{ELEMENT}>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.layout.json").json(path)
    return elements(docs.withColumn("file", F.col("_metadata.file_path")))


def elements(docs: DataFrame) -> DataFrame:
    """Elements of (file, elements) rows, in order; what isn't an object is left out."""
    return docs.select("file", F.posexplode("elements").alias("ord", "e")).filter("e is not null").select("file", "ord", "e.*")


# The format that a file name's suffix says.
FORMATS = {"svg": "svg", "drawio": "drawio", "excalidraw": "excalidraw", "mmd": "mermaid", "mermaid": "mermaid", "dot": "graphviz", "gv": "graphviz", "graphviz": "graphviz", "html": "html", "htm": "html", "pptx": "pptx"}


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, format, content): whole text files under the path, with their format by name (empty if unknown)."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return d.select("path", detect_format(F.col("path")).alias("format"), F.col("content").cast("string").alias("content"))


def detect_format(path, override=None):
    """The format of a file by its suffix, or as the override says (`dot` and `gv` are graphviz)."""
    names = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    by_name = F.coalesce(names[F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))], F.lit(""))
    if override is None:
        return by_name
    said = F.lower(override)
    return F.coalesce(F.when(said.isin("dot", "gv"), "graphviz").otherwise(F.nullif(said, F.lit(""))), by_name)


def _endless(c: Column, kind: DataType) -> Column:
    """Whether a value holds a number that isn't finite, at any depth."""
    if kind.simpleString() in ("double", "float"):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.exists(c, lambda v: _endless(v, kind.elementType)), F.lit(False))
    if isinstance(kind, MapType):
        return F.coalesce(F.exists(F.map_values(c), lambda v: _endless(v, kind.valueType)), F.lit(False))
    out = F.lit(False)
    for f in kind if isinstance(kind, StructType) else ():
        out = out | _endless(c.getField(f.name), f.dataType)
    return out


def write_json(df: DataFrame, path: str) -> None:
    """Writes rows as JSON lines; fails if the path has something, or if a number isn't finite."""
    bad = F.lit(False)
    for f in df.schema:
        bad = bad | _endless(F.col(f"`{f.name}`"), f.dataType)
    checked = df.withColumn("bad_", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a number is not finite")).cast("int"))).filter("bad_ is null").drop("bad_")
    checked.write.mode("errorifexists").json(path)
