"""Slide packages (zipped XML), read from binary files: parts, relationships, slides, objects, text runs, paths, connectors."""

from __future__ import annotations

import hashlib
import io
import math
import re
import zipfile
import zlib
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from figmill.functions.numeric import affine
from figmill.operators import graph

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HEADS = {f"{P}sp": "nvSpPr", f"{P}pic": "nvPicPr", f"{P}graphicFrame": "nvGraphicFramePr", f"{P}cxnSp": "nvCxnSpPr"}
PART = "package string, part string, size long, error string"
OBJECT = "package string, slide int, part string, ord int, depth int, shape_id string, name string, kind string, preset string, x_emu long, y_emu long, w_emu long, h_emu long, rotation_deg double, flip_h boolean, flip_v boolean, matrix array<double>, unsupported string, line_width long, line_color string, target_id string, crop array<double>, text string"
FORM = "struct<x:double,y:double,w:double,h:double,turn:double,flip_h:boolean,flip_v:boolean,left:double,top:double,cw:double,ch:double,whole:boolean>"
RAW_OBJECT = OBJECT.replace("matrix array<double>, unsupported string", f"groups array<{FORM}>, own {FORM}, clipped boolean, effects boolean")
RUN = "package string, slide int, part string, shape_id string, name string, paragraph int, ord int, text string, size double, baseline double, east_asian boolean"
COMMAND = "package string, slide int, part string, shape_id string, name string, path_index int, ord int, kind string, points array<struct<x:double,y:double>>, w double, h double"
BOUND = "package string, slide int, part string, id string, name string, source_id string, source_port string, target_id string, target_port string, start_arrow string, end_arrow string"
COUNT = "package string, part string, kind string, native int, shapes int, text_shapes int, characters int, connectors int, groups int, frames int, charts int, tables int, pictures int, backgrounds array<string>"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pptx").load(path).select(F.col("path").alias("package"), "content")


class Package:
    """An open package; what can't be read is left out, and parts() says why."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = {i.filename: i for i in self.zip.infolist()}

    def xml(self, part: str):
        try:
            return ElementTree.fromstring(self.zip.read(part)) if part in self.names else None
        except (ElementTree.ParseError, zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error):
            return None

    def slide_parts(self):
        """(part, root) of the parts that are slides, shown or not."""
        for part in self.names:
            if re.search(r"(^|/)slides/[^/]+\.xml$", part) and (root := self.xml(part)) is not None:
                yield part, root


def _whole(value: str | None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _real(value: str | None, default: float = math.nan) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def _each(df: DataFrame, read, schema: str) -> DataFrame:
    """Rows of read(name, package) for every package that can be opened."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(parts):
        for batch in parts:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    package = Package(content)
                except zipfile.BadZipFile:
                    continue
                rows = list(read(name, package))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return df.select("package", "content").mapInArrow(run, schema)


def _numbered(df: DataFrame, read, schema: str) -> DataFrame:
    """Rows of read() over the slide parts, whose schema has no slide, with the numbers of the slides that show them."""
    rows = _each(df, read, schema.replace("slide int, ", ""))
    found = rows.join(slides(df).select("package", "part", "slide"), ["package", "part"])
    return found.select("package", "slide", *(c for c in rows.columns if c != "package"))


def parts(df: DataFrame) -> DataFrame:
    """Every part, its size and, if it should be XML but isn't, the error; a file that is no package gives one row with the error."""
    kind = to_arrow_schema(StructType.fromDDL(PART))

    def read(name, content):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    error = ""
                    if i.filename.endswith((".xml", ".rels")):
                        try:
                            ElementTree.fromstring(z.read(i))
                        except (ElementTree.ParseError, zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error) as e:
                            error = str(e)
                    yield name, i.filename, i.file_size, error
        except zipfile.BadZipFile as e:
            yield name, "", 0, str(e)

    def run(batches):
        for batch in batches:
            rows = [r for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in read(name, content)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return df.select("package", "content").mapInArrow(run, PART)


def part_hashes(df: DataFrame, wanted: str = "^ppt/media/") -> DataFrame:
    """(package, part, size, sha256) of the parts whose names `wanted` finds; only these are unpacked."""
    name_is = re.compile(wanted)

    def read(name, package):
        for part, about in package.names.items():
            if name_is.search(part):
                yield name, part, about.file_size, hashlib.sha256(package.zip.read(part)).hexdigest()

    return _each(df, read, "package string, part string, size long, sha256 string")


NODE = "package string, part string, node int, parent int, depth int, position int, namespace string, tag string, text string, attributes map<string,string>"


def directory(df: DataFrame) -> DataFrame:
    """(package, part, size) of every part, from the packages' directories alone."""

    def read(name, package):
        for part, about in package.names.items():
            yield name, part, about.file_size

    return _each(df, read, "package string, part string, size long")


def nodes(df: DataFrame, wanted: str) -> DataFrame:
    """The elements of the XML parts whose names `wanted` finds, a row each; other parts aren't unpacked, and what isn't XML has no rows."""
    name_is = re.compile(wanted)

    def read(name, package):
        for part in package.names:
            root = package.xml(part) if name_is.search(part) else None
            todo, n = [(root, None, 0, 0)] if root is not None else [], 0
            while todo:
                e, parent, depth, position = todo.pop()
                space, _, tag = e.tag.rpartition("}")
                yield name, part, n, parent, depth, position, space[1:], tag, e.text, list(e.attrib.items())
                todo += [(c, n, depth + 1, k) for k, c in reversed(list(enumerate(e)))]
                n += 1

    return _each(df, read, NODE)


def resolved(source: Column, target: Column) -> Column:
    """A target as a part's name: beside the source unless it begins with a slash, without `.` and `..`."""
    whole = F.when(target.startswith("/"), target).otherwise(F.concat(F.regexp_replace(source, r"[^/]*$", ""), target))
    none = F.array().cast("array<string>")

    def step(path: Column, name: Column) -> Column:
        climbs = (F.size(path) > 0) & (F.element_at(F.concat(F.array(F.lit("")), path), -1) != "..")
        up = F.when(climbs, F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(F.when(target.startswith("/"), path).otherwise(F.concat(path, F.array(name))))
        return F.when(name.isin("", "."), path).when(name == "..", up).otherwise(F.concat(path, F.array(name)))

    return F.array_join(F.aggregate(F.split(whole, "/"), none, step), "/")


def relationships(df: DataFrame) -> DataFrame:
    """(package, source_part, id, target, target_mode, type) of every relationship; internal targets are part names."""
    value = lambda k, other: F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit(other))
    source = F.regexp_replace(F.col("part"), r"(?:(.*/)|^)_rels/([^/]*)\.rels$", "$1$2")
    found = nodes(df, r"(^|/)_rels/[^/]*\.rels$").filter("depth = 1").select("package", source.alias("source_part"), value("Id", "").alias("id"), value("Target", "").alias("target"), value("TargetMode", "Internal").alias("target_mode"), F.substring_index(value("Type", ""), "/", -1).alias("type"))
    return found.withColumn("target", F.when(F.col("target_mode") == "External", F.col("target")).otherwise(resolved(F.col("source_part"), F.col("target")))).select("package", "source_part", "id", "target", "target_mode", "type")


def slides(df: DataFrame) -> DataFrame:
    """(package, slide, part, width, height): the slides in order, from 1, with the slide size.

    The presentation's list names relationships, these name parts; a package whose list finds none has the parts of
    slides in the order of their numbers.
    """
    main = graph.cut(nodes(df, r"^ppt/presentation\.xml$").filter("depth BETWEEN 1 AND 2"))
    names = graph.cut(directory(df).select("package", "part"))
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    whole = lambda k: F.coalesce(F.when(at(k).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(at(k)).cast("long")), F.lit(0))
    size = main.filter("tag = 'sldSz' AND depth = 1").groupBy("package").agg(F.first(whole("cx")).alias("width"), F.first(whole("cy")).alias("height"))
    lists = main.filter("tag = 'sldIdLst' AND depth = 1").select("package", F.col("node").alias("parent"))
    listed = main.filter("tag = 'sldId'").join(lists, ["package", "parent"], "left_semi").select("package", "node", at(f"{R}id").alias("id"))
    target = relationships(df).filter("source_part = 'ppt/presentation.xml'").select("package", "id", F.col("target").alias("part"))
    found = listed.join(target, ["package", "id"]).join(names, ["package", "part"], "left_semi").select("package", "part", F.struct(F.col("node").cast("long").alias("n"), F.lit("").alias("name")).alias("order"))
    plain = names.filter(F.col("part").rlike(r"^ppt/slides/slide[0-9]+\.xml$")).join(found.select("package").distinct(), "package", "left_anti")
    plain = plain.select("package", "part", F.struct(F.regexp_extract("part", "([0-9]+)\\.xml$", 1).cast("long").alias("n"), F.col("part").alias("name")).alias("order"))
    place = F.row_number().over(Window.partitionBy("package").orderBy("order"))
    d = found.unionByName(plain).withColumn("slide", place).join(size, "package", "left")
    return d.select("package", "slide", "part", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"))


def _form(form, group: bool) -> dict:
    """The numbers of a transform as written; `whole`: all elements that it needs are there."""
    found = {c.tag.rpartition("}")[2]: c for c in (form if form is not None else ())}
    read = lambda part, key: _real(found[part].get(key)) if part in found else math.nan
    flag = lambda key: form is not None and form.get(key) in ("1", "true")
    out = {n: read(p, k) for n, p, k in (("x", "off", "x"), ("y", "off", "y"), ("w", "ext", "cx"), ("h", "ext", "cy"), ("left", "chOff", "x"), ("top", "chOff", "y"), ("cw", "chExt", "cx"), ("ch", "chExt", "cy"))}
    return out | {"turn": _real(form.get("rot", "0")) if form is not None else 0.0, "flip_h": flag("flipH"), "flip_v": flag("flipV"), "whole": set(found) >= ({"off", "ext", "chOff", "chExt"} if group else {"off", "ext"})}


def _reason(form: Column, group: bool) -> Column:
    """Why a transform gives no map, or null."""
    known = lambda *names: reduce(lambda a, b: a & b, [~F.isnan(form[n]) & (F.abs(form[n]) < float("inf")) for n in names])
    usable = known("x", "y", "w", "h", "turn") & (F.least(form["w"], form["h"]) > 0)
    why = F.when(~form["whole"], "incomplete transform").when(~usable, "extent or rotation is not usable")
    return why.when(~(known("left", "top", "cw", "ch") & (F.least(form["cw"], form["ch"]) > 0)), "group has no child space") if group else why


def _map(form: Column, group: bool) -> Column:
    """The affine map of a transform: its child space, or the unit square, is scaled to its extent, mirrored and turned about its centre."""
    angle = F.radians(form["turn"] / 60000)
    fx, fy = F.when(form["flip_h"], -1.0).otherwise(1.0), F.when(form["flip_v"], -1.0).otherwise(1.0)
    sx, sy = (form["w"] / form["cw"], form["h"] / form["ch"]) if group else (form["w"], form["h"])
    dx, dy = (-form["left"] * sx - form["w"] / 2, -form["top"] * sy - form["h"] / 2) if group else (-form["w"] / 2, -form["h"] / 2)
    right, down = (F.cos(angle) * fx, F.sin(angle) * fx), (-F.sin(angle) * fy, F.cos(angle) * fy)
    return F.array(right[0] * sx, right[1] * sx, down[0] * sy, down[1] * sy, *(right[k] * dx + down[k] * dy + form["xy"[k]] + form["wh"[k]] / 2 for k in (0, 1)))


def _line(shape) -> tuple[int | None, str | None]:
    """Width and colour of a solid outline."""
    line = shape.find(f"{P}spPr/{A}ln")
    fill = line.find(f"{A}solidFill") if line is not None and line.find(f"{A}noFill") is None else None
    if fill is None or not len(fill):
        return None, None
    c = fill[0]
    width = _whole(line.get("w", "12700"))
    return 12700 if width is None else width, f"{c.tag.split('}')[1]}:{c.get('val') or c.get('lastClr') or sorted(c.attrib.items())}"


def objects(df: DataFrame) -> DataFrame:
    """Shapes, pictures, frames and connectors of every slide in paint order, also inside groups.

    x_emu to rotation_deg are the object's own; matrix maps its unit square to the slide through all groups, multiplied
    from the outermost inwards.  `unsupported` says why there is no matrix, or why a picture isn't simply a rectangle of pixels.
    """

    def read(name, package):
        for part, root in package.slide_parts():
            tree = root.find(f"{P}cSld/{P}spTree")
            todo, order = [(e, []) for e in reversed(tree if tree is not None else ())], 0
            while todo:
                e, groups = todo.pop()
                kind = e.tag.rpartition("}")[2]
                if kind == "grpSp":
                    inner = [*groups, _form(e.find(f"{P}grpSpPr/{A}xfrm"), True)]
                    todo.extend((k, inner) for k in reversed(e))
                elif e.tag in HEADS:
                    head, form = e.find(f"{P}{HEADS[e.tag]}/{P}cNvPr"), e.find(f"{P}xfrm" if kind == "graphicFrame" else f"{P}spPr/{A}xfrm")
                    at = {p: form.find(f"{A}{p}") if form is not None else None for p in ("off", "ext")}
                    size = [_whole(at[p].get(k, "0")) if at[p] is not None else None for p, k in (("off", "x"), ("off", "y"), ("ext", "cx"), ("ext", "cy"))]
                    preset, blip, crop = e.find(f"{P}spPr/{A}prstGeom"), e.find(f"{P}blipFill/{A}blip"), e.find(f"{P}blipFill/{A}srcRect")
                    clipped = e.find(f"{P}spPr/{A}custGeom") is not None or preset is not None and preset.get("prst") != "rect"
                    effects = any(x.tag.rpartition("}")[2] in EFFECTS for x in e.iter())
                    text = "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in e.iter(f"{A}p"))
                    own = _form(form, False)
                    yield (
                        name, part, order, len(groups), head.get("id") if head is not None else None, head.get("name") if head is not None else None, kind, preset.get("prst") if preset is not None else None, *size, (_whole(form.get("rot", "0")) or 0) / 60000 if form is not None else 0.0,
                        own["flip_h"], own["flip_v"], groups, own, clipped, effects, *_line(e), blip.get(f"{R}embed") if blip is not None else None, [_real(crop.get(k, "0"), 0.0) / 100000 for k in "ltrb"] if crop is not None else [0.0] * 4, text,
                    )
                    order += 1

    d = _numbered(df, read, RAW_OBJECT)
    outer = F.get(F.filter(F.transform("groups", lambda g: _reason(g, True)), lambda w: w.isNotNull()), F.lit(0))
    why = F.coalesce(outer, _reason(F.col("own"), False))
    still = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 1, 0, 0)))
    d = d.withColumns({"why": why, "maps": F.transform("groups", lambda g: _map(g, True)), "unit": _map(F.col("own"), False)})
    d = d.withColumn("around", F.aggregate("maps", still, affine)).withColumn("matrix", F.when(F.col("why").isNull(), affine(F.col("around"), F.col("unit"))))
    a, b, c, e = (F.get("matrix", F.lit(k)) for k in range(4))
    picture = (F.col("kind") == "pic") & F.col("matrix").isNotNull()
    skewed = F.abs(a * c + b * e) > 1e-7 * F.hypot(a, b) * F.hypot(c, e)
    unlike = F.when(picture, F.when(F.col("effects"), "has effects").when(F.col("clipped"), "clipped").when(a * e - b * c <= 0, "reflected").when(skewed, "not orthogonal"))
    return d.withColumn("unsupported", F.coalesce("why", unlike)).select(*(c.strip().split(" ")[0] for c in OBJECT.replace("array<double>", "array").split(",")))


# Drawing elements that change how a picture's pixels appear.
EFFECTS = frozenset("effectLst effectDag tile alphaModFix duotone lum grayscl clrChange scene3d sp3d".split())


def runs(df: DataFrame) -> DataFrame:
    """Text runs with the size and baseline that they inherit: level default, then paragraph default, then the run's own, times the text's autofit scale.

    size is null if nothing usable says it; east_asian: the run names a font for East Asian text.
    """

    def read(name, package):
        for part, root in package.slide_parts():
            for shape in root.iter(f"{P}sp"):
                head, body = shape.find(f"{P}nvSpPr/{P}cNvPr"), shape.find(f"{P}txBody")
                if body is None:
                    continue
                fit = body.find(f"{A}bodyPr/{A}normAutofit")
                scale = _real(fit.get("fontScale", "100000"), 100000.0) / 100000 if fit is not None else 1.0
                for k, paragraph in enumerate(body.iterfind(f"{A}p")):
                    about = paragraph.find(f"{A}pPr")
                    level = (_whole(about.get("lvl", "0")) or 0) + 1 if about is not None else 1
                    above = [body.find(f"{A}lstStyle/{A}lvl{level}pPr/{A}defRPr"), paragraph.find(f"{A}pPr/{A}defRPr")]
                    for order, run in enumerate(paragraph):
                        if run.tag not in (f"{A}r", f"{A}fld"):
                            continue
                        own = run.find(f"{A}rPr")
                        values: dict = {}
                        for source in (*above, own):
                            values.update(source.attrib if source is not None else {})
                        size, base = _real(values.get("sz")) / 100 * scale, _real(values.get("baseline", "0"))
                        font = own.find(f"{A}ea") if own is not None else None
                        usable = math.isfinite(size) and size > 0 and math.isfinite(base)
                        yield name, part, head.get("id") if head is not None else None, head.get("name") if head is not None else None, k, order, "".join(t.text or "" for t in run.iter(f"{A}t")), size if usable else None, base if usable else 0.0, font is not None and bool(font.get("typeface", "").strip())

    return _numbered(df, read, RUN)


def path_commands(df: DataFrame) -> DataFrame:
    """Commands of the shapes' own paths, for curves.decode(): points in the path's units, with its width and height."""

    def read(name, package):
        for part, root in package.slide_parts():
            for shape in root.iter(f"{P}sp"):
                head = shape.find(f"{P}nvSpPr/{P}cNvPr")
                for index, path in enumerate(shape.iterfind(f"{P}spPr/{A}custGeom/{A}pathLst/{A}path")):
                    for order, command in enumerate(path):
                        points = [{"x": _real(p.get("x")), "y": _real(p.get("y"))} for p in command.iterfind(f"{A}pt")]
                        yield name, part, head.get("id") if head is not None else None, head.get("name") if head is not None else None, index, order, command.tag.split("}")[1], points, _real(path.get("w", "0")), _real(path.get("h", "0"))

    return _numbered(df, read, COMMAND)


def bound_connectors(df: DataFrame) -> DataFrame:
    """Connectors with the ids and ports that their ends are bound to, and their arrows."""

    def read(name, package):
        for part, root in package.slide_parts():
            for e in root.iter(f"{P}cxnSp"):
                head = e.find(f"{P}nvCxnSpPr/{P}cNvPr")
                ends = [e.find(f"{P}nvCxnSpPr/{P}cNvCxnSpPr/{A}{t}") for t in ("stCxn", "endCxn")]
                arrows = [e.find(f"{P}spPr/{A}ln/{A}{t}") for t in ("headEnd", "tailEnd")]
                yield name, part, head.get("id") if head is not None else None, head.get("name") if head is not None else None, *(x.get(k) if x is not None else None for x in ends for k in ("id", "idx")), *(x.get("type", "none") if x is not None else "none" for x in arrows)

    return _numbered(df, read, BOUND)


def part_counts(df: DataFrame) -> DataFrame:
    """What every slide, layout and master holds, and the targets of its background pictures."""

    def read(name, package):
        for part in package.names:
            m = re.fullmatch(r"ppt/(slide|slideLayout|slideMaster)s/[^/]+\.xml", part)
            root = package.xml(part) if m else None
            if root is None:
                continue
            count = lambda *tags: sum(1 for e in root.iter() if e.tag in tags)  # noqa: B023, E731
            shape = list(root.iter(f"{P}sp"))
            back = [e.get(f"{R}embed") or "" for e in root.iterfind(f"{P}cSld/{P}bg/{P}bgPr/{A}blipFill/{A}blip")]
            connectors, frames = count(f"{P}cxnSp"), count(f"{P}graphicFrame")
            texts = sum(1 for x in shape if x.find(f"{P}txBody") is not None and x.find(f".//{A}t") is not None)
            yield name, part, m.group(1), len(shape) + connectors + frames, len(shape), texts, sum(len(t.text or "") for t in root.iter(f"{A}t")), connectors, count(f"{P}grpSp"), frames, count(f"{C}chart"), count(f"{A}tbl"), count(f"{P}pic"), back

    rows = _each(df, read, COUNT)
    related = relationships(df).select("package", F.col("source_part").alias("part"), "id", "target")
    named = rows.select("package", "part", F.posexplode("backgrounds").alias("at", "id")).join(related, ["package", "part", "id"], "left")
    targets = named.groupBy("package", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("target", F.lit("")).alias("t")))), lambda s: s["t"]).alias("targets"))
    found = rows.join(targets, ["package", "part"], "left").withColumn("backgrounds", F.coalesce("targets", F.array().cast("array<string>")))
    return found.select(*rows.columns)


def integrity(part: DataFrame, relation: DataFrame) -> DataFrame:
    """(package, rule, subject): empty media, external targets that aren't hyperlinks, internal targets that are missing."""
    empty = part.filter("part like 'ppt/media/%' and size = 0").select("package", F.lit("empty media").alias("rule"), F.col("part").alias("subject"))
    outside = relation.filter("lower(target_mode) = 'external' and type <> 'hyperlink'").select("package", F.lit("external target").alias("rule"), F.col("target").alias("subject"))
    inner = relation.filter("lower(target_mode) <> 'external' and type in ('image', 'audio', 'video', 'oleObject', 'package')").select("package", F.col("target").alias("part"))
    broken = inner.join(part.select("package", "part"), ["package", "part"], "left_anti").select("package", F.lit("missing target").alias("rule"), F.col("part").alias("subject"))
    return empty.unionByName(outside).unionByName(broken)
