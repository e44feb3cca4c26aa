"""Geometry and colour arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_PER_INCH, EMU_PER_POINT = 914400, 12700


def number(value: Column, default: float = 0.0) -> Column:
    """A lenient number: not finite or not a number gives the default."""
    n = value.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), n).otherwise(F.lit(default))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def angle_difference(a: Column, b: Column) -> Column:
    return F.pmod(a - b + 180, F.lit(360)) - 180


def projected_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two ranges share; below zero is the gap."""
    return F.least(F.greatest(a0, a1), F.greatest(b0, b1)) - F.greatest(F.least(a0, a1), F.least(b0, b1))


def rotated_bounds(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> Column:
    """struct(x, y, w, h): upright box around a box rotated about its centre, rounded half to even."""
    r = F.radians(degrees)
    nw, nh = F.abs(w * F.cos(r)) + F.abs(h * F.sin(r)), F.abs(w * F.sin(r)) + F.abs(h * F.cos(r))
    return F.struct(F.bround(x + w / 2 - nw / 2).alias("x"), F.bround(y + h / 2 - nh / 2).alias("y"), F.bround(nw).alias("w"), F.bround(nh).alias("h"))


def segment_hits_box(x0, y0, x1, y1, bx, by, bw, bh, pad) -> Column:
    """Whether a segment meets a box grown by pad; touching counts (slab test)."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    apart = F.lit(False)
    for p, d, a, b in ((x0, x1 - x0, bx - pad, bx + bw + pad), (y0, y1 - y0, by - pad, by + bh + pad)):
        s, t = (a - p) / F.nullif(d, F.lit(0.0)), (b - p) / F.nullif(d, F.lit(0.0))
        flat = d == 0
        apart |= flat & ((p < a) | (p > b))
        lo, hi = F.greatest(lo, F.when(flat, 0.0).otherwise(F.least(s, t))), F.least(hi, F.when(flat, 1.0).otherwise(F.greatest(s, t)))
    return ~apart & (lo <= hi)


def point_segment(px, py, x0, y0, x1, y1) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / F.nullif(n, F.lit(0.0)))))
    return F.hypot(px - x0 - t * dx, py - y0 - t * dy)


def crosses(px, py, x0, y0, x1, y1) -> Column:
    """1 if a ray to the right of the point crosses the edge; the sum over a polygon's edges is odd inside."""
    straddles = (y0 > py) != (y1 > py)
    return F.when(straddles & (px < (x1 - x0) * (py - y0) / F.nullif(y1 - y0, F.lit(0.0)) + x0), 1).otherwise(0)


def blend(mode: str, over: Column, under: Column, alpha: Column) -> Column:
    """A channel 0..255 painted over another by normal, multiply or screen, rounded half to even."""
    mixed = {"normal": over, "multiply": over * under / 255, "screen": 255 - (255 - over) * (255 - under) / 255}[mode]
    return F.bround(mixed * alpha + under * (1 - alpha))


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.30 * r + 0.59 * g + 0.11 * b


def on_polygon(px, py, x0, y0, x1, y1) -> Column:
    """Whether the point is on the edge (to 1e-7); a polygon that has it on some edge contains it."""
    return point_segment(px, py, x0, y0, x1, y1) < 1e-7


def affine(a: Column, b: Column) -> Column:
    """Array of six: the affine map (a, b, c, d, e, f) that applies b, then a."""
    m, n = ([F.get(v, F.lit(k)) for k in range(6)] for v in (a, b))
    return F.array(m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def moved(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point under an affine map."""
    v = [F.get(m, F.lit(k)) for k in range(6)]
    return F.struct((v[0] * x + v[2] * y + v[4]).alias("x"), (v[1] * x + v[3] * y + v[5]).alias("y"))


def place(sx, sy, sw, sh, tx, ty, tw, th, x, y, w, h) -> Column:
    """struct(x, y, w, h): a box of a source frame in a target frame, scaled alike both ways and centred; null if it isn't in the source."""
    k = F.least(tw / sw, th / sh)
    inside = (x >= sx) & (y >= sy) & (x + w <= sx + sw + 1e-8) & (y + h <= sy + sh + 1e-8)
    return F.when(inside, F.struct((tx + (tw - sw * k) / 2 + (x - sx) * k).alias("x"), (ty + (th - sh * k) / 2 + (y - sy) * k).alias("y"), (w * k).alias("w"), (h * k).alias("h")))


def fitted(mode: str, w: Column, h: Column, cw: Column, ch: Column) -> Column:
    """struct(x, y, w, h): where an image of w by h lies on a canvas of cw by ch: within it (`contain`), over all of it (`crop`), or `stretch`ed to it; centred."""
    k = {"contain": F.least(cw / w, ch / h), "crop": F.greatest(cw / w, ch / h), "stretch": None}[mode]
    nw, nh = (cw, ch) if k is None else (w * k, h * k)
    return F.when((w > 0) & (h > 0) & (cw > 0) & (ch > 0), F.struct(((cw - nw) / 2).alias("x"), ((ch - nh) / 2).alias("y"), nw.alias("w"), nh.alias("h")))


def same_points(emu: Column, points: Column, eighths: Column) -> Column:
    """Whether a length in EMU is one in points, exactly or, where `eighths` holds, rounded to an eighth of a point."""
    near = lambda v: F.abs(v - points) <= 1e-6
    return near(emu / EMU_PER_POINT) | (eighths & near(F.floor((8 * emu + EMU_PER_POINT // 2) / EMU_PER_POINT) / 8))


def unmix(observed: Column, alpha: Column, under: Column) -> Column:
    """struct(value, error, clamped): the channel 0..255 that, painted with alpha over `under`, gives what is observed.

    value is 0 where alpha is 0, null where no channel value can give it (beyond half a code).
    """
    v = (observed - (1 - alpha) * under) / F.nullif(alpha, F.lit(0.0))
    slack = 0.5000001 / F.nullif(alpha, F.lit(0.0))
    kept = F.when(alpha == 0, 0.0).when((v < -slack) | (v > 255 + slack), None).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))))
    return F.struct(kept.alias("value"), F.when(alpha > 0, F.abs(kept * alpha + (1 - alpha) * under - observed)).otherwise(0.0).alias("error"), ((alpha > 0) & ((v < 0) | (v > 255))).alias("clamped"))


def decode_mask(meaning: str, space: str, *channels: Column) -> Column:
    """A mask sample 0..1 of 8-bit channels: alpha, gray luminosity, or RGB luminosity; other combinations are refused."""
    if (meaning, space, len(channels)) in (("alpha", "alpha", 1), ("luminosity", "DeviceGray", 1)):
        return channels[0] / 255
    if (meaning, space, len(channels)) == ("luminosity", "DeviceRGB", 3):
        return gray(*channels) / 255
    raise ValueError("no such mask")


def linear_coordinate(x, y, bx, by, bw, bh, degrees) -> Column:
    """Where a point lies along a direction, from 0 at the first corner of the box that it meets to 1 at the last."""
    a = F.radians(F.bround(degrees * 60000) / 60000)
    dx, dy = F.cos(a), F.sin(a)
    ends = [px * dx + py * dy for px in (bx, bx + bw) for py in (by, by + bh)]
    lo, hi = F.least(*ends), F.greatest(*ends)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x * dx + y * dy - lo) / (hi - lo)))


def radial_coordinate(x, y, bx, by, bw, bh, radius=None) -> Column:
    """A point's distance from the box's centre as a share of the radius (that of the circle around the box, if none is given), at most 1; null for a radius beyond it."""
    most = F.hypot(bw, bh) / 2
    r = most if radius is None else radius
    return F.when((r > 0) & (r <= most), F.least(F.lit(1.0), F.hypot(x - bx - bw / 2, y - by - bh / 2) / r))


def gradient(t: Column, stops: Column, channel: str) -> Column:
    """A channel at t on the lines between stops (array of struct(position, channel...), ascending), constant beyond them."""
    at = lambda s: F.bround(s["position"] * 100000) / 100000
    below, above = F.filter(stops, lambda s: at(s) <= t), F.filter(stops, lambda s: at(s) > t)
    a, b = F.element_at(F.when(F.size(below) > 0, below), -1), F.get(above, F.lit(0))
    return F.when(a.isNull(), b[channel]).when(b.isNull(), a[channel]).otherwise(a[channel] + (b[channel] - a[channel]) * (t - at(a)) / (at(b) - at(a)))


def radial_stops(stops: Column, radius, w, h) -> Column:
    """Stops of a centred circle of this radius as stops of the circle around its box; the last colour goes on to the edge.  Null where the circle isn't inside, or there are over 31 stops."""
    k = radius / (F.hypot(w, h) / 2)
    last = F.element_at(stops, -1)
    moved_ = F.transform(stops, lambda s: s.withField("position", s["position"] * k))
    return F.when((k > 0) & (k < 1) & (F.size(stops) <= 31), F.concat(moved_, F.array(last.withField("position", F.lit(1.0)))))


def composite(mode: str, over: Column, under: Column, alpha: Column) -> Column:
    """Six hex digits of one colour painted over another."""
    part = lambda c, k: F.conv(F.substring(c, 2 * k + 1, 2), 16, 10).cast("double")
    return F.concat(*(F.lpad(F.hex(blend(mode, part(over, k), part(under, k), alpha).cast("long")), 2, "0") for k in range(3)))


def paint_xml(kind: Column, colour: Column, alpha: Column, angle: Column, focus: Column, stops: Column, opacity: Column) -> Column:
    """A fill as drawing XML: none, group, solid, linear (angle) or path (focus [u, v]) with stops of struct(position, color, alpha)."""
    whole = lambda v, k: F.bround(v * k).cast("long").cast("string")
    tint = lambda c, a: F.concat(F.lit('<a:srgbClr val="'), c, F.lit('"><a:alpha val="'), whole(a * opacity, 100000), F.lit('"/></a:srgbClr>'))
    inner = F.array_join(F.transform(stops, lambda s: F.concat(F.lit('<a:gs pos="'), whole(s["position"], 100000), F.lit('">'), tint(s["color"], s["alpha"]), F.lit("</a:gs>"))), "")
    u, v = (F.bround(F.get(focus, F.lit(k)) * 100000).cast("long") for k in (0, 1))
    linear = F.concat(F.lit('<a:lin ang="'), whole(angle, 60000), F.lit('" scaled="0"/>'))
    path = F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in ('<a:path path="circle"><a:fillToRect l="', u, '" t="', v, '" r="', 100000 - u, '" b="', 100000 - v, '"/></a:path><a:tileRect/>')))
    shade = lambda form: F.concat(F.lit('<a:gradFill rotWithShape="1"><a:gsLst>'), inner, F.lit("</a:gsLst>"), form, F.lit("</a:gradFill>"))
    return F.when(kind == "none", "<a:noFill/>").when(kind == "group", F.when(opacity == 1, "<a:grpFill/>")).when(kind == "solid", F.concat(F.lit("<a:solidFill>"), tint(colour, alpha), F.lit("</a:solidFill>"))).when(kind == "linear", shade(linear)).when(kind == "path", shade(path))


def compositing_xml(opacity: Column, mask_xml: Column) -> Column:
    """Group effects: an alpha mask's fill, and an opacity below 1; empty without either."""
    parts = F.concat(F.coalesce(F.concat(F.lit("<a:alphaMod><a:cont><a:fill>"), mask_xml, F.lit("</a:fill></a:cont></a:alphaMod>")), F.lit("")), F.when(opacity != 1, F.concat(F.lit('<a:alphaModFix amt="'), F.bround(opacity * 100000).cast("long").cast("string"), F.lit('"/>'))).otherwise(""))
    return F.when(parts == "", "").otherwise(F.concat(F.lit("<a:effectDag>"), parts, F.lit("</a:effectDag>")))


def primitive_path(tag: Column, v: dict[str, Column]) -> Column:
    """SVG path text of a rectangle (x, y, width, height), circle (cx, cy, r), ellipse (cx, cy, rx, ry) or line (x1, y1, x2, y2); null where it has no size."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    rx, ry = F.when(tag == "circle", v["r"]).otherwise(v["rx"]), F.when(tag == "circle", v["r"]).otherwise(v["ry"])
    round_ = text("M ", v["cx"] - rx, " ", v["cy"], " A ", rx, " ", ry, " 0 1 0 ", v["cx"] + rx, " ", v["cy"], " A ", rx, " ", ry, " 0 1 0 ", v["cx"] - rx, " ", v["cy"], " Z")
    box = text("M ", v["x"], " ", v["y"], " H ", v["x"] + v["width"], " V ", v["y"] + v["height"], " H ", v["x"], " Z")
    line = text("M ", v["x1"], " ", v["y1"], " L ", v["x2"], " ", v["y2"])
    return F.when(tag.isin("circle", "ellipse") & (rx > 0) & (ry > 0), round_).when((tag == "rect") & (v["width"] > 0) & (v["height"] > 0), box).when(tag == "line", line)


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes of x0, y0, x1, y1 meet; touching counts."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])
