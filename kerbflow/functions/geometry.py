"""Column expressions over points, boxes, colours and text labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature types by the words that name them, the first that fits wins.
FEATURE_WORDS = (("subsoil_drain", ("subsoil drain",)), ("flush_nib", ("flush nib",)), ("gap65", ("gap65",)), ("footpath", ("footpath",)), ("concrete", ("conc", "concrete")))
#: Keyword patterns of the text scan, by the name they are reported under.
KEYWORD_PATTERNS = (
    ("footpath", r"(?i)\bfootpath\b"),
    ("concrete", r"(?i)\bconcrete\b"),
    ("conc", r"(?i)\bconc\b"),
    ("gap65", r"(?i)\bgap\s*65\b"),
    ("subsoil drain", r"(?i)\bsubsoil\s+drain\b"),
    ("flush nib", r"(?i)\bflush\s+nib\b"),
    ("legend", r"(?i)\blegend\b"),
)


def feature_type(text: Column, words=FEATURE_WORDS) -> Column:
    """The first feature type one of whose words occurs in the text; null if none does."""
    low, out = F.lower(text), None
    for name, listed in words:
        hit = None
        for w in listed:
            one = low.contains(w)
            hit = one if hit is None else hit | one
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def link_score(gap: Column) -> Column:
    """1 at distance 0, one half at 100 points; four decimals."""
    return F.round(1 / (1 + gap / 100), 4)


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def to_pixel(v: Column, scale) -> Column:
    """Points to pixels; halves go to the even neighbour."""
    return F.bround(v * scale).cast("int")


def rgb_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two colours of three channels; null if either is."""
    part = lambda k: (a[k] - b[k]) * (a[k] - b[k])
    return F.sqrt(part(0) + part(1) + part(2))


def rgb255(color: Column, k: int) -> Column:
    return F.bround(clamp(color[k], 0.0, 1.0) * 255).cast("int")


def hex_color(color: Column) -> Column:
    return F.when(color.isNotNull(), F.format_string("#%02X%02X%02X", *(rgb255(color, k) for k in range(3))))


def y_overlap_ratio(ay0: Column, ay1: Column, by0: Column, by1: Column) -> Column:
    """Common height over the smaller height; 0 without overlap or height."""
    common = F.least(ay1, by1) - F.greatest(ay0, by0)
    small = F.least(ay1 - ay0, by1 - by0)
    return F.when((common > 0) & (small > 0), common / small).otherwise(0.0)


def normal_label(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


def scale_ratio(text: Column) -> Column:
    """n of the first ``1 : n``; null if there is none."""
    return F.expr("cast(null as int)") if text is None else F.regexp_extract(text, r"\b1\s*:\s*(\d+)\b", 1).try_cast("int")


def boxes_overlap(a: str, b: str, gap: float = 0.0) -> Column:
    """Closed boxes that meet once each is widened by ``gap``; ``a`` and ``b`` are column prefixes."""
    c = lambda p, k: F.col(f"{p}{k}")
    return (c(a, "x1") + gap >= c(b, "x0")) & (c(b, "x1") + gap >= c(a, "x0")) & (c(a, "y1") + gap >= c(b, "y0")) & (c(b, "y1") + gap >= c(a, "y0"))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """From a point to a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, clamp(((px - ax) * dx + (py - ay) * dy) / square, 0.0, 1.0)).otherwise(0.0)
    return distance(px, py, ax + t * dx, ay + t * dy)


def rect_distance(px, py, x0, y0, x1, y1) -> Column:
    """From a point to a box; 0 inside."""
    dx = F.greatest(x0 - px, F.lit(0.0), px - x1)
    dy = F.greatest(y0 - py, F.lit(0.0), py - y1)
    return F.sqrt(dx * dx + dy * dy)


def bezier(p0, c1, c2, p1, t) -> Column:
    """One coordinate of a cubic curve."""
    u = 1 - t
    return u * u * u * p0 + 3 * u * u * t * c1 + 3 * u * t * t * c2 + t * t * t * p1


def angle_between(a: Column, b: Column) -> Column:
    """The angle between two directions that have no sense, 0 to 90 degrees."""
    d = F.abs(F.pmod(a, F.lit(180.0)) - F.pmod(b, F.lit(180.0)))
    return F.least(d, 180.0 - d)


def sigma_class(z: Column) -> Column:
    return F.when(z <= 1, "green").when(z <= 2, "yellow").otherwise("red")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0 to 179, saturation and value 0 to 255 of 8-bit channels."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    turn = F.when(span == 0, 0.0).when(high == r, 60.0 * (g - b) / F.nullif(span, F.lit(0))).when(high == g, 120 + 60.0 * (b - r) / F.nullif(span, F.lit(0))).otherwise(240 + 60.0 * (r - g) / F.nullif(span, F.lit(0)))
    hue = F.bround(F.pmod(turn, F.lit(360.0)) / 2).cast("int") % 180
    return hue, F.when(high == 0, 0).otherwise(F.bround(255.0 * span / F.nullif(high, F.lit(0)))).cast("int"), high


def hsv_kinds(h: Column, s: Column, v: Column) -> dict[str, Column]:
    """Predicates on hue, saturation and value: grey and green surfaces, what is not black, and black."""
    return {"gray": (s <= 20) & (v >= 90), "green": h.between(35, 95) & (s >= 55) & (v >= 35), "non_black": v >= 55, "black": v <= 45}


def document_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("section") | low.contains("sec"), "Section").when(low.contains("longitudinal") | low.contains("profile"), "Longitudinal").otherwise("Plan")


def shortened(text: Column, most: int = 2000, suffix: str = "... (truncated)") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)
