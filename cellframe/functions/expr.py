"""Column expressions over cells: unit conversion, threshold and index equations, scores, masks, labels."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


@dataclass(frozen=True)
class Soil:
    """Constants of the threshold equation. ``n1`` is accepted and unused."""

    rho_w: float = 1000.0
    rho_s: float = 2650.0
    g: float = 9.81
    tau_star: float = 0.043
    k: float = 0.0474
    p: float = 1.0 / 6.0
    m1: float = 0.6
    n1: float = 0.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def finite(x) -> Column:
    """NULL for NaN and the infinities: a cell without a finite value has none."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nodata_to_null(x, nodata: float | None, match: str = "exact") -> Column:
    """NULL where a band equals its nodata value: exactly, or ``close`` to within 1e-8 + 1e-5 of it."""
    x = finite(x)
    if nodata is None:
        return x
    same = x == float(nodata) if match == "exact" else F.abs(x - float(nodata)) <= 1e-8 + 1e-5 * abs(float(nodata))
    return F.when(~same, x)


def at_least(x, low: float) -> Column:
    """``x`` no smaller than ``low``; NULL stays NULL, which ``greatest`` alone would replace."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))


def clipped(x, low: float, high: float, null_to: float | None = None) -> Column:
    x = col(x)
    out = F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(x, F.lit(float(high)))))
    return out if null_to is None else F.coalesce(out, F.lit(float(null_to)))


#: Fixed: keys of a quantity's spec, and unit names without spaces, that say in what unit it is.
MM_KEYS, MM_NAMES = ("value_mm", "mean_mm", "min_mm"), ("mm", "millimeter", "millimeters")
RATE_KEYS, RATE_NAMES = ("value_mm_hr", "mean_mm_hr", "min_mm_hr"), ("mm/hr", "mmh", "mmperhour", "millimeter/hour")


def converted(x, quantity: str, spec: dict) -> Column:
    """SI units of a quantity: diameters (``d50``) from mm to m, rainfall rates (``r``, ``rainfall_excess``) from mm/hr to m/s, else as it is.

    The spec says so by a key or by ``units``, whose case and spaces don't count;
    a largest value's key alone says nothing, and unknown units pass.
    """
    units = str(spec.get("units", "")).lower().replace(" ", "")
    if quantity == "d50" and (units in MM_NAMES or any(k in spec for k in MM_KEYS)):
        return col(x) / 1000.0
    if quantity in ("r", "rainfall_excess") and (units in RATE_NAMES or any(k in spec for k in RATE_KEYS)):
        return col(x) / 1000.0 / 3600.0
    return col(x)


def roughness(d50, soil: Soil = Soil()) -> Column:
    """Bare-soil roughness of a grain diameter in m."""
    return F.lit(soil.k) * F.pow(at_least(d50, EPS), F.lit(soil.p))


def critical_shear(d50, soil: Soil = Soil()) -> Column:
    return F.lit(soil.tau_star * soil.g * (soil.rho_s - soil.rho_w)) * col(d50)


def threshold_c(d50, na, r, soil: Soil = Soil()) -> Column:
    """The resistance threshold C of diameter (m), added roughness, and runoff rate (m/s)."""
    d = at_least(d50, EPS)
    nb = roughness(d, soil)
    below = F.lit(soil.rho_w * soil.g) * F.pow(nb, F.lit(1.5)) * F.pow(nb + at_least(na, 0.0), F.lit(-0.9)) * F.pow(at_least(r, EPS), F.lit(soil.m1))
    return F.pow(critical_shear(d, soil) / at_least(below, EPS), F.lit(1.0 / soil.m1))


def driving_index(a, s, alpha: float = 1.167) -> Column:
    """G = a * S^alpha with slopes under 0 taken as 0."""
    return col(a) * F.pow(at_least(s, 0.0), F.lit(alpha))


def specific_area(drainage, cell_size: float) -> Column:
    return col(drainage) / float(cell_size)


def drainage_area(a, cell_size: float) -> Column:
    return col(a) * float(cell_size)


def deterministic_pci(g, c) -> Column:
    """1 where C <= G, else 0; NULL where either is missing."""
    return F.when(col(g).isNotNull(), (col(c) <= col(g)).cast("double"))


def pci_from_count(count, n: int) -> Column:
    if n <= 0:
        raise ValueError("the number of samples must be over 0")
    return col(count) / float(n)


def safe_log10(x) -> Column:
    x = col(x)
    return F.when(x > 0, F.log10(x))


def effective_c(g, p, k: float) -> Column:
    """The threshold that a probability stands for: G less its logit over k."""
    q = clipped(p, 0.001, 0.999)
    return col(g) - F.ln(q / (1 - q)) / float(k)


def linear_score(terms: dict[str, float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for name, weight in terms.items():
        out = out + col(name) * float(weight)
    return out


def sigmoid(eta) -> Column:
    return 1 / (1 + F.exp(-col(eta)))


def normalized_difference(nir, red, scale: float = 2.75e-5, offset: float = -0.2) -> Column:
    """NDVI of scaled reflectances; NULL where their sum is 0."""
    a, b = col(nir) * scale + offset, col(red) * scale + offset
    return F.try_divide(a - b, a + b)


def clear_low_bits(qa) -> Column:
    return col(qa).bitwiseAND(F.lit(3)) == 0


def clear_cloud_bits(qa) -> Column:
    """Bits 3 and 4 are clear."""
    return (F.shiftright(col(qa), 3).bitwiseAND(F.lit(1)) == 0) & (F.shiftright(col(qa), 4).bitwiseAND(F.lit(1)) == 0)


def classified(p, threshold: float) -> Column:
    p = col(p)
    return F.when(p.isNotNull(), (p >= float(threshold)).cast("byte"))


def without_channels(x, g, cutoff: float = 120.0) -> Column:
    """NULL where the index is that of a channel; a cell without an index keeps its value."""
    return F.when(F.coalesce(col(g) < float(cutoff), F.lit(True)), col(x))


def core_valid(s="s", a="a", da="da", g="g", dz="dz", need_g: bool = True) -> Column:
    """All inputs present, slope and areas over 0, and the index too unless ``need_g`` is off."""
    out = F.lit(True)
    for x in (s, a, da, g, dz):
        out = out & col(x).isNotNull()
    for x in (s, da, *([g] if need_g else [])):
        out = out & (col(x) > 0)
    return F.coalesce(out, F.lit(False))


def non_channel(g="g", cutoff: float = 120.0, **inputs) -> Column:
    return core_valid(g=g, **inputs) & F.coalesce(col(g) < float(cutoff), F.lit(False))


def leaf_area(x, scale: float = 0.1) -> Column:
    """Leaf area index of its stored whole number."""
    return col(x) * float(scale)


def short_number(x) -> Column:
    """A number with six digits in its shortest form; a power of ten where it is under 1e-4, or 1e6 and over."""
    x = col(x).cast("double")
    science = F.format_string("%.5e", x)
    power = F.regexp_extract(science, r"e([+-]\d+)$", 1).cast("int")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.coalesce(*[F.when(power == k, bare(F.format_string(f"%.{5 - k}f", x))) for k in range(-4, 6)])
    return F.when(x == 0, F.lit("0")).otherwise(F.coalesce(plain, F.concat(bare(F.regexp_extract(science, r"^(.*)e", 1)), F.regexp_extract(science, r"(e[+-]\d+)$", 1))))


def name_part(x) -> Column:
    """A number as part of a name: ``-0.5`` becomes ``minus0p5``."""
    return F.regexp_replace(F.regexp_replace(short_number(x), "-", "minus"), r"\.", "p")


def top_label(percent) -> Column:
    return F.concat(F.lit("top"), F.regexp_replace(short_number(percent), r"\.", "p"))


def band_label(c_min, c_max) -> Column:
    return F.when(col(c_max).isNull(), F.concat(F.lit("cmin"), name_part(c_min), F.lit("_g"))).otherwise(F.concat(F.lit("cmin"), name_part(c_min), F.lit("_lt_cmax"), name_part(c_max), F.lit("_g")))


def erosion_label(threshold) -> Column:
    sign = F.when(col(threshold) < 0, F.lit("minus_")).otherwise(F.lit("plus_"))
    return F.concat(F.lit("erosion_mask_dod_lt_"), sign, name_part(F.abs(col(threshold))), F.lit("m"))


def equation_text(intercept, terms, prefix: str = "") -> Column:
    """``b + w*x - v*y`` of an intercept and an array of ``{name, weight}``, each number with four digits."""
    four = lambda x: F.regexp_replace(F.regexp_replace(F.format_string("%.3e", x), r"(\.\d*?)0+e", "$1e"), r"\.e", "e")

    def digits(x):
        power = F.regexp_extract(F.format_string("%.3e", x), r"e([+-]\d+)$", 1).cast("int")
        bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        plain = F.coalesce(*[F.when(power == k, bare(F.format_string(f"%.{3 - k}f", x))) for k in range(-4, 4)])
        return F.when(x == 0, F.lit("0")).otherwise(F.coalesce(plain, four(x)))

    each = F.transform(col(terms), lambda t: F.concat(F.when(t["weight"] >= 0, F.lit(" + ")).otherwise(F.lit(" - ")), digits(F.abs(t["weight"])), F.lit(f"*{prefix}"), t["name"]))
    return F.concat(digits(col(intercept)), F.array_join(each, ""))


def looked_up(code, names: dict, default: str = "unknown") -> Column:
    """The name of a code; codes are few and fixed."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, col(code)), F.lit(default))


def ring_area(ring) -> Column:
    """Planar area of a closed or open ring of ``{x, y}`` by the shoelace sum."""
    ring = col(ring)
    turn = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda s, x: s + x)) / 2


def polygon_area(rings) -> Column:
    """Planar area of ``rings``: the first one's, less those of the holes after it."""
    rings = col(rings)
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), F.lit(0.0), lambda s, r: s + ring_area(r))
    return F.when(F.size(rings) > 0, ring_area(F.get(rings, F.lit(0))) - holes).otherwise(F.lit(0.0))


def utm_forward(lon, lat, zone: Column | None = None) -> tuple[Column, Column, Column]:
    """``(zone, easting, northing)`` on WGS 84 by the transverse Mercator series, north positive."""
    lon, lat = col(lon), col(lat)
    zone = zone if zone is not None else F.floor((lon + 180) / 6).cast("int") + 1
    a, e2 = 6378137.0, 0.00669437999014132
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2.0)))
    t, c, aa = F.pow(F.tan(phi), F.lit(2.0)), ep2 * F.pow(F.cos(phi), F.lit(2.0)), lam * F.cos(phi)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - 35 * e2**3 / 3072 * F.sin(6 * phi))
    x = 0.9996 * n * (aa + (1 - t + c) * aa**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * aa**5 / 120) + 500000.0
    y = 0.9996 * (m + n * F.tan(phi) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * aa**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * aa**6 / 720))
    return zone, x, y


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it: long formulas stay as long as they are written."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def utm_inverse(x, y, zone: Column) -> Column:
    """``{lon, lat}`` of metres in a zone on WGS 84, the inverse of ``utm_forward``.

    The latitude whose arc is ``y`` is a series in the third flattening; what
    lies off the middle meridian follows from powers of the distance to it.
    """
    x, y = col(x), col(y)
    a, e2 = 6378137.0, 0.00669437999014132
    ep2 = e2 / (1 - e2)
    f = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    arc = y / (0.9996 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))

    def latitude(mu):
        return mu + (3 * f / 2 - 27 * f**3 / 32) * F.sin(2 * mu) + (21 * f**2 / 16 - 55 * f**4 / 32) * F.sin(4 * mu) + 151 * f**3 / 96 * F.sin(6 * mu) + 1097 * f**4 / 512 * F.sin(8 * mu)

    def around(foot):
        w = 1 - e2 * F.pow(F.sin(foot), F.lit(2.0))
        t, c, d = F.pow(F.tan(foot), F.lit(2.0)), ep2 * F.pow(F.cos(foot), F.lit(2.0)), (x - 500000.0) * F.sqrt(w) / (0.9996 * a)
        return F.struct(foot.alias("foot"), t.alias("t"), c.alias("c"), d.alias("d"), (F.tan(foot) * w / (1 - e2)).alias("bend"))

    def point(v):
        t, c, d = v["t"], v["c"], v["d"]
        lat = v["foot"] - v["bend"] * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d**6 / 720)
        lam = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d**5 / 120) / F.cos(v["foot"])
        return F.struct((F.degrees(lam) + (zone * 6 - 183)).alias("lon"), F.degrees(lat).alias("lat"))

    return let(let(let(arc, latitude), around), point)
