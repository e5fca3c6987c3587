"""Column builders shared by the operators: fixed-point helpers, levels, colour and tone."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX16 = 65535


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.least(v, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)


def trunc(v: Column) -> Column:
    """Truncation toward zero, as a store to an integer does."""
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")


def clamp16(v: Column) -> Column:
    return clamp(v, 0, MAX16)


def levels(v: Column, black: int, white: int, bits: int = 14) -> Column:
    """Black and white level stretch of 16-bit values; the white level is taken at 99.3 percent."""
    b, w = black << (16 - bits), int((white << (16 - bits)) * 0.993)
    return clamp16(trunc((v - F.lit(b)) * F.lit(65535.0) / F.lit(float(w - b))))


def promote(v: Column, bits: int, to: int = 14) -> Column:
    return F.shiftleft(v, to - bits)


def demote(v: Column, bits: int, of: int = 14) -> Column:
    """Undo promote() with rounding."""
    s = of - bits
    return F.shiftright(v + F.lit(1 << (s - 1)), s) if s else v


def restricted_range(v: Column, black: int, white: int, add: int = 0) -> Column:
    """Rescale a sensor's restricted range to the full range of its bit depth, in 14 bits."""
    depth = (white - black - 1).bit_length()
    a = black + 2 ** (depth + add) - 1
    s = (white - black) * 2 ** (14 - depth)
    return F.least(trunc((v - F.lit(black)) * F.lit(float(s - black)) / F.lit(float(a - black)) + F.lit(black + 0.5)), F.lit(16383))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 4 + g * 11 + b, 4)


def matrix(rgb: Sequence[Column], m: Sequence[float]) -> list[Column]:
    """A 3x3 matrix (row-major) applied to three columns; zero terms are left out."""
    out = []
    for row in range(3):
        terms = [rgb[k] * F.lit(float(m[3 * row + k])) for k in range(3) if m[3 * row + k]]
        total = terms[0] if terms else F.lit(0.0)
        for t in terms[1:]:
            total = total + t
        out.append(total)
    return out


def compose(*matrices: Sequence[float]) -> list[float]:
    """Product of 3x3 matrices (row-major), computed once on the driver."""
    out = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    for m in matrices:
        out = [sum(out[3 * i + k] * m[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]
    return out


def invert(m: Sequence[float]) -> list[float]:
    a, b, c, d, e, f, g, h, i = map(float, m)
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [x / det for x in (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)]


def kelvin_gains(kelvin: Column, knots: Sequence[tuple[float, float, float, float]]) -> list[Column]:
    """Red, green and blue gains, linear between the knots (kelvin, r, g, b), clamped to their range."""
    k = clamp(kelvin, knots[0][0], knots[-1][0])
    out = []
    for c in (1, 2, 3):
        value = F.lit(float(knots[-1][c]))
        for lo, hi in zip(knots[-2::-1], knots[:0:-1]):
            w = (F.lit(float(hi[0])) - k) / F.lit(float(hi[0] - lo[0]))
            value = F.when(k < hi[0], F.lit(float(lo[c])) * w + F.lit(float(hi[c])) * (F.lit(1.0) - w)).otherwise(value)
        out.append(value)
    return out


def tint_shape(t: Column) -> Column:
    return F.signum(t) * F.pow(F.abs(t) / 10.0, F.lit(1.75)) * 10.0


def tinted(gains: Sequence[Column], tint: Column) -> list[Column]:
    """Gains with a tint, divided by the smallest."""
    r, g, b = gains[0] + tint / 19.0, gains[1], gains[2] + tint / 11.0
    least = F.least(r, g, b)
    return [r / least, g / least, b / least]


def gamut_compress(r: Column, g: Column, b: Column, y: Column, knee: float = 0.5) -> list[Column]:
    """Desaturate toward y where a channel is far below it: a Reinhard shoulder on the distance beyond the knee."""
    low = F.least(r, g, b)
    d = (y - low) / y
    over = (d - F.lit(knee)) / F.lit(1 - knee)
    shaped = F.when(d < knee, d).otherwise(F.lit(knee) + F.lit(1 - knee) * over / (over + 1.0))
    f = F.when(y <= 0, F.lit(1.0)).when(d == 0, F.lit(1.0)).otherwise(shaped / d)
    return [(c - y) * f + y for c in (r, g, b)]


def s_curve(p: Column, dark_range: float, dark: float, light_range: float, light: float, lighten: float = 0.0) -> Column:
    """Dark and light contrast, then lightening, of a value between 0 and 1."""

    def bend(v: Column, extent: float, factor: float) -> Column:
        if not extent:
            return v
        k = factor / (2 * extent)
        return F.when((v > 0) & (v < extent), F.pow(v, F.lit(1.0) + (F.lit(extent) - v) * F.lit(k) * (F.lit(1.0) - v / F.lit(extent)))).otherwise(v)

    v = bend(p, dark_range, dark)
    v = F.lit(1.0) - bend(F.lit(1.0) - v, light_range, light)
    return F.pow(v, F.lit(1.0 - lighten)) if lighten else v


def saturation(rgb: Sequence[Column], factor: float) -> list[Column]:
    y = luma(*rgb)
    return [clamp16(y + trunc((c - y) * F.lit(float(factor)))) for c in rgb]


def vibrance(rgb: Sequence[Column], factor: float) -> list[Column]:
    """Saturation that spares what is saturated already."""
    moved = saturation(rgb, factor)
    if factor <= 1:
        return moved
    top, low = F.greatest(*rgb), F.least(*rgb)
    s = F.when(top > 0, (top - low) / top).otherwise(F.lit(0.0))
    w = F.least(F.lit(1.0), 2.0 * s / (s * s + 1.0))
    return [clamp16(trunc(c * w + m * (F.lit(1.0) - w))) for c, m in zip(rgb, moved)]


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value of components between 0 and 1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = (
        F.when(d == 0, F.lit(0.0))
        .when(top == r, F.pmod(60.0 * (g - b) / d, F.lit(360.0)))
        .when(top == g, 60.0 * (b - r) / d + 120.0)
        .otherwise(60.0 * (r - g) / d + 240.0)
    )
    return h, F.when(top == 0, F.lit(0.0)).otherwise(d / top), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    c = v * s
    x = c * (F.lit(1.0) - F.abs(F.pmod(h / 60.0, F.lit(2.0)) - 1.0))
    m = v - c
    zero = F.lit(0.0)
    sector = F.floor(F.pmod(h, F.lit(360.0)) / 60.0)
    picks = [(c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x)]
    out = []
    for k in range(3):
        value = picks[5][k]
        for n in range(4, -1, -1):
            value = F.when(sector == n, picks[n][k]).otherwise(value)
        out.append(value + m)
    return out


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    h, _, top = hsv(r, g, b)
    low = F.least(r, g, b)
    light = (top + low) / 2.0
    d = top - low
    return h, F.when(d == 0, F.lit(0.0)).otherwise(d / (F.lit(1.0) - F.abs(2.0 * light - 1.0))), light


def ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """Integer luma and chroma, every term truncated on its own."""
    t = lambda c, k: trunc(c * F.lit(k))
    return [
        t(r, 0.299) + t(g, 0.587) + t(b, 0.114),
        F.lit(32768) + t(r, -0.168736) + t(g, -0.331264) + F.shiftright(b, 1),
        F.lit(32768) + F.shiftright(r, 1) + t(g, -0.418688) + t(b, -0.081312),
    ]


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    u, v = cb - 32768, cr - 32768
    t = lambda c, k: trunc(c * F.lit(k))
    return [clamp16(y + t(v, 1.402)), clamp16(y + t(u, -0.344136) + t(v, -0.714136)), clamp16(y + t(u, 1.772))]


def toning(rgb: Sequence[Column], strength: float, tone: Sequence[int]) -> list[Column]:
    dry = (100 - strength / 3) / 100
    return [clamp16(trunc(c * F.lit(dry) + c * F.lit(strength / 3 / 100 * t / 255))) for c, t in zip(rgb, tone)]


def raw_to_ev(v: Column, black: int) -> Column:
    """Exposure value in 1/65536 steps."""
    return trunc(F.log2(F.greatest(F.lit(1), v - black).cast("double")) * 65536.0)


def ev_to_raw(ev: Column, black: int) -> Column:
    return trunc(F.lit(float(black)) + F.pow(F.lit(2.0), ev / 65536.0))


def log_encode(v: Column, black: int, top: int) -> Column:
    """Log companding with a linear toe, back to the input's scale."""
    x = clamp((v - black) / F.lit(float(top - black)), 0.0, 1.0)
    toe = 0.0061
    slope = 1 / (toe * 9.72 * 0.6931471805599453)
    import math

    at = (math.log2(toe) - 1) / 9.72 + 1
    y = F.when(x < toe, F.lit(at) + (x - F.lit(toe)) * F.lit(slope)).otherwise((F.log2(F.greatest(x, F.lit(toe))) - 1.0) / 9.72 + 1.0)
    return F.floor(F.greatest(y, F.lit(0.0)) * F.lit(float(top)) + 0.5)


def log_decode(e: Column, black: int, top: int) -> Column:
    """Inverse of log_encode() above the toe."""
    return F.pow(F.lit(2.0), (e / F.lit(float(top)) - 1.0) * 9.72 + 1.0) * F.lit(float(top - black)) + F.lit(float(black))


def contrast_factor(luma_: Column, slider: float, pivot: float = 0.75) -> Column:
    """Gain per luma that bends tones around a pivot; 1 at luma 0."""
    s, h = -slider, 2.0 ** (-1.5 * slider)
    v = F.pow(luma_ / 65536.0, F.lit(pivot))
    n = s_curve(v, 0.7, s * 0.5, 0.0, 0.0)
    q = (n - 0.2) / 0.8
    n = F.when(n > 0.2, n * (F.lit(1.0) - q) + n * F.lit(h) * q).otherwise(n)
    return F.when(luma_ == 0, F.lit(1.0)).otherwise(v / n)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def gradient_mask(x: Column, y: Column, x1: int, y1: int, x2: int, y2: int) -> Column:
    """0 before the line through point 1, 65535 beyond the line through point 2, linear between."""
    a, b = x2 - x1, y2 - y1
    c1, c2 = a * x1 + b * y1, a * x2 + b * y2
    c = x * a + y * b
    return F.when(c <= c1, F.lit(0)).when(c >= c2, F.lit(65535)).otherwise(trunc((c - c1) * F.lit(65535.0) / F.lit(float(c2 - c1))))


def vignette_mask(x: Column, y: Column, w: int, h: int, radius: float, shape: float = 0.0) -> Column:
    """Cosine fall-off beyond the radius, mirrored to the four quarters."""
    import math

    dx, dy = F.abs(x - F.lit((w - 1) / 2)), F.abs(y - F.lit((h - 1) / 2))
    diag = math.hypot(w / 2, h / 2)
    r = diag * radius * (1 + shape / 5)
    d = F.sqrt(dx * dx + dy * dy)
    return F.when(d > r, F.lit(0.5) - 0.5 * F.cos(F.lit(math.pi) * (d - r) / F.lit(2 * (diag - r)))).otherwise(F.lit(0.0))


def median_of(values: Sequence[Column]) -> Column:
    """Middle element of a fixed number of columns (the upper one of an even number)."""
    return F.element_at(F.array_sort(F.array(*values)), len(values) // 2 + 1)


def timecode(frame: Column, fps: Column) -> Column:
    """HH:MM:SS:FF with the rate rounded, no drop frames."""
    rate = F.round(fps).cast("long")
    s = idiv(frame, rate)
    return F.format_string("%02d:%02d:%02d:%02d", F.pmod(idiv(s, 3600), F.lit(24)), F.pmod(idiv(s, 60), F.lit(60)), F.pmod(s, F.lit(60)), F.pmod(frame, rate))


def bcd(v: Column) -> Column:
    """Two decimal digits in one byte."""
    return F.call_function("shiftleft", idiv(v, 10), F.lit(4)).bitwiseOR(F.pmod(v, F.lit(10)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: the planner copies an expression into each place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def knot_curve(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """A curve through few knots, straight between them, level beyond the ends."""

    def curve(u: Column) -> Column:
        out = F.lit(float(knots[-1][1]))
        for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
            out = F.when(u < x1, F.lit(float(y0)) + (u - float(x0)) * ((float(y1) - float(y0)) / (float(x1) - float(x0)))).otherwise(out)
        return F.when(u < knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)

    return bound(u, curve)


def hue_curves(h: Column, s: Column, v: Column, hue_luma, hue_sat, hue_hue, luma_sat) -> Column:
    """HSV (hue in degrees, the others 0 to 1) under four curves of -1 to 1, as a struct; hue is read in steps of 0.01, luma in steps of 1/36000."""

    def by_hue(c: Column) -> Column:
        at_hue = F.floor(F.round(c["h"] * 100, 6)) / 100.0
        return F.struct(
            F.pmod(c["h"] + 60.0 * knot_curve(at_hue, hue_hue) + 360.0, F.lit(360.0)).alias("h"),
            (c["s"] * (1.0 + 2.0 * knot_curve(at_hue, hue_sat))).alias("s"), (c["v"] * (1.0 + 2.0 * knot_curve(at_hue, hue_luma) * c["s"])).alias("v"),
        )

    def by_luma(c: Column) -> Column:
        return F.struct(c["h"].alias("h"), (c["s"] * (1.0 + 2.0 * knot_curve(F.floor(F.round(c["v"] * 36000, 6)) / 36000.0, luma_sat))).alias("s"), c["v"].alias("v"))

    return bound(bound(F.struct(h.alias("h"), s.alias("s"), v.alias("v")), by_hue), by_luma)


def gradation(rgb: Sequence[Column], luma_curve, curves) -> list[Column]:
    """The common curve on all channels, then each channel's own; values 0 to 65535."""
    step = lambda c, knots: clamp16(trunc(F.round(knot_curve(c / 65535.0, knots) * 65535.0, 6)))
    return [step(step(c, luma_curve), own) for c, own in zip(rgb, curves)]


def pseudo_inverse(rows: Sequence[Sequence[float]]) -> list[list[float]]:
    """n x 3 pseudo-inverse of an n x 3 matrix of full rank, by its normal equations; out[i][j] as the transposed inverse."""
    square = [sum(r[i] * r[j] for r in rows) for i in range(3) for j in range(3)]
    inverse = invert(square)
    return [[sum(inverse[3 * j + k] * r[k] for k in range(3)) for j in range(3)] for r in rows]


#: The cone response matrix of CIECAM02.
CONES = [0.7328, 0.4296, -0.1624, -0.7036, 1.6975, 0.0061, 0.0030, 0.0136, 0.9834]


def daylight_xyz(kelvin: float) -> list[float]:
    """White point at Y = 1: the CIE daylight locus from 4000 K on, below it the cubic approximation of black bodies (Kim et al., 2002)."""
    t = 1e3 / kelvin
    if kelvin < 4000:
        x = -0.2661239 * t**3 - 0.2343589 * t**2 + 0.8776956 * t + 0.179910
        y = (-1.1063814 * x**3 - 1.34811020 * x**2 + 2.18555832 * x - 0.20219683) if kelvin < 2222 else (-0.9549476 * x**3 - 1.37418593 * x**2 + 2.09137015 * x - 0.16748867)
    else:
        x = (-4.6070 * t**3 + 2.9678 * t**2 + 0.09911 * t + 0.244063) if kelvin <= 7000 else (-2.0064 * t**3 + 1.9018 * t**2 + 0.24748 * t + 0.237040)
        y = -3 * x * x + 2.87 * x - 0.275
    return [x / y, 1.0, (1 - x - y) / y]


def _times(m: Sequence[float], v: Sequence[float]) -> list[float]:
    return [sum(m[3 * i + j] * v[j] for j in range(3)) for i in range(3)]


def gains_at(kelvin: float, knots: Sequence[tuple[float, float, float, float]]) -> list[float]:
    """Red, green and blue gains between two knots of temperature."""
    k = min(max(kelvin, knots[0][0]), knots[-1][0])
    for lo, hi in zip(knots, knots[1:]):
        if k < hi[0]:
            w = (hi[0] - k) / (hi[0] - lo[0])
            return [lo[c] * w + hi[c] * (1 - w) for c in (1, 2, 3)]
    return list(knots[-1][1:])


def white_balance(kelvin: float, tint: float, knots, camera: Sequence[float], gamut: Sequence[float]) -> tuple[list[float], list[float]]:
    """Gains of all channels (1 at least) and the 3x3 matrix that follows them.

    The matrix undoes the untinted gains, goes from the camera's colours to XYZ, adapts the white of
    the temperature to that of 6500 K in cone space, and ends in the gamut. ``camera`` is XYZ to camera,
    ``gamut`` XYZ to RGB.
    """
    plain = gains_at(kelvin, knots)
    shaped = math.copysign((abs(tint) / 10) ** 1.75 * 10, tint)
    tinted_ = [plain[0] + shaped / 19.0, plain[1], plain[2] + shaped / 11.0]
    least = min(tinted_)
    undo = [0.0 if i != j else 1 / plain[i] for i in range(3) for j in range(3)]
    target, source = (_times(CONES, daylight_xyz(k)) for k in (6500.0, kelvin))
    adapt = [0.0 if i != j else target[i] / source[i] for i in range(3) for j in range(3)]
    return [g / least for g in tinted_], compose(gamut, invert(CONES), adapt, CONES, invert(camera), undo)
