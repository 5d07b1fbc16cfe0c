"""Vector, matrix, colour and hashing columns. Vectors are arrays of doubles, matrices are column-major arrays of 16."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"), z.cast("double"))


def sub(a: Column, b: Column) -> Column:
    return F.array(*[a[k] - b[k] for k in range(3)])


def cross_parts(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def cross(a: Column, b: Column) -> Column:
    return F.array(*cross_parts(a, b))


def let(values: dict[str, Column], body) -> Column:
    """body(named values), with each value worked out once; expressions that reuse large parts stay small this way."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def norm(a: Column) -> Column:
    return F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])


def distance(a: Column, b: Column) -> Column:
    d = [a[k] - b[k] for k in range(3)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def transform_point(m: Column, p: Column) -> Column:
    return F.array(*[m[k] * p[0] + m[4 + k] * p[1] + m[8 + k] * p[2] + m[12 + k] for k in range(3)])


def multiply(a: Column, b: Column) -> Column:
    """Matrix a times matrix b."""
    return F.array(*[a[r] * b[4 * c] + a[4 + r] * b[4 * c + 1] + a[8 + r] * b[4 * c + 2] + a[12 + r] * b[4 * c + 3] for c in range(4) for r in range(4)])


def from_trs(t: list[Column], q: list[Column], s: list[Column]) -> Column:
    """The matrix of a scale, then a rotation (unit quaternion x, y, z, w), then a translation."""
    x, y, z, w = q
    columns = (
        (1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)),
        (2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)),
        (2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)),
    )
    cells = [c for column, k in zip(columns, s, strict=True) for c in (*[v * k for v in column], F.lit(0.0))]
    return F.array(*[c.cast("double") for c in (*cells, *t, F.lit(1.0))])


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def point_key(p: Column, epsilon: float) -> Column:
    """A point on the grid of a tolerance, as text."""
    return F.concat_ws(",", *[half_up(p[k] / epsilon).cast("string") for k in range(3)])


def clamp_byte(x: Column) -> Column:
    return F.least(F.greatest(half_up(x), F.lit(0)), F.lit(255)).cast("int")


def average_color(colors: list[Column]) -> Column:
    return F.array(*[clamp_byte((colors[0][k] + colors[1][k] + colors[2][k]) / 3.0) for k in range(4)])


#: Fixed value: the colour of what has none.
GREY = (220, 220, 220, 255)


def primitive_color(vertex_colors: list[Column], base_color: Column, named: Column) -> Column:
    """[r, g, b, a] of a triangle: the mean of its corners' colours, else the base colour of its material (fractions, with
    an optional fourth), else the colour that its image's name tells, else grey."""
    mean = F.when(vertex_colors[0].isNotNull() & vertex_colors[1].isNotNull() & vertex_colors[2].isNotNull(), average_color(vertex_colors))
    base = F.when(base_color.isNotNull(), F.array(*[clamp_byte(F.coalesce(F.get(base_color, F.lit(k)), F.lit(1.0)) * 255) for k in range(4)]))
    return F.coalesce(mean, base, named, F.array(*map(F.lit, GREY)))


# Fixed values of the 32-bit mixing function: products and shifts.
MIX_START, MIX_A, MIX_B, MIX_1, MIX_2 = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35, 0x7FEB352D, 0x846CA68B
LOW = 0xFFFFFFFF


def times32(a: Column, k: int) -> Column:
    """Low 32 bits of a product, by halves, so that no step leaves the 64-bit range."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(k)
    high = F.shiftleft((F.shiftright(a, 16) * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(LOW))


def mixed_fraction(seed: Column, a: Column, b: Column, signed: bool = False) -> Column:
    """A number in [0, 1) from three integers; signed gives the variant in [-0.5, 0.5)."""
    start = seed.cast("bigint").bitwiseXOR(F.lit(MIX_START)).bitwiseXOR(times32((a + 1).cast("bigint"), MIX_A)).bitwiseXOR(times32((b + 1).cast("bigint"), MIX_B)).bitwiseAND(F.lit(LOW))

    def step(x: Column, pair: Column) -> Column:
        folded = x.bitwiseXOR(F.when(pair == 1, F.shiftright(x, 15)).otherwise(F.shiftright(x, 16)))
        return F.when(pair == 0, times32(folded, MIX_1)).when(pair == 1, times32(folded, MIX_2)).otherwise(folded)

    x = F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), start, step)
    x = F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x) if signed else x
    return x / F.lit(4294967296.0)


def logit(x: Column) -> Column:
    return F.ln(x / (1 - x))


def quaternion_of_normal(n: Column) -> Column:
    """[w, x, y, z] of the frame whose third axis is the normal: cases by the largest diagonal term, for accuracy."""
    steep = F.abs(n[0]) > 0.9
    helper = [F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0), F.lit(0.0)]
    raw = dict(zip(("y0", "y1", "y2"), cross_parts(n, helper), strict=True))
    normal = {f"z{k}": n[k] for k in range(3)}

    def frame(f: Column) -> Column:
        size = F.sqrt(f["y0"] * f["y0"] + f["y1"] * f["y1"] + f["y2"] * f["y2"])
        return F.struct(*[(f[f"y{k}"] / size).alias(f"y{k}") for k in range(3)], *[f[f"z{k}"].alias(f"z{k}") for k in range(3)])

    def matrix(f: Column) -> Column:
        y, z = [f[f"y{k}"] for k in range(3)], [f[f"z{k}"] for k in range(3)]
        return F.struct(*[axis[r].alias(f"m{r}{c}") for c, axis in enumerate((cross_parts(y, z), y, z)) for r in range(3)])

    def solve(f: Column) -> Column:
        m = {(r, c): f[f"m{r}{c}"] for r in range(3) for c in range(3)}
        trace = m[0, 0] + m[1, 1] + m[2, 2]
        skew = (m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1])

        def largest(k: int) -> Column:
            i, j = (k + 1) % 3, (k + 2) % 3
            s = F.sqrt(1 + m[k, k] - m[i, i] - m[j, j]) * 2
            part = {k: 0.25 * s, i: (m[k, i] + m[i, k]) / s, j: (m[k, j] + m[j, k]) / s}
            return F.array(skew[k] / s, part[0], part[1], part[2])

        s = F.sqrt(trace + 1) * 2
        return (
            F.when(trace > 0, F.array(0.25 * s, *[v / s for v in skew]))
            .when((m[0, 0] > m[1, 1]) & (m[0, 0] > m[2, 2]), largest(0))
            .when(m[1, 1] > m[2, 2], largest(1))
            .otherwise(largest(2))
        )

    def unit(f: Column) -> Column:
        q = f["q"]
        size = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        return F.when(size < 1e-12, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.transform(q, lambda c: c / size))

    turned = let(raw | normal, frame)
    cells = F.transform(F.array(turned), matrix)
    return let({"q": F.transform(cells, solve)[0]}, unit)
