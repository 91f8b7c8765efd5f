"""Geometry as column expressions: projections, boxes, 3x3 matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.pitch import HALF_LENGTH, HALF_WIDTH

Matrix = list[list[Column]]


def r6(x: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def matrix(prefix: str = "h", rows: int = 3, columns: int = 3) -> Matrix:
    return [[F.col(f"{prefix}{i}{j}") for j in range(columns)] for i in range(rows)]


def foot(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Where a boxed player stands."""
    return (x1 + x2) / 2, y2


def project(h: Matrix, x: Column, y: Column, least: float = 0.0) -> tuple[Column, Column]:
    """A point through a homography; NULL where the scale is 0, or below least."""
    w = h[2][0] * x + h[2][1] * y + h[2][2]
    w = F.when(F.abs(w) >= least, w) if least else F.nullif(w, F.lit(0.0))
    return (h[0][0] * x + h[0][1] * y + h[0][2]) / w, (h[1][0] * x + h[1][1] * y + h[1][2]) / w


def clamp(x: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def on_pitch(x: Column, y: Column) -> tuple[Column, Column]:
    """NULL far outside the pitch, else clamped to its surroundings."""
    ok = (F.abs(x) <= 115.0) & (F.abs(y) <= 78.0)
    return F.when(ok, clamp(x, HALF_LENGTH + 5)), F.when(ok, clamp(y, HALF_WIDTH + 5))


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[sum((a[i][k] * b[k][j] for k in range(1, len(b))), a[i][0] * b[0][j]) for j in range(len(b[0]))] for i in range(len(a))]


def determinant(m: Matrix) -> Column:
    minor = lambda j, k: m[1][j] * m[2][k] - m[1][k] * m[2][j]
    return m[0][0] * minor(1, 2) - m[0][1] * minor(0, 2) + m[0][2] * minor(0, 1)


def inverse(m: Matrix) -> Matrix:
    """By cofactors; NULL where the matrix is singular."""
    det = F.nullif(determinant(m), F.lit(0.0))

    def cofactor(i: int, j: int) -> Column:
        (a, b), (c, d) = [r for r in range(3) if r != i], [s for s in range(3) if s != j]
        value = m[a][c] * m[b][d] - m[a][d] * m[b][c]
        return -value if (i + j) % 2 else value

    return [[cofactor(j, i) / det for j in range(3)] for i in range(3)]


def camera(focal: Column, cx: Column, cy: Column, rotation: Matrix, position: list[Column]) -> Matrix:
    """The 3x4 projection K R [I | -position]."""
    zero, one = F.lit(0.0), F.lit(1.0)
    moved = [[one if i == j else zero for j in range(3)] + [-position[i]] for i in range(3)]
    return product([[focal, zero, cx], [zero, focal, cy], [zero, zero, one]], product(rotation, moved))


def convert_box(a: Column, b: Column, c: Column, d: Column, kind: str) -> tuple[Column, Column, Column, Column]:
    """A box of a kind (xyxy, xywh or cxcywh) as corners."""
    if kind == "xyxy":
        return a, b, c, d
    if kind == "xywh":
        return a, b, a + c, b + d
    if kind == "cxcywh":
        return a - c / 2, b - d / 2, a + c / 2, b + d / 2
    raise ValueError(f"unknown box format {kind!r}")


def yolo_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, clip: bool) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of the image; training clips them to 0..1, exporting doesn't."""
    box = ((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in box) if clip else box


def iou(a: list[Column], b: list[Column]) -> Column:
    """Of two boxes x1, y1, x2, y2."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return width * height / (area(a) + area(b) - width * height + 1e-6)


def diagram_pixel(x: Column, y: Column, scale: float = 10.0, margin: float = 50.0) -> tuple[Column, Column]:
    """A pitch position on the drawn pitch; truncated."""
    return (F.lit(margin) + (x + HALF_LENGTH) * scale).cast("int"), (F.lit(margin) + (F.lit(HALF_WIDTH) - y) * scale).cast("int")


def colour_class(h: Column, s: Column, v: Column) -> Column:
    """0 unknown, 1 white, 2 black, 3 red, 4 blue, 5 yellow, 6 green."""
    vivid = F.when((h < 15) | (h > 165), 3).when((h > 95) & (h < 135), 4).when((h > 20) & (h < 40), 5).when((h > 40) & (h < 85), 6).otherwise(0)
    return F.when(s < 50, F.when(v > 180, 1).when(v < 60, 2).otherwise(0)).otherwise(vivid)
