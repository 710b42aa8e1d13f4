"""Cameras and rotations as column expressions.

A rotation is a list of three rows of three columns, a pose the rotation from
camera to world and the camera's place. Camera axes are x right, y down, z
forward.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]
Vector = list[Column]

#: The long side and the patch that image sizes are fitted to.
LONG_SIDE, PATCH = 518, 14


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]


def apply(m: Matrix, v: Vector) -> Vector:
    return [m[i][0] * v[0] + m[i][1] * v[1] + m[i][2] * v[2] for i in range(3)]


def transpose(m: Matrix) -> Matrix:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def attitude(yaw: Column, pitch: Column, roll: Column) -> Matrix:
    """Rx(roll) Ry(pitch) Rz(yaw), angles in degrees."""
    (cy, sy), (cp, sp), (cr, sr) = [(F.cos(F.radians(x)), F.sin(F.radians(x))) for x in (yaw, pitch, roll)]
    one, zero = F.lit(1.0), F.lit(0.0)
    rx = [[one, zero, zero], [zero, cr, -sr], [zero, sr, cr]]
    ry = [[cp, zero, sp], [zero, one, zero], [-sp, zero, cp]]
    rz = [[cy, -sy, zero], [sy, cy, zero], [zero, zero, one]]
    return multiply(multiply(rx, ry), rz)


def up_vector(yaw: Column, pitch: Column, roll: Column) -> Vector:
    return [row[2] for row in attitude(yaw, pitch, roll)]


def pose(enu: Vector, yaw: Column, pitch: Column, roll: Column) -> Column:
    """Camera-to-world as 16 row-major doubles; without a complete attitude the rotation, and without a place the centre, is that of the identity."""
    r = transpose(attitude(yaw, pitch, roll))
    turned = yaw.isNotNull() & pitch.isNotNull() & roll.isNotNull()
    placed = enu[0].isNotNull() & enu[1].isNotNull() & enu[2].isNotNull()
    cells = []
    for i in range(3):
        cells += [F.when(turned, r[i][j]).otherwise(float(i == j)) for j in range(3)] + [F.when(placed, enu[i]).otherwise(0.0)]
    return F.array(*cells, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def aligning_to_up(up: Vector) -> Matrix:
    """The smallest rotation that turns a unit vector to +z; straight down turns about the x axis."""
    x, y, z = up
    k = 1 / (1 + z)
    down = z < -1 + 1e-9
    turn = [[1 - k * x * x, -k * x * y, -x], [-k * x * y, 1 - k * y * y, -y], [x, y, z]]
    flip = [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]]
    return [[F.when(down, flip[i][j]).otherwise(turn[i][j]) for j in range(3)] for i in range(3)]


def project(world: Vector, rotation: Matrix, centre: Vector, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """u, v and depth of a world point; u and v are null for a depth of 0 or less."""
    c = apply(transpose(rotation), [world[i] - centre[i] for i in range(3)])
    front = c[2] > 0
    return F.when(front, fx * c[0] / c[2] + cx), F.when(front, fy * c[1] / c[2] + cy), c[2]


def back_project(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Vector:
    return [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]


def in_frustum(u: Column, v: Column, depth: Column, width: Column, height: Column) -> Column:
    return F.coalesce((depth > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def fitted_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Target width and height: the long side LONG_SIDE, the short one in proportion, rounded half to even to whole patches, at least one."""
    short = lambda a, b: F.greatest(F.bround(a * LONG_SIDE / b / PATCH, 0) * PATCH, F.lit(float(PATCH))).cast("int")
    return F.when(width >= height, LONG_SIDE).otherwise(short(width, height)), F.when(width >= height, short(height, width)).otherwise(LONG_SIDE)


def rescaled(fx: Column, fy: Column, cx: Column, cy: Column, sx: Column, sy: Column) -> tuple[Column, Column, Column, Column]:
    return fx * sx, fy * sy, cx * sx, cy * sy


def plausible(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    most = F.greatest(width, height)
    return (cx > 0) & (cx < width) & (cy > 0) & (cy < height) & fx.between(0.2 * most, 5 * most) & fy.between(0.2 * most, 5 * most)


def default_intrinsics(width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    f = 0.9 * F.greatest(width, height)
    return f, f, width / 2.0, height / 2.0


def angle_between(trace: Column) -> Column:
    """Degrees of the rotation with this trace."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
