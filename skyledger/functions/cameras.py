"""Pinhole cameras, with and without roll and lens distortion, as column expressions. World: x east, y north, z up, metres; yaw clockwise from north, pitch up, roll about the optical axis, degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_degrees(angle: Column) -> Column:
    """An angle of -540 degrees or more, as [-180, 180)."""
    return (angle + 540) % 360 - 180


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of a direction, [-180, 180)."""
    return wrap_degrees(F.degrees(F.atan2(dx, dy)))


def field_of_view(pixels: Column, focal: Column) -> Column:
    return F.degrees(2 * F.atan(pixels / (2 * focal)))


def ray(x: Column, y: Column, focal: Column, cx: Column, cy: Column, yaw: Column, pitch: Column) -> tuple[Column, Column, Column]:
    """World direction, not normalised, in which a pixel looks."""
    right, down = (x - cx) / focal, (y - cy) / focal
    yaw, pitch = F.radians(yaw), F.radians(pitch)
    ahead, up = F.cos(pitch) + F.sin(pitch) * down, F.sin(pitch) - F.cos(pitch) * down
    return F.cos(yaw) * right + F.sin(yaw) * ahead, F.cos(yaw) * ahead - F.sin(yaw) * right, up


def on_plane(direction: tuple[Column, Column, Column], position: tuple[Column, Column, Column], plane: Column) -> tuple[Column, Column]:
    """Where a ray meets the horizontal plane; null if it is parallel to it or the plane lies behind."""
    (dx, dy, dz), (px, py, pz) = direction, position
    t = F.when(F.abs(dz) > 1e-9, (plane - pz) / dz)
    t = F.when(t > 0, t)
    return px + t * dx, py + t * dy


def to_pixel(dx: Column, dy: Column, dz: Column, focal: Column, cx: Column, cy: Column, yaw: Column, pitch: Column) -> tuple[Column, Column]:
    """The pixel of a point that lies (dx, dy, dz) from the camera; null if it is behind."""
    yaw, pitch = F.radians(yaw), F.radians(pitch)
    right, ahead = F.cos(yaw) * dx - F.sin(yaw) * dy, F.sin(yaw) * dx + F.cos(yaw) * dy
    depth, down = F.cos(pitch) * ahead + F.sin(pitch) * dz, F.sin(pitch) * ahead - F.cos(pitch) * dz
    depth = F.when(depth > 1e-9, depth)
    return cx + focal * right / depth, cy + focal * down / depth


# --- lenses: plane coordinates (x, y) at depth 1, coefficients k1, k2, p1, p2, k3 ----------------


def _bent(x: str, y: str, k1: str, k2: str, p1: str, p2: str, k3: str) -> tuple[str, str, str]:
    """SQL of a lens's radial factor and of its tangential shift at (x, y)."""
    r = f"({x} * {x} + {y} * {y})"
    return f"(1 + {r} * ({k1} + {r} * ({k2} + {r} * {k3})))", f"(2 * {p1} * {x} * {y} + {p2} * ({r} + 2 * {x} * {x}))", f"({p1} * ({r} + 2 * {y} * {y}) + 2 * {p2} * {x} * {y})"


def distort(x: str, y: str, coefficients: tuple[str, str, str, str, str]) -> Column:
    """struct (x, y): where the lens shows what would lie at (x, y) without it. Arguments are names of columns or numbers."""
    radial, dx, dy = _bent(x, y, *coefficients)
    return F.expr(f"named_struct('x', {x} * {radial} + {dx}, 'y', {y} * {radial} + {dy})")


def undistort(x: str, y: str, coefficients: tuple[str, str, str, str, str], rounds: int = 10) -> Column:
    """struct (x, y): what the lens shows at (x, y), as it would lie without it. The inverse has no closed form: the shift at the last guess is taken off, `rounds` times, inside one expression. Null coordinates stay null."""
    radial, dx, dy = _bent("s.x", "s.y", *coefficients)
    step = f"named_struct('x', ({x} - {dx}) / {radial}, 'y', ({y} - {dy}) / {radial})"
    return F.expr(f"aggregate(sequence(1, {rounds}), named_struct('x', cast({x} as double), 'y', cast({y} as double)), (s, i) -> {step})")


def turned(right: Column, down: Column, ahead: Column, yaw: Column, pitch: Column, roll: Column) -> tuple[Column, Column, Column]:
    """A direction of the camera (right, down, along its axis) in the world: turned about the axis's own vertical by roll, then by pitch, then by yaw."""
    yaw, tip, roll = F.radians(yaw), F.radians(pitch - 90), F.radians(roll)
    x, z = F.cos(roll) * right + F.sin(roll) * ahead, F.cos(roll) * ahead - F.sin(roll) * right
    y, z = F.cos(tip) * down - F.sin(tip) * z, F.sin(tip) * down + F.cos(tip) * z
    return F.cos(yaw) * x + F.sin(yaw) * y, F.cos(yaw) * y - F.sin(yaw) * x, z


def turned_back(x: Column, y: Column, z: Column, yaw: Column, pitch: Column, roll: Column) -> tuple[Column, Column, Column]:
    """A direction of the world as the camera has it: the turns of turned() undone, last first."""
    yaw, tip, roll = F.radians(yaw), F.radians(pitch - 90), F.radians(roll)
    x, y = F.cos(yaw) * x - F.sin(yaw) * y, F.sin(yaw) * x + F.cos(yaw) * y
    y, z = F.cos(tip) * y + F.sin(tip) * z, F.cos(tip) * z - F.sin(tip) * y
    return F.cos(roll) * x - F.sin(roll) * z, y, F.sin(roll) * x + F.cos(roll) * z
