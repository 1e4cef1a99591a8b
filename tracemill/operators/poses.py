"""Camera poses: chains, centres and the plane a vehicle drives on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.sequence import running

#: Up in camera coordinates, where y points down.
UP = (0.0, -1.0, 0.0)


def camera_center(yaw: Column, tx: Column, tz: Column) -> tuple[Column, Column]:
    """x and z of the centre of a camera that is turned by ``yaw`` about the vertical and shifted by t: -R't."""
    c, s = F.cos(yaw), F.sin(yaw)
    return -(c * tx - s * tz), -(s * tx + c * tz)


def chain_level(steps: DataFrame, key: str, valid: Column) -> DataFrame:
    """Adds heading, x, z: the centres of cameras chained by relative turns ``yaw`` and shifts (tx, tz).

    A centre is the one before less R't with the rotation chained so far, so both are
    running sums.  A step that is not valid holds the pose.
    """
    turned = steps.withColumn("heading", F.sum(F.when(valid, F.col("yaw")).otherwise(0.0)).over(running(key)))
    dx, dz = camera_center(F.col("heading"), F.col("tx"), F.col("tz"))
    moved = {"x": F.when(valid, dx).otherwise(0.0), "z": F.when(valid, dz).otherwise(0.0)}
    return turned.withColumns({c: F.sum(v).over(running(key)) for c, v in moved.items()})


def chain_poses(relative: list[tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
    """Centres of cameras chained by relative poses (R, t) in space, the first at the origin; None holds the pose."""
    rotation, centers = np.eye(3), [np.zeros(3)]
    for step in relative:
        if step is None:
            centers.append(centers[-1])
            continue
        rotation = step[0] @ rotation
        centers.append(centers[-1] - rotation.T @ step[1])
    return np.array(centers)


def driving_plane(points: np.ndarray, up: tuple[float, float, float] = UP, flattest: bool = False) -> np.ndarray:
    """Points [n, 3] on their driving plane, seen from above.

    Of the principal axes the one nearest to ``up`` is dropped, or with ``flattest``
    the one of least variance; the others stay in order of variance, the second
    turned so that their normal points up.
    """
    if len(points) < 3:
        return points[:, [0, 2]].astype(float)
    centered = points - points.mean(axis=0)
    variance, axes = np.linalg.eigh(centered.T @ centered)
    axes = axes[:, np.argsort(-variance, kind="stable")]
    dropped = 2 if flattest else int(np.abs(np.array(up) @ axes).argmax())
    first, second = (axes[:, i] for i in range(3) if i != dropped)
    if np.cross(first, second) @ np.array(up) < 0:
        second = -second
    return centered @ np.c_[first, second]
