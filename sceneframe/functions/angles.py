"""Yaw, bearing and egocentric direction as column expressions."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.functions.rounding import py_round

TWO_PI = 2.0 * math.pi
DEG_TO_RAD = math.pi / 180.0
RAD_TO_DEG = 180.0 / math.pi

# Direction vocabularies, counter-clockwise from straight ahead.
SPOKEN = ("ahead", "ahead to your left", "to your left", "behind to your left",
          "behind", "behind to your right", "to your right", "ahead to your right")
COMPACT = ("ahead", "ahead-left", "left", "behind-left",
           "behind", "behind-right", "right", "ahead-right")
VOCABULARY = {"cloud": SPOKEN, "local": COMPACT}


def radians(deg: Column) -> Column:
    return deg * DEG_TO_RAD


def degrees(rad: Column) -> Column:
    return rad * RAD_TO_DEG


def yaw_from_quaternion(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    return F.atan2((qw * qz + qx * qy) * 2.0, 1.0 - (qy * qy + qz * qz) * 2.0)


def quaternion_from_yaw(yaw: Column) -> Column:
    """Struct ``(z, w)``; an unknown yaw is the identity rotation."""
    return F.struct(
        F.coalesce(F.sin(yaw / 2.0), F.lit(0.0)).alias("z"),
        F.coalesce(F.cos(yaw / 2.0), F.lit(1.0)).alias("w"),
    )


def wrap_angle(rad: Column) -> Column:
    """Bring an angle to [-pi, pi) with a non-negative modulo."""
    r = (rad + math.pi) % TWO_PI
    return F.when(r < 0, r + TWO_PI).otherwise(r) - math.pi


def bearing(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """World-frame angle from a to b; null when either end is unknown."""
    return F.atan2(by - ay, bx - ax)


def relative_angle_deg(yaw, rx, ry, ox, oy) -> Column:
    return degrees(wrap_angle(bearing(rx, ry, ox, oy) - yaw))


def sector_name(deg: Column, dialect: str = "cloud") -> Column:
    """Eight 45-degree sectors with inclusive lower bounds."""
    w = VOCABULARY[dialect]
    return (F.when(deg.isNull(), F.lit(None).cast("string"))
            .when((deg >= 157.5) | (deg < -157.5), w[4])
            .when(deg >= 112.5, w[3])
            .when(deg >= 67.5, w[2])
            .when(deg >= 22.5, w[1])
            .when(deg >= -22.5, w[0])
            .when(deg >= -67.5, w[7])
            .when(deg >= -112.5, w[6])
            .otherwise(w[5]))


def relative_direction(yaw, rx, ry, ox, oy, dialect: str = "cloud") -> Column:
    return sector_name(relative_angle_deg(yaw, rx, ry, ox, oy), dialect)


def with_direction(df: DataFrame, name: str, yaw, rx, ry, ox, oy, dialect: str = "cloud") -> DataFrame:
    """Add :func:`relative_direction` as a column, step by step.

    As one expression the angle stands in each of its comparisons, and generated code above 8,000 bytes a method
    is never compiled by the JVM.  Use this for rows that are pairs.
    """
    turned = df.withColumn("_turn", (bearing(rx, ry, ox, oy) - yaw + math.pi) % TWO_PI)
    t = F.col("_turn")
    return (turned.withColumn("_turn", degrees(F.when(t < 0, t + TWO_PI).otherwise(t) - math.pi))
            .withColumn(name, sector_name(F.col("_turn"), dialect)).drop("_turn"))


def turn_degrees(yaw, rx, ry, ox, oy) -> Column:
    """Signed turn towards the target, one decimal; positive is left."""
    return py_round(relative_angle_deg(yaw, rx, ry, ox, oy), 1)


def turn_message(name: Column, turn_deg: Column) -> Column:
    """``turn_deg`` is the unrounded signed turn."""
    side = F.when(turn_deg > 0, "left").otherwise("right")
    return F.concat(F.lit("Rotating to face "), name, F.lit(" ("),
                    py_round(F.abs(turn_deg), 1).cast("string"),
                    F.lit(" degrees "), side, F.lit(")"))
