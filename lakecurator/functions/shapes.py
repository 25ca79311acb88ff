"""Shapes and perceptual hashes as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def aspect(width: Column, height: Column) -> Column:
    """Long side by short side, so that rotation doesn't matter; null where a side is zero."""
    return F.try_divide(F.greatest(width, height), F.least(width, height))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def rotation_distance(hashes: Column, other: Column) -> Column:
    """The least distance of a hash to those of four rotations."""
    return F.array_min(F.transform(hashes, lambda h: hamming(h, other)))


def hash_from_hex(text: Column) -> Column:
    """The signed 64-bit pattern of 16 hex digits."""
    return F.conv(text, 16, -10).cast("long")


def hash_to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def sign_bits(values: Column, n: int = 64) -> Column:
    """A bigint with a bit for each of n numbers, set where it is positive; the first is the highest."""
    return F.aggregate(F.slice(values, 1, n), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("long")))


def _compared(gray: Column, place: Callable[[int, int], int]) -> Column:
    """64 bits, of which each tells whether a value of 8 rows of 9 is over the next; place: where in gray a row and column are.

    Written out, not as a lambda: what a lambda refers to outside is worked out again for each element.
    """
    over = [F.coalesce(F.get(gray, F.lit(place(r, c))) > F.get(gray, F.lit(place(r, c + 1))), F.lit(False)).cast("long") for r in range(8) for c in range(8)]
    return reduce(lambda bits, bit: bits.bitwiseOR(bit), [F.shiftleft(bit, 63 - i) for i, bit in enumerate(over)])


def difference_hash(gray: Column) -> Column:
    """The 64-bit difference hash of 72 gray values, nine to a row: left brighter than right."""
    return _compared(gray, lambda r, c: 9 * r + c)


def rotation_hashes(wide: Column, tall: Column) -> Column:
    """The difference hashes of a picture and of its turns by a quarter, a half and three quarters to the left.

    wide: 8 rows of 9 gray values of the picture as it is; tall: 9 rows of 8,
    which a quarter turn makes 8 rows of 9.
    """
    quarter, half, three = (lambda r, c: 8 * c + 7 - r), (lambda r, c: 9 * (7 - r) + 8 - c), (lambda r, c: 8 * (8 - c) + r)
    return F.array(difference_hash(wide), _compared(tall, quarter), _compared(wide, half), _compared(tall, three))


def video_gap(source: dict[str, Column], dest: dict[str, Column], tolerance: float = 0.02) -> Column:
    """struct(gap, known): seconds between two videos of one shape.

    known is false if a duration is missing or zero; gap is null then, and for
    different shapes. source and dest: duration, width, height.
    """
    known = (F.coalesce(source["duration"], F.lit(0)) > 0) & (F.coalesce(dest["duration"], F.lit(0)) > 0)
    gap = F.abs(source["duration"] - dest["duration"])
    sized = F.lit(True)
    for side in (source, dest):
        sized = sized & (F.coalesce(side["width"], F.lit(0)) > 0) & (F.coalesce(side["height"], F.lit(0)) > 0)
    own, other = aspect(source["width"], source["height"]), aspect(dest["width"], dest["height"])
    fits = (F.abs(own - other) / own <= tolerance) & (dest["width"] * dest["height"] <= source["width"] * source["height"] * 1.01)
    same = known & (gap <= F.greatest(F.lit(0.5), 0.07 * source["duration"])) & (~sized | F.coalesce(fits, F.lit(False)))
    return F.struct(F.when(same, gap).alias("gap"), known.alias("known"))
