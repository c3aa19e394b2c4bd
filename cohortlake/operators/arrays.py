"""Array volumes: keyed volume table, max scaling, linear resampling, feature fusion.

A volume is a row ``(key, dims array<int>, voxels array<float>)`` with voxels in
C order. Whole volumes are resampled through ``mapInPandas`` with numpy on small Arrow
batches, so one task never holds more than a few volumes.

A volume may also be a row for each tile ``(key, tile, origin, dims, voxels)``: some
consecutive planes of its first axis, which ``origin`` counts, and the plane after them (the
halo), so that every pair of neighbouring planes is in one tile. ``dims`` stay those of the
volume. Tiles are scaled and resampled by built-in array functions, each on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def volume_table(df: DataFrame, key: str, array_col: str, dims: Sequence[int] | None = None,
                 dims_col: str | None = None) -> DataFrame:
    """Keyed array table: ``key, dims, voxels`` (float)."""
    d = F.col(dims_col) if dims_col else F.array(*[F.lit(int(x)) for x in dims])
    return df.select(key, d.alias("dims"), F.col(array_col).cast("array<float>").alias("voxels"))


def volume_max_scale(df: DataFrame, col: str = "voxels") -> DataFrame:
    """Divide every voxel by the volume maximum (NULL voxels when the maximum is 0)."""
    mx = F.array_max(F.col(col))
    return df.withColumn(col, F.transform(F.col(col),
                                          lambda x: F.try_divide(x.cast("double"), mx.cast("double"))))


def volume_resample(df: DataFrame, new_size: Sequence[int], voxels: str = "voxels",
                    dims: str = "dims") -> DataFrame:
    """Resample each volume to ``new_size`` (e.g. 64^3); double voxels in C order.

    Linear on corner-aligned grids (``linspace(0,1,n)`` on both sides) after
    squeezing length-1 axes; separable, so one 1-D pass per axis.
    """
    new_size = [int(x) for x in new_size]
    schema = T.StructType([f if f.name not in (voxels, dims) else
                           T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == voxels
                                         else T.ArrayType(T.IntegerType()))
                           for f in df.schema.fields])

    run = _resample_batches(voxels, dims, new_size)
    return df.mapInPandas(run, schema)


def _resample_batches(voxels: str, dims: str, new_size: list):
    """Build the per-batch function. Everything it needs is defined inside, so it
    is shipped by value and executors need only numpy, not this package."""
    def one(flat, shape_in):
        import numpy as np
        shape = [int(d) for d in shape_in if int(d) != 1]
        if len(shape) != len(new_size):
            raise ValueError("volume rank does not match new size")
        vol = np.asarray(flat, dtype=np.float64).reshape(shape)
        for axis, (d, n) in enumerate(zip(shape, new_size)):
            # two neighbours and a weight for each position of the axis
            at = np.linspace(0.0, 1.0, n) * (d - 1)
            low = np.minimum(at.astype(int), max(d - 2, 0))
            part = (at - low).reshape([-1 if k == axis else 1 for k in range(vol.ndim)])
            high = np.minimum(low + 1, d - 1)
            vol = vol.take(low, axis) * (1 - part) + vol.take(high, axis) * part
        return vol.ravel()

    def run(batches):
        import numpy as np
        for pdf in batches:
            pdf = pdf.copy()
            pdf[voxels] = [one(v, list(d)) for v, d in zip(pdf[voxels], pdf[dims])]
            pdf[dims] = [np.asarray(new_size, dtype=np.int32)] * len(pdf)
            yield pdf
    return run


def fuse_features(left: DataFrame, right: DataFrame, key: str, left_array: str,
                  right_array: str, name: str = "fused") -> DataFrame:
    """Join two feature blocks by key and concatenate their vectors."""
    return (left.select(key, left_array).join(right.select(key, right_array), key, "inner")
            .select(key, F.concat(F.col(left_array).cast("array<double>"),
                                  F.col(right_array).cast("array<double>")).alias(name)))


def volume_tiles(df: DataFrame, planes: int, voxels: str = "voxels", dims: str = "dims") -> DataFrame:
    """Cut each volume into tiles of ``planes`` planes and a halo; axes of length 1 are dropped from ``dims``.

    A volume without voxels (or null) has no tile. Other columns are kept in every tile."""
    shape = F.filter(F.col(dims), lambda d: d != 1)
    shape = F.when(F.size(shape) == 0, F.array(F.lit(1))).otherwise(shape)
    rows = df.withColumn(dims, shape).where(F.size(voxels) > 0)
    depth = F.get(dims, F.lit(0))
    plane = F.try_divide(F.size(voxels), depth).cast("int")
    # the last plane is no tile of its own where it is the halo of the one before
    tiles = F.greatest(F.ceil((depth - 1) / planes), F.lit(1)).cast("int")
    rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    rows = rows.withColumn("origin", F.col("tile") * planes)
    return rows.withColumn(voxels, F.slice(voxels, F.col("origin") * plane + 1, plane * (planes + 1)))


def tiles_max_scale(tiles: DataFrame, key: str, voxels: str = "voxels") -> DataFrame:
    """:func:`volume_max_scale` over tiles: every voxel divided by its volume's maximum (NULL where that is 0).

    The maxima are one number a tile before the shuffle; the voxels are joined with one row a volume."""
    top = tiles.groupBy(F.col(key).alias("_key")).agg(F.max(F.array_max(voxels)).cast("double").alias("_top"))
    out = tiles.join(top, F.col(key).eqNullSafe(F.col("_key")))
    scaled = F.transform(voxels, lambda x: F.try_divide(x.cast("double"), F.col("_top")))
    return out.withColumn(voxels, scaled).select(*tiles.columns)


def tiles_resample(tiles: DataFrame, new_size: Sequence[int], planes: int, voxels: str = "voxels", dims: str = "dims") -> DataFrame:
    """:func:`volume_resample` over tiles of ``planes`` planes: each tile gives the output planes whose lower
    neighbour is one of its own, so that a volume larger than a task is never in one place.

    ``origin`` becomes the first output plane and ``dims`` the new size; a tile without an output plane
    is left out. Whole output planes must fit a task. Same arithmetic, in the same order, as for whole volumes."""
    new_size = [int(n) for n in new_size]
    rows = tiles
    misfit = F.raise_error(F.lit("volume rank does not match new size")).cast("array<double>")

    def places(axis: int):
        """Lower neighbour and weight of every output position of an axis."""
        n, d = new_size[axis], F.get(dims, F.lit(axis))
        at = [1.0 if i and i == n - 1 else i * (1.0 / max(n - 1, 1)) for i in range(n)]

        def place(x):
            low = F.least((x * (d - 1)).cast("int"), F.greatest(d - 2, F.lit(0)))
            return F.struct(low.alias("low"), F.least(low + 1, d - 1).alias("high"), (x * (d - 1) - low).alias("part"))
        return F.transform(F.array(*[F.lit(float(x)) for x in at]), place)

    # the first axis: output planes with their lower plane in this tile
    indexed = F.transform(places(0), lambda p, i: F.struct(i.alias("i"), (p["low"] - F.col("origin")).alias("low"),
                                                           (p["high"] - F.col("origin")).alias("high"), p["part"].alias("part")))
    last = F.col("origin") + planes
    final = F.get(dims, F.lit(0)) - 1 <= last  # the tile of the last planes
    rows = rows.withColumn("_at", F.filter(indexed, lambda p: (p["low"] >= 0) & ((p["low"] < planes) | final))).where(F.size("_at") > 0)
    rows = rows.withColumn("_first", F.get("_at", F.lit(0))["i"])
    # one expression, each pass bound once: a filter that Spark pushes through it never multiplies the passes
    value = F.col(voxels)
    for axis in range(len(new_size)):
        inner = F.lit(1)
        for later in range(axis + 1, len(new_size)):
            inner = inner * F.get(dims, F.lit(later))
        length = F.get(dims, F.lit(axis)) * inner if axis else F.size(voxels)
        at = places(axis) if axis else F.col("_at")
        value = _bound(F.struct(value.alias("v"), at.alias("at"), inner.alias("inner"), length.alias("length")), _mix_axis)
    value = F.when(F.size(dims) == len(new_size), value).otherwise(misfit)
    rows = rows.withColumns({voxels: value, "origin": F.col("_first"), dims: F.array(*[F.lit(n) for n in new_size])})
    return rows.select(*tiles.columns)


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mix_axis(b: Column) -> Column:
    """One axis of the voxels ``b.v``: in every stretch of ``b.length``, blocks of ``b.inner`` mixed at the places ``b.at``."""
    v, inner = b["v"], b["inner"]

    def mixed(start, p):
        return F.zip_with(F.slice(v, start + p["low"] * inner + 1, inner), F.slice(v, start + p["high"] * inner + 1, inner),
                          lambda x, y: x.cast("double") * (1 - p["part"]) + y.cast("double") * p["part"])

    starts = F.transform(F.sequence(F.lit(0), (F.size(v) / b["length"]).cast("int") - 1), lambda k: k * b["length"])
    return F.flatten(F.transform(starts, lambda s: F.flatten(F.transform(b["at"], lambda p: mixed(s, p)))))


def assemble_tiles(tiles: DataFrame, key: str, voxels: str = "voxels", dims: str = "dims") -> DataFrame:
    """Resampled tiles (without halo) to whole volumes ``key, dims, voxels``: the new size bounds a row."""
    parts = F.sort_array(F.collect_list(F.struct("origin", voxels)))
    return (tiles.groupBy(key).agg(F.first(dims).alias(dims), parts.alias("_parts"))
            .select(key, dims, F.flatten(F.col(f"_parts.{voxels}")).alias(voxels)))
