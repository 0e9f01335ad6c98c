"""Joins of file names and headers: bands, instruments, targets, rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions.geometry import axis_from_header, instruments

#: Degrees added to the raw position angle, by channel.
ROTATIONS = {"3": 7.5, "4": 8.3}


#: Fixed values of corrected files by channel: slits, pixel, field of view (arcsec), degrees added to the position angle.
CORRECTED = {1: (21, 0.196, 3.2, 3.7, 8.4), 2: (17, 0.196, 4.0, 4.8, 8.2), 3: (16, 0.245, 5.5, 6.2, 7.5), 4: (12, 0.273, 6.9, 7.9, 8.3)}
#: Names of the bands a, b and c in headers.
LETTERS = ("SHORT", "MEDIUM", "LONG")


def corrected_instrument(files: DataFrame) -> DataFrame:
    """Corrected files with their instrument, from the header's CHANNEL, BAND and PA_V3 alone.

    Adds chan, n_slit, det_pix, alpha_width, beta_width and angle. Their
    constants differ from those by band name. A file with another channel or
    band raises.
    """
    rows = [(channel, *values) for channel, values in CORRECTED.items()]
    table = files.sparkSession.createDataFrame(rows, "CHANNEL int, n_slit int, det_pix double, alpha_width double, beta_width double, turn double")
    letter = F.array_position(F.array(*map(F.lit, LETTERS)), F.upper("BAND")).cast("int")
    known = F.col("CHANNEL").cast("int").isin(list(CORRECTED)) & (F.coalesce(letter, F.lit(0)) > 0)
    named = files.withColumn("CHANNEL", F.when(known, F.col("CHANNEL").cast("int")).otherwise(F.raise_error(F.lit("no such channel or band")))).withColumn("chan", F.concat(F.col("CHANNEL").cast("string"), F.char(96 + letter)))
    return named.join(F.broadcast(table), "CHANNEL").withColumn("angle", F.col("PA_V3") + F.col("turn")).drop("turn")


def pixel_name(name: Column) -> Column:
    """The name, ending in ``pix``."""
    return F.when(name.endswith("pix"), name).otherwise(F.concat(name, F.lit("_pix")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def band_of(name: Column) -> Column:
    """Channel and letter of a name such as ``ch1a`` or ``x_ch4c_02``, or of a plain ``1a``; else it raises."""
    found = F.regexp_extract(name, "(?:^|ch)([1-4][abc])(?:[^0-9a-z]|$)", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no band in the name "), name))).otherwise(found)


def dither_of(name: Column) -> Column:
    """The two digits or more that end a name before its suffix; null without them."""
    found = F.regexp_extract(name, "_([0-9]{2,})(?:\\.[a-z]+)?$", 1)
    return F.when(found != "", found)


def observations(headers: DataFrame) -> DataFrame:
    """Files (name, NAXIS3, CRPIX3, CDELT3, CRVAL3, RA_V1, DEC_V1, PA_V3) as observations: instrument, axis, target and angle.

    Adds the band's instrument, ``axis``, ``alpha``, ``beta`` and ``angle``,
    the position angle and the channel's own.
    """
    axis = axis_from_header(F.col("NAXIS3"), F.col("CRPIX3"), F.col("CDELT3"), F.col("CRVAL3"))
    turn = F.element_at(F.create_map(*[F.lit(x) for channel, values in CORRECTED.items() for x in (str(channel), values[4])]), F.substring("chan", 1, 1))
    return with_instrument(headers).withColumns({"axis": axis, "alpha": F.col("RA_V1"), "beta": F.col("DEC_V1"), "angle": F.col("PA_V3") + turn}).drop("NAXIS3", "CRPIX3", "CDELT3", "CRVAL3", "RA_V1", "DEC_V1", "PA_V3")


def with_instrument(files: DataFrame, name: str = "name") -> DataFrame:
    """Files with their band's instrument: slits, resolution, pixel, field of view."""
    return files.withColumn("chan", band_of(F.col(name))).join(F.broadcast(instruments(files.sparkSession)), "chan")


def copied_targets(raw: DataFrame, corrected: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Corrected files (name, ...) with the target (alpha, beta) of the raw file of their band and dither.

    Of several raw files of one band and dither the last name counts; a
    corrected file without a raw one keeps null. Where names repeat, the
    columns ``within`` of both say which files belong together.
    """
    keyed = lambda df: df.withColumns({"chan": band_of(F.col("name")), "dither": dither_of(F.col("name"))})
    targets = keyed(raw).groupBy(*within, "chan", "dither").agg(F.max_by(F.struct("alpha", "beta"), "name").alias("_target"))
    found = keyed(corrected.drop("alpha", "beta")).join(targets, [*within, "chan", "dither"], "left")
    return found.select(*[c for c in found.columns if c != "_target"], F.col("_target.alpha").alias("alpha"), F.col("_target.beta").alias("beta"))


def turned_headers(raw: DataFrame, filtered: DataFrame) -> DataFrame:
    """Filtered files (name) with the position angle of their channel's raw band ``a`` plus its offset.

    Channels without an offset don't appear; a new table, nothing in place.
    """
    angle = raw.withColumn("_band", band_of(F.col("name"))).where(F.col("_band").isin([f"{c}a" for c in ROTATIONS]))
    angle = angle.groupBy(F.substring("_band", 1, 1).alias("channel")).agg(F.max_by("angle", "name").alias("angle"))
    offset = F.create_map(*[F.lit(x) for pair in ROTATIONS.items() for x in pair])
    known = filtered.drop("angle").withColumn("channel", F.substring(band_of(F.col("name")), 1, 1))
    return known.join(F.broadcast(angle), "channel").withColumn("angle", F.col("angle") + offset[F.col("channel")])


def assembled(arrays: DataFrame) -> DataFrame:
    """Slices (chan, p, s, lp, a, y) of files (path, shape, data) of [lambda, slit, alpha].

    A channel's files are numbered from 0 by name; NaN becomes null.
    """
    from pyspark.sql import Window

    named = arrays.withColumn("name", file_name(F.col("path"))).withColumn("chan", band_of(F.col("name")))
    order = named.select("path", "chan", "name").withColumn("p", F.row_number().over(Window.partitionBy("chan").orderBy("name", "path")) - 1)
    flat = named.select("path", F.col("shape")[1].alias("ns"), F.col("shape")[2].alias("na"), F.posexplode("data").alias("k", "y"))
    return flat.join(order.drop("name"), "path").select(
        "chan", "p", F.expr("(k div na) % ns").cast("int").alias("s"), F.expr("k div (ns * na)").cast("int").alias("lp"), (F.col("k") % F.col("na")).cast("int").alias("a"), F.nanvl("y", F.lit(None).cast("double")).alias("y")
    )
