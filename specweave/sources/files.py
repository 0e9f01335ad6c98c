"""FITS and NPY files as relations, and slices back to tables.

Files are read by Spark's binary source, so that any store it reaches will
do, and parsed in Arrow batches on the executors.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CARD, BLOCK = 80, 2880
#: The format's number types, and the last letter of a band's name.
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: The bits of the NaN that stands in a file for a voxel that its cube doesn't have; a voxel without a value is a plain NaN.
ABSENT = 0x7FF8_6162_7365_6E74
LENGTHS = {"a": "SHORT", "b": "MEDIUM", "c": "LONG"}


def parse_fits(data: bytes) -> list[tuple[dict[str, str], list[int], np.ndarray | None]]:
    """Header, shape and image of each unit of a FITS file, in order."""
    units, at = [], 0
    while at < len(data):
        header: dict[str, str] = {}
        ended = False
        while not ended and at < len(data):
            for k in range(at, at + BLOCK, CARD):
                card = data[k : k + CARD].decode("ascii", "replace")
                if card[:8].strip() == "END":
                    ended = True
                    break
                if card[8:10] == "= ":
                    body = card[10:].strip()
                    value = body[1 : body.find("'", 1)].strip() if body.startswith("'") else body.split("/")[0].strip()
                    header[card[:8].strip()] = value
            at += BLOCK
        shape = [int(header[f"NAXIS{k}"]) for k in range(int(header.get("NAXIS", 0)), 0, -1)]
        image = None
        if shape and header.get("XTENSION", "IMAGE") == "IMAGE":
            kind = np.dtype(KINDS[int(header["BITPIX"])])
            n = int(np.prod(shape)) * kind.itemsize
            image = np.frombuffer(data[at : at + n], kind).astype(float)
            scale, zero = float(header.get("BSCALE", 1)), float(header.get("BZERO", 0))
            image = image if (scale, zero) == (1, 0) else image * scale + zero
            at += -(-n // BLOCK) * BLOCK
        elif shape:
            n = int(np.prod(shape)) * abs(int(header["BITPIX"])) // 8 + int(header.get("PCOUNT", 0))
            columns = int(header.get("TFIELDS", 0))
            if columns and all(header.get(f"TFORM{k + 1}", "").lstrip("1") == "D" for k in range(columns)):
                shape = [shape[0], columns]
                image = np.frombuffer(data[at : at + 8 * shape[0] * columns], ">f8").astype(float)
            at += -(-n // BLOCK) * BLOCK
        units.append((header, shape, image))
    return units


def fits_bytes(units: list[tuple[dict[str, object], np.ndarray | dict[str, np.ndarray] | None]]) -> bytes:
    """A FITS file of image units, and of tables where columns of doubles by name stand for an image, such as a cube's axes."""
    out = b""
    for k, (header, image) in enumerate(units):
        if isinstance(image, dict):
            n = len(next(iter(image.values())))
            cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 8 * len(image)), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(image))]
            cards += [card for c, name in enumerate(image) for card in ((f"TTYPE{c + 1}", f"'{name}'"), (f"TFORM{c + 1}", "'1D      '"))]
            cards += [(name, f"'{v}'" if isinstance(v, str) else v) for name, v in header.items()]
            text = "".join(f"{name:<8}= {v!s:>20}".ljust(CARD) for name, v in cards) + "END".ljust(CARD)
            body = np.stack([np.asarray(v, float) for v in image.values()], 1).astype(">f8").tobytes()
            out += text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
            continue
        cards = [("SIMPLE", "T") if k == 0 else ("XTENSION", "'IMAGE   '"), ("BITPIX", -64), ("NAXIS", 0 if image is None else image.ndim)]
        cards += [] if image is None else [(f"NAXIS{a + 1}", n) for a, n in enumerate(reversed(image.shape))]
        cards += [(n, f"'{v}'" if isinstance(v, str) else v) for n, v in header.items()]
        text = "".join(f"{n:<8}= {v!s:>20}".ljust(CARD) for n, v in cards) + "END".ljust(CARD)
        out += text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")
        if image is not None:
            body = image.astype(">f8").tobytes()
            out += body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
    return out


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """Arrays as lists: null for none, and null elements for absent voxels."""
    flat = np.concatenate([np.zeros(0), *[a.ravel() for a in arrays if a is not None]])
    ends = np.cumsum([0, *[0 if a is None else a.size for a in arrays]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, mask=flat.view(np.int64) == ABSENT), mask=pa.array([a is None for a in arrays]))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def fits_units(contents: DataFrame) -> DataFrame:
    """One row a unit of files (path, content): path, unit, header, shape and values (null without an image; absent voxels are null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("unit", pa.int32()), ("header", pa.map_(pa.string(), pa.string())), ("shape", pa.list_(pa.int32()))])
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                units = parse_fits(content)
                rows = [{"path": name, "unit": k, "header": list(h.items()), "shape": s} for k, (h, s, _) in enumerate(units)]
                yield pa.RecordBatch.from_arrays([*pa.RecordBatch.from_pylist(rows, schema=kind).columns, _lists([d for *_, d in units])], names=[*kind.names, "data"])

    return contents.mapInArrow(run, "path string, unit int, header map<string,string>, shape array<int>, data array<double>")


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    return fits_units(_binary(spark, path))


def npy_arrays(contents: DataFrame) -> DataFrame:
    """The array of each NPY file (path, content): path, shape and values; absent voxels are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([list(a.shape) for a in arrays], pa.list_(pa.int32())), _lists([a.astype(float) for a in arrays])], names=["path", "shape", "data"])

    return contents.mapInArrow(run, "path string, shape array<int>, data array<double>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    return npy_arrays(_binary(spark, path))


def packed_cubes(cubes: DataFrame, kind: str = "fits") -> DataFrame:
    """Files (path, content) of cubes (path, l, i, j, v), each from l, i, j = 0: FITS with an empty first unit, or NPY.

    Voxels that a cube doesn't have are marked as ``ABSENT``; two values of
    one voxel raise.
    """

    def run(table: pa.Table) -> pa.Table:
        at = [table.column(c).to_numpy() for c in ("l", "i", "j")]
        shape = [int(k.max()) + 1 for k in at]
        array, there = np.full(shape, ABSENT, np.int64).view(float), np.zeros(shape, bool)
        array[*at], there[*at] = table.column("v").to_numpy(), True
        if there.sum() < table.num_rows:
            raise ValueError(f"two values of one voxel in {table.column('path')[0]}")
        content = fits_bytes([({}, None), ({"CRPIX3": 1.0}, array)]) if kind == "fits" else npy_bytes(array)
        return pa.table({"path": table.column("path").slice(0, 1), "content": pa.array([content], pa.binary())})

    return cubes.select("path", "l", "i", "j", F.col("v").cast("double").alias("v")).groupBy("path").applyInArrow(lambda t: run(t), "path string, content binary")


def packed_headers(rows: DataFrame, cards: list[str]) -> DataFrame:
    """FITS files (path, content) without images, with the columns ``cards`` in both of their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in cards]
            content = [fits_bytes([(h := dict(zip(cards, row, strict=True)), None), (h, None)]) for row in zip(*values, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(content, pa.binary())], names=["path", "content"])

    return rows.select("path", *cards).mapInArrow(run, "path string, content binary")


def read_dithers(spark: SparkSession, path: str) -> DataFrame:
    """Offsets (alpha, beta) of a comma-separated text with # comments."""
    return spark.read.csv(path, schema="alpha double, beta double", comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_axes(spark: SparkSession, path: str) -> DataFrame:
    """Throughput or wavelength tables: (name, idx, x) of the vectors in NPY files, named as they are."""
    stem = F.regexp_extract("path", "([^/]*)\\.npy$", 1)
    return read_npy(spark, path).select(stem.alias("name"), F.posexplode("data").alias("idx", "x"))


def save_targets(targets: DataFrame, path: str) -> None:
    """Targets (name, alpha, beta) by file name, as Parquet."""
    targets.select("name", "alpha", "beta").write.mode("overwrite").parquet(path)


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, alpha double, beta double").parquet(path)


def unfolded(arrays: DataFrame) -> DataFrame:
    """Values of a three-dimensional array as (path, l, i, j, v), without absent voxels; NaN as null."""
    n1, n2 = F.col("shape")[1], F.col("shape")[2]
    flat = arrays.select("path", n1.alias("n1"), n2.alias("n2"), F.posexplode("data").alias("k", "x")).where("x is not null")
    return flat.select("path", F.expr("k div (n1 * n2)").cast("int").alias("l"), F.expr("(k div n2) % n1").cast("int").alias("i"), (F.col("k") % F.col("n2")).cast("int").alias("j"), F.nanvl("x", F.lit(None).cast("double")).alias("v"))


def header_target(units: DataFrame, unit: int, alpha: str, beta: str) -> DataFrame:
    """Target coordinates from a unit's header."""
    return units.where(F.col("unit") == unit).select("path", F.col("header")[alpha].cast("double").alias("alpha"), F.col("header")[beta].cast("double").alias("beta"))


def band_length(band: Column) -> Column:
    """SHORT, MEDIUM or LONG by a band's last letter; another letter raises."""
    out = F.raise_error(F.concat(F.lit("unknown band "), band))
    for letter, name in reversed(LENGTHS.items()):
        out = F.when(band.endswith(letter), F.lit(name)).otherwise(out)
    return out


def write_slices(slices: DataFrame, path: str) -> None:
    """Slices as Parquet, a folder for each channel."""
    slices.repartition("chan").write.partitionBy("chan").mode("overwrite").parquet(path)


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def float_bytes(values: list[float]) -> bytes:
    return struct.pack(f">{len(values)}d", *values)
