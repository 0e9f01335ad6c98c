"""Dense kernels on array layouts, in Arrow batches of numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.schema import GridSpec


#: Arc seconds of a radian, and the full width at half maximum of a Gaussian over its deviation.
ARC_SECONDS, HALF_MAXIMUM = 206265, 2.354


def gaussian_psf(wavelengths: DataFrame, step: float, diameter: float = 6.5, size: int = 40, reach: float = 30.0) -> DataFrame:
    """Normalised Gaussians (l, x, y, w) for wavelengths (l, um) in micrometres.

    The full width at half maximum is wavelength over diameter; ``step`` is
    a pixel in arc seconds, and the grid has ``size`` samples a side, evenly
    over ``reach`` pixels either way.
    """
    sigma = F.col("um") * 1e-6 / diameter * ARC_SECONDS / (step * HALF_MAXIMUM)
    at = lambda c: F.lit(-reach) + F.col(c) * (2 * reach / (size - 1))
    each = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    spread = wavelengths.withColumn("x", each).withColumn("y", each)
    raw = spread.withColumn("_w", F.exp(-(at("x") * at("x") + at("y") * at("y")) / (2 * sigma * sigma)))
    return raw.select("l", "x", "y", (F.col("_w") / F.sum("_w").over(Window.partitionBy("l"))).alias("w"))


def transfer_function(psf: np.ndarray, shape: tuple[int, int], components: np.ndarray | None = None) -> np.ndarray:
    """Real FFT of point-spread functions [..., x, y] centred on pixel 0 of a larger grid.

    With ``components`` [K, wavelength], of each wavelength's function [l, x, y] weighted by each component: [K, l, ...].
    """
    if components is not None:
        psf = psf[None] * components[:, :, None, None]
    padded = np.zeros((*psf.shape[:-2], *shape))
    padded[..., : psf.shape[-2], : psf.shape[-1]] = psf
    return np.fft.rfft2(np.roll(padded, (-(psf.shape[-2] // 2), -(psf.shape[-1] // 2)), axis=(-2, -1)))


def fft_blur(stacked: DataFrame, otf: np.ndarray, grid: GridSpec, transposed: bool = False) -> DataFrame:
    """Circular blur of planes (l, plane) through the Fourier domain.

    ``otf`` is (rows, columns // 2 + 1), or has a leading axis by plane. The
    adjoint multiplies by the conjugate.
    """
    factor = np.conj(otf) if transposed else otf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("plane").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, grid.rows, grid.columns)
            h = factor[batch.column("l").to_numpy()] if factor.ndim == 3 else factor
            y = np.fft.irfft2(np.fft.rfft2(x) * h, s=(grid.rows, grid.columns)).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([batch.column("l"), pa.array(list(y), pa.list_(pa.float64()))], names=["l", "plane"])

    return stacked.mapInArrow(run, "l int, plane array<double>")


def fft_unmix(stacked: DataFrame, otf: np.ndarray, spectra: np.ndarray, grid: GridSpec) -> DataFrame:
    """Maps (l = template, plane) of blurred planes: each batch blurs and mixes back in one pass, and sums by template meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("plane").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, grid.rows, grid.columns)
            share = spectra[:, batch.column("l").to_numpy()]
            y = np.fft.irfft2(np.tensordot(share, np.fft.rfft2(x) * otf, 1), s=(grid.rows, grid.columns)).reshape(len(share), -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(share)), pa.int32()), pa.array(list(y), pa.list_(pa.float64()))], names=["l", "plane"])

    parts = stacked.mapInArrow(run, "l int, plane array<double>").select("l", F.posexplode("plane").alias("k", "v")).groupBy("l", "k").agg(F.sum("v").alias("v"))
    return parts.groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("plane"))


def fourier_resample(pixels: DataFrame, samples: int) -> DataFrame:
    """Spectra of ``samples`` values by cutting off their high frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("spectrum")
            length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out: list[np.ndarray | None] = [None] * len(column)
            for n in np.unique(length[length > 0]):
                at = np.flatnonzero(length == n)
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                for k, y in zip(at, np.fft.irfft(np.fft.rfft(x)[:, : samples // 2 + 1], samples), strict=True):
                    out[k] = y
            yield batch.set_column(batch.schema.get_field_index("spectrum"), "spectrum", pa.array(out, pa.list_(pa.float64())))

    return pixels.mapInArrow(run, "i int, j int, spectrum array<double>")


def spectral_response(wavelengths: DataFrame, detector: DataFrame, columns: DataFrame, resolution: float, scale: float, margin: int = 14) -> DataFrame:
    """Squared-sinc response (lp, l, b, w), of one sum for each detector sample and column.

    ``wavelengths`` is a regular axis (l, x) from l = 0, ``detector`` (lp, y)
    and ``columns`` (b, beta) the columns' places in the slit. The argument
    is multiplied by pi once more than the sinc itself does. Sums run over
    the wavelengths and a margin on either side, which is then left out.
    """
    ends = wavelengths.agg(F.max("l").alias("n"), F.min("x").alias("x0"), F.max("x").alias("xn")).first()
    step = (ends.xn - ends.x0) / ends.n
    wide = detector.sparkSession.range(-margin, ends.n + margin + 1).select(F.col("id").cast("int").alias("l"), (ends.x0 + step * F.col("id")).alias("x"))
    z = np.pi * np.pi * resolution * (F.col("y") - F.col("x") - scale * F.col("beta")) / F.col("y")
    pairs = detector.join(columns, F.lit(True)).join(wide, F.lit(True)).withColumn("_z", z)
    raw = pairs.withColumn("_w", F.when(F.abs("_z") < 1e-12, 1.0).otherwise(F.pow(F.sin("_z") / F.col("_z"), F.lit(2.0))))
    share = F.col("_w") / F.sum("_w").over(Window.partitionBy("lp", "b"))
    return raw.withColumn("w", share).where(F.col("l").between(0, ends.n)).select("lp", "l", "b", "w")


def one_hot_response(wpsf: DataFrame) -> DataFrame:
    """A response (lp, l, b, w) reduced to its largest wavelengths; ties are all 1."""
    top = F.max("w").over(Window.partitionBy("lp", "b"))
    return wpsf.select("lp", "l", "b", F.when(F.col("w") == top, 1).otherwise(0).alias("w"))


def repair_low(pixels: DataFrame, least: float = 1e-2) -> DataFrame:
    """Interior values below ``least`` become the mean of their neighbours.

    In order of wavelength, so that a repaired value serves the next one.
    Spectra (i, j, spectrum) may differ in length; null ones stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spectra = batch.column("spectrum").to_pylist()
            out: list[np.ndarray | None] = [None] * len(spectra)
            for n in {len(s) for s in spectra if s is not None}:
                rows = [k for k, s in enumerate(spectra) if s is not None and len(s) == n]
                x = np.array([spectra[k] for k in rows], float)
                for l in range(1, n - 1):
                    x[:, l] = np.where(x[:, l] < least, (x[:, l - 1] + x[:, l + 1]) / 2, x[:, l])
                for k, v in zip(rows, x, strict=True):
                    out[k] = v
            yield batch.set_column(batch.schema.get_field_index("spectrum"), "spectrum", pa.array(out, pa.list_(pa.float64())))

    return pixels.select("i", "j", F.col("spectrum").cast("array<double>").alias("spectrum")).mapInArrow(run, "i int, j int, spectrum array<double>")


_FREQUENCIES = "f int, l int, re array<double>, im array<double>"


def to_frequencies(stacked: DataFrame, grid: GridSpec) -> DataFrame:
    """Planes (l, plane) as rows of frequencies: (f, l, re, im), f the row of the real FFT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("plane").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, grid.rows, grid.columns)
            y = np.fft.rfft2(x).reshape(len(x) * grid.rows, -1)
            of = np.repeat(batch.column("l").to_numpy(), grid.rows)
            row = np.tile(np.arange(grid.rows), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(of, pa.int32()), pa.array(list(y.real), pa.list_(pa.float64())), pa.array(list(y.imag), pa.list_(pa.float64()))], names=["f", "l", "re", "im"])

    return stacked.mapInArrow(run, _FREQUENCIES)


def from_frequencies(rows: DataFrame, grid: GridSpec) -> DataFrame:
    """Planes again; a plane's rows meet in one group of the size of a plane."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("f")
        z = np.array(table.column("re").to_pylist()) + 1j * np.array(table.column("im").to_pylist())
        plane = np.fft.irfft2(z, s=(grid.rows, grid.columns)).ravel()
        return pa.table({"l": table.column("l").slice(0, 1), "plane": pa.array([plane], pa.list_(pa.float64()))})

    return rows.groupBy("l").applyInArrow(lambda t: run(t), "l int, plane array<double>")


def apply_by_frequency(rows: DataFrame, system: Callable[[int], np.ndarray], solve: bool = False) -> DataFrame:
    """A K by K matrix at each frequency applied to K maps, or solved for them.

    ``system`` gives the matrices [column, K, K] of one row of frequencies;
    maps are in order of l. Each row of frequencies is one group of K arrays.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("l")
        z = np.array(table.column("re").to_pylist()) + 1j * np.array(table.column("im").to_pylist())
        m = system(table.column("f")[0].as_py())
        y = (np.linalg.solve(m, z.T[..., None]) if solve else m @ z.T[..., None])[..., 0].T
        return pa.table({"f": table.column("f"), "l": table.column("l"), "re": pa.array(list(y.real), pa.list_(pa.float64())), "im": pa.array(list(y.imag), pa.list_(pa.float64()))})

    return rows.groupBy("f").applyInArrow(lambda t: run(t), _FREQUENCIES)


def mixing_system(spectra: np.ndarray, otf: np.ndarray, grid: GridSpec, mu: float = 0.0) -> Callable[[int], np.ndarray]:
    """Normal matrices of blur and mixing by row of frequencies, with ``mu`` on differences.

    ``spectra`` is [K, wavelength]; ``otf`` [rows, columns // 2 + 1], or with
    a leading axis by wavelength, which may include a throughput.
    """
    k = spectra.shape[0]
    across = 4 * np.sin(np.pi * np.fft.rfftfreq(grid.columns)) ** 2
    down = 4 * np.sin(np.pi * np.fft.fftfreq(grid.rows)) ** 2

    def system(f: int) -> np.ndarray:
        power = np.abs(otf[..., f, :]) ** 2
        gram = np.einsum("al,bl,lc->cab", spectra, spectra, power) if otf.ndim == 3 else (spectra @ spectra.T)[None] * power[:, None, None]
        return gram + mu * (down[f] + across)[:, None, None] * np.eye(k)

    return system


def closed_form_maps(stacked_maps: DataFrame, spectra: np.ndarray, otf: np.ndarray, grid: GridSpec, mu: float) -> DataFrame:
    """Maps that solve the regularised mixing problem, one small system a frequency.

    ``stacked_maps`` holds the adjoint's maps as planes (l = template).
    """
    normal = mixing_system(spectra, otf, grid, mu)
    steady = lambda f: normal(f) + 1e-12 * np.eye(spectra.shape[0])
    return from_frequencies(apply_by_frequency(to_frequencies(stacked_maps, grid), steady, solve=True), grid)
