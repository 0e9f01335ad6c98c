"""The relations of the data model, derived from the tables at hand.

The cube's pixels are the rows of ``embeddings``, 25 to a row of the grid,
and its wavelengths the components. ``SQL`` has the same relations as
common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.runtime import ship

COLUMNS, PLANES = 25, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l, i, j, v, q, label): q is v in thousandths, so that sums are exact."""
    flat = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {COLUMNS}").cast("int").alias("i"), (F.col("vec_id") % COLUMNS).cast("int").alias("j"), "label", F.posexplode("embedding").alias("l", "x"))
    return flat.select("l", "i", "j", F.col("x").cast("double").alias("v"), "label").withColumn("q", F.round(F.col("v") * 1000).cast("long"))


def rows_of(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid, from the largest id."""
    return table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] // COLUMNS + 1


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct (i, j) that are there; the grid's last row may end early."""
    return table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {COLUMNS}").cast("int").alias("i"), (F.col("vec_id") % COLUMNS).cast("int").alias("j")).distinct()


def templates(c: DataFrame) -> DataFrame:
    """(m, l, t): the floor of the mean of q by label and wavelength."""
    return c.groupBy(F.col("label").alias("m"), "l").agg(F.floor(F.sum("q") / F.count("*")).cast("long").alias("t"))


def maps(c: DataFrame) -> DataFrame:
    from specweave.operators.linear import unmix_cube

    return unmix_cube(c, templates(c), "q")


SQL = {
    "cube": """cube AS (
    SELECT CAST(p - 1 AS INTEGER) AS l, CAST(vec_id // 25 AS INTEGER) AS i, CAST(vec_id % 25 AS INTEGER) AS j,
           CAST(embedding[p] AS DOUBLE) AS v, CAST(round(CAST(embedding[p] AS DOUBLE) * 1000) AS BIGINT) AS q, label
    FROM embeddings, range(1, 65) AS r(p))""",
    "templates": """templates AS (
    SELECT label AS m, l, CAST(floor(CAST(sum(q) AS DOUBLE) / count(*)) AS BIGINT) AS t FROM cube GROUP BY label, l)""",
    "maps": """maps AS (
    SELECT m, i, j, CAST(sum(q * t) AS BIGINT) AS a FROM cube JOIN templates USING (l) GROUP BY m, i, j)""",
    "size": "size AS (SELECT max(vec_id) // 25 + 1 AS n FROM embeddings)",
    "psf": "psf AS (SELECT * FROM (VALUES (0, 0, 4), (0, 1, 2), (0, -1, 1), (1, 0, 2), (-1, 0, 1)) AS t(di, dj, w))",
    "wpsf": """wpsf AS (
    SELECT CAST(p AS INTEGER) AS lp, CAST(2 * p + d AS INTEGER) AS l, CAST(b AS INTEGER) AS b, CAST(3 - abs(d) + b % 2 AS BIGINT) AS w
    FROM range(0, 32) AS x(p), range(-2, 3) AS y(d), range(0, 25) AS z(b) WHERE 2 * p + d BETWEEN 0 AND 63)""",
    "slits": """slits AS (
    SELECT CAST(s AS INTEGER) AS s, CAST(k AS INTEGER) AS j, CAST(least(k + 1.0, (s + 1) * 3.5) - greatest(k * 1.0, s * 3.5) AS DOUBLE) AS w
    FROM range(0, 7) AS x(s), range(0, 25) AS y(k) WHERE least(k + 1.0, (s + 1) * 3.5) - greatest(k * 1.0, s * 3.5) > 0)""",
    "mask": "mask AS (SELECT i, j FROM cube GROUP BY i, j HAVING bool_or(v >= 0.35 AND v <> 0))",
}


def sql(*names: str) -> str:
    """Common table expressions by name, after WITH."""
    return "WITH " + ",\n".join(SQL[n] for n in names)


def solver_sql(rounds: list[tuple[int, float | None]], mu: float) -> str:
    """Conjugate-gradient steps of the mixing problem (relations cube and templates / 1000), as common table expressions.

    Each round is (steps, threshold): the differences over both axes weigh
    min(1, threshold / |difference of the round's start|), or 1 without a
    threshold, times ``mu``. The last relation is ``found (m, i, j, v)``.
    """
    parts = ["tt AS MATERIALIZED (SELECT m, l, t / 1000.0 AS t FROM templates)", "b AS MATERIALIZED (SELECT m, i, j, sum(v * t) AS v FROM cube JOIN tt USING (l) GROUP BY m, i, j)"]
    here = {"i": ("(a.i - 1 + n) % n", "a.j"), "j": ("a.i", "(a.j - 1 + 25) % 25")}

    def normal(name: str, of: str, column: str, weights: str | None) -> None:
        terms = [f"SELECT m, i, j, sum(h.v * t) AS v FROM (SELECT l, i, j, sum({column} * t) AS v FROM {of} JOIN tt USING (m) GROUP BY l, i, j) h JOIN tt USING (l) GROUP BY m, i, j"]
        for axis, (i, j) in here.items():
            y = f"{mu} * (z.{column} - a.{column})" + (f" * w.of_{axis}" if weights else "")
            bent = f"FROM {of} a JOIN size ON true JOIN {of} z ON z.m = a.m AND z.i = {i} AND z.j = {j}" + (f" JOIN {weights} w ON w.m = a.m AND w.i = a.i AND w.j = a.j" if weights else "")
            terms += [f"SELECT a.m, a.i, a.j, -({y}) {bent}", f"SELECT a.m, {i}, {j}, {y} {bent}"]
        parts.append(f"{name} AS MATERIALIZED (SELECT m, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(v) AS q FROM (" + " UNION ALL ".join(terms) + ") GROUP BY ALL)")

    state, k, weights = "s0", 0, None
    parts.append("s0 AS MATERIALIZED (SELECT m, i, j, 0.0 AS x, v AS r, v AS p FROM b)")
    for number, (steps, threshold) in enumerate(rounds):
        if number:
            if threshold is not None:
                weights = f"w{number}"
                columns = ", ".join(f"least(1.0, coalesce({threshold} / nullif(abs({axis}.x - a.x), 0), 1.0)) AS of_{axis}" for axis in here)
                joins = " ".join(f"JOIN {state} {axis} ON {axis}.m = a.m AND {axis}.i = {i} AND {axis}.j = {j}" for axis, (i, j) in here.items())
                parts.append(f"{weights} AS MATERIALIZED (SELECT a.m, a.i, a.j, {columns} FROM {state} a JOIN size ON true {joins})")
            normal(f"n{number}", state, "x", weights)
            parts.append(f"s{k + 1} AS MATERIALIZED (SELECT m, i, j, x, b.v - q AS r, b.v - q AS p FROM {state} JOIN n{number} USING (m, i, j) JOIN b USING (m, i, j))")
            k, state = k + 1, f"s{k + 1}"
        for _ in range(steps):
            normal(f"q{k}", state, "p", weights)
            parts.append(f"c{k} AS MATERIALIZED (SELECT sum(p * q) AS pq, sum(p * r) / sum(p * q) AS step, sum(r * q) AS rq, sum(q * q) AS qq FROM {state} JOIN q{k} USING (m, i, j))")
            parts.append(f"s{k + 1} AS MATERIALIZED (SELECT m, i, j, x + step * p AS x, r - step * q AS r, r - step * q - (rq - step * qq) / pq * p AS p FROM {state} JOIN q{k} USING (m, i, j), c{k})")
            k, state = k + 1, f"s{k + 1}"
    return ",\n".join([*parts, f"found AS (SELECT m, i, j, x AS v FROM {state})"])


def psf(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, 4), (0, 1, 2), (0, -1, 1), (1, 0, 2), (-1, 0, 1)], "di int, dj int, w int")


def wpsf(spark: SparkSession) -> DataFrame:
    """A triangular response of five wavelengths to a detector sample, by column."""
    p = spark.range(32).select(F.col("id").cast("int").alias("lp"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d"))
    p = p.withColumn("l", F.col("lp") * 2 + F.col("d")).where(F.col("l").between(0, PLANES - 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS - 1))))
    return p.select("lp", "l", "b", (3 - F.abs("d") + F.col("b") % 2).cast("long").alias("w"))
