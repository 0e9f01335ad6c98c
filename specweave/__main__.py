"""python -m specweave FOLDER RESULT: maps and cube of the tables in a folder, see ``plans.fusion``."""

import argparse

from pyspark.sql import SparkSession

from specweave.plans import fusion


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="specweave", description=__doc__)
    parser.add_argument("folder", help="folder of the tables " + ", ".join(fusion.TABLES))
    parser.add_argument("result", help="folder for maps.parquet and cube.parquet")
    parser.add_argument("--factor", type=int, required=True, help="super-resolution factor")
    parser.add_argument("--weight", type=float, default=1.0, help="weight of the differences")
    parser.add_argument("--iterations", type=int, default=5)
    parser.add_argument("--templates", type=int, help="take the first templates only")
    parser.add_argument("--method", choices=sorted(fusion.METHODS), default="lcg")
    parser.add_argument("--joint", action="store_true", help="Laplacian instead of separate differences")
    parser.add_argument("--scale-data", action="store_true", help="samples are per solid angle")
    parser.add_argument("--verbose", action="store_true")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("specweave").getOrCreate()
    say = (lambda k, _: print(f"iteration {k + 1}")) if given.verbose else None
    maps, cube = fusion.fuse(fusion.read(spark, given.folder), given.factor, given.weight, given.iterations, given.method, given.templates, given.scale_data, given.joint, callback=say)
    maps.write.mode("overwrite").parquet(f"{given.result}/maps.parquet")
    cube.write.mode("overwrite").parquet(f"{given.result}/cube.parquet")


if __name__ == "__main__":
    main()
