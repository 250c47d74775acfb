"""Feature layers in a folder partitioned by theme and type: written once, read by box with their own columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (theme, type) -> columns; the box columns come with every layer.
LAYERS = {
    ("transportation", "segment"): ("id", "subtype", "class", "subclass", "names", "connectors", "access_restrictions", "road_flags", "geometry"),
    ("base", "water"): ("id", "subtype", "class", "names", "geometry"),
    ("base", "land_use"): ("id", "subtype", "class", "names", "geometry"),
    ("base", "land"): ("id", "subtype", "class", "names", "geometry"),
    ("buildings", "building"): ("id", "subtype", "class", "height", "geometry"),
}
BOX = ("xmin", "xmax", "ymin", "ymax")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scan_layers(spark: SparkSession, root: str, box: tuple[float, float, float, float], layers: dict | None = None, merge: bool = False) -> dict[str, DataFrame]:
    """Per type the features that meet the closed box; folders, row groups and columns that are not needed are not read.

    A layer's columns are those of one of its files, so one footer is read a layer; ``merge`` reads them all, for layers
    whose files differ. Columns that a layer lacks come as nulls, and a layer without a folder as no rows.
    """
    x0, x1, y0, y1 = box
    out = {}
    for (theme, kind), columns in (layers or LAYERS).items():
        folder = f"{root}/theme={theme}/type={kind}"
        own = spark.read.options(basePath=root, mergeSchema=merge).parquet(folder) if _there(spark, folder) else spark.createDataFrame([], ", ".join(["theme string", "type string", *(f"{c} double" for c in BOX)]))
        have = set(own.columns)
        inside = own.where((F.col("theme") == theme) & (F.col("type") == kind)).where(f"xmin <= {x1!r}D and xmax >= {x0!r}D and ymin <= {y1!r}D and ymax >= {y0!r}D")
        out[kind] = inside.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in (*columns, *BOX)])
    return out


def union_promoted(tables: list[DataFrame]) -> DataFrame:
    """All rows, with every column that any table has; a table without rows still gives its columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def layer_cache(df: DataFrame, path: str) -> DataFrame:
    """``df`` as zstd Parquet under ``path``, written only if no complete table is there; ``path`` should name the parameters."""
    spark = df.sparkSession
    if not _there(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
