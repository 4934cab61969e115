"""The grid index: build, write, load."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangegrid.operators import encode, grid


@dataclass
class GridIndex:
    """Rows (rid, x[, y[, z]], bx, by, bin, tx, ty), the parameters of their grid, and a value map (v, pos) for each column.

    An index of one column has a grid of one row.
    """

    params: grid.GridParams
    rows: DataFrame
    n_columns: int
    maps: list[DataFrame] = field(default_factory=list)
    encoded: DataFrame | None = None

    @classmethod
    def build(cls, df: DataFrame, rid: str, columns: list[str], resolution: int = grid.RESOLUTION, method: str = "ranges") -> GridIndex:
        if len(columns) not in (1, 2, 3):
            raise ValueError("an index has one, two or three columns")
        names = dict(zip("xyz", columns, strict=False))
        n = df.select(*columns).dropna().count()
        encoded = encode.encode_columns(df, rid, names, method, n, keep_values=True)
        return cls._of(encoded, grid.GridParams(n, resolution), len(columns))

    @classmethod
    def _of(cls, encoded: DataFrame, p: grid.GridParams, n_columns: int) -> GridIndex:
        names = "xyz"[:n_columns]
        # a value's first position is the least of its rows': no order is needed for the maps
        maps = [encoded.groupBy(F.col(f"v_{c}").alias("v")).agg(F.min(c).alias("pos")) for c in names]
        return cls(p, grid.with_bin(encoded.select("rid", *names), p), n_columns, maps, encoded)

    @property
    def directory(self) -> DataFrame:
        return grid.directory(grid.histogram(self.rows))

    def write(self, path: str) -> None:
        """Parquet below ``path``, a folder for each coarse tile, rows in order of bins within files; and the value maps.

        There are at most (resolution / TILE) ** 2 tiles. Ranges of (tile, bin) make files of even size, however the
        values are spread; min and max of each row group then bound its bins. Positions are computed once, into a table
        that goes when the others are there.
        """
        spark, index, staged = self.rows.sparkSession, self, f"{path}/staged"
        if self.encoded is not None:
            self.encoded.write.parquet(staged)
            index = self._of(spark.read.schema(self.encoded.schema).parquet(staged), self.params, self.n_columns)
        dealt = index.rows.repartitionByRange("tx", "ty", "bin", "rid").sortWithinPartitions("tx", "ty", "bin", "rid")
        dealt.write.partitionBy("tx", "ty").parquet(f"{path}/rows")
        for k, m in enumerate(index.maps):
            m.repartitionByRange("v").sortWithinPartitions("v").write.parquet(f"{path}/map-{k}")
        spark.createDataFrame([(self.params.n, self.params.resolution, self.params.lo, self.n_columns)], "n long, resolution int, lo long, n_columns int").coalesce(1).write.parquet(f"{path}/params")
        if self.encoded is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(staged)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GridIndex:
        n, resolution, lo, columns = spark.read.parquet(f"{path}/params").first()
        return cls(grid.GridParams(n, resolution, lo), spark.read.parquet(f"{path}/rows"), columns, [spark.read.parquet(f"{path}/map-{k}") for k in range(columns)])

    def payload(self) -> DataFrame:
        """Rows with their slot in bin order."""
        return grid.scatter(self.rows, self.directory).select("slot", *[c for c in "xyz"[: self.n_columns]], "rid", "bin")

    def n_bins(self) -> int:
        return self.rows.select(F.countDistinct("bin")).first()[0]
