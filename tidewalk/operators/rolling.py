"""Decayed signals of users and items over the last ``history_days``, kept up to date day by day.

A weight at time t counts 2 ** ((t - ORIGIN) / half_life): at a later moment all sums decay by one common factor, so nothing that is stored
has to change as time goes by. A new day adds its own sums and takes off those of the day that leaves the window, which were stored
when it came, so it costs these two days and the buckets of the pairs in them. The number of events goes along: a pair without any
left is removed, and no rounding keeps it alive. Sums of newer events are the larger ones and leave last, so little is lost in differences.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewalk.config import CONFIG
from tidewalk.sources.versioned import KeyedTable

#: The moment whose events count 1; sums stay finite for some 80 years after it.
ORIGIN = datetime(2020, 1, 1)
PAIR = ["user_id", "project_id"]
SCHEMA = T.StructType([T.StructField(k, T.LongType()) for k in PAIR] + [T.StructField("sum", T.DoubleType()), T.StructField("n", T.LongType())])


class RollingSignals:
    """The table of sums under ``path``, as of the end of the last day that it took."""

    def __init__(self, spark: SparkSession, path: str, history_days: int = CONFIG.history_days, half_life: float = CONFIG.half_life_days, buckets: int = 64):
        self.spark, self.path, self.history, self.half_life = spark, path.rstrip("/"), history_days, half_life
        self.table = KeyedTable(spark, f"{self.path}/sums", SCHEMA, PAIR, buckets)

    def last(self) -> date | None:
        ids = self.table.state()["ids"]
        return date.fromisoformat(ids[-1]) if ids else None

    def _sums(self, rows: DataFrame, *by: str) -> DataFrame:
        days = F.timestamp_diff("MICROSECOND", F.lit(ORIGIN.isoformat(" ")).cast("timestamp_ntz"), F.col("created_at")) / F.lit(86_400_000_000.0)
        grown = F.col("weight") * F.pow(F.lit(2.0), days / F.lit(float(self.half_life)))
        return rows.filter("weight <> 0").groupBy(*by, *PAIR).agg(F.sum(grown).alias("sum"), F.count("*").alias("n"))

    def _day(self, day: date) -> DataFrame:
        """The sums stored for a day, none if there are none."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/days/day={day}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/days/day={day}")

    def load(self, rows: DataFrame, until: date) -> None:
        """Begin with all rows (user_id, project_id, created_at, weight) up to the end of day ``until``."""
        if self.last() is not None:
            raise ValueError("there are sums already")
        day = F.to_date("created_at")
        inside = rows.filter((day <= F.lit(until)) & (day > F.lit(until - timedelta(days=self.history)))).withColumn("day", day)
        self._sums(inside, "day").repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/days")
        stored = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/days")
        self.table.upsert(stored.groupBy(*PAIR).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")), str(until))

    def advance(self, rows: DataFrame, day: date) -> bool:
        """Take the rows of the next day; a day that it has taken changes nothing, a later one than the next is an error. Whether it was taken.

        A call that failed can be made again: a day's own sums are written anew, and count with the commit.
        """
        last = self.last()
        if last is None or day > last + timedelta(days=1):
            raise ValueError(f"the next day is {last and last + timedelta(days=1)}")
        if day <= last:
            return False
        own = rows.filter(F.to_date("created_at") == F.lit(day))
        self._sums(own).write.mode("overwrite").parquet(f"{self.path}/days/day={day}")
        gone = self._day(day - timedelta(days=self.history)).select(*PAIR, F.negative("sum").alias("sum"), F.negative("n").alias("n"))
        moved = self._day(day).unionByName(gone).groupBy(*PAIR).agg(F.sum("sum").alias("more"), F.sum("n").alias("n_more"))
        old = self.table.read("rows", self.table.touched("rows", moved))
        now = moved.join(old, PAIR, "left").select(*PAIR, (F.coalesce("sum", F.lit(0.0)) + F.col("more")).alias("sum"), (F.coalesce("n", F.lit(0)) + F.col("n_more")).alias("n"))
        return self.table.upsert(now.withColumn("gone", F.col("n") == 0), str(day), deleted="gone")

    def signals(self, features: DataFrame) -> DataFrame:
        """user_id, feature, signal at the end of the last day."""
        now = datetime.combine(self.last(), datetime.min.time()) + timedelta(days=1)
        factor = 2.0 ** (-(now - ORIGIN).total_seconds() / 86_400 / self.half_life)
        return self.table.rows().join(features, "project_id").groupBy("user_id", "feature").agg((F.sum(F.col("sum") * F.col("value")) * factor).alias("signal"))
