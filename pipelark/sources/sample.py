"""Sample tables: the access log of a sign-in service, and its users.

Every value is a hash of the seed, the row's number and the column, so that the
same seed gives the same tables on any number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .csv_sink import store

# Fixed values of the sample tables: names with their weights.
CODES = {"login": 30, "tokenvalidation": 25, "userinfo": 18, "tokenexchange": 12, "logout": 8, "signup": 7}
REGIONS = {"eastus": 40, "westus": 30, "northeurope": 20, "southeastasia": 10}
TIERS = {"free": 60, "pro": 30, "enterprise": 10}
COUNTRIES = ("US", "GB", "DE", "FR", "CA", "AU", "JP", "BR", "IN", "NL")
MINUTES = (15, 30, 60, 120, 240, 480, 1440)
STATUS = {200: 65, 201: 4, 400: 9, 401: 14, 500: 8}
USERS = 50
FIRST_DAY = "2026-05-01 00:00:00"

_HALF_DAY = 12 * 3_600_000


class _Draws:
    """Random numbers of one table's rows."""

    def __init__(self, seed: int, table: str):
        self.seed, self.table = seed, table

    def below(self, n: int, what: str) -> Column:
        """A whole number from 0 up to ``n``, other for each ``what``."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.table), F.lit(what), F.col("id")), F.lit(n))

    def one_of(self, weights: dict, what: str) -> Column:
        draw, total = self.below(sum(weights.values()), what), 0
        chosen = F
        for value, weight in weights.items():
            total += weight
            chosen = chosen.when(draw < total, F.lit(value))
        return chosen

    def sometimes(self, value: Column, percent: int, what: str) -> Column:
        """``value``, or null in so many of a hundred rows."""
        return F.when(self.below(100, f"null {what}") >= percent, value)


def _after(start: str, millis: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(F.expr(f"TIMESTAMP'{start}Z'")) + millis).cast("timestamp_ntz")


def requests(spark: SparkSession, files: int = 14, rows: int = 500, seed: int = 42) -> DataFrame:
    """``files`` half days from 2026-05-01 on, with ``rows`` requests each, numbered in order of time."""
    draw = _Draws(seed, "requests")
    ids = spark.range(files * rows)
    # A multiplier that shares no factor with a half day's milliseconds spreads rows without ties.
    offset = F.pmod((F.col("id") % rows) * 7_919_777 + draw.seed * 104_729 + (F.col("id") / rows).cast("long") * 15_485_863, F.lit(_HALF_DAY))
    placed = ids.withColumn("part", F.floor(F.col("id") / rows)).withColumn("offset", offset)
    number = F.col("part") * rows + F.row_number().over(Window.partitionBy("part").orderBy("offset", "id"))
    user = F.format_string("user-%03d", 1 + draw.below(USERS, "user"))
    status = draw.one_of(STATUS, "status")
    slow = F.when(status == 500, 8.0).when(status == 400, 0.5).otherwise(1.0)
    return placed.select(
        _after(FIRST_DAY, F.col("part") * _HALF_DAY + F.col("offset")).alias("timestamp"),
        F.format_string("req-%07d", number).alias("requestId"),
        draw.sometimes(user, 5, "user").alias("userId"),
        draw.one_of(CODES, "code").alias("requestCode"),
        status.cast("int").alias("statusCode"),
        F.round(slow * (8 + draw.below(60_000, "duration") / 1000), 3).alias("durationMs"),
        draw.sometimes(draw.one_of(REGIONS, "region"), 3, "region").alias("region"),
        draw.sometimes(F.make_dt_interval(F.lit(0), F.lit(0), draw.one_of(dict.fromkeys(MINUTES, 1), "ttl").cast("int")), 10, "ttl").alias("ttl"),
    )


def users(spark: SparkSession, seed: int = 42) -> DataFrame:
    """One row for each user, from the day before the first request."""
    draw = _Draws(seed, "users")
    return spark.range(USERS).select(
        _after("2026-04-30 00:00:00", F.col("id") * 1_700_000 + draw.below(1_000_000, "time")).alias("timestamp"),
        F.format_string("user-%03d", F.col("id") + 1).alias("userId"),
        draw.one_of(TIERS, "tier").alias("tier"),
        (draw.below(4, "active") > 0).alias("active"),
        draw.sometimes(draw.one_of(dict.fromkeys(COUNTRIES, 1), "country"), 5, "country").alias("countryCode"),
        _after("2025-01-01 00:00:00", draw.below(455, "signup") * 86_400_000).alias("signupDate"),
    )


def write(spark: SparkSession, folder: str, files: int = 14, rows: int = 500, seed: int = 42) -> None:
    """Both tables as CSV folders under ``folder``."""
    store(requests(spark, files, rows, seed), f"{folder}/requests", "requests", "timestamp", "half-day")
    store(users(spark, seed), f"{folder}/users", "users", "timestamp")
