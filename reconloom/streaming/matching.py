"""Stream-stream band join: statement rows meet ledger rows of the same cents within a window of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join_stream(stmt: DataFrame, led: DataFrame, days: int = 7, tolerance: int = 1, lateness: str = "1 day") -> DataFrame:
    """Pairs as they can be formed. Both sides have an event time (b_ts, a_ts); state older than the window and lateness goes.

    The amount is in the equality key, as in the batch join, so state is spread over all tasks.
    """
    b = stmt.withWatermark("b_ts", lateness).withColumn("_c", F.explode(F.sequence(F.col("b_cents") - tolerance, F.col("b_cents") + tolerance)))
    a = led.withWatermark("a_ts", lateness).withColumn("_ca", F.col("a_cents")).withColumnsRenamed({"ccy": "a_ccy", "account": "a_account"})
    near = F.expr(f"a_ts >= b_ts - INTERVAL {days} DAYS AND a_ts <= b_ts + INTERVAL {days} DAYS")
    return b.join(a, (F.col("ccy") == F.col("a_ccy")) & (F.col("account") == F.col("a_account")) & (F.col("_c") == F.col("_ca")) & near).drop("_c", "_ca", "a_ccy", "a_account")
