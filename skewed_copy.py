"""

    python skewed_copy.py SOURCE TARGET [FACTOR]

Events and embeddings are repeated FACTOR times under new ids; a third of the events go to one user.
The other tables are copied as they are. TARGET must not exist.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from featloom.session import get_session  # noqa: E402
from featloom.workload.views import BASE  # noqa: E402


def repeated(df, key: str, factor: int):
    """Every row once for each copy, with keys that do not meet."""
    span = df.agg(F.max(key) + 1).scalar()
    copies = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("_copy")
    return df.select("*", copies).withColumn(key, F.col(key) + F.col("_copy") * span)


def main(source: str, target: str, factor: int = 100) -> None:
    spark = get_session("featloom-skewed-copy")
    for table in BASE:
        df = spark.read.parquet(f"{source}/{table}.parquet")
        if table == "events":
            df = repeated(df, "event_id", factor)
            user = F.when(F.col("event_id") % 3 == 0, 0).otherwise(
                F.col("user_id") + F.col("_copy") * 1500
            )
            df = df.withColumn("user_id", user.cast(df.schema["user_id"].dataType)).drop("_copy")
        elif table == "embeddings":
            df = repeated(df, "vec_id", factor * 5).drop("_copy")
        df.write.mode("errorifexists").parquet(f"{target}/{table}.parquet")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(int, sys.argv[3:]))
