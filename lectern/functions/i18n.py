"""Display names of the closed value sets, as a dimension to join, with fallback to English and then to the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Display names of statuses and relevances.
NAMES = {
    "en": {"Unread": "Unread", "Screened": "Screened", "Read": "Read", "Important": "Important", "A": "A — directly relevant", "B": "B — related", "C": "C — peripheral"},
    "ja": {"Unread": "未読", "Screened": "確認済み", "Read": "既読", "Important": "重要"},
}


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lang, key, name) for lang, names in NAMES.items() for key, name in names.items()], "lang string, key string, name string")


def translated(df: DataFrame, column: str, lang: str) -> DataFrame:
    """Add ``<column>_name``: the name in ``lang``, else in English, else the value itself. The dimension is a literal table, so it is broadcast."""
    names = dimension(df.sparkSession)
    own = names.where(F.col("lang") == lang).select(F.col("key").alias(column), F.col("name").alias("__own"))
    english = names.where("lang = 'en'").select(F.col("key").alias(column), F.col("name").alias("__english"))
    joined = df.join(F.broadcast(own), column, "left").join(F.broadcast(english), column, "left")
    return joined.withColumn(f"{column}_name", F.coalesce("__own", "__english", column)).drop("__own", "__english")


def canonical(name: str, lang: str) -> str:
    """The stored value of a display name."""
    for table in (NAMES.get(lang, {}), NAMES["en"]):
        for key, shown in table.items():
            if shown == name:
                return key
    return name
