"""Template rotation to the first unused question."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a topic whose first rows are found apart.
SALTS = 64


def rotate(rows: DataFrame, *, id_col: str, topic_col: str, start_col: str, templates: int) -> DataFrame:
    """(id, topic, template): in id order, each row of a topic takes the first free template from its start.

    A question holds its topic, so collisions lie within a topic; a topic has
    at most ``templates`` rows with a template, later ones get null. Each task
    passes on its least ids of a topic only, so a large topic is neither sorted
    nor gathered, and the rows with a template are joined back.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(topic_col).alias("topic"), F.col(start_col).cast("long").alias("start"))
    # Spark keeps a window's first rows in each task before it deals them out; salts share out what is left of a large topic.
    best = base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.row_number().over(Window.partitionBy("topic", "salt").orderBy("id")))
    best = best.where(F.col("n") <= templates).withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy("id"))).where(F.col("n") <= templates)

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        for row in frame.sort_values("id").itertuples():
            k = next((k % templates for k in range(row.start, row.start + templates) if k % templates not in used), None)
            used.add(k)
            out.append((row.id, row.topic, k))
        return pd.DataFrame(out, columns=["id", "topic", "template"])

    first = best.select("id", "topic", "start").groupBy("topic").applyInPandas(assign, "id long, topic string, template long")
    out = base.select("id", "topic").join(first.select("id", F.col("topic").alias("t"), "template"), (F.col("topic").eqNullSafe(F.col("t"))) & (base["id"] == first["id"]), "left")
    return out.select(base["id"], "topic", "template").withColumnsRenamed({"id": id_col, "topic": topic_col})
