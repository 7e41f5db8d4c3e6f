"""Tables and SQL fragments that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import TOKEN
from ..operators import catalog


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; in one local process a temporary one."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with catalog columns."""
    return catalog.views(spark, docs(spark, sf_dir))


#: The same as corpus(), as a CTE.
C = f"""c AS (
  SELECT *, '/corp/' || source || '/' || lang || '/' || doc_id || '.' || ext AS file_path FROM (
    SELECT doc_id, text, lang, source, md5(text) AS md5, TIMESTAMP '2024-01-01' + to_days((doc_id % 365)::INT) AS create_time,
      CASE doc_id % 6 WHEN 0 THEN 'md' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'log' WHEN 4 THEN 'py' ELSE 'xyz' END AS ext,
      CASE WHEN doc_id % 10 < 6 THEN '{schemas.INDEXED}' WHEN doc_id % 10 = 6 THEN '{schemas.SAVED}' WHEN doc_id % 10 = 7 THEN '{schemas.ERROR}'
        WHEN doc_id % 10 = 8 THEN '{schemas.DELETED}' ELSE '{schemas.IGNORED}' END AS state
    FROM documents))"""


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '{TOKEN}')"


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], columns: str) -> str:
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns})"


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
