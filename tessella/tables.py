"""Tables in the folder that the cluster shares, and schemas of the mesh model."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in spark.checkpoint.dir: iterations end their lineage here. Only where that is unset, a folder of our own."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/mesh/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


L, I, S, D, B = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BinaryType()
FACES = _schema(mesh_id=L, face_idx=L, p0=L, p1=L, p2=L)
ATTRIBUTES = _schema(mesh_id=L, att_id=I, att_type=S, domain=S, component_type=S, num_components=I, name=S)
ATTRIBUTE_VALUES = _schema(mesh_id=L, att_id=I, val_idx=L, value=T.ArrayType(T.FloatType()))
POINT_VALUES = _schema(mesh_id=L, att_id=I, point_idx=L, val_idx=L)
BITSTREAMS = _schema(mesh_id=L, drc=B)
