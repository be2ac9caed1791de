"""Folders of models to folders of encoded files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import drc, files, gltf, obj
from .tables import written


def stem(path: str, folder: str):
    """A path without its ending, relative to the folder that was read; files of one name in two folders stay apart."""
    base = "/" + folder.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    full = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.when(F.contains(full, F.lit(base)), F.substring_index(full, base, -1)).otherwise(F.regexp_extract(full, "([^/]+)$", 1))


def encode_folder(spark: SparkSession, folder: str, out: str) -> None:
    """A compressed mesh for each OBJ file with faces."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.obj").option("recursiveFileLookup", "true").load(folder).select(F.xxhash64("path").alias("mesh_id"), F.concat(stem("path", folder), F.lit(".drc")).alias("name"))
    done = drc.encode_meshes(*obj.meshes(obj.read_obj(spark, folder)))
    files.write_files(done.join(names, "mesh_id").select("name", F.col("drc").alias("content")), out)


def transcode_folder(spark: SparkSession, folder: str, out: str, loose: bool = False) -> DataFrame:
    """Writes the documents' files and a report of all documents, failed ones with their reason; gives the report."""
    done = written(gltf.transcoded(gltf.scenes(spark, folder)), "transcoded").withColumn("stem", stem("path", folder))
    good = done.where("status = 'done'")
    if loose:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    names, bodies = zip(*gltf.loose(body.as_py(), name, "resources"), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["name", "content"])

        rows = good.select("stem", "glb").mapInArrow(run, "name string, content binary")
    else:
        rows = good.select(F.concat("stem", F.lit(".glb")).alias("name"), F.col("glb").alias("content"))
    files.write_files(rows, f"{out.rstrip('/')}/files")
    report = gltf.report(done)
    report.write.mode("overwrite").json(f"{out.rstrip('/')}/report")
    return report
