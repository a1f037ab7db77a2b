"""The job from documents to a chunk table, and the table's versions.

A version is a manifest: the folders that make the table, in order. A run writes a folder with the chunks of documents that are new or changed, and the
state of these and of those that are gone; folders of earlier runs stay as they are, and what they say of documents that a later folder names is hidden.
So a run writes in proportion to the change. Trailing folders are merged when they are as large as the one before (each row is rewritten a number of
times that grows with the logarithm of the table). A manifest is published under the next number by a rename that fails if the number is taken: then
the run puts its folder behind what the other has published, and tries again. Of two runs that change one document, the later to publish counts; a run
deletes those documents only that it saw when it began. The file system must rename atomically, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import incremental, tables

Step = Callable[[DataFrame], DataFrame]
#: Documents of later folders are broadcast up to so many, when those of an earlier one are read.
HIDDEN = 500_000


@dataclass(frozen=True)
class Version:
    number: int
    folders: list[dict]  # path, docs (how many documents its state names)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers that are published and not vacuumed."""
    where, fs = _files(spark, f"{path}/_log")
    if not fs.exists(where):
        return []
    return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(where) if x.getPath().getName().endswith(".json"))


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The last version, or that of a number; number 0 and no folders where there is none."""
    last = number if number is not None else max(versions(spark, path), default=0)
    if not last:
        return Version(0, [])
    return Version(last, json.loads(spark.read.text(f"{path}/_log/{last:012}.json", wholetext=True).first()["value"]))


def _publish(spark: SparkSession, path: str, version: Version) -> bool:
    """Whether this number was free."""
    draft, fs = _files(spark, f"{path}/_log/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(version.folders).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    goal = jvm.org.apache.hadoop.fs.Path(f"{path}/_log/{version.number:012}.json")
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, goal, option)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def append(spark: SparkSession, path: str, folder: dict | None, tries: int = 20) -> Version:
    """Publishes a version with the folder (path, docs) behind those of the last one, whatever others publish meanwhile."""
    for _ in range(tries):
        last = current(spark, path)
        version = Version(last.number + 1, [*last.folders, folder] if folder else last.folders)
        if _publish(spark, path, version):
            return version
    raise RuntimeError(f"{path}: others published {tries} times meanwhile")


def _rows(spark: SparkSession, folders: list[dict], part: str) -> DataFrame | None:
    """The rows of a part that no later folder hides."""
    out = None
    for i, folder in enumerate(folders):
        rows, later = spark.read.parquet(f"{folder['path']}/{part}"), folders[i + 1 :]
        if later:
            hidden = spark.read.parquet(*[f"{x['path']}/state" for x in later]).select("doc_id").distinct()
            rows = rows.join(F.broadcast(hidden) if sum(x["docs"] for x in later) <= HIDDEN else hidden, "doc_id", "left_anti")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read(spark: SparkSession, path: str, part: str = "chunks", number: int | None = None) -> DataFrame:
    """The chunks (or the state) of the last version, or that of a number."""
    version = current(spark, path, number)
    if not version.folders:
        raise ValueError(f"no version of {path} is published")
    rows = _rows(spark, version.folders, part)
    return rows.where(~F.col("gone")).drop("gone") if part == "state" else rows


def prepare(docs: DataFrame, path: str, chunk: Step, source: str, now: str, frame: Step | None = None, extract: tuple[Step, ...] = ()) -> dict | None:
    """Writes the folder of a run, which is not published yet. None if nothing changed."""
    spark = docs.sparkSession
    marked = docs.withColumn("fingerprint", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    version = current(spark, path)
    state = read(spark, path, "state", version.number) if version.folders else marked.select("doc_id", "fingerprint").limit(0)
    changed = incremental.changed(marked, state, "doc_id", "fingerprint")
    gone = incremental.deleted(marked, state, "doc_id").select("doc_id", F.lit(None).cast("string").alias("fingerprint"), F.lit(True).alias("gone"))
    folder = f"{path}/data-{uuid.uuid4().hex}"
    changed.select("doc_id", "fingerprint", F.lit(False).alias("gone")).unionByName(gone).write.parquet(f"{folder}/state")
    touched = spark.read.parquet(f"{folder}/state")
    count = touched.count()
    fresh = changed.drop("fingerprint")
    rows = chunk(frame(fresh) if frame else fresh)
    for step in extract:
        rows = step(rows)
    if not count and version.folders:
        return None
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seq_num").cast("string"))
    rows = rows.select(name.alias("id"), "*", F.lit(source).alias("source"), F.lit(now).cast("timestamp").alias("created_at"))
    if version.folders:
        before = _rows(spark, version.folders, "chunks")
        tables.append_preflight(before, rows)
        ids = touched.select("doc_id")
        own = before.join(F.broadcast(ids) if count <= HIDDEN else ids, "doc_id", "left_semi").select("id", F.col("source").alias("_source"), F.col("created_at").alias("_created"))
        rows = rows.join(own, "id", "left").withColumn("source", F.coalesce("_source", "source")).withColumn("created_at", F.coalesce("_created", "created_at")).drop("_source", "_created")
    rows.write.parquet(f"{folder}/chunks")
    return {"path": folder, "docs": count}


def ingest(docs: DataFrame, path: str, chunk: Step, source: str, now: str, frame: Step | None = None, extract: tuple[Step, ...] = ()) -> DataFrame:
    """Brings the table at path up to docs (doc_id, content, and more). Only documents that are new or changed go through frame, chunk
    (giving doc_id, seq_num, original_content, embedded_content, and more) and extract; chunks of documents that are gone go, so do those
    that a document no longer has. Source and creation time of a chunk are written once. Returns the new version's chunks."""
    spark = docs.sparkSession
    append(spark, path, prepare(docs, path, chunk, source, now, frame, extract))
    version = merge_small(spark, path)
    return read(spark, path, number=version.number)


def merge_small(spark: SparkSession, path: str, most: int = 4) -> Version:
    """Merges trailing folders while there are more than `most` and they name as many documents as the one before them. Given up if others merge, too."""
    version = current(spark, path)
    first, docs = len(version.folders), 0
    while first and (first == len(version.folders) or version.folders[first - 1]["docs"] <= docs):
        first -= 1
        docs += version.folders[first]["docs"]
    if len(version.folders) <= most or len(version.folders) - first < 2:
        return version
    merged, folder = version.folders[first:], f"{path}/data-{uuid.uuid4().hex}"
    _rows(spark, merged, "chunks").write.parquet(f"{folder}/chunks")
    state = _rows(spark, merged, "state")
    # with nothing before, there is nothing left to hide
    (state if first else state.where(~F.col("gone"))).write.parquet(f"{folder}/state")
    made = {"path": folder, "docs": spark.read.parquet(f"{folder}/state").count()}
    for _ in range(20):
        last = current(spark, path)
        if last.folders[first : first + len(merged)] != merged:
            return last
        version = Version(last.number + 1, [*last.folders[:first], made, *last.folders[first + len(merged) :]])
        if _publish(spark, path, version):
            return version
    return current(spark, path)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes versions but for the last `keep`, and folders that none of these has: to be called when no run is at work. How many folders went."""
    numbers = versions(spark, path)
    used = {f["path"].rsplit("/", 1)[1] for n in numbers[-keep:] for f in current(spark, path, n).folders}
    where, fs = _files(spark, path)
    gone = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith("data-") and x.getPath().getName() not in used]
    for n in numbers[:-keep]:
        fs.delete(_files(spark, f"{path}/_log/{n:012}.json")[0], False)
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)
