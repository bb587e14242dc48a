"""Files in any Hadoop file system: kept results, object listing, JSON records, the stage cache."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session, whose executors are its driver, may leave that
    unset, as in tests."""
    try:
        named = spark.conf.get("spark.checkpoint.dir")
    except PySparkException:  # unset
        named = None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lumenlake-")
    return _OWN[app]


def kept(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut in lineage that survives lost executors. Files
    lie under the application's id; released() deletes what is used up."""
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lies_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes the files of kept tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lies_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def safe_key(key: str) -> str:
    """A relative key with forward slashes; one that is absolute or leaves its root is an error."""
    clean = key.replace("\\", "/")
    path = posixpath.normpath(clean) if clean else ""
    if not clean or clean.startswith("/") or ":" in clean.split("/")[0] or path.startswith("..") or path == ".":
        raise ValueError(f"not a key under the root: {key!r}")
    return path


class ObjectStore:
    """Blobs by key under a root path of any Hadoop file system (file, hdfs, s3a, ...). Driver-side;
    reading many objects is listing(), a distributed scan."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def read(self, key: str) -> bytes | None:
        path = self._path(safe_key(key))
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, key: str, data: bytes, only_new: bool = False) -> bool:
        """Written aside and put into place whole, so a reader never sees a part. only_new: false if it is there; of
        several writers one wins, where renaming does not replace (HDFS) or files can be linked (local ones)."""
        path = self._path(safe_key(key))
        if only_new and self._fs.exists(path):
            return False
        aside = self._path(f"{safe_key(key)}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if not only_new:
            self._fs.delete(path, False)
        done = self._linked(aside, path) if only_new and self._fs.getScheme() == "file" else self._fs.rename(aside, path)
        if self._fs.exists(aside):
            self._fs.delete(aside, False)
        return bool(done)

    def _linked(self, aside, path) -> bool:
        """Whether a local file's second name could be made: never over one that is there."""
        at = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self._jvm.java.nio.file.Files.createLink(at(path), at(aside))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def delete(self, key: str) -> None:
        self._fs.delete(self._path(safe_key(key)), False)

    def stat(self, key: str) -> tuple[int, int] | None:
        """Bytes and modification time in milliseconds."""
        path = self._path(safe_key(key))
        if not self._fs.exists(path):
            return None
        found = self._fs.getFileStatus(path)
        return found.getLen(), found.getModificationTime()

    def listing(self, prefix: str = "", content: bool = False) -> DataFrame:
        """key, length, modified (and content) of the objects whose key starts with a string prefix. Spark's
        scan passes over empty files."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        root = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/")
        key = F.regexp_replace(F.col("path"), rf"^[a-z0-9]+:(?://[^/]*)?{root}/", "")
        out = files.select(key.alias("key"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
        return out.where(F.col("key").startswith(prefix)).where(~F.col("key").endswith(".part"))


def json_record(text: Column, schema: str) -> Column:
    """A struct from JSON; null for text that is none."""
    return F.from_json(text, f"struct<{schema}, _bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def read_json(text: Column, schema: str) -> Column:
    parsed = json_record(text, schema)
    return F.when(parsed.isNotNull() & parsed["_bad"].isNull(), parsed.dropFields("_bad"))


def derivative_key(kind: str, content_hash: Column) -> Column:
    """kind/ab/hash.jpg."""
    return F.concat_ws("/", F.lit(kind), F.substring(content_hash, 1, 2), F.concat(content_hash, F.lit(".jpg")))


def face_key(content_hash: Column, number: Column) -> Column:
    return F.concat(F.lit("face/"), F.substring(content_hash, 1, 2), F.lit("/"), content_hash, F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit(".jpg"))


def cache_get(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (content_hash, stage, model) with the payload of each, null where there is none."""
    keys = ["content_hash", "stage", "model"]
    return wanted.join(cache.select(*keys, "payload"), keys, "left")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries in place of old ones of the same key."""
    keys = ["content_hash", "stage", "model"]
    return cache.join(new.select(*keys), keys, "left_anti").unionByName(new)


def cache_prune(cache: DataFrame, photos: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Entries of photos that are still there, and, given jobs, of models that are still in use."""
    out = cache.join(photos.select("content_hash"), "content_hash", "left_semi")
    return out.join(jobs.where("model IS NOT NULL").select("model").distinct(), "model", "left_semi").select(*cache.columns) if jobs is not None else out
