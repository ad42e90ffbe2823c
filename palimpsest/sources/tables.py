"""Reading tables, schemas of the catalog's own tables, and sinks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "array<struct<name:string,type:string,comment:string,required:boolean>>"
PARAMS = "array<struct<name:string,type:string,`default`:string>>"
ITEM_VERSION = f"spec string, name string, kind string, domain string, fork string, fork_seq int, code string, file string, github_url string, line_number int, fields {FIELDS}, params {PARAMS}, return_type string, docstring string, prose string, references array<string>, section_path array<string>, inline_comments array<string>, is_new boolean, is_modified boolean"
CONSTANT_VERSION = "spec string, name string, fork string, fork_seq int, value string, type string, description string, section string, category string, github_url string"
ENDPOINT = "spec string, key string, method string, path string, operation_id string, summary string, description string, tags array<string>, domain string, parameters array<struct<name:string,`in`:string,type:string,required:boolean,description:string>>, fork_variants map<string,string>, request_types array<string>, response_types array<string>, ssz_support boolean, has_examples boolean, errors array<struct<code:string,message:string>>, result_type string, source_file string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out evenly over four tasks a core (32 at least, as executors may still be starting).

    Files are cut by bytes: narrow rows lie in one or few splits, however long each takes in the parser that they go to.
    """
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, 32))


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local masters only)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='palimpsest')}")
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def put_text(spark: SparkSession, path: str, content: str) -> None:
    """Write one small file, such as a recorded answer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def file_name(part: str = "file_name") -> Column:
    """A file's name or path as it stands in the file system; the metadata column has it with percent signs."""
    return F.url_decode(F.replace(F.col(f"_metadata.{part}"), F.lit("+"), F.lit("%2B")))


def text_files(spark: SparkSession, path: str, version_pattern: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """(file, fork, content) of whole text files; the version is cut out of the path."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(file_name("file_path").alias("file"), F.col("value").alias("content"))
    return raw.withColumn("fork", F.regexp_extract("file", version_pattern, 1))


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there with any rows; one without rows has no folders, and so no schema."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and any(s.getPath().getName()[0] not in "._" for s in fs.listStatus(p))


def write_by(df: DataFrame, path: str, *by: str) -> None:
    """Write a table with one folder a key, and overwrite only the folders that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON without its missing values: empty texts and empty arrays count as missing."""
    kinds = dict(df.dtypes)
    keep = [F.when(F.size(c) > 0, F.col(c)).alias(c) if kinds[c].startswith(("array", "map")) else F.when(F.col(c) != "", F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*keep), {"ignoreNullFields": "true"}).alias("json"))


def indexes(spark: SparkSession, path: str) -> DataFrame:
    """(spec, doc) of index files named ``{spec}_index.json``, as variants; malformed files fail."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*_index.json").select(F.regexp_extract(file_name(), r"^(.*)_index\.json$", 1).alias("spec"), "value")
    return raw.select("spec", F.parse_json("value").alias("doc"))
