"""Readers with detection at the edge, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The headers that tell the two keyword exports apart.
EXPORT_A = ("Keyword", "Country", "Volume", "KD", "CPC", "Current position", "Current URL")
EXPORT_B = ("page", "query", "Clicks", "Impressions", "Avg Position")


def encoding_of(head: bytes) -> str:
    """Encoding by byte order mark, else UTF-16LE for many zero bytes, else UTF-8."""
    if head.startswith(b"\xff\xfe"):
        return "UTF-16LE"
    if head.startswith(b"\xfe\xff"):
        return "UTF-16BE"
    return "UTF-16LE" if head[:400].count(0) > 40 else "UTF-8"


def delimiter_of(line: str) -> str:
    """The most frequent of tab, comma and semicolon; tab wins ties."""
    return max("\t,;", key=lambda c: (line.count(c), c == "\t"))


def _first_piece(spark: SparkSession, path: str, n: int = 4096) -> bytes:
    """The first bytes of a file, or of the first file of a folder, through the store that Spark would use."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    if store.getFileStatus(at).isDirectory():
        at = min((x.getPath() for x in store.listStatus(at) if x.isFile() and not x.getPath().getName().startswith(("_", "."))), key=lambda x: x.getName())
    stream = store.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header, all columns strings; encoding and delimiter are found on its first bytes."""
    start = bytes(_first_piece(spark, path))
    encoding = encoding_of(start)
    first = start.decode(encoding, errors="ignore").lstrip("﻿").splitlines()[0]
    frame = spark.read.options(header=True, sep=delimiter_of(first), encoding=encoding, multiLine=True, quote='"', escape='"').csv(path)
    return frame.toDF(*[c.strip().lstrip("﻿") for c in frame.columns])


def detect_export(frame: DataFrame) -> str:
    """``a`` or ``b``; anything else fails with the columns it has."""
    for kind, need in (("a", EXPORT_A), ("b", EXPORT_B)):
        if set(need) <= set(frame.columns):
            return kind
    raise ValueError(f"unknown export with columns {frame.columns}")


def read_crawl(spark: SparkSession, path: str, extractor: str = "JSON-LD") -> DataFrame:
    """A crawl export: repeated extractor columns as an array, ``skip_reason`` for rows that are no indexable page."""
    frame = read_table(spark, path)
    if "Address" not in frame.columns:
        raise ValueError(f"no Address in {frame.columns}")
    blocks = [F.col(f"`{c}`") for c in frame.columns if c.startswith(extractor)]
    why = F.when(F.col("`Status Code`") != "200", "status").when(~F.contains(F.lower(F.coalesce(F.col("`Content Type`"), F.lit(""))), F.lit("html")), "content type").when(F.lower("Indexability") != "indexable", "not indexable")
    return frame.withColumn("blocks", F.filter(F.array(*blocks), lambda b: b.isNotNull() & (b != "")) if blocks else F.array().cast("array<string>")).withColumn("skip_reason", why)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def write_csv(frame: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Fixed columns; nested ones joined by semicolons."""
    flat = [F.array_join(c, "; ").alias(c) if dict(frame.dtypes)[c].startswith("array") else F.col(c) for c in columns]
    frame.select(*flat).write.mode(mode).option("header", True).csv(path)


def upsert(existing: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """New rows replace old ones by key; columns of ``keep`` stay as the old row has them; other old rows stay."""
    old = existing.select(key, *[F.col(c).alias(f"__{c}") for c in keep])
    fresh = new.join(old, key, "left")
    for c in keep:
        fresh = fresh.withColumn(c, F.coalesce(f"__{c}", F.col(c)))
    return fresh.select(*new.columns).unionByName(existing.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def file_targets(pages: DataFrame, *, url: str, file: str) -> DataFrame:
    """One page for each file name: without a query first, then the shortest; others have ``dropped``."""
    from pyspark.sql import Window

    w = Window.partitionBy(file).orderBy(F.contains(url, F.lit("?")), F.length(url), url)
    return pages.withColumn("dropped", F.row_number().over(w) > 1)


def digest(frame: DataFrame) -> DataFrame:
    """One hash of all rows, whatever their order: the exact sum of row hashes and their number."""
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(frame.columns)])
    return frame.select(row.cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.sha2(F.coalesce(F.sum("h"), F.lit(0)).cast("string"), 256).alias("digest"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """``platform, record`` of saved raw files, JSON lists or lines, named after their platform; to build reviews again without a network."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/.]+)\.[^/]*$", 1).alias("platform"), F.trim("value").alias("value"))
    listed = F.from_json("value", "array<string>")
    records = F.when(F.col("value").startswith("["), listed).otherwise(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))
    return whole.select("platform", F.explode(records).alias("record"))
