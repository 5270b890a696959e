"""Reading packet tables, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.functions.media import is_live, url_basename

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("stream_id", T.LongType()),
        T.StructField("frame_id", T.LongType()),
        T.StructField("stream_index", T.IntegerType()),
        T.StructField("media", T.StringType()),
        T.StructField("is_key", T.BooleanType()),
        T.StructField("pts", T.LongType()),
        T.StructField("dts", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def read_packets(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PACKET_SCHEMA,
    fmt: str = "parquet",
) -> DataFrame:
    """All packets of the inputs at ``path``; the schema is given, never inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_packet_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PACKET_SCHEMA,
    watermark: tuple[str, str] | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """The same packets as they arrive; ``watermark`` is a time column and a delay."""
    packets = spark.readStream.schema(schema).format(fmt).options(**options).load(path)
    return packets.withWatermark(*watermark) if watermark else packets


def probe_streams(
    df: DataFrame, stream: str = "stream_id", index: str = "stream_index"
) -> DataFrame:
    """First video and first audio index of each input; inputs without video are left out."""
    def first(media: str) -> Column:
        return F.min(F.when(F.col("media") == media, F.col(index)))

    return (
        df.groupBy(stream)
        .agg(first("video").alias("video_index"), first("audio").alias("audio_index"))
        .filter(F.col("video_index").isNotNull())
    )


def media_inventory(df: DataFrame, url: str = "url") -> DataFrame:
    """How many inputs are live or files, by the extension of their name.

    An extension is what follows the last dot of the name, in lower case and without query or
    fragment; a name without one has the empty extension.
    """
    path = F.regexp_replace(F.col(url), "[?#].*$", "")
    suffix = F.lower(F.regexp_extract(url_basename(path), r"\.[^.]*$", 0))
    return (
        df.select(
            F.when(is_live(url), "live").otherwise("file").alias("kind"), suffix.alias("suffix")
        )
        .groupBy("kind", "suffix")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def media_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, time and size of real media files; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("url"), "modificationTime", "length")
    )
