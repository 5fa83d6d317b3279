"""JSON documents, JSON lines, text, RTTM, manifests, listings and WAV audio."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palaver.operators.attribution import parse_rttm


def read_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON document per file; a file that doesn't parse fails the read, so that nothing is overwritten with emptiness."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_documents, or no rows where the path holds nothing. Other failures stay failures."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return read_documents(spark, path, schema) if there is not None and len(there) else spark.createDataFrame([], schema)


def write_documents(df: DataFrame, path: str) -> None:
    """JSON lines; the committer puts the files in place only when all are written."""
    df.write.mode("overwrite").json(path)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of every file below, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


RESULT = "result struct<final:struct<channelTag:string,alternatives:array<struct<text:string,words:array<struct<text:string,startTimeMs:bigint,endTimeMs:bigint>>>>>,channelTag:string>"


def parse_recognition(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """tag, text, words of the recogniser's JSON lines that hold a final result whose first alternative isn't blank; blank and bad lines are skipped.

    The tag is the final result's, else the result's, else "0"."""
    d = lines.select(*(keep or []), F.from_json(F.col(line), RESULT).alias("j"))
    first = F.try_element_at("j.result.final.alternatives", F.lit(1))
    return d.select(*(keep or []), F.coalesce("j.result.final.channelTag", "j.result.channelTag", F.lit("0")).alias("tag"), first["text"].alias("text"), first["words"].alias("words")).where("trim(text) <> ''")


def read_recognition(spark: SparkSession, path: str) -> DataFrame:
    return parse_recognition(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"), keep=["path"])


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return parse_rttm(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"), keep=["path"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """id, audio, ref, tags of a JSON-lines manifest; blank lines are no records."""
    return spark.read.schema("id string, audio string, ref string, tags array<string>").json(path).where("id IS NOT NULL")


def long_enough(samples: DataFrame, words: int, most: int) -> DataFrame:
    """The first ``most`` samples, by id, whose reference has at least ``words`` words: a bounded sample is the purpose."""
    n = F.size(F.filter(F.split("ref", r"\s+"), lambda w: w != ""))
    return samples.where(n >= words).orderBy("id").limit(most)


def wav_header(data: bytes) -> tuple[int, int, int]:
    """Channels, rate and bits of a canonical WAV header."""
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV header")
    channels, rate = struct.unpack_from("<HI", data, 22)
    return channels, rate, struct.unpack_from("<H", data, 34)[0]


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit WAV; samples are clamped to [-1, 1]."""
    x = np.clip(samples, -1, 1)
    pcm = np.where(x < 0, x * 32768, x * 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(pcm)) + pcm


def decode_wav(data: bytes) -> np.ndarray:
    """Samples of a 16-bit WAV as floats, channels averaged."""
    channels, _, bits = wav_header(data)
    if bits != 16:
        raise ValueError("only 16-bit WAV")
    x = np.frombuffer(data[44:], "<i2").astype(float) / 32768
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


def split_wav(files: DataFrame, most_bytes: int = 24_000_000) -> DataFrame:
    """path, part, offset_s, duration_s, content: WAV files cut into WAV parts of at most most_bytes. files: path, content; what is no WAV has no parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in b[["path", "content"]].itertuples(index=False):
                try:
                    channels, rate, bits = wav_header(data)
                except (ValueError, TypeError):
                    continue
                block = channels * bits // 8
                step = max(block, (most_bytes - 44) // block * block)
                body, out = data[44:], []
                for k, lo in enumerate(range(0, len(body), step)):
                    pcm = body[lo : lo + step]
                    head = bytearray(data[:44])
                    struct.pack_into("<I", head, 4, 36 + len(pcm))
                    struct.pack_into("<I", head, 40, len(pcm))
                    out.append((path, k, lo / block / rate, len(pcm) / block / rate, bytes(head) + pcm))
                yield pd.DataFrame(out, columns=["path", "part", "offset_s", "duration_s", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, part int, offset_s double, duration_s double, content binary")
