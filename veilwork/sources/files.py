"""Folders of files, uploads and settings as tables."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.config import DEFAULT, Config
from veilwork.functions import predicates as Q


def documents_in(spark: SparkSession, folder: str, with_content: bool = True) -> DataFrame:
    """The PDF and DOCX files of a folder, not of folders in it: path, filename, length, and content if asked for. The
    suffix is tested before a file is opened, and content that is not selected is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).filter(Q.supported(F.col("path")))
    named = files.withColumn("filename", F.url_decode(F.element_at(F.split(F.regexp_replace("path", r"\+", "%2B"), "/"), -1)))
    return named.select("path", "filename", "length", *(["content"] if with_content else []))


def uploads(spark: SparkSession, files: list[tuple[str, bytes]], config: Config = DEFAULT) -> DataFrame:
    """Uploaded files; too many of them, or one that is too large, is an error of the call."""
    if len(files) > config.max_files:
        raise ValueError(f"{len(files)} files; at most {config.max_files} are taken")
    large = [name for name, data in files if len(data) > config.max_upload_mb << 20]
    if large:
        raise ValueError(f"{large[0]} is larger than {config.max_upload_mb} MB")
    return spark.createDataFrame([(n, bytearray(d), len(d)) for n, d in files], "filename string, content binary, length long")


def upload_errors(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Each file with `error`: too large, or of a kind that is not taken; null if it is fine."""
    return files.withColumn("error", F.when(F.col("length") > config.max_upload_mb * 1048576, "too large").when(~Q.supported(F.col("filename")), "unsupported type"))


def int_setting(name: str, default: int, env: Mapping[str, str] = os.environ) -> int:
    try:
        return int(env.get(name, "").strip())
    except ValueError:
        return default


def int_setting_column(value: Column, default: int) -> Column:
    """The same for a column: blank and garbage give the default."""
    return F.coalesce(F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("int")), F.lit(default))


def manifest_of(raw: DataFrame, column: str = "raw") -> DataFrame:
    """A manifest read back from JSON; null where it is missing or broken."""
    schema = "struct<total_redactions:bigint,failed:bigint,files:array<struct<filename:string,output_name:string,redactions:bigint,pages:int,used_ocr:boolean,unmapped:boolean,error:string>>>"
    return raw.withColumn("manifest", F.from_json(column, schema)).withColumn("manifest", F.when(F.col("manifest.files").isNotNull(), F.col("manifest")))


def manifest_in(bundle: bytes) -> dict | None:
    """The manifest of one bundle; None where the zip or the manifest is missing or broken."""
    try:
        with zipfile.ZipFile(io.BytesIO(bundle)) as z:
            return json.loads(z.read("manifest.json"))
    except (zipfile.BadZipFile, KeyError, ValueError):
        return None
