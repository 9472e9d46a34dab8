"""File and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Language packs by code.
LANGUAGES = {
    "kan": "Kannada", "eng": "English", "hin": "Hindi", "san": "Sanskrit", "tam": "Tamil", "tel": "Telugu", "mal": "Malayalam", "mar": "Marathi",
    "ben": "Bengali", "guj": "Gujarati", "ori": "Odia", "pan": "Punjabi", "asm": "Assamese", "urd": "Urdu", "sin": "Sinhala",
}
DEFAULT_LANGUAGES = ("kan", "eng")
SUPPORTED = (".pdf", *T.IMAGES)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the supported files of a folder, not of its subfolders."""
    files = spark.read.format("binaryFile").load(folder)
    return files.filter(T.file_extension(F.col("path")).isin(*SUPPORTED)).select("path", "length", "content")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): whole text files, stripped; empty ones go."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), T.strip(F.col("value")).alias("text"))
    return df.filter("text <> ''")


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts) if t.strip()], "doc_id long, text string")


def languages(spark: SparkSession, installed: list[str] | None = None) -> DataFrame:
    """(code, name) of the installed packs (the defaults, if none is known), sorted."""
    codes = sorted(set(installed or DEFAULT_LANGUAGES))
    return spark.createDataFrame([(c, LANGUAGES.get(c, c)) for c in codes], "code string, name string").orderBy("code")


def uploads(files: DataFrame) -> DataFrame:
    """(upload_path, filename, file_size_mb) of accepted files, with safe names."""
    name = F.regexp_extract("path", r"[^/\\]*$", 0)
    return files.filter(T.file_extension(F.col("path")).isin(*SUPPORTED)).select(F.col("path").alias("upload_path"), T.safe_filename(name).alias("filename"), F.round(F.col("length") / 1048576, 2).alias("file_size_mb"))


def system_status(spark: SparkSession, ocr=None, pdf=None, images=None) -> dict:
    """What this installation can do: engine versions, backends, languages."""
    installed = list(ocr.languages()) if ocr is not None else []
    return {
        "spark": spark.version, "ocr": bool(installed), "pdf": pdf is not None, "images": images is not None,
        "languages": [r.code for r in languages(spark, installed).collect()] if installed else [], "formats": list(SUPPORTED),
    }
