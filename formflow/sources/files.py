"""Readers and writers of files, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formflow.functions import text as T

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
RECT = "struct<x:int,y:int,width:int,height:int>"
COLUMN = "index:int,x_start:int,x_end:int,width:int,type:string"
DEFINITION = (
    "form_type string, version string, extracted_from string, extraction_date string, "
    "image_dimensions struct<width:int,height:int>, "
    "grid struct<horizontal_lines:array<int>,vertical_lines:array<int>,row_count:int,column_count:int>, "
    f"columns struct<product_number:struct<{COLUMN}>,product_name:struct<{COLUMN}>,input_columns:array<struct<{COLUMN},name:string>>>, "
    f"products array<struct<row:int,product_number:string,product_name:string,product_number_cell:{RECT},product_name_cell:{RECT},cells:map<string,{RECT}>>>, "
    "empty_cell_threshold struct<variance:double,white_ratio:double>, _corrupt_record string"
)


def emails(spark: SparkSession, folder: str) -> DataFrame:
    """Mail files of a folder, any case of the suffix: ``email_id, path, modification_time, content``."""
    raw = spark.read.schema(BINARY).format("binaryFile").option("pathGlobFilter", "*.[eE][mM][lL]").load(folder)
    return _named(raw)


def email_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream: new files only, remembered by the query's checkpoint."""
    raw = (
        spark.readStream.schema(BINARY).format("binaryFile").option("pathGlobFilter", "*.[eE][mM][lL]")
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return _named(raw)


def _named(raw: DataFrame) -> DataFrame:
    return raw.select(
        T.stem(F.col("path")).alias("email_id"), "path", F.col("modificationTime").alias("modification_time"), "content"
    )


def images(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg,PNG,JPG,JPEG}") -> DataFrame:
    """Decodable images of a folder: ``name, path, image``; unreadable ones are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder)
    return raw.select(T.stem(F.col("image.origin")).alias("name"), F.col("image.origin").alias("path"), "image")


def template_images(spark: SparkSession, folder: str, word: str = "Bestellblatt") -> DataFrame:
    """PNG templates whose name holds ``word``, sorted by name."""
    return images(spark, folder, "*.{png,PNG}").filter(F.col("name").contains(word)).orderBy("name")


def latest(files: DataFrame, preferred: Column, by: list[str] | None = None) -> DataFrame:
    """Newest file: among the preferred ones if there are any, ties to the greater path.

    ``files``: ``path, modification_time``.
    """
    key = F.struct(preferred.cast("int").alias("p"), F.col("modification_time"), F.col("path"))
    return files.groupBy(*(by or [])).agg(F.max_by("path", key).alias("path")).filter(F.col("path").isNotNull())


def definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Form definitions of all JSON files; the last file of a form type wins.

    Files that can't be parsed or have no form type are left out.
    """
    raw = spark.read.schema(DEFINITION).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*.json")
    rows = raw.withColumn("_path", F.col("_metadata.file_path")).filter(F.col("_corrupt_record").isNull() & F.col("form_type").isNotNull())
    w = Window.partitionBy("form_type").orderBy(F.desc("_path"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_corrupt_record").withColumnRenamed("_path", "path")


def zone_sets(spark: SparkSession, path: str) -> DataFrame:
    """``(zone_set, kind, zone_idx, rect)``; a kind may be one object or an array of them."""
    raw = spark.read.text(path, wholetext=True).select(T.stem(F.col("_metadata.file_path")).alias("zone_set"), "value")
    rows = None
    for kind in ("orders", "names", "codes"):
        text = F.get_json_object("value", f"$.{kind}")
        items = F.when(text.startswith("["), F.from_json(text, f"array<{RECT}>")).otherwise(F.array(F.from_json(text, RECT)))
        part = raw.filter(text.isNotNull()).select("zone_set", F.lit(kind).alias("kind"), F.posexplode(items).alias("zone_idx", "rect"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.filter(F.col("rect").isNotNull())


def save_zone_set(spark: SparkSession, path: str, body: str) -> None:
    """Replace a zone file as a whole."""
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def product_list(spark: SparkSession, path: str) -> DataFrame:
    """``(row, code, code_lo, code_hi, name, section)`` of the pipe-separated list.

    Separator lines name the section of the rows after them. The file is read
    as one text, so the order of lines is that of the file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return parse_product_list(lines)


def parse_product_list(lines: DataFrame) -> DataFrame:
    """The same from ``(line, value)``."""
    section = F.when(F.col("value").startswith("---"), T.strip(F.regexp_replace("value", "-{2,}", "")))
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.split("value", r"\|")
    part = lambda i: T.strip(F.try_element_at(parts, F.lit(i)))
    code = F.nullif(part(2), F.lit(""))
    return (
        lines.withColumn("section", F.last(section, ignorenulls=True).over(w))
        .filter(F.size(parts) == 3)
        .select(
            part(1).try_cast("int").alias("row"), code.alias("code"),
            F.regexp_extract(code, r"^(\d+)", 1).try_cast("int").alias("code_lo"),
            F.regexp_extract(code, r"(\d+)$", 1).try_cast("int").alias("code_hi"), part(3).alias("name"), "section",
        )
        .filter(F.col("row").isNotNull())
    )


def training_samples(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, label, content)`` of PNG files in folders named by one digit."""
    raw = spark.read.schema(BINARY).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(folder)
    label = F.regexp_extract("path", r"/(\d)/[^/]+$", 1)
    return raw.select("path", label.alias("label"), "content").filter(F.col("label") != "")


def sample_rows(posts: DataFrame) -> DataFrame:
    """Posted samples with a digit and a well-formed data URL: ``digit, row, column, content``."""
    return posts.withColumn("content", T.from_data_url(F.col("image_data"))).filter(
        F.col("digit").rlike("^[0-9]$") & F.col("content").isNotNull()
    ).select("digit", "row", "column", "content")


def write_results(df: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    """Results partitioned by their task, replaced task by task."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind).save(path)


def task_summary(files: DataFrame, by: str = "task_id") -> DataFrame:
    """Files of each task, sorted, with their number; a summary file doesn't list itself."""
    listed = files.filter(~F.col("path").endswith("/summary.json"))
    return listed.groupBy(by).agg(F.array_sort(F.collect_set("path")).alias("files")).withColumn("count", F.size("files"))


class FormRegistry:
    """Form type -> definition JSON kept as a small table in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        """All entries; none where nothing was saved."""
        from pyspark.errors import AnalysisException

        schema = "form_type string, definition string"
        try:
            return self.spark.read.schema(schema).json(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def get(self, form_type: str) -> str | None:
        row = self.load().filter(F.col("form_type") == form_type).first()
        return row["definition"] if row else None

    def register(self, form_type: str, definition: str) -> None:
        """Add or replace one entry."""
        rest = self.load().filter(F.col("form_type") != form_type).collect()  # a registry of forms
        new = self.spark.createDataFrame([*map(tuple, rest), (form_type, definition)], "form_type string, definition string")
        new.coalesce(1).write.mode("overwrite").json(self.path)
