"""Sources of documents: layout rows as JSON or Parquet, whole texts, uploads, annotations, and append-only logs.

Readers of PDF and DOCX are optional plug-ins that give the same rows; the engine itself starts from layout rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "doc_id string, page int, text string"
LINE = "doc_id string, page int, line_no int, text string, top double, bottom double, in_table boolean"
TABLE = "doc_id string, table_no int, page int, top double, bottom double, header array<string>, context string"
CELL = "doc_id string, table_no int, page int, row_no int, col_no int, text string"
REF = "struct<page:int,quote:string,object:string,value:struct<num:double,str:string,bool:boolean,range:array<double>>,unit:string,section:string,row:string,col:string,derived:string,occurrences:int>"
ANNOTATION = f"document_id string, lang string, pages int, objects map<string,string>, findings array<struct<id:string,level:string,type:string,field:string,object:string,confidence:string,refs:array<{REF}>>>"
ACCESS_REQUEST = "email string, organization string, comment string, created_at timestamp"
STATEMENT = "package_id string, doc_id string, section string, object_id string, field string, value double, raw string, page int, source string, method string, score double, seq long"
SCHEMAS = {"page": PAGE, "line": LINE, "table": TABLE, "cell": CELL, "annotation": ANNOTATION, "access_request": ACCESS_REQUEST, "statement": STATEMENT}
FURNITURE_POINTS = 72.0


def read_rows(spark: SparkSession, path: str, kind: str, fmt: str = "json") -> DataFrame:
    """Rows of a known kind; a malformed file fails at once."""
    reader = spark.read.schema(SCHEMAS[kind])
    return reader.option("mode", "FAILFAST").json(path) if fmt == "json" else reader.format(fmt).load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents of one page; form feeds part pages."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.split("value", "\f").alias("p"))
    return whole.select("doc_id", F.posexplode("p").alias("page", "text")).withColumn("page", F.col("page") + 1)


def read_uploads(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """Files with a name for the store; larger ones are marked, not read by later steps."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.concat(F.substring(F.sha1(name), 1, 20), F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("key"), "length", (F.col("length") <= most_bytes).alias("accepted"), "content")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """Pages of plain text as lines."""
    return pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def without_furniture(lines: DataFrame, pages: DataFrame, points: float = FURNITURE_POINTS) -> DataFrame:
    """Lines between the running head and foot. pages: doc_id, page, height; lines have top and bottom."""
    return lines.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"], "left").where(F.col("height").isNull() | ((F.col("bottom") >= points) & (F.col("top") <= F.col("height") - points))).drop("height")


def lines_outside_tables(lines: DataFrame, tables: DataFrame, slack: float = 1.0) -> DataFrame:
    """Marks lines that lie in a table's box; a page has few tables, so the join is by page and narrow."""
    boxes = tables.select("doc_id", "page", F.col("top").alias("_t"), F.col("bottom").alias("_b")).groupBy("doc_id", "page").agg(F.collect_list(F.struct("_t", "_b")).alias("_boxes"))
    inside = F.exists(F.coalesce("_boxes", F.array().cast("array<struct<_t:double,_b:double>>")), lambda b: (F.col("top") >= b["_t"] - slack) & (F.col("top") <= b["_b"]))
    return lines.join(boxes, ["doc_id", "page"], "left").withColumn("in_table", inside).drop("_boxes")


def annotation_problems(annotations: DataFrame, level_of_type: dict[str, str]) -> DataFrame:
    """Broken constraints: document_id, finding, problem."""
    levels = F.create_map(*[F.lit(x) for kv in sorted(level_of_type.items()) for x in kv])
    found = annotations.select("document_id", "pages", F.map_keys("objects").alias("known"), F.explode("findings").alias("f"))
    row = lambda df, text: df.select("document_id", F.col("f.id").alias("finding"), F.lit(text).alias("problem"))
    return (
        row(found.where(~F.coalesce(F.try_element_at(levels, F.col("f.type")) == F.col("f.level"), F.lit(False))), "level does not fit type")
        .unionByName(row(found.where(~F.array_contains("known", F.col("f.object")) & ~F.col("f.object").isin("site", "document", "all", "project")), "unknown object"))
        .unionByName(row(found.where(F.exists("f.refs", lambda r: (r["page"] < 1) | (r["page"] > F.col("pages")))), "page out of range"))
        .unionByName(found.groupBy("document_id", F.col("f.id").alias("finding")).count().where("count > 1").select("document_id", "finding", F.lit("id used twice").alias("problem")))
    )


def plain_path(path: Column | str) -> Column:
    """A path without empty and `.` steps, and without steps that `..` takes back."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    back = lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), back), "/")


def annotations_of(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Files with the annotation of each, by normalised path; of several the first by name. annotations: name, source_file."""
    known = annotations.groupBy(plain_path("source_file").alias("_path")).agg(F.min("name").alias("annotation"))
    return files.withColumn("_path", plain_path("path")).join(known, "_path", "left").drop("_path")
