"""Readers and writers of extracted entities: explicit schemas, no inference."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = """page int, index_on_page int, seqno int, type string, rect array<double>, width double, lineCap string, lineJoin string, dashes string,
stroke array<double>, fill array<double>, even_odd boolean, closePath boolean, fill_opacity double, stroke_opacity double,
path_items array<struct<op string, p0 array<double>, c1 array<double>, c2 array<double>, p1 array<double>, rect array<double>, orientation double, quad string, raw string>>"""
DRAWINGS = "drawing_id string, page int, bbox array<double>, stroke_color array<double>, fill_color array<double>, width double, line_cap string, line_join string, path_length_proxy double"
WORDS = "page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"
SPANS = "page int, line_no int, span_no int, text string, bbox array<double>"
CALIBRATION = "calibration struct<meters_per_point: double, meters_per_pixel: double, pixels_per_point: double, source_file: string, method: string>"
GRAPH = "seeds array<struct<id: int, x: int, y: int, degree: int, active: boolean>>, edges array<struct<a: int, b: int, dist: double, outside_ratio: double>>, start_end array<int>, endpoint_ids array<int>"
IMAGES = "page int, xref int, rect array<double>"
FIELDS = {"images": IMAGES, "vectors": VECTORS, "drawings": DRAWINGS, "words": WORDS, "spans": SPANS, "calibration": CALIBRATION, "graph": GRAPH}


def read(spark: SparkSession, path: str, kind: str, form: str = "json") -> DataFrame:
    """A table of one of the known kinds, as JSON documents or Parquet."""
    reader = spark.read.schema(FIELDS[kind].replace("\n", " "))
    return reader.option("multiLine", "true").json(path) if form == "json" else reader.parquet(path)


def pages(df: DataFrame, page: int = 0, most: int | None = None) -> DataFrame:
    """One page (0: all) of the first ``most``."""
    out = df if page == 0 else df.where(F.col("page") == page)
    return out if most is None else out.where(F.col("page") <= most)


def vector_scan(spark: SparkSession, path: str, page: int = 0) -> DataFrame:
    """The vectors of one page (0: all) of a table written by page.

    A page is a folder, so Spark lists and reads that of the page alone; one that is not there is an error.
    """
    table = spark.read.schema(FIELDS["vectors"].replace("\n", " ")).parquet(path)
    if page == 0:
        return table
    out = table.where(F.col("page") == page)
    if page < 0 or out.limit(1).isEmpty():
        raise ValueError(f"Page out of range: {page}")
    return out


def scan_summary(vectors: DataFrame) -> DataFrame:
    """(page_count, vector_count, pages) of a scan."""
    return vectors.agg(F.count_distinct("page").alias("page_count"), F.count("*").alias("vector_count"), F.sort_array(F.collect_set("page")).alias("pages"))


def required(df: DataFrame, key: str, path: str = "") -> DataFrame:
    """``df`` with an error for each row whose ``key`` is null or an empty list."""
    kind = dict(df.dtypes).get(key)
    if kind is None:
        raise ValueError(f"Missing key {key} in {path}")
    value = F.nullif(F.col(key), F.array().cast(kind)) if kind.startswith("array") else F.col(key)
    return df.withColumn(key, F.coalesce(value, F.raise_error(F.lit(f"Missing key {key} in {path}")).cast(kind)))


def curve(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(i, y, x): the points [y, x] below ``key`` of a JSON document; a missing or empty key is an error."""
    rows = required(spark.read.schema(f"{key} array<array<double>>").option("multiLine", "true").json(path), key, path)
    return rows.select(F.posexplode(key).alias("i", "p")).select("i", F.col("p")[0].alias("y"), F.col("p")[1].alias("x"))


def text_lines(spans: DataFrame) -> DataFrame:
    """Spans joined by blanks to lines, without empty ones, with the box around all spans."""
    order = F.sort_array(F.collect_list(F.struct("span_no", "text")))
    corner = lambda f, k: f(F.col("bbox")[k])
    out = spans.groupBy("page", "line_no").agg(order.alias("s"), F.array(corner(F.min, 0), corner(F.min, 1), corner(F.max, 2), corner(F.max, 3)).alias("bbox"))
    return out.select("page", "line_no", F.trim(F.array_join(F.transform("s", lambda s: s["text"]), " ")).alias("text"), "bbox").where("text <> ''")


def path_items(vectors: DataFrame) -> DataFrame:
    """One row a path item."""
    return vectors.select("page", "seqno", F.posexplode("path_items").alias("item_no", "item")).select("page", "seqno", "item_no", "item.*")


def calibration(df: DataFrame) -> DataFrame:
    """The calibration's fields; a missing scale is an error."""
    out = df.select("calibration.*")
    return out.withColumn("meters_per_point", F.coalesce("meters_per_point", F.raise_error(F.lit("calibration without meters_per_point")).cast("double")))


def graph_seeds(graph: DataFrame) -> DataFrame:
    """Active seeds; those without the flag are active."""
    return graph.select(F.explode("seeds").alias("s")).select("s.*").where(F.coalesce("active", F.lit(True)))


def graph_edges(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode("edges").alias("e")).select("e.*")


def graph_ends(graph: DataFrame) -> DataFrame:
    """start_end where it is given, else endpoint_ids."""
    ends = F.when(F.size(F.coalesce("start_end", F.array().cast("array<int>"))) > 0, F.col("start_end")).otherwise(F.col("endpoint_ids"))
    return graph.select(F.posexplode(ends).alias("i", "id"))


def write(df: DataFrame, path: str, form: str = "parquet", by_page: bool = False) -> None:
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy("page") if by_page else writer).save(path)


def write_run(folder: str, form: str = "parquet", **tables: DataFrame) -> None:
    """The tables of a run, each below the folder under its name."""
    for name, df in tables.items():
        write(df, f"{folder.rstrip('/')}/{name}", form)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(summary, metrics, error): the JSON texts of a run's ``run_summary.json`` and ``metrics.json``, with forward slashes.

    Without a summary the error is ``none`` and nothing else is given; without metrics they are null.
    """
    found = []
    for name in ("run_summary.json", "metrics.json"):
        try:
            found.append(spark.read.text(f"{folder.rstrip('/')}/{name}", wholetext=True))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found.append(None)
    summary, metrics = found
    if summary is None:
        return spark.range(1).select(F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("metrics"), F.lit("none").alias("error"))
    # a backslash is written twice in JSON
    text = F.replace("value", F.lit("\\\\"), F.lit("/"))
    rows = summary.select(F.lit("summary").alias("name"), text.alias("text"))
    if metrics is not None:
        rows = rows.unionByName(metrics.select(F.lit("metrics").alias("name"), text.alias("text")))
    return rows.agg(*[F.max(F.when(F.col("name") == n, F.col("text"))).alias(n) for n in ("summary", "metrics")], F.lit(None).cast("string").alias("error"))
