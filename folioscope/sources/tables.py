"""Scans of text files, JSON rules, logs and listings, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import natural_key

TERMS = "terms array<struct<from: string, to: string, mode: string, confidence: double, note: string>>"
ENTITIES = "entities array<struct<canonical: string, originalName: string, role: string, note: string, aliases: array<struct<from: string, to: string, mode: string, confidence: double, note: string>>>>"
RULES = "characters array<struct<name: string, gender: string>>, customGlossary map<string, string>, expressionRules array<struct<regex: string, problem: string, suggestion: string>>"


def glossary_terms(spark: SparkSession, path: str) -> DataFrame:
    """Glossary rows of JSON files, read with a schema (nothing is inferred)."""
    rows = spark.read.schema(TERMS).option("multiLine", "true").json(path).select(F.explode("terms").alias("t"))
    return rows.select(F.col("t.from").alias("from_text"), F.col("t.to").alias("to_text"), F.coalesce("t.mode", F.lit("manual_only")).alias("apply_mode"), F.coalesce("t.confidence", F.lit(0.7)).alias("confidence"), F.col("t.note").alias("note"))


def entity_aliases(entities: DataFrame) -> DataFrame:
    """Alias rows of entity records: canonical, from_text, to_text (the canonical form where it is missing)."""
    rows = entities.select("canonical", F.explode("aliases").alias("a"))
    named = "from_text" in entities.select(F.explode("aliases").alias("a")).select("a.*").columns
    old, new = ("from_text", "to_text") if named else ("from", "to")
    return rows.select("canonical", F.col(f"a.{old}").alias("from_text"), F.coalesce(F.col(f"a.{new}"), F.col("canonical")).alias("to_text")).where("from_text IS NOT NULL")


def project_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULES).option("multiLine", "true").json(path)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text logs with their file and number (one file is read as one row, so order is certain)."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def log_entries(lines: DataFrame, most_notes: int = 500) -> DataFrame:
    """``kind`` replacement (from -> to), field (key: value) or note; the instruction block ends at the first blank line after text."""
    line = F.trim("line")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = line.rlike(r"(?iu)^(?:instructions?|instruç(?:ão|ões)|instrucciones?)\s*:?$")
    rows = lines.withColumn("_start", F.max(F.when(starts, F.col("line_no"))).over(w))
    text_seen = F.max(F.when((line != "") & ~starts, F.col("line_no"))).over(w)
    rows = rows.withColumn("_text", text_seen).withColumn("_end", F.max(F.when((line == "") & (F.col("_text") > F.col("_start")), F.col("line_no"))).over(w))
    inside = F.col("_start").isNotNull() & (F.col("_end").isNull() | (F.col("_end") < F.col("_start")))
    arrow, pair = r"^(.+?)\s*(?:->|→|=>)\s*(.+)$", r"^([\p{L}][\p{L}\s_-]{0,40}):\s*(.+)$"
    kind = F.when((line == "") | starts, None).when(inside, "instruction").when(line.rlike(arrow), "replacement").when(line.rlike(pair), "field").otherwise("note")
    out = rows.select("file", "line_no", kind.alias("kind"), F.when(kind == "replacement", F.regexp_extract(line, arrow, 1)).when(kind == "field", F.regexp_extract(line, pair, 1)).alias("left"), F.when(kind == "replacement", F.regexp_extract(line, arrow, 2)).when(kind == "field", F.regexp_extract(line, pair, 2)).otherwise(line).alias("right")).where("kind IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("file", "kind").orderBy("line_no"))
    return out.withColumn("_n", n).where((F.col("kind") != "note") | (F.col("_n") <= most_notes)).drop("_n")


def markdown_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with ``chapters: 1-3, 7`` lines: one row a chapter they cover."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    listed = F.regexp_extract("value", r"(?im)^(?:audit[_ ])?chapters?\s*:\s*(.+)$", 1)
    body = F.regexp_replace("value", r"(?m)^[A-Za-z_ ]+:\s.*\n?", "")
    return whole.select("file", body.alias("text"), F.explode(numbers_of(listed, F.lit(9_999))).alias("chapter"))


def numbers_of(selection: Column, most: Column) -> Column:
    """``1,3-5,all`` as a sorted array of numbers."""
    parts = F.split(F.lower(F.replace(selection, F.lit(" "), F.lit(""))), ",")
    of = lambda p: (
        F.when(p.isin("all", "todos", "*"), F.sequence(F.lit(1), most))
        .when(p.rlike(r"^\d+-\d+$"), F.sequence(F.least(F.split(p, "-")[0].cast("int"), F.split(p, "-")[1].cast("int")), F.greatest(F.split(p, "-")[0].cast("int"), F.split(p, "-")[1].cast("int"))))
        .when(p.rlike(r"^\d+$"), F.array(p.cast("int")))
        .otherwise(F.expr("CAST(array() AS array<int>)"))
    )
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, of)), lambda n: (n >= 1) & (n <= most))))


def newest(df: DataFrame, stamp: str, fallback: str) -> DataFrame:
    """The newest row by a day-first stamp in its name (parsed, so months sort), else by name."""
    at = F.try_to_timestamp(F.regexp_extract(stamp, r"(\d{2}-\d{2}-\d{4}_\d{2}-\d{2}-\d{2})", 1), F.lit("dd-MM-yyyy_HH-mm-ss"))
    return df.withColumn("_at", at).orderBy(F.desc_nulls_last("_at"), F.desc(fallback)).limit(1).drop("_at")


def natural_first(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(name)), name).limit(1)


def exactly_one(df: DataFrame) -> DataFrame:
    """The rows, if there is exactly one; otherwise the job ends."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy())).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("exactly one input is expected")).cast("boolean"))).drop("_n")


def route(df: DataFrame, name: str) -> DataFrame:
    """The adapter of each reference file by its ending; unsupported ones say so."""
    end = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return df.withColumn("adapter", F.when(end == "epub", "epub").when(end.isin("txt", "md"), "text").when(end == "json", "json").when(end == "pdf", "pages")).withColumn("adapter_status", F.when(F.col("adapter").isNull(), "unsupported").otherwise("ok"))


def lines_from_glyphs(df: DataFrame, key: list[str], order: str, y: str, text: str, step: float = 2.0) -> DataFrame:
    """Lines of a page from placed glyph runs: a new line where y moves by more than ``step``."""
    w = Window.partitionBy(*key).orderBy(order)
    new = F.coalesce(F.abs(F.col(y) - F.lag(y).over(w)) > step, F.lit(False)).cast("int")
    rows = df.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("line"))


# Sinks -----------------------------------------------------------------------------------------------------------------


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_issues_csv(df: DataFrame, path: str, detail: str = "detail", limit: int = 200) -> None:
    """Semicolons, quoted, details cut: for spreadsheets."""
    df.withColumn(detail, F.substring(detail, 1, limit)).write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table, one text line each."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in columns)), F.lit(" |")).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet by keys; rows are brought together by key first, so a key makes few files."""
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def free_name(names: list[str], wanted: str) -> str:
    """The wanted name, or it with ``-2``, ``-3`` and so on."""
    if wanted not in names:
        return wanted
    stem, dot, end = wanted.rpartition(".")
    stem, end = (stem, dot + end) if dot else (wanted, "")
    n = 2
    while f"{stem}-{n}{end}" in names:
        n += 1
    return f"{stem}-{n}{end}"
