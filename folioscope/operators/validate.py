"""Row filters, gates and validators; errors come out as rows with codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "approved", "rejected", "needs_context")


def is_textual(media_type: Column, href: Column) -> Column:
    return media_type.isin("application/xhtml+xml", "text/html", "text/x-oeb1-document") | href.rlike(r"(?i)\.x?html?(?:[#?].*)?$")


def is_front_matter(href: Column, label: Column, length: Column, linear: Column) -> Column:
    names = r"(?iu)(?:cover|capa|title|rosto|copyright|cr[eé]dit|toc|nav|index|[ií]ndice|sum[aá]rio|dedicat|prefac|about|colophon)"
    return F.coalesce(linear == "no", F.lit(False)) | F.coalesce(href.rlike(names), F.lit(False)) | F.coalesce(label.rlike(names), F.lit(False)) & (length < 2_000)


def document_role(front: Column, has_number: Column, length: Column) -> Column:
    return F.when(front, "frontmatter").when(has_number & (length < 200), "broken-chapter").when(has_number, "chapter").otherwise("ignored")


def is_system_block(c: Column) -> Column:
    """Interface text of the story: a block in brackets."""
    return F.trim(c).rlike(r"^[\[【〔].+[\]】〕]$")


def eligible(df: DataFrame, least: float = 0.55) -> DataFrame:
    return df.where((F.col("severity") == "medium") & (F.col("score") >= least))


def needs_review(mode: Column) -> Column:
    return mode.isin("auto_review", "manual_only")


def skip_reason(mode: Column, confidence: Column, before: Column, after: Column, least: float = 0.9) -> Column:
    """Why an action is not applied by itself; null if it may be."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(before), "missing_before").when(blank(after), "missing_after").when(before == after, "no_change").when(F.coalesce(mode, F.lit("")) != "auto_safe", "not_auto_safe").when(F.coalesce(F.nanvl(confidence, F.lit(0.0)), F.lit(0.0)) < least, "low_confidence")


def gate(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and those that are skipped, with the reason."""
    judged = df.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def queue_errors(queue: DataFrame, ident: str = "id") -> DataFrame:
    """One row a failed field rule: ``id, code, level``."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = [
        (F.col(ident).isNull(), "id_missing", "error"), (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status_invalid", "error"),
        (blank("before"), "before_missing", "error"), (blank("after"), "after_missing", "error"), (F.coalesce(F.col("before") == F.col("after"), F.lit(False)), "no_change", "warning"),
        (blank("location"), "location_missing", "warning"),
    ]
    rows = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("code"), F.lit(s).alias("level"))) for c, n, s in checks)))
    return queue.select(ident, F.explode(rows).alias("x")).select(ident, "x.*")


def small_items(df: DataFrame, size: str, titled: Column, least: int = 5_000) -> DataFrame:
    return df.where((F.col(size) >= least) | titled)


def without_repeated_headings(df: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """Paragraphs without those after the first that say a chapter's heading again."""
    from pyspark.sql import Window

    from folioscope.functions.text import heading_key

    first = F.first(heading_key(F.col(text))).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("_f", first).withColumn("_r", rank).where((F.col("_r") == 1) | (F.col("_r") > 3) | (heading_key(F.col(text)) != F.col("_f"))).drop("_f", "_r")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows as they are; a row that breaks the condition ends the job with the message."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def extraction_errors(pages: DataFrame, key: str, expected: Column, chars: str, chapters: DataFrame, chapter_chars: str, most: int = 500_000) -> DataFrame:
    """Documents whose pages do not add up, and chapters that are far too large."""
    total = pages.groupBy(key).agg(F.count("*").alias("pages"), F.max(expected).alias("expected"), F.sum(chars).alias("chars"))
    a = total.where("pages != expected").select(key, F.lit("PAGE_COUNT").alias("code"))
    large = chapters.join(total.select(key, "chars"), key).where(F.col(chapter_chars) > F.greatest(F.lit(most).cast("double"), 0.25 * F.col("chars")))
    return a.unionByName(large.select(key, F.lit("CHAPTER_TOO_LARGE").alias("code")).distinct())


def package_errors(entries: DataFrame, required: list[str], key: str, path: str, position: str, stored: str) -> DataFrame:
    """Required members that are missing, and a mimetype that is not first or not stored."""
    books = entries.select(key).distinct()
    lost = books.withColumn(path, F.explode(F.array(*map(F.lit, required))))
    lost = lost.join(entries, [key, path], "left_anti").select(key, F.lit("MISSING_ENTRY").alias("code"), path)
    mime = entries.where(F.col(path) == "mimetype")
    first = mime.where(F.col(position) != 0).select(key, F.lit("MIMETYPE_NOT_FIRST").alias("code"), path)
    packed = mime.where(~F.col(stored)).select(key, F.lit("MIMETYPE_COMPRESSED").alias("code"), path)
    return lost.unionByName(first).unionByName(packed)
