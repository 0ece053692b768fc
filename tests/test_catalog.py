"""Every catalogue query runs on the small tables; those with SQL agree with DuckDB."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from folioscope.plans import queries as catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return v.isoformat() if isinstance(v, pd.Timestamp) else str(v)


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE:
        assert table(got) == table(db.execute(catalog.ORACLE[name]).df())


def test_chapters_of_one_edition_only(spark):
    sections = spark.read.parquet(f"{SF}/sections.parquet").select("book_id", "section_index", "edition").distinct()
    a, b = (sections.where(f"edition = '{e}'").drop("edition") for e in ("source", "translation"))
    lost = a.join(b, ["book_id", "section_index"], "left_anti").count()
    assert lost > 0 and catalog.QUERIES["coverage_findings"](spark, SF).where("type = 'chapter_missing'").count() == lost
    assert catalog.QUERIES["comparison_audit"](spark, SF).where("category = 'chapter_missing'").first()["n"] == lost


def test_edits_of_all_names(spark, tmp_path):
    data = [("José", "Jose"), ("봉별금", "봉별굼"), ("Ana", "Anna"), ("Ana", None), ("Zoë", "Benjamin")]
    spark.createDataFrame(data, "canonical string, original_name string").write.parquet(f"{tmp_path}/entities.parquet")
    got = {tuple(r) for r in catalog.QUERIES["levenshtein_pairs_all"](spark, str(tmp_path)).collect()}
    assert got == {("José", "Jose", 1), ("봉별금", "봉별굼", 1), ("Ana", "Anna", 1)}


def test_groups_of_both_editions(spark):
    got = catalog.QUERIES["group_by_size"](spark, SF).groupBy("edition").count().collect()
    want = spark.read.parquet(f"{SF}/sections.parquet").dropDuplicates(["section_id"]).groupBy("edition").count().collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}


def test_glossary_words_travel_without_their_text(spark):
    """What crosses the join with the glossary is a word and the few behind it, never the array of all words."""
    from folioscope.operators import match

    docs, terms = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "terms"))
    plan = match.glossary_hits(docs, terms, ["doc_id"], "text")._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    below = join[: join.index("Generate")]
    assert "_ahead" in below and "_words" not in below.split("slice(")[0]


def test_resolved_findings_are_left_out(spark):
    got = {r.category: r.n for r in catalog.QUERIES["comparison_audit"](spark, SF).collect()}
    numbers = catalog.QUERIES["coverage_findings"](spark, SF).where("type = 'numbers_missing'").count()
    assert set(got) >= {"title_mismatch", "residual_phrase"} and got["numbers_missing"] <= numbers
