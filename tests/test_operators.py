"""Operators on small frames, against expected rows and plain versions; properties of dedupe, caps and corrections."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import aggregate, align, correct, detect, findings, match, models, segment, state, validate, windows


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_chunks_keep_all_text():
    text = "\n\n".join(f"Block {i}. " + "word " * (i * 13 % 120) for i in range(60)) + "\n\n" + "x" * 2500 + ". " + "y" * 700
    out = segment.chunks_of(text, 1000)
    assert max(map(len, out)) <= 1000
    assert "".join("".join(out).split()) == "".join(text.split())
    assert segment.chunks_of(None) == segment.chunks_of("  ") == []


def test_group_by_size(spark):
    df = spark.createDataFrame([("b", i, n) for i, n in enumerate([3, 3, 3, 20, 1, 1])], "k string, i int, n int")
    out = segment.group_by_size(df, "k", "i", F.col("n"), 7)
    assert [r.group_no for r in out.orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]


def test_segments_and_ranges(spark):
    df = spark.createDataFrame([(1, 0, "intro"), (1, 1, "Chapter 1"), (1, 2, "a"), (1, 3, "Chapter 2"), (1, 4, "b")], "d int, i int, t string")
    out = segment.segment_texts(df, ["d"], ["i"], F.col("t").startswith("Chapter"), "t")
    assert rows(out, "segment", "heading", "body") == [(0, None, "intro"), (1, "Chapter 1", "a"), (2, "Chapter 2", "b")]
    starts = spark.createDataFrame([(1, 1, "one"), (1, 3, "two")], "d int, i int, label string")
    inside = segment.assign_to_ranges(df, starts, "d", "i", "label")
    assert rows(inside, "i", "label") == [(0, None), (1, "one"), (2, "one"), (3, "two"), (4, "two")]
    assert rows(segment.before_first(df, "d", "i", F.col("t").startswith("Chapter")), "i") == [(0,)]


def test_protect_and_restore(spark):
    names = ["Ana", "Ana Maria"]
    t = spark.createDataFrame([("Ana Maria viu Ana.",)], "t string")
    p = segment.protect(F.col("t"), names)
    assert "Ana" not in t.select(p).first()[0]
    assert t.select(segment.restore(p, names)).first()[0] == "Ana Maria viu Ana."


def test_alignment_is_complete(spark):
    s = spark.createDataFrame([(1, 10, 0, 100), (1, 11, 1, 50), (1, 12, 2, 0)], "b int, id int, i int, n int")
    t = spark.createDataFrame([(1, 20, 0, 80), (1, 21, 1, 50), (1, 22, 2, 10)], "b int, id int, i int, n int")
    out = align.by_position(s, t, "b", ["i"], "n")
    assert rows(out, "source_id", "target_id", "match_type") == [(10, 20, "matched"), (11, 21, "matched"), (None, 22, "extra")]


def test_best_with_margin(spark):
    df = spark.createDataFrame([("t", "a", 0.9), ("t", "b", 0.7), ("u", "a", 0.8), ("u", "b", 0.75), ("v", "a", 0.5)], "t string, s string, score double")
    assert rows(align.best_with_margin(df, ["t"], "s", "score"), "t", "s", "safe") == [("t", "a", True), ("u", "a", False), ("v", "a", False)]


def test_greedy_assignment(spark):
    df = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 5, 0.95), (1, 2, 6, 0.4), (1, 3, 6, 0.2)], "d int, a int, b int, s double")
    assert rows(align.assign_greedily(df, "d", "a", "b", "s"), "a", "b") == [(1, 5), (2, 6)]


def test_banded_join_finds_every_near_pair(spark):
    s = spark.createDataFrame([("k", i) for i in range(0, 200, 7)], "k string, p int")
    out = align.banded(s, s, "k", "p", F.lit(1.0) - F.abs(F.col("source_pos") - F.col("target_pos")) / 100, 18)
    assert rows(out, "target_pos", "source_pos") == [(i, i) for i in sorted(range(0, 200, 7), key=lambda x: repr((x, x)))]


def test_glossary_hits(spark):
    t = spark.createDataFrame([(1, "The mana stones; a Mana-stones sword, SWORD!"), (2, None), (3, "")], "id int, t string")
    g = spark.createDataFrame([("mana stones",), ("sword",), (None,), (" ",), ("sword",)], "from_text string")
    assert rows(match.glossary_hits(t, g, ["id"], "t")) == [(1, "mana stones", 2), (1, "sword", 2)]


def test_state_and_antijoin(spark):
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, sig string")
    old = spark.createDataFrame([("a", "q", 1, "approved"), ("a", "q", 2, "rejected"), ("n", "y", 1, "approved")], "k string, sig string, n int, status string")
    out = match.carry_state(new, old, ["k", "sig"], "n", ["status"])
    assert rows(out, "k", "status") == [("a", "rejected"), ("b", "approved"), ("c", None)]
    assert rows(match.unresolved(new, old, ["k", "sig"]), "k") == [("c",)]


def test_sequences(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 2), (1, 3, 5), (1, 4, 4)], "d int, i int, n int")
    assert rows(windows.sequence_problems(df, ["d"], ["i"], "n"), "i", "problem") == [(2, "duplicate"), (3, "gap"), (4, "out_of_order")]
    assert rows(aggregate.missing_numbers(df, ["d"], "n"), "from_number", "to_number") == [(3, 3)]
    r = spark.createDataFrame([("s", "a", 1, 60), ("s", "b", 62, 120), ("s", "c", 120, 130)], "s string, f string, x int, y int")
    assert rows(windows.range_problems(r, ["s"], "f", "x", "y"), "f", "kind", "from_number", "to_number") == [("b", "gap", 61, 61), ("c", "overlap", 120, 120)]
    assert rows(aggregate.covered_twice(r, ["s"], "f", "x", "y"), "number") == [(120,)]


def test_dedupe_is_idempotent_and_caps_are_monotone(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}", "d", f"K {i % 4}") for i in range(40)], "i int, type string, d string, key string")
    once = findings.dedupe(df, findings.dedupe_key(F.col("key")), ["i"])
    assert rows(once, "i") == rows(findings.dedupe(once.repartition(3), findings.dedupe_key(F.col("key")), ["i"]), "i") and once.count() == 4
    sizes = [windows.capped(df, ["d"], "type", ["i"], k, 20).count() for k in (1, 3, 7, 50)]
    assert sizes == [3, 9, 20, 20]


def test_corrections(spark):
    df = spark.createDataFrame([(1, "The sword and the gate. Sword!"), (2, None), (3, "none")], "id int, t string")
    rules = spark.createDataFrame([("sword", "espada"), ("gate", "p$1"), ("x", None)], "from_text string, to_text string")
    out = correct.replace_from_table(df, rules, ["id"], "t")
    assert rows(out, "id", "corrected", "replacements") == [(1, "The espada and the p$1. espada!", 3), (2, None, 0), (3, "none", 0)]
    again = correct.replace_from_table(out.select("id", F.col("corrected").alias("t")), rules, ["id"], "t")
    assert again.agg(F.sum("replacements")).first()[0] == 0
    nth = df.select(correct.replace_nth(F.col("t"), F.lit("sword"), F.lit("axe"), F.lit(1)))
    assert [r[0] for r in nth.collect()] == ["The sword and the gate. axe!", None, "none"]


def test_scoped_edits():
    text = "She came home. He said she left. She slept."
    out, n = correct.edit_scoped(text, [{"from": "she", "to": "he", "context": "He said she left."}, {"from": "she", "to": "he", "context": "nothing like it at all"}])
    assert (out, n) == ("She came home. He said he left. She slept.", 1)


def test_detectors(spark):
    df = spark.createDataFrame([(1, "<p>x</p> a ,b"), (2, "fine text."), (3, None)], "id int, t string")
    assert rows(detect.by_rules(df, "id", "t", detect.MARKUP + detect.PUNCTUATION), "unit", "type") == [("1", "residual_markup")]
    assert rows(detect.ending_findings(spark.createDataFrame([(1, "cut of"), (2, "done."), (3, "wait...")], "id int, t string"), "id", "t"), "unit", "type") == [("1", "ends_with_letter"), ("3", "ends_with_dots")]
    pairs = spark.createDataFrame([("p", "Ana paid 12 coins and 300 pages to Rui Costa today, said the old man.", "Ana pagou 12 moedas.")], "u string, s string, t string")
    assert {r.type for r in detect.pair_findings(pairs, "u", "s", "t").collect()} >= {"omission_or_expansion", "number_missing"}


def test_name_variants_that_differ_at_the_start(spark):
    names = ["Bing Geum-hae", "Ping Geum-hae", "Crimson Compass Brotherhood", "The Crimson Compass Brotherhood", "Vesvon Harrowmore", "Dr. Vesvon Harrowmore", "Rui", "RUI", "Ana", ""]
    df = spark.createDataFrame([(b, n, 9 - i) for b in (1, 2) for i, n in enumerate(names)] + [(3, "Ping Geum-hae", 2)], "book int, name string, n bigint")
    want = [(b, x, y) for b in (1, 2) for x, y in zip(names[:8:2], names[1:8:2])]
    assert rows(detect.name_variants(df, ["book"], "name", "n", total=0), "book", "lead", "variant") == sorted(want, key=repr)


def test_name_variants_broadcast_no_cut_names(spark, tmp_path):
    """The planner does not see how rows grow where names are cut; a side of the join that looks small must not go to the driver."""
    names = ["Harrowmore", "Harowmore", "Harrowmoor", "Arrowmore", "Wick", "Wicks", "Vick", "Wycliffe of the Glass Shore", "The Wycliffe of Glass Shore", "Wycliff of the Glas Shore"]
    spark.createDataFrame([(b, n, 9 - i) for b in range(3) for i, n in enumerate(names)], "book int, name string, n bigint").write.parquet(f"{tmp_path}/names")
    out = detect.name_variants(spark.read.parquet(f"{tmp_path}/names"), ["book"], "name", "n", total=0)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    pairs = [("Harrowmore", "Harowmore"), ("Harrowmore", "Harrowmoor"), ("Harrowmore", "Arrowmore"), ("Wick", "Wicks"), ("Wycliffe of the Glass Shore", "Wycliff of the Glas Shore")]
    assert {(r.lead, r.variant) for r in out.where("book = 1").collect()} >= set(pairs)


def test_gates_and_queue(spark):
    df = spark.createDataFrame([("auto_safe", 0.95, "a", "b"), ("auto_safe", 0.5, "a", "b"), ("manual_only", 0.99, "a", "b"), ("auto_safe", 0.99, "a", "a")], "m string, c double, x string, y string")
    passed, skipped = validate.gate(df, validate.skip_reason(*(F.col(c) for c in ("m", "c", "x", "y"))))
    assert passed.count() == 1 and {r.reason for r in skipped.collect()} == {"low_confidence", "not_auto_safe", "no_change"}
    with pytest.raises(Exception, match="too few"):
        validate.require(df, F.col("c") > 0.6, "too few").collect()


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    m = state.publish(df, str(tmp_path), 1, None, "src")
    m = state.publish(df, str(tmp_path), 2, m, "src")
    m = state.publish(df, str(tmp_path), 2, m, "src2")
    assert rows(m, "version", "source") == [(1, "src"), (2, "src2")]
    assert state.working_input(m, "orig").first()[0].endswith("version=2")
    assert state.step(m, 1, "next").first()[0] == 2


def test_models_fall_back(spark):
    df = spark.createDataFrame([("Traduza: o portão antigo caiu no rio.",), ("boom",)], "p string")

    def model(prompts):
        if "boom" in prompts:
            raise ValueError("no")
        return ["The old gate fell in the river." for _ in prompts]

    out = models.accepted(models.answers(df, "p", model, batch=1), "p", "answer", F.col("p"))
    assert rows(out, "p", "accepted") == [("Traduza: o portão antigo caiu no rio.", True), ("boom", False)]
    assert models.answers(df, "p").where("answer IS NOT NULL").count() == 0


def test_content_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "n string, c string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "3")], "n string, c string")
    assert rows(findings.content_diff(a, b, "n", "c")) == [("w", "added"), ("y", "changed"), ("z", "removed")]
