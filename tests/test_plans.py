"""That costly steps are in a plan once, and that no more moves than is needed."""

from pyspark.sql import functions as F

from stratadoc.functions import text as T
from stratadoc.operators import content as C
from stratadoc.operators import evaluation as E
from stratadoc.plans import evaluation_queries as Q


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_normed_before_they_meet(spark):
    placed = spark.createDataFrame([(1, 1, "Abc"), (1, 2, "abd"), (1, 3, None), (2, 1, "x")], "doc_id long, block long, text string")
    final = spark.createDataFrame([(1, "xxABCxx"), (3, "x")], "doc_id long, final_text string")
    rows = C.audit_presence(placed, final, F.upper)
    assert [tuple(r) for r in rows.collect()] == [(1, 2)]
    assert "Contains(_final" in optimized(rows) and "Contains(upper" not in optimized(rows)


def test_offsets_move_sizes_once(spark):
    rows = [(1, 1, 1, "ab", True), (1, 1, 2, "", True), (1, 1, 3, "c", True), (1, 2, 1, "de", False), (2, 1, 1, None, True)]
    runs = spark.createDataFrame(rows, "doc_id long, block long, run int, text string, ends_section boolean")
    got = C.offsets(runs)
    assert got.columns == [*runs.columns, "start", "stop", "section"]
    assert sorted((r.doc_id, r.block, r.run, r.start, r.stop, r.section) for r in got.collect()) == [(1, 1, 1, 0, 2, 0), (1, 1, 2, 2, 2, 0), (1, 1, 3, 2, 3, 0), (1, 2, 1, 0, 2, 1), (2, 1, 1, 0, None, 0)]
    plan = got.drop("text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_block_is_trimmed_once(spark):
    texts = spark.createDataFrame([(" 　",), (" 图 1 x",), ("第三章 ",), ("1.2 x",), ("2、x",), ("（4）",), ("plain ",), (None,)], "text string")
    rows = texts.select(T.classify_block(F.col("text"), F.lit("paragraph"), F.lit("text")).alias("label"))
    assert [r.label for r in rows.collect()] == [None, "body.figure.caption", "body.heading.level1", "body.heading.level3", "body.heading.level2", "body.numbered_list_item", "body.paragraph", "body.paragraph"]
    assert optimized(texts.select(T.classify_block(F.col("text"), F.col("text"), F.col("text")).alias("label"))).count("regexp_replace") <= 2


def moved(df):
    """What an exchange of the plan takes, for each."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return [part.split("Arguments:")[0] for part in df._jdf.queryExecution().explainString(mode).split("\n\n") if ") Exchange\n" in part]


def test_values_move_as_digests(spark):
    """Values that are only held equal or not, and their texts, aren't shuffled; null equals null alone."""
    gold = spark.createDataFrame([(1, "i", "f", "A b", [("o", "a"), ("p", "b")]), (1, "j", "f", "x", [("q", "x")]), (1, "k", "f", None, [("r", None)])], "doc_id long, item_id string, field_id string, value string, pieces array<struct<object_id:string,text:string>>")
    actual = spark.createDataFrame([(1, 1, ["o"], "f", "a "), (1, 2, ["p"], "f", "c"), (1, 3, ["q"], "f", "X"), (1, 4, ["r"], "f", None)], "doc_id long, seq long, sources array<string>, field_id string, value string")
    df = E.compare_item_values(actual, gold, T.norm_text)
    assert {(r.item_id, r.object_id, r.result) for r in df.collect()} == {("i", "o", "exact"), ("i", "p", "mismatch"), ("j", None, "exact"), ("k", None, "exact")}
    assert moved(df) and not [x for x in moved(df) if " value#" in x or "[value#" in x or " pieces#" in x]


def test_documents_are_compared_once_and_names_move_as_digests(spark):
    """Comparisons with several measures are in the report's plan once; names that only meet aren't shuffled there."""
    read = optimized(Q.dimensions(spark, "/root/testdata/sf0.001")).count("Join FullOuter")
    assert read == 5  # one for each of provenance, coverage, counts of fields, groups and order
    rows = spark.createDataFrame([(1, "a", "x", 1, None), (1, "b", "y", 2, "f")], "doc_id long, object_id string, status string, block long, field_id string")
    plain = moved(E.compare_coverage(rows, rows)) + moved(E.compare_fields(rows, rows).groupBy("doc_id", "result").count())
    assert plain and not [x for x in plain if "object_id#" in x]
