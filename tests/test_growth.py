"""Work that is dealt to all tasks, in parts whose size does not follow the input's."""

from pyspark.sql import functions as F

from lodestack import registry
from lodestack.operators import chunking, projection, rounds, sections, tables

SF = "/root/testdata/sf0.001"


def test_parsing_of_a_small_file_is_dealt_to_all_tasks(spark):
    one = spark.range(600).coalesce(1).select("id", F.lit("<table><tr><th>a</th></tr><tr><td>b</td></tr></table>").alias("html"))
    for cells in (tables.html_cells(one, "id", "html"), projection.source_cells(one, "id", "html")):
        assert cells.rdd.getNumPartitions() == 4 and cells.count() == 1200


def test_process_definitions_are_parsed_once(spark):
    df = registry.QUERIES["process_structure"](spark, SF)
    assert df._jdf.queryExecution().analyzed().toJSON().count("xml.XPath") == 1  # six before


def test_formulas_of_cells_are_parsed_once_and_never_broadcast(spark):
    df = registry.QUERIES["cell_formulas"](spark, SF)
    assert df.count() == len(df.collect()) == 600
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and plan.count("MapInPandas") == 1 and "Broadcast" not in plan  # two parses and two broadcasts of all formulas before


def test_tasks_follow_the_rows(spark):
    few = spark.range(100)
    assert rounds.spread(few, "id", 100).rdd.getNumPartitions() == 4
    assert rounds.spread(few, "id", 10 * rounds.TASK_ROWS + 1).rdd.getNumPartitions() == 11


def test_chunks_of_many_documents_come_in_small_batches(spark):
    docs = spark.range(1000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = chunking.packed(docs, 100)
    sizes = got.mapInArrow(lambda batches: batches, got.schema).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert chunking.ROWS <= 64 and sizes == [1000]


def test_tidied_runs_hold_their_text(spark):
    text = "\n  a b \n\n c\t\n $x\n y$ \nlast \n"
    tidy, runs = sections.tidied(spark.createDataFrame([(1, text)], "k int, text string"), "k")
    whole = tidy.first().text
    assert [r.text for r in runs.orderBy("place").collect()] == [whole[r.place : r.place + r.length] for r in runs.orderBy("place").collect()] and whole.startswith("a b\nc\n")
