import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import language_id
from lodestack.llm.entries import PIECE_MODEL
from tests.llm import test_decontaminate, test_line_dedup, test_near_dedup


SF = "/root/testdata/sf0.001"


def written(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_each_stage_against_brute_force_on_its_own_input(spark, tmp_path):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append({r.doc_id: r for r in docs.collect()})
        docs = written(spark, stage(spark, docs, SF), tmp_path, name.replace(" ", "-"))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    final = {r.doc_id: r for r in docs.collect()}
    start, lines, near, leaks, pieces = inputs

    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    said = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", model.predict(F.col("text")).alias("p")).collect()
    assert {r.doc_id: r.p.lang for r in said if not r.p.rejected} == {i: r.lang for i, r in lines.items()}
    assert len(lines) >= 0.98 * len(start)

    want = test_line_dedup.brute(sorted((i, r.text) for i, r in lines.items()))
    for i, t in want.items():
        if t == lines[i].text or test_line_dedup.normal(t.replace("\n", " ")):
            assert near[i].text == t and near[i].n_chars == len(t)
        else:
            assert i not in near
    assert set(near) <= set(lines)

    rows = [(i, r.text) for i, r in near.items()]
    assert {i for (i, _), (_, first) in zip(rows, test_near_dedup.brute(rows, 5), strict=True) if first == i} == set(leaks)

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {i for i, r in leaks.items() if not test_decontaminate.brute(r.text, items)[1]} == set(pieces)

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert {i: library.encode(r.text) for i, r in pieces.items()} == {i: r.ids for i, r in final.items()}


def test_run_and_empty_documents(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "n_tokens", "ids", "round_trip"] and out.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "a null id and words enough to stay here", "en", "s", 1), (900_001, None, "en", None, None), (900_002, "", None, "s", 0), (900_003, "same words in both rows of this id", "en", "s", 1), (900_003, "same words in both rows of this id", "en", "s", 1)], docs.schema)
    docs = docs.limit(40).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, SF), tmp_path, name.replace(" ", "-"))
    ids = [r.doc_id for r in docs.collect()]
    assert None in ids and 900_003 in ids and 900_001 not in ids and 900_002 not in ids


def test_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = {"doc": 1, "hash": 2, "_hash": 3, "said": 4, "_said": 5, "gone": 6, "text_hash": 7, "n_lines": 8, "component_id": 9}
    for c, v in extra.items():
        docs = docs.withColumn(c, F.lit(v))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*extra).distinct().collect()} <= {tuple(extra.values())}
    assert {"doc_id", "ids"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + " a b c d e f g h i j k l m n o p"), (None, text + " a b c d e f g h i j k l m n o p"), (2, None), (2, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, docs, SF).collect()), key=str)
    assert len(out) == 3
