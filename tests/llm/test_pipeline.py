"""Each stage on its own input, and the whole."""

import corpus_pipeline
from pyspark.sql import types as T

from junctura.llm import ngram_join, pii, quality, queries, storage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = storage.table(stage(spark, before, SF), "t")
        seen.append(name)
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.quality(before, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        elif name == "near_duplicates":
            first = {r.doc_id for r in ngram_join.ngram_join(before).where("class_id = doc_id").collect()}
            assert {r.doc_id for r in docs.collect()} == first
        elif name == "personal_data":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.text == pii.redact(texts[r.doc_id]) and r.n_chars == len(r.text) for r in docs.collect())
        if name != "packing":
            assert docs.columns == columns
        else:
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert seen == ["quality_rules", "line_dedup", "near_duplicates", "personal_data", "packing"]
    assert docs.count() == queries.pipeline(spark, SF).count()


def test_edge_rows_through_all_stages(spark, tmp_path):
    """Nulls, repeated rows and ids, large ids, clashing names and an empty table."""
    prose = " ".join(f"word{i} and{i % 7} other{i % 11} thing{i % 13}" for i in range(80))
    big = (1 << 53) + 1
    rows = [
        (big, prose, "en", "s", 5), (big + 2, prose + " end", "en", None, None), (big, prose, "en", "s", 5), (big, prose[::-1], None, "s", 1), (None, prose + " more", "de", "s", 2),
        (None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", None), (3, "x " * 200_000, "en", "s", 1), (4, "mail a@b.co " + prose.replace("word", "term"), "en", "s", 1),
    ]
    extra = [(*r, "n", 1, "h", 2, "p") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, k int, h string, label int, part string"
    spark.createDataFrame([(big, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(extra, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = storage.table(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == schema.replace(",", "").split(" ")[0::2], name
    got = {(r.doc_id, r.text[:10]) for r in docs.collect()}
    assert got == {(big, prose[:10]), (big, prose[::-1][:10]), (4, "mail [EMAI")}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {big, 4}
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_odd_names_through_all_stages(spark, tmp_path):
    """Dots, backticks, structs with spaces, and names that the stages use themselves."""
    prose = " ".join(f"word{i} and{i % 7} other{i % 11} thing{i % 13}" for i in range(80))
    kind = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("x.y", T.StringType()), T.StructField("a`b", T.LongType()),
        T.StructField("s t", T.StructType([T.StructField("a b", T.LongType()), T.StructField("c.d", T.ArrayType(T.StringType()))])), T.StructField("__rest", T.StringType()), T.StructField("__drops", T.LongType()), T.StructField("__quality", T.LongType()), T.StructField("c0", T.StringType()),
    ])
    more = ("dot", 7, (8, ["p", "q"]), "r", 9, 10, "c")
    texts = [(1, prose), (2, prose + " end"), (3, prose[::-1]), (3, prose[::-1]), (4, "mail a@b.co " + prose.replace("word", "term")), (None, prose.replace("and", "or")), (5, None)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", 1, *more) for i, t in texts], kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = storage.table(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == kind.names and [f.dataType for f in docs.schema] == [f.dataType for f in kind], name
    got = docs.collect()
    assert {r[0] for r in got} == {1, 3, 4, None} and len(got) == 4
    assert all((r[4], r[5], (r[6][0], r[6][1]), *r[7:]) == more for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 4
