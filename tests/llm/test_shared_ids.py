"""One row of each class where rows share an id."""

from junctura.llm import ngram_join


def prose(start, n=80):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_rows_with_one_id(spark):
    rows = [
        (1, prose(0)), (1, prose(1000)),  # unrelated: both are the first of their class
        (2, prose(2000)), (2, prose(2000)), (2, prose(2000) + " tail"),  # a copy and a near copy: one
        (3, prose(0) + " end"), (3, prose(3000)),  # a near copy of 1 goes, the other is a first
        (4, prose(1000)), (5, prose(5000)), (6, ""), (6, None), (6, prose(6000)), (None, prose(5000)), (None, prose(7000)), (None, prose(7000) + " end"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    kept = ngram_join.one_of_each(docs)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), (r.text or "")[:5]) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == [(-1, "w7000"), (1, "w0 w1"), (1, "w1000"), (2, "w2000"), (3, "w3000"), (5, "w5000"), (6, ""), (6, ""), (6, "w6000")]


def test_the_choice_does_not_depend_on_partitions(spark):
    rows = [(1, prose(0), "b"), (1, prose(0).upper(), "a"), (1, prose(0), "a"), (1, prose(0), "c"), (2, prose(0), "x"), (1 << 60, prose(9000), "y"), (None, prose(9000), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {tuple(sorted((r.doc_id, r.text[:2], r.lang) for r in ngram_join.one_of_each(docs.repartition(n, "lang" if n > 2 else "text")).collect())) for n in (1, 2, 3, 5)}
    assert len(found) == 1 and [x[0] for x in found.pop()] == [1, 1 << 60]


def test_heavy_keys(spark, monkeypatch):
    """With every node and label heavy, the result is the same."""
    docs = spark.createDataFrame([(i, prose(1000 * (i % 3)) + " end" * (i % 2)) for i in range(30)], "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.ngram_join(docs).collect()))
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect())
    monkeypatch.setattr(ngram_join, "MANY", 2)
    assert sorted(map(tuple, ngram_join.ngram_join(docs).collect())) == want
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == kept == [0, 1, 2]
