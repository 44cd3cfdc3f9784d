from junctura.sources import alignments
from junctura.streaming import junctions


def test_counts(spark, tmp_path):
    rows = [("s", "c", 100, 0, "20M100N30M", 0, "+", None, None), ("s", "c", 100, 0, "50M", 0, None, None, None)]
    for k in range(3):
        spark.createDataFrame(rows * (k + 1), alignments.SCHEMA).write.parquet(f"{tmp_path}/in/{k}")
        for f in (tmp_path / "in" / str(k)).glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
    for p in (tmp_path / "in").iterdir():
        if p.is_dir():
            import shutil

            shutil.rmtree(p)
    stream = junctions.junction_counts(junctions.read_alignments(spark, f"{tmp_path}/in", 1))
    junctions.write(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("s", "c", "+", 120, 220, 6)]
