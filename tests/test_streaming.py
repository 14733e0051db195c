"""Staging expressions on a streaming table."""

from axisflow.operators import staging


def test_floats_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("1.5,x\n2,3\n")
    stream = spark.readStream.schema("a string, b string").csv(str(tmp_path / "in"))
    query = staging.to_float_table(stream).writeStream.format("memory").queryName("staged").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    rows = sorted(spark.table("staged").collect())
    assert [r["a"] for r in rows] == [1.5, 2.0] and rows[1]["b"] == 3.0 and rows[0]["b"] != rows[0]["b"]
