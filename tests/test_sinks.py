import json

from underlay.operators import characters
from underlay.operators.findings import union
from underlay.operators.rollup import Growing
from underlay.sources import sinks
from underlay.streaming.arrivals import watch, watch_survey

UNIT = "file_id string, inside string, unit_no int, page int, text string"
FILES = "file_id string, kind string, searched boolean, sha256 string, refusal string"
REMARK = "file_id string, inside string, seq long, text string"


def test_json_and_reports(spark):
    found = union(characters.detect(spark.createDataFrame([("a", "", 0, None, "x​<script>|```` y‮z")], UNIT)))
    files = spark.createDataFrame([("a", "text", True, "00", None), ("b", "", False, "11", "no")], FILES)
    out = {r.file_id: json.loads(r.json) for r in sinks.scan_json(files, found, spark.createDataFrame([("a", "", 0, "hm")], REMARK)).collect()}
    assert [f["detector"] for f in out["a"]["findings"]] == ["zero-width", "bidi-control"]
    assert out["a"]["findings"][0]["location"] == {"line": 1, "column": 2} and "decoded" not in out["a"]["findings"][0]
    assert out["a"]["remarks"] == ["hm"] and out["b"]["findings"] == [] and out["b"]["refusal"] == "no"
    rows = found.collect()
    assert "<script>" not in sinks.page("a<b", True, rows) and "&lt;script&gt;" in sinks.page("a<b", True, rows)
    assert "`````\n" in sinks.markdown("a", True, rows)
    assert "2 findings" in sinks.text("a", True, rows)
    assert sinks.headline(True, 0) != sinks.headline(False, 0)
    assert [sinks.exit_status(*x) for x in ((0, 0, 0), (2, 2, 0), (2, 1, 3), (2, 0, 0))] == [0, 0, 1, 2]


def test_arrivals_are_judged_once(spark, tmp_path):
    rows = [("a", "", 0, None, "x​y"), ("a", "", 0, None, "x​y"), ("b", "", 0, None, "x​y"), ("c", "", 0, None, "plain")]
    source = spark.createDataFrame(rows, UNIT).selectExpr("*", "timestamp'2024-01-01 00:00:00' AS arrived")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    watch(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.file_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_a_survey_grows_with_arrivals(spark, tmp_path):
    """Two runs of the stream, the second after a stop: each file counts once, though one comes again and one stands twice."""
    schema = f"{UNIT}, rel_path string"

    def arrive(*rows):
        spark.createDataFrame([(i, "", 0, None, text, path) for i, path, text in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        watch_survey(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination(120)
        return {(r.folder, r.detector): (r.files, r.hiding, r.findings) for r in Growing(spark, str(tmp_path / "s")).totals().collect()}

    first = arrive(("1", "a/1", "x​y"), ("1", "a/1", "x​y"), ("2", "b/2", "plain"))
    assert first == {("", None): (2, 1, 1), ("", "zero-width"): (None, 1, 1), ("a", None): (1, 1, 1), ("a", "zero-width"): (None, 1, 1), ("b", None): (1, 0, 0)}
    then = arrive(("1", "a/1", "x​y"), ("3", "b/3", "p​q‮r"))
    assert then["", None] == (3, 2, 3) and then["", "zero-width"] == (None, 2, 2) and then["b", "bidi-control"] == (None, 1, 1) and then["a", None] == (1, 1, 1)
