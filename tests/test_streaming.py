from pyspark.sql import types as T

from fieldsieve.streaming import inspections

SCHEMA = T.StructType([T.StructField("uuid", T.StringType()), T.StructField("state", T.StringType())])


def test_each_id_is_taken_once(spark, tmp_path):
    source, sink, done = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "done")
    source.mkdir()
    (source / "1.json").write_text('{"uuid": "a", "state": "x"}\n{"uuid": "a", "state": "x"}\n{"uuid": "b", "state": "y"}\n')
    inspections.append_once(inspections.read(spark, str(source), SCHEMA), sink, done).awaitTermination(60)
    (source / "2.json").write_text('{"uuid": "b", "state": "z"}\n{"uuid": "c", "state": "z"}\n')
    inspections.append_once(inspections.read(spark, str(source), SCHEMA), sink, done).awaitTermination(60)
    assert sorted(tuple(r) for r in inspections.current(spark, sink, SCHEMA).collect()) == [("a", "x"), ("b", "y"), ("c", "z")]
