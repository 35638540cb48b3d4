"""Results that arrive in files."""

import json

from veridia.streaming import incremental

SCHEMA = "model_id string, prompt_template string, task_id string, compile_passed boolean, execution_passed boolean"


def put(folder, name, *rows):
    (folder / name).write_text("".join(json.dumps(dict(zip(("model_id", "prompt_template", "task_id", "compile_passed", "execution_passed"), r))) + "\n" for r in rows))


def test_files_are_appended_once_across_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, "a.jsonl", ("m", "p", "t1", True, True), ("m", "p", "t2", True, False), ("m", "p", "t2", True, True))

    def run():
        stream = incremental.follow_json_lines(spark, f"file://{source}", SCHEMA, 1)
        incremental.append_results(stream, f"file://{tmp_path}/out", ["model_id", "prompt_template", "task_id"], f"file://{tmp_path}/state").awaitTermination()
        return spark.read.json(f"file://{tmp_path}/out").count()

    assert run() == 2 and run() == 2
    put(source, "b.jsonl", ("m", "p", "t1", True, True), (None, "p", "t3", None, None))
    assert run() == 3
    stream = incremental.running_funnel(incremental.follow_json_lines(spark, f"file://{source}", SCHEMA))
    query = stream.writeStream.format("memory").queryName("funnel_so_far").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state2").start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("funnel_so_far").collect()) == [("?", "p", 1, 0, 0), ("m", "p", 4, 4, 3)]
