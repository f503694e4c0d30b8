"""Flattening against a recursive walk, and its edge cases."""

import json

from stepweave.operators import nested

TRAJ = "content_hash string, data string, path string, array_path string"
BROWSER = "traj_id bigint, steps array<struct<step_id:int,thought:string,tool_call:struct<name:string,parameters:string>,tool_result:struct<output:string,exit_code:int,error:string>>>, text string"


def flat(spark, trajs, browser=()):
    rows = nested.flat_tables(spark.createDataFrame(trajs, TRAJ), spark.createDataFrame(list(browser), BROWSER)).collect()
    return {tuple(r) for r in rows}


def one(spark, data, key="h"):
    return flat(spark, [(key, data, "x", "y")])


def test_steps_at_any_depth_keep_their_parents(spark):
    doc = {"steps": [{"tool": "a", "children": [{"action": "grep(x y)", "sub": [{"steps": [{"tool_call": {"name": "b"}}]}]}]}, {"tool": None, "action": None}, 3, None]}
    assert one(spark, json.dumps(doc)) == {
        ("trajectories", "h", "steps[0]", "", "a"),
        ("trajectories", "h", "steps[0].children[0]", "steps[0]", "grep"),
        ("trajectories", "h", "steps[0].children[0].sub[0].steps[0]", "steps[0].children[0]", "b"),
    }


def test_top_level_array_and_text_that_holds_a_document(spark):
    inner = json.dumps([{"tool": "t", "output": json.dumps({"steps": [{"action": "run now"}]})}])
    expected = {("trajectories", "h", "[0]", "", "t"), ("trajectories", "h", "[0].output.steps[0]", "[0]", "run")}
    assert one(spark, inner) == expected
    assert one(spark, json.dumps(inner)) == expected
    assert one(spark, json.dumps(json.dumps(inner))) == expected


def test_text_that_is_no_json_gives_no_row(spark):
    step = '[{"tool": "a"}]'
    for bad in (None, "", " ", "no", step + " x", step + step, "[{'tool': 'a'}]", '[{"tool": NaN}]', step[:-1], '{"tool": "a"}'):
        assert one(spark, bad) == set(), bad


def test_very_deep_and_very_long_documents(spark):
    deep = '{"a":' * 300 + '[{"tool":"x"}]' + "}" * 300
    assert {r[4] for r in one(spark, deep)} == {"x"}
    long = json.dumps([{"tool": "t", "output": "y" * 1_000_000}] * 3)
    assert len(one(spark, long)) == 3


def test_repeated_rows_null_keys_and_missing_names(spark):
    rows = [("h", '[{"tool_call": {}}]', None, None)] * 3 + [(None, '[{"tool": "a"}]', None, None)]
    assert flat(spark, rows) == {("trajectories", "h", "[0]", "", None)}
    assert flat(spark, []) == set()


def test_urls_of_both_fields(spark):
    steps = [
        {"step_id": None, "thought": None, "tool_call": {"name": "go", "parameters": '{"url": "u1", "more": [{"url": "u2"}, {"url": null}, {"url": 3}]}'}, "tool_result": {"output": '{"links": [{"url": "u3", "action": "x"}]}', "exit_code": 0, "error": None}},
        {"step_id": 2, "thought": None, "tool_call": None, "tool_result": {"output": '{"url": "u4"}', "exit_code": 0, "error": None}},
        {"step_id": 3, "thought": None, "tool_call": {"name": "n", "parameters": None}, "tool_result": None},
    ]
    got = flat(spark, [], [(7, steps, "t"), (7, steps, "t"), (8, None, None), (None, steps, None)])
    assert got == {
        ("browser_trajectory", "7", "steps[0].tool_call.parameters.url", "steps[0]", "u1"),
        ("browser_trajectory", "7", "steps[0].tool_call.parameters.more[0].url", "steps[0]", "u2"),
        ("browser_trajectory", "7", "steps[0].tool_result.output.links[0].url", "steps[0].tool_result.output.links[0]", "u3"),
        ("browser_trajectory", "7", "steps[1].tool_result.output.url", "", "u4"),
    }


def test_merged_schema_names_conflicting_kinds(spark):
    df = spark.createDataFrame([("a", '{"x": [1]}', "", ""), ("b", '{"x": {"y": 1}}', "", ""), ("c", '{"x": "[2]"}', "", "")], TRAJ)
    got = {tuple(r) for r in nested.merged_schema(nested.trajectory_roots(df)).collect()}
    assert {("x", "array"), ("x", "object"), ("x", "text:array")} <= got


def test_documents_of_any_depth(spark):
    doc = '{"a":[' * 30_000 + '{"tool": "x"}' + "]}" * 30_000
    assert {r.leaf for r in nested.flat_tables(spark.createDataFrame([("h", doc, "x", "y")], TRAJ), spark.createDataFrame([], BROWSER)).select("leaf").collect()} == {"x"}


def test_without_a_merged_schema_the_rows_are_the_same(spark, monkeypatch):
    doc = json.dumps({f"key{i}": {"steps": [{"tool": f"t{i}"}]} for i in range(30)})
    want = one(spark, doc)
    monkeypatch.setattr(nested, "MAX_PATHS", 3)
    assert one(spark, doc) == want and len(want) == 30


def test_child_rows(spark):
    doc = json.dumps({"steps": [{"tool": "a", "n": 1, "parts": [3, [4]]}, "x"], "meta": {"tags": ["u"]}})
    got = {(r.array_path, r.path, r.parent_path, r.ordinal, r.value) for r in nested.child_rows(spark.createDataFrame([("h", doc, "", "")] * 2, TRAJ)).collect()}
    assert got == {
        ("steps[]", "steps[0]", "", 0, '{"n": 1, "tool": "a"}'),
        ("steps[]", "steps[1]", "", 1, '"x"'),
        ("steps[].parts[]", "steps[0].parts[0]", "steps[0]", 0, "3"),
        ("steps[].parts[]", "steps[0].parts[1]", "steps[0]", 1, None),
        ("steps[].parts[][]", "steps[0].parts[1][0]", "steps[0].parts[1]", 0, "4"),
        ("meta.tags[]", "meta.tags[0]", "", 0, '"u"'),
    }
