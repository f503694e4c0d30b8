"""Rules, pairs, store, statistics and the rest on literal cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from stepweave import __main__ as cli
from stepweave import dims, registry, sinks
from stepweave.functions import agent_text, deepjson, sanitize
from stepweave.functions.text import parse_document
from stepweave.operators import episodes, export, judging, pairs, rules, statistics, store, training
from stepweave.operators.ranking import distributed_row_number
from stepweave.plans import flows
from stepweave.sources import files, logs, sessions
from stepweave.streaming import ingest

STEP = "traj_id string, ord int, tool string, target string, old_s string, new_s string, output string, params_key string, params_text string"


def steps(spark, *rows):
    return spark.createDataFrame([("t", i, tool, target, old, new, "", f"{target}|{old}|{new}", target) for i, (tool, target, old, new) in enumerate(rows)], STEP)


def column(df, name):
    return [r[name] for r in df.orderBy("traj_id", "ord").collect()]


@pytest.mark.parametrize(
    ("rows", "r1"),
    [
        ([("Read", "a", "", ""), ("Read", "a", "", "")], [1.0, 0.0]),
        ([("Read", "a", "", ""), ("Edit", "a", "x", "y"), ("Read", "a", "", "")], [1.0, 1.0, 1.0]),
        ([("bash", "", "", ""), ("bash", "", "", "")], [1.0, 0.3]),
    ],
)
def test_redundancy(spark, rows, r1):
    assert column(rules.redundancy(rules.classify_tools(steps(spark, *rows))), "r1") == r1


def test_regression(spark):
    got = rules.regression(rules.classify_tools(steps(spark, ("Edit", "f", "x", "y"), ("Edit", "f", "y", "x"), ("Edit", "g", "y", "x"))))
    assert column(got, "r2") == [1.0, 0.0, 1.0]


def test_rules_against_a_plain_loop(spark):
    rng, rows = random.Random(3), []
    for t in range(60):
        for i in range(rng.randint(0, 12)):
            tool = rng.choice(["Read", "Edit", "bash", "grep", "other"])
            old, new = (rng.choice("xyz"), rng.choice("xyz")) if tool == "Edit" else ("", "")
            target = rng.choice(["a", "b", ""])
            rows.append((f"t{t}", i, tool, target, old, new, "", f"{target}{old}{new}", ""))
    df = rules.regression(rules.redundancy(rules.classify_tools(spark.createDataFrame(rows, STEP))))
    got = {(r.traj_id, r.ord): (r.r1, r.r2) for r in df.collect()}
    want, state = {}, {}
    for t, i, tool, target, old, new, _, key, _ in rows:
        seen, reads, writes, edits = state.setdefault(t, (set(), {}, {}, []))
        read, write = tool in ("Read", "grep"), tool == "Edit"
        dup = (tool, key) in seen
        fresh = read and target and target in writes and (target not in reads or writes[target] > reads[target])
        r1 = 0.0 if read and not fresh and ((target and target in reads) or dup) else 0.3 if dup and not read else 1.0
        r2 = 0.0 if write and any(e == (target, new, old) for e in edits) else 1.0
        seen.add((tool, key))
        if read:
            reads[target] = i
        if write:
            writes[target] = i
            edits.append((target, old, new))
        want[t, i] = (r1, r2)
    assert got == want


def test_efficiency_and_outcome(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    assert one(rules.efficiency(F.lit(6), F.lit(3))) == 0.5
    assert one(rules.efficiency(F.lit(0), F.lit(3))) == 0.0
    assert one(rules.efficiency(F.lit(5), F.lit(0))) == 1.0
    null = F.lit(None).cast("double")
    score = lambda p, a, b, s: one(rules.outcome_score(p, a, b, s))
    assert score(null, F.lit(8), F.lit(10), F.lit(False)) == 0.8
    assert score(F.lit(1.5), F.lit(0), F.lit(0), F.lit(False)) == 1.0
    assert score(F.lit(-0.5), F.lit(0), F.lit(0), F.lit(True)) == 0.0
    assert score(null, null, null, F.lit(None).cast("boolean")) == 0.0


def test_info_tokens(spark):
    got = spark.createDataFrame([("see (src/a.py), my_name your_name, ok_ 9_x a/b",)], "o string").select(rules.info_tokens(F.col("o"))).first()[0]
    assert sorted(got) == ["my_name", "src/a.py"]


def trajs(spark, *rewards):
    return spark.createDataFrame([("k", f"t{i}", float(r), i + 1) for i, r in enumerate(rewards)], "task_id string, traj_id string, reward double, n_steps int")


def test_pairs(spark):
    assert pairs.adjacent_pairs(trajs(spark, 0.9, 0.5, 0.2)).count() == 2
    assert pairs.adjacent_pairs(trajs(spark, 0.5, 0.5)).count() == 0
    assert pairs.adjacent_pairs(trajs(spark, 0.5, 0.5), keep_ties=True).count() == 1
    got = {(r.chosen, r.rejected) for r in pairs.outside_in_pairs(trajs(spark, 0.9, 0.7, 0.5, 0.1)).collect()}
    assert got == {("t0", "t3"), ("t1", "t2")}
    assert pairs.outside_in_pairs(trajs(spark, 0.51, 0.50)).count() == 0
    assert pairs.pairs_summary(pairs.outside_in_pairs(trajs(spark))).first().avg_margin == 0.0


def test_store(spark):
    df = spark.createDataFrame([("h", 0.5, 1.0, "first"), ("h", 0.9, 2.0, "second")], "content_hash string, reward double, created_at double, data string")
    one = store.upsert(df.limit(0), df).collect()
    assert [(r.reward, r.data) for r in one] == [(0.9, "first")]
    g = lambda r, e, c, f=0.5: spark.range(1).select(store.desirability(F.lit(r), F.lit(e), F.lit(c).cast("double"), F.lit(0.0), f)).first()[0]
    assert g(1.5, 0, None).intrinsic == 1 and g(-0.3, 0, None).intrinsic == 0 and g(0.5, 0, None).freshness == 1 and g(0.5, 0, None, 1.5).feedback == 1
    assert g(None, 0, None).intrinsic == 0
    with pytest.raises(ValueError):
        store.desirability(F.lit(1), F.lit(1), F.lit(1.0), F.lit(1.0), weights={"a": 2.0})
    hashes = spark.createDataFrame([('[{"tool": "a", "params": {"p": 1}, "output": "o", "thought": "x"}]',), ('{"steps": [{"tool_call": {"name": "a", "parameters": {"p": 1}}, "tool_result": {"output": "o"}}]}',), ("bad",), (None,)], "j string").select(store.content_hash(F.col("j")).alias("h")).collect()
    assert hashes[0].h == hashes[1].h and len(hashes[0].h) == 16 and hashes[2].h is None and hashes[3].h is None


def test_distributed_row_number_with_hot_group_and_ties(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 40)}", rng.randint(0, 3), i) for i in range(3000)] + [(None, 1, -1)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {r.id: r.rn for r in distributed_row_number(df, ["g"], [F.desc("v"), F.asc("id")], "rn", 7).collect()}
    want, at = {}, {}
    for g, v, i in sorted((r for r in rows if r[0]), key=lambda r: (r[0], -r[1], r[2])):
        at[g] = at.get(g, 0) + 1
        want[i] = at[g]
    assert got == want
    assert distributed_row_number(df.limit(0), ["g"], [F.asc("id")], "rn").count() == 0


def test_bonferroni_words_and_intervals(spark):
    assert spark.range(1).select(statistics.p_words(F.lit(3.6)), statistics.p_words(F.lit(-2.1)), statistics.p_words(F.lit(1.0))).first()[:] == ("p<0.001", "p<0.05", "p>0.15")
    df = spark.createDataFrame([("a", 0.5, 1)], "g string, reward double, success int")
    r = statistics.summaries(df, "g").first()
    assert (r.std, r.ci_low, r.ci_high) == (0.0, 0.5, 0.5)
    boot = statistics.bootstrap_interval(spark.createDataFrame([("a", float(i % 5)) for i in range(50)], "g string, v double"), "g", "v", 200).first()
    assert boot.low <= 2.0 <= boot.high


def test_exports(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert {r.split: r["count"] for r in export.split(df, "k").groupBy("split").count().collect()} == {"train": 8, "val": 1, "test": 1}
    lengths = spark.createDataFrame([("t", i, n) for i, n in enumerate([90, 90, 0, 90, 300])], "traj_id string, ord int, length int")
    got = [(r.chunk, r.first_ord, r.last_ord, r.context_from) for r in export.chunks(lengths, 250).orderBy("chunk").collect()]
    assert got == [(0, 0, 2, 0), (1, 3, 3, 2), (2, 4, 4, 3)]
    assert export.chunks(lengths.where("ord < 2"), 250).count() == 1
    assert not export.validate_sft(spark.createDataFrame([], "instruction string, response string, reward double")).first().valid


def test_judging(spark):
    for n in (0, 5, 30, 31, 45, 200, 1999):
        got = [r[0] for r in spark.range(n).where(judging.sampled(F.col("id").cast("int"), F.lit(n))).orderBy("id").collect()] if n else []
        if n <= 30:
            assert got == list(range(n))
        else:
            stride = max(1, (n - 10) // 21)
            assert got == sorted({*range(5), *range(n - 5, n), *[5 + stride * i for i in range(20) if 5 + stride * i < n - 5]})
    assert judging.scores_of('```json\n{"scores": {"a": 2, "b": "x"}}\n```', ["a", "b", "c"]) == [1.0, 0.5, 0.5]
    assert judging.scores_of('so {"scores": {"a": 0.25}, "why": "trunc', ["a"]) == [0.25]
    assert judging.scores_of('{"a": 0.25}', ["a"]) == [0.5]
    assert judging.scores_of(None, ["a"]) == [0.5]
    filled = judging.fill_with_median(spark.createDataFrame([("t", 0, 0.2), ("t", 1, 0.8), ("t", 2, None), ("u", 0, None)], "traj_id string, ord int, score double"))
    assert {(r.traj_id, r.ord): r.filled for r in filled.collect()} == {("t", 0): 0.2, ("t", 1): 0.8, ("t", 2): 0.8, ("u", 0): 0.5}
    df = spark.createDataFrame([("t", 0, "p")], "traj_id string, ord bigint, prompt string")
    assert judging.judged(df, ["a"], lambda p: '{"scores": {"a": 0.9}}').first().scores == [0.9]


def test_sanitizer(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(sanitize.sanitized(F.col("t"))).first()[0]
    assert one("password=mysecretpassword123") == "password=[REDACTED_CREDENTIAL]"
    assert one("mail a.b@c.org or 13812345678") == "mail [REDACTED_EMAIL] or [REDACTED_PHONE]"
    assert one("/usr/local/lib/python3/site-packages/module/file.py") == "/usr/local/lib/python3/site-packages/module/file.py"
    assert one("http://10.1.2.3 and 192.168.0.1") == "http://[REDACTED_INTERNAL_IP] and [REDACTED_INTERNAL_IP]"
    deep = spark.createDataFrame([('{"a": [{"b": "13812345678"}]}',), ("x 13812345678",), (None,)], "t string").select(sanitize.sanitized_json(F.col("t"))).collect()
    assert [r[0] for r in deep] == ['{"a": [{"b": "[REDACTED_PHONE]"}]}', "x [REDACTED_PHONE]", None]


def test_agent_texts(spark):
    df = spark.createDataFrame([("Step 1:\nThought: a\nAction: b\nObservation: c\n\nStep 2:\nAction: d",)], "t string")
    got = df.select(agent_text.parse_steps(F.col("t"))).first()[0]
    assert [tuple(s) for s in got] == [("a", "b", "c"), ("", "d", "")]
    act = lambda t: tuple(spark.createDataFrame([(t,)], "t string").select(agent_text.parse_action(F.col("t"))).first()[0])
    assert act("bash ls -la") == ("bash", '{"command":"ls -la"}', "")
    assert act('grep {"pattern": "x"}') == ("grep", '{"pattern": "x"}', "")
    assert act("<thought>t</thought><action>submit</action>") == ("submit", "{}", "t")
    assert act("") == ("think", "{}", "")


def test_whole_documents(spark):
    texts = ['{"a":1}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "[1],[2]", "", None, '{"a":1}],[{', "3"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(parse_document(F.col("t")).isNotNull()).collect()]
    assert got == [True, False, False, False, False, False, False, False, True]


def test_profiles_and_adapters():
    assert ("Read", "read", "file_path") in dims.profile("coding")
    assert dims.profile("nowhere") == []
    assert sum(w for s, _, w, _ in dims.rubric_rows() if s == "default") == pytest.approx(1)
    assert logs.list_adapters() == ["crew", "openhands", "swe-agent", "sweagent"]
    with pytest.raises(KeyError):
        logs.get_adapter("none")


def test_adapters(spark):
    doc = '{"history": [["ls", "Error: no"], [{"action": "open", "path": "x", "thought": "hm"}, "ok"], [{"action": "think"}, ""], ["short"], [{"path": "y"}, "Error"]], "info": {"exit_status": "submitted"}}'
    swe = spark.createDataFrame([("d", doc)], "doc string, value string")
    assert [(r.step_id, r.tool, r.params, r.thought, r.exit_code) for r in logs.swe_steps(swe).orderBy("step_id").collect()] == [(0, "bash", '{"command":"ls"}', "", 1), (1, "read_file", '{"path":"x","thought":"hm"}', "hm", 0), (2, "unknown", '{"path":"y"}', "", 0)]
    assert logs.swe_outcome(swe).first().success is True
    crew = spark.createDataFrame([("s", 0, "message", "step", "p1", None), ("s", 1, "message", "assistant", "a1", None), ("s", 2, "message", "step", "p2", None), ("s", 3, "end", None, None, "completed")], "session string, ord int, event string, role string, content string, status string")
    assert [(r.step_id, r.prompt, r.content) for r in logs.crew_pipeline_steps(crew).collect()] == [(0, "p1", "a1")]
    assert tuple(logs.crew_employee_step(crew).first()) == ("s", "a1", True)
    said = lambda role, blocks: json.dumps({"type": role, "message": {"role": role, "content": blocks}})
    result = lambda text: {"type": "tool_result", "tool_use_id": "u", "content": text}
    lines = [said("assistant", [{"type": "text", "text": "hm"}]), "no json", said("assistant", [{"type": "text", "text": "go"}, {"type": "tool_use", "id": "u", "name": "bash", "input": {"c": 1}}, {"type": "tool_use", "id": "v", "name": "ls"}]), said("user", [result("old")]), said("user", [result("x" * 9000)]), said("user", "plain text")]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, ord bigint, value string")
    got = sessions.session_steps(sessions.entries(rows)).orderBy("step_id").collect()
    assert [(r.tool, r.params, r.thought, len(r.output)) for r in got] == [("thinking", "{}", "hm", 0), ("bash", '{"c":1}', "go", 8000 + len("\n... (truncated, 9000 chars total)")), ("ls", "{}", "", 0)]


def test_files(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"task_id": "x", "language": "Go"}\n\nbad\n{"description": "d"}\n')
    got = {(r.task_id, r.language, r.difficulty) for r in files.read_tasks(spark, str(p)).collect()}
    assert got == {("x", "Go", "medium"), ("task_4", "python", "medium")}
    assert files.filter_tasks(files.read_tasks(spark, str(p)), language="GO").count() == 1
    a = tmp_path / "p.json"
    a.write_text('[{"task_id": "k", "reward_margin": 0.5}]')
    assert files.read_preferences(spark, str(a)).first().reward_margin == 0.5
    s = tmp_path / "s.jsonl"
    s.write_text('{"instruction": "i", "response": "r"}\nbroken\n')
    assert files.read_lines(spark, str(s), files.SFT).count() == 1
    files.write_lines(files.read_lines(spark, str(s), files.SFT), str(tmp_path / "out"))
    assert files.read_lines(spark, str(tmp_path / "out"), files.SFT, strict=True).count() == 1


def test_episodes(spark):
    df = spark.createDataFrame([("e", i, t, float(i), t == "submit") for i, t in enumerate(["bash", "bash", "submit"])], "traj_id string, ord int, tool string, gain double, terminated boolean")
    cut = episodes.truncate_after(df, 2)
    assert column(cut, "truncated") == [False, True, False]
    assert episodes.recorded(cut).first().success is True
    assert column(episodes.running_statistics(df, "gain"), "return_so_far") == [0.0, 1.0, 3.0]
    it = spark.createDataFrame([(i, m) for i, m in enumerate([0.1, 0.3, 0.3, 0.2, 0.4])], "iteration int, mean double")
    assert [r.stop for r in episodes.early_stop(it, 2).orderBy("iteration").collect()] == [False, False, False, True, False]


def test_tail_reads_whole_lines_and_survives_truncation(spark, tmp_path):
    p = tmp_path / "grow.jsonl"
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def drain():
        q = ingest.tail(spark, str(p)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.value for r in spark.read.schema("value string").parquet(out).collect())

    p.write_text('{"a": 1}\n{"a": 2}\n{"a":')
    assert drain() == ['{"a": 1}', '{"a": 2}']
    with p.open("a") as f:
        f.write(' 3}\n')
    assert drain() == ['{"a": 1}', '{"a": 2}', '{"a": 3}']


def test_upsert_stream(spark, tmp_path):
    merge = ingest.upsert_into(str(tmp_path))
    row = lambda r, d: spark.createDataFrame([("h", r, 1.0, d)], "content_hash string, reward double, created_at double, data string")
    merge(row(0.5, "a"), 0)
    merge(row(0.9, "b"), 1)
    merge(row(0.95, "c"), 1)  # the same batch again
    assert [(r.reward, r.data) for r in ingest.read_store(spark, str(tmp_path)).collect()] == [(0.9, "a")]
    ingest.compact(spark, str(tmp_path), str(tmp_path / "one"))
    assert [(r.reward, r.data) for r in ingest.read_store(spark, str(tmp_path / "one")).collect()] == [(0.9, "a")]


def test_content_hash_of_odd_texts(spark):
    odd = ["line1\nline2", 'a"b\\c', "\t\r\b\f\u0001\u001f\u007f", "é漢😀", None, ""]
    df = spark.createDataFrame([(f"t{i}", 0, "bash", "x/\ny", o) for i, o in enumerate(odd)], "traj_id string, ord int, tool string, target string, output string")
    got = {r.traj_id: r.content_hash for r in store.flat_content_hash(df).collect()}
    for i, o in enumerate(odd):
        text = json.dumps([{"tool": "bash", "params": {"path": "x/\ny"}, "output": o or ""}], sort_keys=True, ensure_ascii=False)
        assert got[f"t{i}"] == hashlib.sha256(text.encode()).hexdigest()[:16]
    deep = "[" * 5000 + "1" + "]" * 5000
    assert spark.createDataFrame([(f'[{{"tool": "t", "params": {{"a": {deep}}}}}]',)], "t string").select(store.content_hash(F.col("t"))).first()[0]


def test_json_of_any_depth():
    rng = random.Random(1)

    def made(k):
        r = rng.random()
        if k > 4 or r < 0.4:
            return rng.choice([1, -2.5, 1e10, 'a"\n\\é', None, True, False, ""])
        return [made(k + 1) for _ in range(rng.randint(0, 4))] if r < 0.7 else {rng.choice("abc\n"): made(k + 1) for _ in range(rng.randint(0, 4))}

    for _ in range(500):
        v = made(0)
        text = json.dumps(v, indent=rng.choice([None, 1]))
        assert deepjson._read(text, float) == v
        i = rng.randrange(len(text))
        bad = text[:i] + rng.choice('{}[],:"x') + text[i + rng.randint(0, 1) :]
        try:
            want = json.loads(bad)
        except ValueError:
            with pytest.raises(ValueError):
                deepjson._read(bad, float)
        else:
            assert deepjson._read(bad, float) == want
    deep = "[" * 100_000 + "]" * 100_000
    assert deepjson.dumps(deepjson.loads(deep)) == deep


def test_samples_mask_all_but_the_assistant():
    steps = [{"thought": "a b", "action": "go", "observation": "seen it"}, {"thought": "", "action": "end", "observation": ""}]
    turns = training.agent_turns("do this", "", steps)
    assert [r for r, _ in turns] == ["user", "assistant", "user", "assistant"]
    got = training.masked(turns, training.words_tokenizer, 100, [1.0, 3.0])
    words = training.conversation_text(turns).split()
    kept = [w for w, label in zip(words, got["labels"]) if label != training.IGNORED]
    assert kept == ["assistant:", "Thought:", "a", "b", "Action:", "go", "assistant:", "Action:", "end"]
    assert [w for w in got["weights"] if w != 1.0] == [0.5] * 6 + [1.5] * 3
    assert len(training.masked(turns, training.words_tokenizer, 5)["input_ids"]) == 5


def test_audits_and_full_redaction(spark):
    text = "password=mysecretpassword123 and a.b@c.org"
    got = spark.createDataFrame([(text,)], "t string").select(sanitize.audit(F.col("t"))).first()[0]
    assert [tuple(a) for a in got] == [("credential_assignment", "mysecretpassword123", "[REDACTED_CREDENTIAL]", 9), ("email", "a.b@c.org", "[REDACTED_EMAIL]", 35)]
    doc = {"steps": [{"step_id": 4, "thought": "mail a@b.org", "tool_call": {"parameters": {"x": [{"y": "13812345678"}]}}}], "task": {"description": "a@b.org"}}
    row = sanitize.sanitize_trajectories(spark.createDataFrame([(json.dumps(doc),), ("x a@b.org",), (None,)], "data string")).collect()
    assert [(r.total_redacted, len(r.entries)) for r in row] == [(3, 3), (1, 1), (0, 0)]
    assert [(e.step_id, e.field) for e in row[0].entries] == [("4", "thought"), ("4", "params"), (None, "task.description")]
    assert json.loads(row[0].data)["steps"][0]["tool_call"]["parameters"] == {"x": [{"y": "[REDACTED_PHONE]"}]}
    soft = spark.createDataFrame([("mail a@b.org now",), ("short",)], "t string").select(sanitize.sanitize_full(F.col("t"), str.upper)).collect()
    assert [r[0] for r in soft] == ["MAIL [REDACTED_EMAIL] NOW", "short"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "a", 0.9, 1, 3, "m", "e", "f", ""), ("t2", "b", 0.1, 0, 2, "n", "e", "f", "kept")], "traj_id string, task_id string, reward double, success int, n_steps int, agent_model string, employee string, agent_framework string, content_hash string")
    saved = sinks.save_trajectories(rows, F.lit('[{"tool": "x"}]'), str(tmp_path / "saved"))
    assert {r.content_hash for r in saved.collect()} == {"kept", hashlib.sha256(b'[{"output": "", "params": {}, "tool": "x"}]').hexdigest()[:16]}
    sinks.save_checkpoint(rows.select("task_id").limit(1), rows, str(tmp_path / "check"))
    left, before = sinks.resume(spark, rows.select("task_id"), str(tmp_path / "check"))
    assert (left.count(), before.count()) == (1, 2)
    sinks.save_report(sinks.evaluation_report(rows), str(tmp_path / "r.md"))
    with pytest.raises(ValueError):
        sinks.save_report(rows, str(tmp_path / "r.txt"))
    seen = []
    sinks.export_folder(rows, rows, rows.limit(0), rows, str(tmp_path / "set"), seen.append)
    assert seen and not (tmp_path / "set/dpo").exists() and "| Total trajectories | 2 |" in spark.read.text(str(tmp_path / "set/README"), wholetext=True).first()[0]
    write = sinks.append_batch(str(tmp_path / "daily"), lambda b: b)
    write(rows, 0)
    write(rows, 0)
    assert spark.read.json(str(tmp_path / "daily/numbers")).first().high == 1


def test_batches_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"history": [["ls", "ok"]], "info": {}}')
    (tmp_path / "b.json").write_text('{"history": []}')
    (tmp_path / "c.json").write_text("no json")
    assert [(r.doc, r.tool) for r in flows.convert_batch(spark, str(tmp_path), "sweagent", "*.json").collect()] == [("a.json", "bash")]
    (tmp_path / "e.jsonl").write_text('{"id": 1, "source": "agent", "action": "run", "args": "{}"}\n{"id": 2, "observation": "run", "content": "x"}\n')
    (tmp_path / "f.jsonl").write_text('{"id": 1, "source": "agent"}\n')
    assert [(r.log_id, r.tool) for r in flows.convert_batch(spark, str(tmp_path), "openhands", "*.jsonl").collect()] == [("e.jsonl", "bash")]
    found = sessions.read_sessions(spark, str(tmp_path))
    assert found.count() == 3 and sessions.read_sessions(spark, str(tmp_path), "2999-01-01").count() == 0


def test_custom_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"domain": "lab", "tools": [{"name": "stir", "category": "write", "stateful_key": "pot", "aliases": ["mix"]}], "rubrics": [{"id": "care", "weight": 1.0, "evaluator": "rule"}]}')
    assert dims.load_profile(spark, str(tmp_path / "p.json")) == "lab" and "lab" in dims.list_domains()
    assert ("mix", "write", "pot") in dims.profile("lab") and dims.rubric_set_of("lab") == "lab" and dims.rubric("lab", "care")[2] == 1.0
    dims.CUSTOM_TOOLS.clear(), dims.CUSTOM_RUBRICS.clear()


def test_episode_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    row = lambda e, r, done, at: json.dumps({"episode": e, "reward": r, "done": done, "at": f"2024-01-01T{at}:00Z"})
    batches = [[row("a", 1.0, False, "00:00"), row("b", 2.0, False, "00:01")], [row("a", 0.5, True, "00:05"), row("c", 1.0, False, "00:40")], [row("d", 1.0, False, "03:00")], [row("d", 1.0, False, "03:01")]]
    stream = ingest.episode_sums(spark.readStream.schema("episode string, reward double, done boolean, at timestamp").json(str(source)), "10 minutes")
    q = stream.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").json(f"{out}/batch={i}")).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).start()
    for i, lines in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(lines) + "\n")
        q.processAllAvailable()
    q.stop()
    got = {(r.episode, r.steps, r.total, r.done) for r in spark.read.schema("episode string, steps bigint, total double, done boolean").json(out).collect()}
    assert {("a", 2, 1.5, True), ("b", 1, 2.0, False), ("c", 1, 1.0, False)} <= got


def test_rescoring_shares_and_losses(spark):
    df = spark.createDataFrame([("a", 0.0, 0.7), ("b", 0.2, 0.9)], "traj_id string, reward double, computed double")
    assert {r.traj_id: r.reward for r in rules.rescored(df).collect()} == {"a": 0.7, "b": 0.2}
    assert episodes.worker_shares(10, 4) == [3, 3, 2, 2]
    tokens = spark.createDataFrame([("t", 0, 5, -9.0, 1.0), ("t", 1, 5, -1.0, 2.0), ("t", 2, -100, -7.0, 1.0)], "traj_id string, pos int, label int, log_prob double, weight double")
    assert statistics.sequence_log_probs(tokens).first().log_prob == -1.0
    assert statistics.weighted_cross_entropy(tokens).first().loss == pytest.approx(5.5)
    with pytest.raises(ValueError):
        statistics.calibration(df.limit(1), "reward", "computed")


@pytest.mark.parametrize("block", [7, 65_536])
def test_pairwise_agreement_takes_values_as_they_are(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice([0.5, rng.random() / 100]), rng.choice([0.25, rng.random() / 100])) for _ in range(90)]
    rows += rows[:15]
    pairs_of = [(a, b) for i, a in enumerate(rows) for b in rows[:i]]
    alike = sum((a[0] > b[0]) - (a[0] < b[0]) == (a[1] > b[1]) - (a[1] < b[1]) for a, b in pairs_of)
    got = statistics.pairwise_agreement(spark.createDataFrame(rows, "x double, y double"), "x", "y", **({"block": 7} if block == 7 else {})).first()
    assert (got.pairs, got.agreement) == (len(pairs_of), round(alike / len(pairs_of), 4))


def test_exact_calibration_queries(spark, data):
    from stepweave.plans import queries as core

    q = core.queries()
    rows = [(r.x, r.y) for r in core._exact(spark, data).collect()]
    alike = sum((a[0] > b[0]) - (a[0] < b[0]) == (a[1] > b[1]) - (a[1] < b[1]) for i, a in enumerate(rows) for b in rows[:i])
    got = q["a13_agreement_exact"](spark, data).first()
    assert got.pairs == len(rows) * (len(rows) - 1) // 2 and got.agreement == pytest.approx(alike / got.pairs, abs=6e-5)
    error = [abs(a - b) for a, b in rows]
    got = q["a10_calibration_exact"](spark, data).first()
    assert got.n == len(rows) and got.mae == pytest.approx(sum(error) / len(error), abs=6e-5) and got.max_error == pytest.approx(max(error), abs=6e-5)
    assert q["t4_paired_exact"](spark, data).first().df == len(rows) - 1


def test_environments_settings_and_simulated_tools(spark, tmp_path):
    registry.register("echo", lambda **k: k, "coding", most=3)
    assert registry.make("echo", seed=1) == {"most": 3, "seed": 1} and registry.list_envs("coding") == ["echo"] and registry.list_envs("crew") == []
    with pytest.raises(ValueError):
        registry.register("echo", dict)
    with pytest.raises(KeyError):
        registry.make("none")
    (tmp_path / "s.json").write_text('{"epochs": 5, "seed": 7}')
    s = registry.settings(spark, str(tmp_path / "s.json"), seed=9, max_length=None)
    assert (s.epochs, s.seed, s.max_length) == (5, 9, 2048)
    said = spark.createDataFrame([("coding", "grep", '{"pattern": "x"}'), ("coding", "fly", "{}")], "d string, t string, p string").select(registry.simulated_output(F.col("d"), F.col("t"), F.col("p"))).collect()
    assert [r[0] for r in said] == ["[grep] x", "unknown tool: fly"]


def test_crew_lines_go_into_the_store(spark, tmp_path):
    line = lambda name, reward: json.dumps({"task": {"task_id": name}, "agent": "crew/ann", "steps": [{"tool_call": {"name": "ls", "parameters": {"p": name}}, "tool_result": {"output": "o"}}], "outcome": {"success": True, "reward": reward}})
    take = ingest.crew_ingest(str(tmp_path))
    take(spark.createDataFrame([(line("a", 0.2),), ("broken",), (line("b", 0.4),)], "value string"), 0)
    take(spark.createDataFrame([(line("a", 0.9),)], "value string"), 1)
    got = {r.task_id: (r.reward, r.employee, r.agent_framework) for r in ingest.read_store(spark, str(tmp_path / "store")).collect()}
    assert got == {"a": (0.9, "ann", "crew"), "b": (0.4, "ann", "crew")}
    assert {(r.ingested, r.errors) for r in spark.read.json(str(tmp_path / "numbers")).collect()} == {(2, 1), (1, 0)}
    (tmp_path / "x.txt").write_text("one\n\nthree\n")
    rows, cursor = ingest.new_lines(spark, str(tmp_path / "x.txt"), 2)
    assert ([r.value for r in rows.collect()], cursor) == (["three"], 4)


def test_command_line(spark, data, tmp_path):
    assert cli.main(["validate", f"{data}/trajectories.parquet", "--out", str(tmp_path / "v")], spark) == 0
    assert spark.read.json(str(tmp_path / "v")).first().total > 0
    assert cli.main(["process", f"{data}/messages.parquet", "--out", str(tmp_path / "p")], spark) == 0
    assert spark.read.json(str(tmp_path / "p")).where("reward > 0").count() > 0
    for verb in ("card", "compare", "pairs", "split"):
        assert cli.main([verb, f"{data}/trajectories.parquet", "--out", str(tmp_path / verb)], spark) == 0
