"""Operators for training data against plain Python, round trips and held-out cases."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.llm import caps, conversations, crf, langs, languages, mixing, packing, pairs, personal, tokens, truncation

MESSAGES = "log_id string, id int, source string, action string, observation string, args string, content string, thought string, timestamp string, extras struct<model:string>, received_at timestamp"


def log_rows(rng, log, n):
    rows, at, pending = [], 0, None
    for _ in range(n):
        at += rng.choice([1, 1, 1, 2, 7])
        kind = rng.random()
        if pending and kind < 0.75:
            rows.append((log, at, rng.choice([None, "environment"]), None, pending if rng.random() < 0.93 else "other", None, "out"))
            pending = None
        elif kind < 0.35:
            rows.append((log, at, rng.choice(["user", " USER"]), "message", None, None, rng.choice(["hi", "hi", "hi", " ", None])))
        elif kind < 0.7:
            rows.append((log, at, rng.choice(["agent", "Agent "]), "message", None, json.dumps({"content": rng.choice(["yes", ""])}), rng.choice([None, "x"])))
        elif kind < 0.98:
            pending = rng.choice(["run", "read"])
            rows.append((log, at, "agent", pending, None, "{}", None))
        else:
            rows.append((log, at, "system", "message", None, None, "s"))
    if rng.random() < 0.1 and rows:
        rows.append((*rows[-1][:6], "changed"))
    return rows


def plain_defect(rows):
    by_id = defaultdict(set)
    for r in rows:
        by_id[r[1]].add(r)
    order = [min(by_id[k], key=repr) for k in sorted(by_id)]
    speaker = lambda r: (r[2] or "").strip().lower()

    def text(r):
        a = json.loads(r[5]).get("content") if r[5] else None
        return next((x for x in (a, r[6]) if x and x.strip()), None)

    says = [r[3] == "message" and speaker(r) in ("user", "agent") and text(r) is not None for r in order]
    if not any(says):
        return "empty"
    if any(len(v) > 1 for v in by_id.values()) or any(not r[3] and not r[4] for r in order):
        return "broken"
    for i, r in enumerate(order):
        if r[4] and not (i and speaker(order[i - 1]) == "agent" and order[i - 1][3] == r[4]):
            return "broken"
    if speaker(order[says.index(True)]) == "agent":
        return "broken"
    waiting = acted = False
    for r, s in zip(order, says):
        if speaker(r) == "user" and r[3] == "message":
            if waiting and acted:
                return "no_reply"
            waiting, acted = True, False
        elif speaker(r) == "agent":
            acted = True
            if s and r[3] == "message":
                waiting = False
    return "no_reply" if waiting else None


@pytest.mark.parametrize(("chunk", "part"), [(1, 8), (2, 6), (5, 20), (16, 65_536)])
def test_defects_of_logs(spark, monkeypatch, chunk, part):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    monkeypatch.setattr(conversations, "PART", part)
    rng = random.Random(chunk)
    logs = {f"l{i}": log_rows(rng, f"l{i}", rng.choice([1, 3, 6, 12, 40])) for i in range(120)}
    logs = {k: v for k, v in logs.items() if v}
    rows = [(*r, None, None, None, None) for rs in logs.values() for r in rs for _ in range(rng.choice([1, 1, 2]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, MESSAGES)
    want = {k: d for k, v in logs.items() if (d := plain_defect(v))}
    assert {r.log_id: r.defect for r in conversations.left_out_logs(df).collect()} == want
    got = defaultdict(list)
    for r in conversations.conversations(df).orderBy("log_id", "pos").collect():
        got[r.log_id].append((r.pos, r.id))
    assert {k: v for k, v in got.items()} == {k: list(enumerate(sorted({r[1] for r in v}))) for k, v in logs.items() if k not in want}


def test_pointers_orphans_and_cycles(spark):
    rows = [("k", 1, None), ("k", 2, 1), ("k", 3, 2), ("k", 4, 3), ("k", 5, 99), ("k", 6, 5), ("k", 7, 8), ("k", 8, 7), ("k", 9, 9)]
    df = spark.createDataFrame(rows, "log string, node int, up int").withColumn("acc", F.struct(F.lit(1).alias("n")))
    got = conversations.pointer_jump(df, ["log"], "node", "up", "acc", lambda a, b: F.struct((a["n"] + b["n"]).alias("n"))).collect()
    assert {r.node: r.status for r in got} == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "orphan", 6: "orphan", 7: "cycle", 8: "cycle", 9: "cycle"}
    assert {r.node: r.acc.n for r in got if r.status == "ok"} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_rows_of_the_table_are_resolved_by_jumps(spark):
    messages = spark.read.parquet("/root/testdata/sf0.01/messages.parquet")
    nodes = conversations.log_nodes(conversations.message_rows(messages)).cache()
    longest = nodes.groupBy("log_id").count().agg(F.max("count")).first()[0]
    assert longest > 2**5  # more than five rounds
    ways = {r.status: r["count"] for r in nodes.groupBy("status").count().collect()}
    assert ways["ok"] > 500 and ways["orphan"] > 20 and ways["cycle"] > 0


def test_nested_caps_are_greedy_by_level(spark):
    rng = random.Random(2)
    rows = [(i, f"a{rng.randint(0, 4)}", f"d{rng.randint(0, 1)}", rng.randint(0, 3), 4, 9) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, author string, domain string, q int, ca int, cd int")
    got = {r.id for r in caps.laminar_caps(df, [(["domain", "author"], "ca"), (["domain"], "cd")], [F.desc("q"), F.asc("id")]).where("dropped_at IS NULL").collect()}
    order, keep, n = sorted(rows, key=lambda r: (-r[3], r[0])), [], defaultdict(int)
    for r in order:
        if n[r[2], r[1]] < 4:
            n[r[2], r[1]] += 1
            keep.append(r)
    kept, m = set(), defaultdict(int)
    for r in keep:
        if m[r[2]] < 9:
            m[r[2]] += 1
            kept.add(r[0])
    assert got == kept


def test_top_n_with_ties_nan_and_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 30)}", rng.choice([1.0, 1.0, 0.5, -7.25, 1e9, None]), i) for i in range(2000)]
    df = spark.createDataFrame([*rows, (None, 1.0, -1)], "g string, s double, id int")
    got = defaultdict(list)
    for r in caps.top_n(df, "g", "s", 3, [F.desc("s"), F.asc("id")]).orderBy("g", "rank").collect():
        got[r.g].append(r.id)
    want = defaultdict(list)
    for g, s, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], -r[1], r[2])):
        if len(want[g]) < 3:
            want[g].append(i)
    assert got == want


@pytest.mark.parametrize(
    ("value", "name"),
    [("Data Engineer 2", "data-engineer-2"), ("@data_engineer", "data-engineer"), ("crew/data‑engineer", "data-engineer"), (" data - engineer ", "data-engineer"), ("quartz-3-20260110", "quartz-3"), ("quartz-3-1", "quartz-3-1"), ("proxy:quartz-3-mini", "quartz-3-mini"), ("QUARTZ_3@latest", "quartz-3"), ("guest", None), ("", None), ("-", None)],
)
def test_contributor_spellings(spark, value, name):
    known = {"data-engineer", "data-engineer-2", "quartz-3", "quartz-3-1", "quartz-3-mini"}
    parts = spark.createDataFrame([(value,)], "v string").select(caps.contributor_parts(F.col("v"))).first()[0]
    assert max((p for p in parts if p in known), key=len, default=None) == name


@pytest.mark.parametrize(
    ("instruction", "response", "defect"),
    [
        ("Write unit tests for the parser and cover empty input.", None, "empty"),
        ("Write unit tests.", "Step 1:\nThought: \nAction: \nObservation: ", "empty"),
        ("Write unit tests.", "<p></p>", "empty"),
        ("Write unit tests.", "​", "empty"),
        ("Write unit tests.", "I'm sorry, but I can't help with that request. Is there anything else you need?", "refusal"),
        ("Write a polite message that declines a refund.", "We are sorry, but we can't help with this refund.", None),
        ("Write unit tests for the parser and cover empty input.", "> write unit tests for the parser and cover empty input", "copy"),
        ("Write unit tests for the parser.", "Write unit tests for the parser.\n\nStep 1:\nThought: I open the file to see how it is used.\nAction: grep x\nObservation: y", None),
        ("Explain why the loop is slow when it is called from the view.", "Die Schleife endet ein Element zu früh und ich passe die Aufrufer danach an.", "other_language"),
        ("Answer in German: Explain why the loop is slow when it is called.", "Die Schleife endet ein Element zu früh und ich passe die Aufrufer danach an.", None),
        ("Explain why the loop is slow.", "Step 1:\nThought: The loop runs twice.\nAction: grep x\nObservation: y\n\nStep 2:\nThought:", "truncated"),
    ],
)
def test_pairs_one_by_one(spark, instruction, response, defect):
    # Enough whole texts that the ends can be told.
    rows = [(100 + i, "Fix it.", "The loop runs twice.\nStep 1:\nThought: Go.\nAction: grep x\nObservation: y") for i in range(20)]
    df = spark.createDataFrame([*rows, (1, instruction, response)], "record_id bigint, instruction string, response string")
    got = {r.record_id: r.defect for r in pairs.defective_pairs(df).collect()}
    assert got.get(1) == defect


def browser(spark, texts, agent="a"):
    steps = [(i, [{"thought": t, "tool_call": {"name": "n", "parameters": None}, "tool_result": {"output": None}}], agent) for i, t in enumerate(texts)]
    return spark.createDataFrame(steps, "traj_id bigint, steps array<struct<thought:string,tool_call:struct<name:string,parameters:string>,tool_result:struct<output:string>>>, agent string")


def test_cut_values(spark):
    whole = ["I need to open the next page. The search box is at the top.", "The search box is at the top. I need to open the next page.", "OK, done", "Wait for the page...", '{"a": [1, 2]}'] * 30
    cut = ["I need to open the ne", "I need to open the", "I need to open the...", "The search box is at the top. [truncated]", "The search box is at t�", '{"a": [1,', "The search box is at the "]
    got = {r.traj_id for r in truncation.cut_values(browser(spark, whole + cut)).collect()}
    assert got == set(range(len(whole), len(whole) + len(cut)))
    shares = truncation.cut_shares(browser(spark, whole + cut)).first()
    assert (shares.n_values, shares.n_cut) == (len(whole) + len(cut), len(cut))


def test_a_cut_that_recurs_stays_cut(spark):
    whole = ["I need to open the next page. The search box is at the top.", "The search box is at the top. I need to open the next page."] * 300
    cut = ["I need to open the next pag"] * 60 + ["I need to open the next pag�"] * 5
    for times in (1, 10):
        got = {r.traj_id for r in truncation.cut_values(browser(spark, (whole + cut) * times)).collect()}
        assert len(got) == len(cut) * times and {i % len(whole + cut) for i in got} == set(range(len(whole), len(whole + cut)))


def test_a_table_copied_many_times_has_the_same_cuts(spark):
    one = spark.read.parquet("/root/testdata/sf0.01/browser_trajectory.parquet").where("traj_id IS NOT NULL").select("traj_id", "steps", "agent")
    many = one.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("traj_id", F.col("traj_id") + 10**9 * F.col("copy").cast("bigint")).drop("copy")
    found = {(r.traj_id, r.step_pos, r.field) for r in truncation.cut_values(one).collect()}
    got = truncation.cut_values(many).groupBy((F.col("traj_id") % 10**9).alias("traj_id"), "step_pos", "field").count().collect()
    assert found and {(r.traj_id, r.step_pos, r.field) for r in got} == found and {r["count"] for r in got} == {100}


def test_limits_of_fields(spark):
    rng = random.Random(8)
    words = ["open", "page", "with", "the", "list", "of", "offers", "and", "prices", "below"]
    long = [" ".join(rng.choice(words) for _ in range(60))[: rng.choice([*[80] * 40, *range(60, 100)])] for _ in range(400)]
    limits = truncation.field_limits(browser(spark, long + ["Always the same phrase of this one length"] * 300)).collect()
    assert {(r.field, r.unit, r["size"]) for r in limits} == {("thought", "characters", 80), ("thought", "bytes", 80)}


def test_very_long_words_meet_by_their_beginnings(spark):
    whole = ["We open " + "x" * 300 + " today."] * 9 + ["We open it today."] * 9
    got = {r.traj_id for r in truncation.cut_values(browser(spark, whole + ["We open " + "x" * 200, "We open " + "x" * 20])).collect()}
    assert got == {18, 19}


def test_truncated_pairs_are_the_same_in_a_table_ten_times_as_large(spark):
    whole = ["I fix the sort first.\nAction: edit_file src/sort.py", "Next I update the callers of merge_rows before I run the tests."] * 30
    cut = ["I fix the sort first.\nAction: ed", "Next I update the callers of mer"]
    for times in (1, 10):
        texts = [(i, "Please repair the loop and tell me what you did.", t) for i, t in enumerate((whole + cut) * times)]
        got = pairs.defective_pairs(spark.createDataFrame(texts, "record_id bigint, instruction string, response string")).collect()
        assert sorted((r.record_id % len(whole + cut), r.defect) for r in got) == sorted([(len(whole), "truncated"), (len(whole) + 1, "truncated")] * times)


def test_personal_values_and_placeholders(spark):
    names = spark.createDataFrame([("Oriolde",), ("Brisolde",), ("Elsvwyn",), ("Nadrwyn",)], "name string")
    cases = [
        ("Contact person: Kasmolde Quistrell. Write to a.b+c@mail.example now.", {("name", "Kasmolde Quistrell"), ("email", "a.b+c@mail.example")}),
        ("Dear Ms. Elsvwyn B. de la Quille, call +49 1632 960123 please.", {("name", "Elsvwyn B. de la Quille"), ("phone", "+49 1632 960123")}),
        ("Full name: O'Ferrand, Oriolde\nE-mail: x_y [at] corp.test", {("name", "O'Ferrand, Oriolde"), ("email", "x_y [at] corp.test")}),
        ("National ID: 123-45-6789. Invoice 4471 2208 41 is paid. Build 1.41.23125-960 was tagged.", {("id_number", "123-45-6789")}),
        ("Ship it to Flat 2, 14 Velmount Road, Nether Quill QX1 2ZZ.", {("address", "Flat 2, 14 Velmount Road, Nether Quill QX1 2ZZ")}),
        ("收货地址：虚云市云杉区青禾路11号5单元480室。", {("address", "虚云市云杉区青禾路11号5单元480室")}),
        ("Quick Start Guide and Release Notes are linked. Install pkg@8.4.0 from @lampfeld.", set()),
    ]
    df = browser(spark, [t for t, _ in cases] * 6)
    got = defaultdict(set)
    for r in personal.personal_values(df, names).collect():
        got[r.traj_id].add((r.kind, r.value))
    for i, (_, want) in enumerate(cases):
        assert got[i] == want
    red = {r.traj_id: r.text for r in personal.redacted_texts(df, names).collect()}
    assert red[0] == "Contact person: [NAME]. Write to [EMAIL] now."


def test_label_model_never_turns_a_vote_around():
    got = personal.reliabilities({(1, 1, 1): 50, (2, 2, 2): 50, (1, 0, 0): 10, (2, 0, 0): 10, (0, 0, 0): 5})
    assert got[1, 1, 1] > 0.9 and got[2, 2, 2] < 0.1 and got[1, 0, 0] > got[0, 0, 0] > got[2, 0, 0]
    assert personal.reliabilities({}) == {}


@pytest.mark.parametrize("capacity", [16, 50, 101])
def test_packing_is_whole_and_tight(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(10):
        sizes = rng.integers(1, capacity + 1, 200)
        fit = packing.best_fit(sizes, capacity)
        bins = packing.local_search(sizes, fit, capacity)
        assert len(bins) == len(sizes) and np.bincount(bins, weights=sizes).max() <= capacity
        assert bins.max() <= fit.max() and bins.max() + 1 <= 1.08 * np.ceil(sizes.sum() / capacity) + 1
    assert len(packing.local_search(np.array([], dtype=int), np.array([], dtype=int), capacity)) == 0


def test_packed_documents_round_trip(spark, data, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    docs, kinds = spark.read.parquet(f"{data}/documents.parquet"), spark.createDataFrame([("s", 64), ("m", 300), (None, 4), ("bad", 0)], "container string, capacity_tokens int")
    docs = docs.select("doc_id", "text").union(docs.select("doc_id", "text").limit(5)).union(spark.createDataFrame([(9001, ""), (9002, None), (9003, "word " * 5000)], "doc_id bigint, text string"))
    got = packing.packed_documents(docs, kinds).collect()
    sizes = {r.doc_id: r.tokens for r in tokens.token_sizes(docs).collect()}
    for kind, capacity in (("s", 64), ("m", 300)):
        rows, fill, pieces = [r for r in got if r.container == kind], defaultdict(int), defaultdict(list)
        for r in rows:
            fill[r.bin_id] += r.tokens
            pieces[r.doc_id].append((r.start_token, r.tokens))
        assert max(fill.values()) <= capacity and set(pieces) == set(sizes)
        for doc, parts in pieces.items():
            parts.sort()
            assert sum(n for _, n in parts) == sizes[doc] and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
            assert len(parts) == max(1, -(-sizes[doc] // capacity))
        assert len(fill) <= 1.1 * sum(sizes.values()) / capacity + 2
    assert 9002 not in sizes


def test_sainte_lague_against_a_heap(spark):
    rng = random.Random(6)
    rows = [(p, f"k{i:02d}", float(rng.randint(0, 500)), seats) for p, seats in (("a", 7), ("b", 100), ("c", 3), ("d", 0)) for i in range(12)]
    got = {(r.part, r.key): r.quota for r in mixing.sainte_lague(spark.createDataFrame(rows, "part string, key string, votes double, seats int"), "part", "key", "votes", "seats").collect()}
    for p, seats in (("a", 7), ("b", 100), ("c", 3), ("d", 0)):
        votes, won = {k: v for q, k, v, _ in rows if q == p and v}, defaultdict(int)
        for _ in range(seats):
            best = min(votes, key=lambda k: (-votes[k] / (2 * won[k] + 1), k))
            won[best] += 1
        assert {k: got[p, k] for k in votes} == {k: won[k] for k in votes}


def test_mixture_keeps_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 60)
    docs = spark.createDataFrame([(i, "word " * (5 + i % 30), ["A", " a", "b", "c", None][i % 5]) for i in range(1000)], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 2), ("d", 0.2, 3)], "source string, target_share double, max_repeats int")
    got = mixing.mixture(docs, goal)
    assert {r.source: r["max(uses)"] for r in got.groupBy("source").agg({"uses": "max"}).collect()}["b"] <= 2
    shares = {r.source: r.share for r in mixing.reached_shares(got, goal).collect()}
    assert shares["d"] == 0 and abs(shares["a"] - 0.625) < 0.03 and abs(shares["b"] - 0.375) < 0.03
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mixture(docs.repartition(7), goal).collect()))


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    k, n = len(langs.LANGUAGES), 3
    scores, moves, border = rng.normal(size=(1, n, k)), rng.normal(size=(2, k, k)), np.array([[1, 0, 1]])
    total, ahead, back = crf.forward_backward(scores, border, np.array([n]), moves)
    weight = {}
    for a in range(k):
        for b in range(k):
            for c in range(k):
                weight[a, b, c] = np.exp(scores[0, 0, a] + moves[0, a, b] + scores[0, 1, b] + moves[1, b, c] + scores[0, 2, c])
    z = sum(weight.values())
    assert np.isclose(total[0], np.log(z))
    for b in range(k):
        assert np.isclose(np.exp(ahead[0, 1, b] + back[0, 1, b] - total[0]), sum(w for (_, y, _), w in weight.items() if y == b) / z)


def test_languages_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.train_model(docs.where("doc_id % 2 = 0"), 600)
    held = docs.where("doc_id % 2 = 1").select("doc_id", "text", "lang")
    one = languages.document_segments(held, model).where("n_segments = 1").join(held.select("doc_id", F.col("lang").alias("tag"), "text"), "doc_id").collect()
    sure = [(r.lang, guess[0]) for r in one if (guess := langs.guess(r.text))[1] >= 8]
    assert len(sure) > 200 and sum(a == b for a, b in sure) / len(sure) > 0.97
    mixed = spark.createDataFrame([(1, "I would buy this again without thinking twice. Die Schleife ist leider schon nach einer Woche kaputt gegangen.", "en"), (2, "10/10 !!!", None), (3, "The delivery was on time and the box was intact.", "EN_gb"), (4, "El paquete llegó antes y no faltaba nada.", "ja")], "doc_id bigint, text string, lang string")
    got = {(r.doc_id, r.seg_no): r.lang for r in languages.mislabelled(mixed, model).collect()}
    assert got == {(1, 0): "en", (1, 1): "de", (4, 0): "es"}
