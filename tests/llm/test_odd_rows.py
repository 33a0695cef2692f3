"""Rows that are rare and once went wrong: wide ids beside nulls, very long runs, repeated windows, clashing and dotted names."""

import json
import random
import re
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlume.llm import decontam, neardup, phrasedup, queries, secrets, toolcalls
from gridlume.llm.scratch import Scratch

WIDE = 2**53 + 1


def test_wide_ids_beside_nulls_stay_what_they_are(spark):
    chats = spark.createDataFrame([(WIDE, WIDE + 2, "user", "a"), (None, None, "user", "b"), (-(2**63), 2**63 - 1, "assistant", None), (2**63 - 1, -(2**63), None, "c")], "conv_id long, turn long, role string, text string").coalesce(1)
    got = toolcalls.link_tool_calls(chats)
    assert {(r["conv_id"], r["turn"]) for r in got.collect()} == {(WIDE, WIDE + 2), (None, None), (-(2**63), 2**63 - 1), (2**63 - 1, -(2**63))}


JSON = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(), st.text(max_size=4)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=3), x, max_size=3)), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(JSON, st.sampled_from([None, 1, 2]))
def test_json_without_recursion_reads_and_writes_what_json_does(value, indent):
    """``repr`` compares, as NaN is not equal to itself."""
    for ascii_ in (True, False):
        text = json.dumps(value, indent=indent, ensure_ascii=ascii_)
        assert repr(toolcalls.read_nested(f" {text}\n")) == repr(json.loads(text))
    try:
        assert toolcalls._written(value) == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except ValueError:
        assert "null" in toolcalls._written(value)
    assert toolcalls._written({"k": [float("nan"), float("-inf"), {}, []], "a": {"z": 1, "b": "é"}}) == '{"a":{"b":"é","z":1},"k":[null,null,{},[]]}'


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet='{}[],:"a1-.e \\0nul', max_size=12))
def test_json_without_recursion_turns_away_what_json_does(text):
    for t in (text, f"[{text}]", '{"a":' + text + "}"):
        try:
            want = repr(json.loads(t))
        except ValueError:
            want = None
        try:
            got = repr(toolcalls.read_nested(t))
        except ValueError:
            got = None
        assert got == want, t


def test_calls_nested_to_any_depth(spark):
    """References below 50,000 brackets are found, checked and written; deep ids and broken deep texts have a result."""
    n = 50_000
    args = '{"a":' * n + '{"$ref":"c0"}' + "}" * n
    first = json.dumps({"tool_calls": [{"id": "c0", "name": "f", "arguments": {}}]})
    deep = '{"tool_calls":[{"id":"c1","name":"f","arguments":' + args + '},{"id":' + "[" * n + "]" * n + ',"name":"f","arguments":{"x":NaN}}]}'
    rows = [(1, 1, "assistant", first), (1, 0, "assistant", deep), (1, 2, "assistant", deep[:-1]), (1, 3, "tool", '{"tool_call_id":"c1","content":' + args + "}")]
    tools = {"f": {"type": "object", "properties": {"a": {"type": "object"}}}}
    got = toolcalls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools=tools).collect()
    by = {(r.turn, r.pos): r for r in got}
    assert len(got) == 7 and [by[x].kind for x in ((0, 1), (0, 2), (1, 1), (2, 0), (3, 0))] == ["call", "call", "call", "message", "result"]
    assert by[0, 1].status == "ok" and by[0, 1].order_turn == 1 and by[0, 1].json == '{"arguments":' + args + ',"id":"c1","name":"f"}'
    assert by[0, 2].call_id == "[" * n + "]" * n and by[0, 2].json.startswith('{"arguments":{"x":null},') and by[3, 0].linked_turn == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123/-_vx/7", max_size=24))
def test_both_forms_of_the_allowed_stretches_match_alike(text):
    for t in (text, f"a/{text}", f"{text}/examples/{text}"):
        assert [m.span() for m in re.finditer(secrets.ALLOW_PARTS, t)] == [m.span() for m in re.finditer(secrets._JVM_PARTS, t)]


def test_very_long_runs_of_a_pattern_end_well(spark):
    units = ["1-", "v1/", "1_2/", "a1", "examples/", "password=", "AKIA0", "x", "0f", "/", "sha256-", "1--2/", "aB3+"]
    rows = [(k, unit * 50_000) for k, unit in enumerate(units)] + [(100 + k, "token: " + unit * 20_000 + " end") for k, unit in enumerate(units)]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert set(got) == {i for i, _ in rows}


def test_words_of_samples_do_not_hide_what_stands_beside_them(spark):
    key = "q9Zr4KtW8vXp2LmN6sYd1BhJ3fGc5AeT7uRoQkVi"
    rows = [(0, key), (1, f"my_sample_{key}"), (2, f"{key[:30]}xxxx{key}"), (3, f"sha256-{key}{key}"), (4, "sha256-" + (key * 2)[:43] + "="), (5, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"), (6, "v1/2024/10/11/12/13/14/15/16")]
    found = {r["doc_id"]: [s["body"] for s in r["spans"]] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == [key] and found[1] and key in found[1][0] and found[2] == [key[:30], key] and found[3]
    assert found[4] == found[5] == found[6] == []


def test_the_least_id_is_no_null(spark):
    body = "".join(random.Random(5).choices("abcdefgh ", k=300))
    rows = [(-(2**63), "x" + body), (None, body), (-(2**63) + 1, "z" + body), (3, "no copy at all")]
    got = {r["doc_id"]: (r["n_removed"], r["n_bytes"]) for r in phrasedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: (0, 300), -(2**63): (300, 301), -(2**63) + 1: (300, 301), 3: (0, 14)}


NAMES = ["my.col", "_secret_spans", "_secret_dirty", "_nd_id", "_bad_id", "a b"]


def odd_frame(spark, rows):
    """Documents with columns that clash with helpers, a dotted name and a map."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumns({c: F.lit(7) for c in NAMES})


def test_stages_keep_columns_of_any_name_and_type(spark):
    rng = random.Random(2)
    body = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    docs = odd_frame(spark, [(1, body), (1, body), (2, body + " end"), (3, "password = hunter2hunter2hunter2"), (None, None), (4, "What is the sum of 12 apples and 30 pears in Paris today my dear friend?")])
    items = spark.createDataFrame([(1, "What is the sum of 5 apples and 8 pears in London today my dear friend?")], "item_id long, text string")
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.schema["m"].dataType == docs.schema["m"].dataType
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert {r["text"] for r in clean.where("doc_id = 3").collect()} == {"[SECRET]"}
    rest = decontam.without_contaminated(docs, items)
    assert rest.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in rest.collect()) == ["1", "1", "2", "3", "None"]
    assert {r["my.col"] for r in kept.unionByName(clean).unionByName(rest).collect()} == {7}


def test_repeated_windows_cost_what_they_are_long(spark):
    """An item of equal words against a page of equal words, several copies in a row, and with words of its own around."""
    item = " ".join(["word"] * 5000)
    mixed = " ".join(f"w{i} same same same same same same same same same" for i in range(60))
    copies = " ".join([mixed] * 6)
    docs = spark.createDataFrame([(1, "word " * 50_000), (2, f"begin {copies} end"), (3, f"{mixed[: len(mixed) // 3]}"), (4, "same " * 3000), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, mixed)], "item_id long, text string")
    began = time.time()
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(docs, items).collect()}
    assert time.time() - began < 60
    assert got[1, 1]["contaminated"] and got[2, 2]["contaminated"] and got[2, 2]["n_consistent"] == got[2, 2]["n_windows"]
    assert not got[3, 2]["contaminated"] if (3, 2) in got else True


def test_repeated_windows_of_numbers_stay_consistent(spark):
    """Slots repeat, too: the copy has other numbers, one for one; the other text mixes them."""
    item = " . ".join(f"take {n} from the box and put it back on the left" for n in (5, 6, 7, 8, 9))
    copy = " . ".join(f"take {n} from the box and put it back on the left" for n in (50, 60, 70, 80, 90))
    docs = spark.createDataFrame([(1, copy), (2, f"{copy} . {copy}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1]["contaminated"] and got[2]["contaminated"]


def test_stage_of_the_query_reads_ids_as_they_are(spark):
    docs = spark.createDataFrame([(WIDE, "password = abcdefghijkl"), (None, "x")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in secrets.secret_spans(docs).collect()} == {WIDE, None}
    assert "op2_tool_calls" in queries.QUERIES


def test_batches_of_a_written_table_are_bounded_and_the_session_keeps_its_limit(spark):
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 50, 1, 1)
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    before, store = spark.conf.get(name), Scratch(spark, "batches")
    assert [r.n for r in store.save(sizes, "some", batch_rows=20).collect()] == [20, 20, 10] and spark.conf.get(name) == before
    try:
        spark.conf.set(name, "15")
        assert max(r.n for r in store.save(sizes, "less", batch_rows=20).collect()) == 15 and spark.conf.get(name) == "15"
        spark.conf.set(name, "0")  # no limit
        assert max(r.n for r in store.save(sizes, "none", batch_rows=20).collect()) == 20
    finally:
        spark.conf.set(name, before)
