import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.oracle import check_oracle
from tessera.llm import chat as C


def test_query_equals_sql(spark):
    check_oracle(spark, "op6_chat_format", SF_MID)


def test_every_layout_becomes_canonical_turns(spark):
    records = {
        1: {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": "x"},
        3: {"prompt": "q", "completion": "a"}, 4: {"prompt": "q", "response": "a", "metadata": {"k": 1}}, 5: {"question": "q", "answer": "a"},
        6: {"instruction": "q", "output": "a"}, 7: {"instruction": "q", "input": "i", "output": "a"}, 8: {"system": "s", "prompt": "q", "response": "a"},
        9: {"turn": 4, "role": "user", "text": None}, 10: {"messages": []}, 11: {"unknown": 1}, 12: [1], 13: {"instruction": "q", "input": "", "output": 5}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [(14, "{broken"), (15, None)], "conv_id long, record string")
    got = {}
    for r in C.canonical_turns(df).orderBy("conv_id", "turn", "sub").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    qa = [("user", "q"), ("assistant", "a")]
    assert got == {1: [("system", "s")] + qa, 2: qa, 3: qa, 4: qa, 5: qa, 6: qa, 7: [("user", "q\n\ni"), ("assistant", "a")], 8: [("system", "s")] + qa,
                   9: [("user", "")], 13: [("user", "q"), ("assistant", "5")]}
    counts = [(r.layout, r.n) for r in C.layouts(df).collect()]
    assert sum(n for name, n in counts if name) == 11 and sum(n for name, n in counts if name == "messages") == 2
    assert sum(n for name, n in counts if not name) == 4


def test_incomplete_and_odd_records(spark):
    m = lambda x: {"messages": x}
    ok = {"role": "user", "content": "x"}
    records = [json.dumps(r) for r in (
        m([ok, {"role": "assistant"}]), m([{"content": "only text"}, ok]), m(["a", "b"]), m([None]), m([ok, None]), m([ok, {}]), m([{"role": ["list"], "content": {"k": 1}}]),
        {"turn": "first", "role": "user", "text": "x"}, {"turn": 2.5, "role": "user", "text": "x"}, {"turn": 1 << 70, "role": "user", "text": "x"},
        {"turn": None, "role": "user", "text": "x"}, {"turn": True, "role": "user", "text": "x"}, m([{"role": "user", "content": "a\ud800b\U0001F600"}]), {"\ud800": 1})]
    records += ["[" * 100_000, '{"a":' * 100_000, json.dumps(m([ok]))[:-1]]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    got = {}
    for r in C.canonical_turns(df).orderBy("conv_id", "turn", "sub").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {0: [("user", "x"), ("assistant", "")], 1: [("", "only text"), ("user", "x")], 5: [("user", "x"), ("", "")],
                   10: [("user", "x")], 12: [("user", "a\ufffdb\U0001F600")]}
    counts = C.layouts(df).collect()
    assert sum(r.n for r in counts) == len(records) and sum(r.n for r in counts if r.fingerprint is None) == 3
    assert sum(r.n for r in counts if r.layout) == len(got)
    assert C.digests(C.format_turns(C.canonical_turns(df))).count() == len(got)


def test_round_trip_and_mask(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), k, rng.choice(["user", "assistant", "a: b\n#", "", None]),
             rng.choice([None, "", "".join(rng.choice("\\<#>/tur n\n:é😀") for _ in range(rng.randrange(40)))])) for k in range(400)]
    rows += [(None, 1, "assistant", "x" * 300_000), (None, 1, "assistant", "x" * 300_000), (3, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash")).withColumn("sub", F.lit(9))
    out = C.format_turns(C.canonical_turns(C.row_records(df)))
    found = [(r.conv_id, r.turn, *C.parse_turn(r.formatted)) for r in out.collect()]
    key = lambda x: repr(x)
    assert sorted(found, key=key) == sorted([(a, b, c or "", d or "") for a, b, c, d in rows], key=key)
    for r in out.collect():
        role, text = C.parse_turn(r.formatted)
        assert (r.loss_start is not None) == (role == "assistant")
        if role == "assistant":
            assert C.unescape(r.formatted[r.loss_start:r.loss_end]) == text
    d = {r.conv_id: r for r in C.digests(out).collect()}
    assert d[None].n_turns == 2 and d[None].loss_chars == 600_000 and len(d) == len({r[0] for r in rows})
    assert C.digests(out.where("false")).count() == 0


def test_other_text_is_refused():
    with pytest.raises(ValueError):
        C.parse_turn("### user: a </turn>\n### user: b </turn>\n")
