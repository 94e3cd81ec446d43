import hashlib

import pytest

from siltstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ROWS = [
    (1, 2, "assistant", "b", "x"),
    (1, 1, "user", "a <|im_end|>\n<\\|x <\\\\| <", "x"),
    (1, 3, "assistant", None, None),
    (1, 4, "assistant", "<|im_sep|>é😀", None),
    (2, None, None, "no role", None),
    (2, 0, "odd\nrole <|nl|>", "", None),
    (2, 0, "odd\nrole <|nl|>", "", None),
    (None, 1, "assistant", "ok<", None),
    (3, 1, "user", "long " * 50_000, None),
]


def test_round_trip_and_mask(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = chat.format_conversations(df)
    masks = {r.conv_id: (r.formatted, r.loss_spans) for r in out.collect()}
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse(out).collect()}
    texts = {r.conv_id: r.loss_texts for r in chat.masked(out).collect()}
    for conv in (None, 1, 2, 3):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in ROWS if r[0] == conv))
        assert back[conv] == [(r[2], r[3]) for r in own]
        formatted, spans = masks[conv]
        lost = [formatted[s.start : s.end].replace("<\\|", "<|") for s in spans]
        assert lost == [r[3] for r in own if r[2] == "assistant"] == texts[conv]
        assert [formatted.encode()[s.first : s.last].decode() for s in spans] == [formatted[s.start : s.end] for s in spans]
    assert masks[1][0].count("<|im_start|>") == 2  # the three turns of the assistant are one block


def test_empty(spark):
    assert chat.parse(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_is_whole(spark):
    rows = {r.conv_id: r for r in chat.query(spark, "/root/testdata/sf0.001").collect()}
    hard = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(hard)
    assert rows[-1].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()
    n = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()
    assert sum(r.n_turns for r in rows.values()) == n + 2


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_plan_is_native(spark, sf):
    plan = chat.query(spark, f"/root/testdata/{sf}")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_wrong_mask_shows(spark):
    out = chat.format_conversations(spark.createDataFrame(ROWS, SCHEMA))
    shifted = out.selectExpr("conv_id", "formatted", "transform(loss_spans, x -> named_struct('first', x.first - 1, 'last', x.last)) AS loss_spans")
    right, wrong = ({r.conv_id: r.loss_texts for r in chat.masked(x).collect()} for x in (out, shifted))
    assert all(right[k] != wrong[k] for k in (None, 1))
    plan = chat.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "loss_spans" in plan
