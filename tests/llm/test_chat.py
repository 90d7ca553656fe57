import hashlib
import random

from pyspark.sql import functions as F

from quotelock.llm.chat import ChatTemplate, format_chats, read_loss, read_turns


def read_back(turns):
    formatted = format_chats(turns)
    rows = formatted.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("pieces")).alias("loss")
    ).collect()
    return {row["conv_id"]: row for row in rows}


def test_round_trip_of_texts_that_look_like_marks(spark):
    random.seed(4)
    parts = [*ChatTemplate().marks, "\\", "[", "<", "é\n", "a", ""]
    rows = []
    for conv in range(60):
        for turn in range(random.randrange(1, 7)):
            role = random.choice(["user", "assistant", "assistant", "system", "tool [TEXT]", ""])
            rows.append((conv, turn, role, "".join(random.choices(parts, k=random.randrange(6)))))
    got = read_back(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    for conv, row in got.items():
        own = [(role, text) for c, _, role, text in rows if c == conv]
        assert [(turn["role"], turn["text"]) for turn in row["turns"]] == own
        assert row["loss"] == "".join(text for role, text in own if role == "assistant")


def test_adjacent_turns_of_one_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 2, "assistant", "c"), (1, 1, "user", "b")]
    got = read_back(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert got[1]["formatted"] == "[INST]a[NEXT]b[/INST]<s>c</s>"


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "a"),
        (1, None, None, None),
        (1, 0, "user", "b"),
        (1, 0, "user", "b"),
        (2, 0, "assistant", "x" * 100_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = read_back(turns.withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(1)))
    assert [tuple(turn) for turn in got[1]["turns"]] == [("", ""), ("user", "b"), ("user", "b")]
    assert [tuple(turn) for turn in got[None]["turns"]] == [("user", "a")]
    assert len(got[2]["loss"]) == 100_000
    assert read_back(turns.where("conv_id = 9")) == {}


def test_plan_has_no_python(spark, folder):
    from quotelock.llm.queries import op1

    result = op1.build(spark, folder)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    probe = result.where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert probe["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert probe["n_turns"] == 2 and probe["loss_chars"] == len(text)
