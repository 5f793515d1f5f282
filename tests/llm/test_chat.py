from pyspark.sql import functions as F

from plumbline.llm import chat


def test_turns_survive_control_strings_merging_and_nulls(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s> <<s>> <m/><r/>", "[\\INST]\\", "", "<", "plain\n</s", "é<|im_end|>" * 3]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "assistant", "user", "user", "sys<r/>\ntem", "assistant"], nasty))]
    rows += [(2, 0, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (None, 0, "user", "free")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_conversations(df).withColumn("turns", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[:7]]
    assert got[1].loss == "".join(t for _, _, r, t in rows[:7] if r == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", "x"), ("assistant", "x")]
    assert got[2].formatted == "<s><r/></s><s>assistant<r/>x<m/>x</s>"
    assert got[None].loss == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).count() == 0
