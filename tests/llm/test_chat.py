import hashlib
import random

from pyspark.sql import functions as F

from colscope.llm.chat import Codec, Template, format_chat, read_back

SCHEMA = "conv_id long, turn long, role string, text string, segment int, id string"


def test_any_text_reads_back():
    codec, pick = Codec(Template()), random.Random(9)
    pieces = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "<", ">", "[", " ", "\n", "a", "é😀"]
    for _ in range(2000):
        turns = [(pick.choice(["user", "assistant", "system", "tool", "", "a\nb", "other"]),
                  "".join(pick.choice(pieces) for _ in range(pick.randint(0, 12)))) for _ in range(pick.randint(0, 5))]
        turns = [(r.replace("\n", " "), t) for r, t in turns]
        formatted = "".join(s for r, t in turns for s, _ in codec.segments(r, t))
        assert codec.read(formatted) == turns


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi </s>"), (1, 0, "user", "a\\"), (2, 0, "user", "x"), (2, 1, "user", "y"), (3, 0, "system", "s"),
            (3, 1, "user", None), (3, 2, "assistant", "é😀"), (4, None, None, None), (None, 0, "user", "q"), (None, 1, "assistant", "r"),
            (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "assistant", "first"), (7, 0, "tool", "t [/ROLE]")]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], SCHEMA)
    found = {r.conv_id: r for r in read_back(format_chat(df)).collect()}
    assert len(found) == 8
    assert {k: (r.n_turns, r.loss_chars, r.n_system, r.well_formed) for k, r in found.items()} == {
        1: (2, 7, 0, True), 2: (2, 0, 0, False), 3: (3, 2, 1, True), 4: (1, 0, 0, False), None: (2, 1, 0, True),
        5: (2, 0, 0, False), 6: (1, 5, 0, False), 7: (1, 0, 0, False)}
    assert found[1].turns_sha256 == digest(["user\na\\\n", "assistant\nhi </s>\n"]) and found[1].loss_sha256 == digest(["hi </s>"])
    assert found[4].turns_sha256 == digest(["\n\n"]) and found[2].loss_sha256 == digest([])
    segments = format_chat(df)
    lengths = {r.conv_id: r.n for r in segments.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert lengths == {k: r.formatted_chars for k, r in found.items()}
    assert segments.filter("loss and role != 'assistant'").count() == 0


def test_turn_order_machine(spark):
    roles = ["system", "user", "assistant", "assistant", "user", "system", "user"]
    df = spark.createDataFrame([(1, i, r, "t", 0, "") for i, r in enumerate(roles)], SCHEMA)
    rows = format_chat(df).filter("segment % 3 = 1").orderBy("segment").collect()
    assert [r.in_order for r in rows] == [True, True, True, False, True, False, True]


def test_another_template_and_none(spark):
    template = Template(marks={"user": ("<u>", "</u>"), "assistant": ("<a>", "</a>"), "other": ("<o>", "</o>")}, loss=("user",))
    df = spark.createDataFrame([(1, 0, "user", "<a>"), (1, 1, "system", "x\ny")], "conv_id long, turn long, role string, text string")
    row = read_back(format_chat(df, template), template).first()
    assert row.loss_chars == 3 and row.turns_sha256 == digest(["user\n<a>\n", "system\nx\ny\n"])
    assert read_back(format_chat(df.limit(0))).count() == 0


def test_a_long_conversation_streams(spark):
    df = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                    F.concat(F.lit("t"), "id").alias("text"))
    row = read_back(format_chat(df)).first()
    assert row.n_turns == 30_000 and row.well_formed
    assert row.loss_sha256 == digest([f"t{i}" for i in range(1, 30_000, 2)])
