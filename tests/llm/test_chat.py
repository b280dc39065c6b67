import hashlib

from pyspark.sql import functions as F

from risklake.llm import chat

TURN = "conv_id long, turn long, role string, text string"


def read(spark, rows, **extra):
    turns = spark.createDataFrame(rows, TURN)
    for name, value in extra.items():
        turns = turns.withColumn(name, F.lit(value))
    examples = chat.prefix_examples(turns)
    return examples, {r["conv_id"]: r for r in chat.digests(examples).collect()}


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip_with_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", r"[\INST] [\\ROLE] <\s>", "", "plain [INST", "[/ROLE][ROLE]</s", "\\", "<s></s>\n\U0001f600é"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "system", "odd [ROLE] name"))]
    examples, got = read(spark, rows)
    turns = [(r, t) for _, _, r, t in rows]
    assert got[1]["turns_sha256"] == digest(turns) and got[1]["n_turns"] == len(turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    assert got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[1]["loss_chars"] == len(loss)
    assert got[1]["n_examples"] == len(texts)
    one = examples.filter("example_no = 0").first()
    assert one["formatted"].startswith("[INST]<\\/s>[\\INST]") and one["formatted"].endswith("</s>")


def test_each_reply_has_all_turns_before_it(spark):
    examples, got = read(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "left")])
    said = [(r["formatted"], r["loss_start"], r["loss_length"]) for r in examples.orderBy("example_no").collect()]
    assert [f for f, _, _ in said] == ["[INST]q[/INST]<s>a</s>", "[INST]q[/INST]<s>a</s>[INST]r[/INST]<s>b</s>", "[INST]q[/INST]<s>a</s>[INST]r[/INST]<s>b</s>[INST]left[/INST]"]
    assert [f[s : s + n] for f, s, n in said[:2]] == ["a", "b"] and said[2][1:] == (None, None)
    assert got[1]["formatted_chars"] == sum(len(f) for f, _, _ in said)


def test_nulls_ties_repeats_and_no_reply(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (2, 0, "user", "x"), (2, 0, "user", "x"), (2, 0, "assistant", "y"), (None, 0, "user", "z")]
    _, got = read(spark, rows, formatted="clash", pieces=1)
    assert got[1]["turns_sha256"] == digest([("", ""), ("user", "")]) and got[1]["n_examples"] == 0 and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == digest([("assistant", "y"), ("user", "x"), ("user", "x")])
    assert got[None]["n_turns"] == 1
    assert read(spark, [])[1] == {}


def test_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 50) for k in range(200)]
    _, got = read(spark, rows)
    assert got[1]["n_turns"] == 200 and got[1]["turns_sha256"] == digest([(r, t) for _, _, r, t in rows])
