from tessera.llm import op6_chat


def formatted(spark, rows):
    return op6_chat.format_pairs(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string, part string"))


def test_longest_common_prefix(spark):
    rows = [(1, c, t, role, text, None) for c, talk in ((True, "abc"), (False, "abd")) for t, (role, text) in enumerate(zip(("user", "assistant", "assistant"), talk))]
    rows += [(1, False, 3, "user", "e", None), (2, True, 0, "user", "same", None), (2, False, 0, "user", "same", None), (3, False, 5, None, None, None), (None, True, 0, "user", "x", None), (4, True, None, "user", "x", None)]
    got = formatted(spark, rows)
    whole = {r["pair_id"]: r for r in op6_chat.assembled(got).collect()}
    assert whole[1]["prompt"] == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n" and whole[1]["chosen"] == "<|assistant|>\nc<|end|>\n"
    assert whole[1]["rejected"] == "<|assistant|>\nd<|end|>\n<|user|>\ne<|end|>\n" and whole[2]["chosen"] == whole[2]["rejected"] == ""
    assert whole[3]["rejected"] == "<||>\n<|end|>\n" and set(whole) == {1, 2, 3}
    loss = {(r["part"], r["turn"]): r["loss"] for r in got.where("pair_id = 1").collect()}
    assert loss == {("prompt", 0): False, ("prompt", 1): False, ("chosen", 2): True, ("rejected", 2): True, ("rejected", 3): False}


def test_repeated_turns(spark):
    rows = [(1, c, 0, "user", t, None) for c, ts in ((True, "ab"), (False, "ba")) for t in ts] + [(1, True, 1, "user", "a", None)] * 2 + [(1, False, 1, "user", "a", None)]
    got = {r["part"]: r["prompt_turns"] for r in formatted(spark, rows).collect()}
    assert got == {"prompt": 1, "chosen": 1, "rejected": 1}
    assert formatted(spark, []).count() == 0
