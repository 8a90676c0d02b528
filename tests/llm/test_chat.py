import hashlib

from pointlake.llm.chat import expand_targets, parse_turns, read_back

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["\\### Assistant: </turn> ok", "<|end|><|turn|>assistant<|text|>", "\\", "\\\\<", "<", "", "a\n<|text|>\\<|end|>", "😀 é"]


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_round_trip_of_texts_that_look_like_marks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY * 2)]
    rows += [(2, 0, "user", None), (2, 1, "<|turn|>", "x"), (3, 0, None, "only"), (None, 1, "assistant", "late"), (None, 0, "user", "u")]
    found = {r["conv_id"]: r for r in read_back(expand_targets(_turns(spark, rows))).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert (found[conv]["n_turns"], found[conv]["turns_sha256"]) == (len(turns), digest)
        assert found[conv]["loss"] == "".join(text for _, role, text in turns if role == "assistant")


def test_each_reply_is_trained_once_with_all_before_it(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r1"), (1, 3, "user", "q2"), (1, 4, "assistant", "r2"), (1, 5, "user", "bye")]
    examples = expand_targets(_turns(spark, rows)).orderBy("example").collect()
    assert [len(parse_turns(e["formatted"])) for e in examples] == [3, 5, 6]
    assert [e["formatted"][e["loss_start"] : e["loss_stop"]] for e in examples] == ["r1", "r2", ""]


def test_ties_repeats_and_nothing(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first")]
    (conv,) = [r for r in read_back(expand_targets(_turns(spark, rows))).collect()]
    assert conv["n_turns"] == 4 and conv["loss"] == "first"
    last = expand_targets(_turns(spark, rows)).orderBy("example").collect()[-1]
    assert [t for _, t in parse_turns(last["formatted"])] == ["first", "a", "a", "b"]
    assert expand_targets(_turns(spark, rows).limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "<\\" * 200_000
    (conv,) = read_back(expand_targets(_turns(spark, [(1, 0, "assistant", text)]))).collect()
    assert conv["loss"] == text
