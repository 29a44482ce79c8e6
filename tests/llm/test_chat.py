import hashlib

from voxmere.llm.chat import digest_chats, format_chats, read_chats

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_and_loss(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "back\\slash <\\| <|im_sep|>", "", None, "<<||>>", "\\", "a\nb\n", "<|nl|>", "<"]
    rows = [(k, t, ("user", "assistant")[(t // 2) % 2], x, "z") for k in range(3) for t, x in enumerate(odd[k:])]
    rows += [(9, 0, None, "no role", "z"), (9, 0, None, "no role", "z"), (9, None, "new\nline", "first", "z"), (None, 1, "assistant", "null id", "z")]
    chats = format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read_chats(chats).collect()}
    found = {r["conv_id"]: r for r in digest_chats(chats).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text, _ in rows if c == conv)
        assert back[conv] == [(role, text) for _, role, text in mine]
        learned = "".join(text for _, role, text in mine if role == "assistant")
        assert found[conv]["n_turns"] == len(mine)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_merges_neighbours(spark):
    rows = [(1, k, role, "t", "") for k, role in enumerate(["user", "user", "assistant", "user"])]
    (chat,) = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert chat["formatted"] == "<|im_start|>user\nt<|im_sep|>t<|im_end|>\n<|im_start|>assistant\nt<|im_end|>\n<|im_start|>user\nt<|im_end|>\n"


def test_empty(spark):
    assert digest_chats(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
