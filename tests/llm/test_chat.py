import hashlib

from forumetry.llm import chat

from .helpers import TEXTS, store

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    said = "</s>[INST] ok [/INST]"
    convs = {}
    for conv, turn, role, text in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_op6(spark, sf, tmp_path):
    hard = [*(x for x in TEXTS), "\\", "\\l<[\\e\\\\b", "<|turn|>user<|text|>no<|end|>", "a\\<|end|>\n", "😀<s>"]
    rows = [(i // 4, i % 4, ("user", "assistant", "system", "<|end|>")[i % 4], x) for i, x in enumerate(hard)] + [(90, 1, "assistant", "x"), (90, 1, "assistant", "x"), (91, 0, None, None)]
    small = store(spark.createDataFrame(rows, SCHEMA), tmp_path, "conversations")
    for folder in (sf, small):
        real = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert {r.conv_id: tuple(r)[1:5] for r in chat.op6_chat_format(spark, folder).collect()} == expected(real)
    none = store(spark.createDataFrame([], SCHEMA), tmp_path / "none", "conversations")
    assert [r.conv_id for r in chat.op6_chat_format(spark, none).collect()] == [-7]


def test_no_control_string_survives(spark):
    df = spark.createDataFrame([("</s>[INST] ok [/INST]<|end|>",)], "t string").select(chat.escape(chat.F.col("t")).alias("e"))
    got = df.select("e", chat.unescape(chat.F.col("e")).alias("u")).first()
    assert not {"</s>", "[INST]", "<|end|>"} & {x for x in ("</s>", "[INST]", "<|end|>") if x in got.e}
    assert got.u == "</s>[INST] ok [/INST]<|end|>"


def test_reply_trees(spark):
    nodes = [
        ("t", 1, None, "user", "root", 1.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", -1.0), ("t", 4, 3, "user", "more", None),
        ("t", 5, 99, "user", "orphan", 0.0), ("u", 1, 2, "user", "cycle", 1.0), ("u", 2, 1, "user", "cycle", 1.0), ("v", 7, 7, "user", "self", 1.0), ("w", 1, None, "user", None, None),
    ]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): ([x.node for x in r.path], r.branch, r.score) for r in chat.ranked(chat.paths(df)).collect()}
    assert got == {("t", 2): ([1, 2], 1, 3.0), ("t", 4): ([1, 3, 4], 2, 0.0), ("t", 5): ([5], 3, 0.0), ("w", 1): ([1], 1, None)}


def test_deep_chains_and_null_trees(spark):
    nodes = [(None, k, k - 1 if k else None, "user", f"x{k}", float(k)) for k in range(130)] + [("", 0, None, "user", "other tree", 0.0), (None, None, 0, "user", "no id", 0.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): [x.node for x in r.path] for r in chat.paths(df).collect()}
    assert got == {(None, 129): list(range(130)), ("", 0): [0]}
    assert chat.paths(df.limit(0)).count() == 0


def test_best_branches_only(spark):
    nodes = [("t", 1, None, "user", "root", 1.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", -1.0), ("t", 4, 3, "user", "more", None), (None, 1, None, "user", "a", None)]
    nodes += [("many", k, 0 if k else None, "assistant" if k else "user", f"answer {k}", float(k % 97)) for k in range(400)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double").selectExpr("*", "1 AS leaf", "2 AS key", "3 AS path", "4 AS above")
    for best in (1, 3):
        want = {(r.tree, r.leaf): [tuple(x) for x in r.path] for r in chat.ranked(chat.paths(df)).where(f"branch <= {best}").collect()}
        got = {(r.tree, r.leaf): [tuple(x) for x in r.path] for r in chat.paths(df, best).collect()}
        assert got == want and {("many", 96), ("t", 2), (None, 1)} <= set(got)


def test_long_conversations_are_formatted_whole(spark):
    rows = [("t", k, k - 1 if k else None, "assistant" if k % 2 else "user", "<" * (k % 5) + "é" * (k % 7) + ("x" * 3_000_000 if k == 1500 else ""), None) for k in range(3001)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    row = chat.parsed(chat.formatted(chat.paths(df, 1))).first()
    assert [(x.role, x.text) for x in row.turns] == [(r, t) for _, _, _, r, t, _ in rows]
    assert "".join(row.learned) == "".join(t for _, _, _, r, t, _ in rows if r == "assistant")
