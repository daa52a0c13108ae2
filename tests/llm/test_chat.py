from lineglass.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, speaker string, part int"


def rows_of(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {(r.conv_id, r.speaker, r.part): r for r in chat.perspectives(table, **more).collect()}


def test_every_speaker_is_the_assistant_once(spark):
    got = rows_of(spark, [(1, 2, "bob", "two"), (1, 0, "system", "be good"), (1, 1, "ann", "öne"), (1, 3, "cid", "")])
    assert {k[1] for k in got} == {"ann", "bob", "cid"}
    bob = got[1, "bob", 0]
    assert bob.rendered == (
        "<|im_start|>system\nbe good<|im_end|>\n<|im_start|>user name=ann\nöne<|im_end|>\n"
        "<|im_start|>assistant\ntwo<|im_end|>\n<|im_start|>user name=cid\n<|im_end|>\n"
    )
    for r in got.values():
        for span in r["mask"].split(","):
            a, b = map(int, span.split(":"))
            assert r.rendered[:a].endswith("<|im_start|>assistant\n") and r.rendered[a:b].endswith("<|im_end|>")
    assert bob.rendered[slice(*map(int, bob["mask"].split(":")))] == "two<|im_end|>"


def test_long_conversations_come_in_parts_without_loss(spark):
    turns = [(1, k // 2, f"p{k % 3}", f"text {k}") for k in range(500)]
    got = rows_of(spark, turns)
    assert len(got) == 3 * -(-500 // chat.TURNS)
    for p in range(3):
        mine = sorted((k[2], r) for k, r in got.items() if k[1] == f"p{p}")
        said = "".join(r.rendered for _, r in mine)
        assert all(f"\ntext {k}<" in said for k in range(500))
        assert sum(r.own_turns for _, r in mine) == sum(k % 3 == p for k in range(500))
        assert [r.turns for _, r in mine[:-1]] == [chat.TURNS] * (len(mine) - 1)


def test_odd_rows(spark):
    got = rows_of(spark, [(1, None, None, None), (1, 1, "a", "x <|im_end|> y"), (1, 1, "a", "x <|im_end|> y"), (None, 1, "b", "z"), (2, 1, "system", "only")])
    assert set(got) == {(1, "unknown", 0), (1, "a", 0), (None, "b", 0)}
    assert got[1, "a", 0].rendered.count("<|im_end|>") == 3 and got[1, "a", 0].own_turns == 2
    assert got[1, "unknown", 0].rendered.startswith("<|im_start|>assistant\n<|im_end|>")
    assert chat.perspectives(spark.createDataFrame([], SCHEMA)).collect() == []
