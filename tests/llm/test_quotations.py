from veilcell.llm import quotations as qt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, position string, thread int"


def run(spark, ws, rows):
    return qt.conversations(ws, spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)).collect()


def test_nested_quotes_build_threads(spark, ws):
    rows = [
        (1, 0, "a", "Where is the key?\nI looked everywhere."),
        (1, 1, "b", "Different topic: lunch at noon?"),
        (1, 2, "c", "On Monday Ann wrote:\n> Where is the  KEY\n> i looked everywhere!\n\nUnder the mat."),
        (1, 3, "a", ">> Where is the key?\n> Under the mat.\nThanks, found it."),
        (1, 4, "d", "> Different topic: lunch at noon?\nYes."),
        (1, 5, "d", "> never said by anyone\nno link here"),
        (2, 0, "x", "> Under the mat.\nother conversation"),
    ]
    got = {(r.conv_id, r.turn): r for r in run(spark, ws, rows)}
    assert {k: (r.reply_to, r.thread, r.depth, r.position) for k, r in got.items()} == {
        (1, 0): (None, 0, 0, 0), (1, 2): (0, 0, 1, 1), (1, 3): (2, 0, 2, 2), (1, 1): (None, 1, 0, 3), (1, 4): (1, 1, 1, 4), (1, 5): (None, 5, 0, 5),
        (2, 0): (None, 0, 0, 0)}
    assert got[1, 2].text == "Under the mat." and got[1, 3].text == "Thanks, found it."
    assert got[1, 4].formatted == "<|d|>\nYes.\n<|end|>\n"


def test_wrapped_quotes_are_linked_and_comparisons_stay(spark, ws):
    rows = [(1, 0, "a", "The meeting moves to Tuesday at ten because\nthe large room is taken all of Monday."), (1, 1, "b", "x>5 holds\nother words"),
            (1, 2, "c", "> The meeting moves to Tuesday\n> at ten because the large\n> room is taken all of Monday.\nFine."), (1, 3, "d", "Bob> x>5 holds\nWhy?")]
    got = {r.turn: r for r in run(spark, ws, rows)}
    assert {t: r.reply_to for t, r in got.items()} == {0: None, 1: None, 2: 0, 3: 1}
    assert got[1].text == "x>5 holds\nother words" and got[2].text == "Fine." and got[3].text == "Why?"


def test_long_reply_chain_and_common_lines(spark, ws):
    """A chain that quotes the message before, and one line that all messages of a large conversation share."""
    rows = [(1, i, "u", (f"> own words number {i - 1}\n" if i else "") + f"own words number {i}") for i in range(40)]
    rows += [(2, i, "u", f"> the common line\nthe common line\nown {i}") for i in range(300)]
    got = {(r.conv_id, r.turn): r for r in run(spark, ws, rows)}
    assert len(got) == len(rows)
    assert all(got[1, i].depth == i and got[1, i].thread == 0 and got[1, i].position == i for i in range(40))
    assert all(got[2, i].reply_to == (0 if i else None) and got[2, i].position == i for i in range(300))


def test_odd_rows(spark, ws):
    rows = [(None, None, None, None), (None, 1, None, ""), (3, None, "u", "> a"), (3, 1, None, "a"), (3, 1, None, "a"), (3, 2, "u", "> a\r\n> a\rb"), (4, 0, "u", ">" * 5000 + "x"),
            (5, 0, "u", "w" * 100_000)]
    got = run(spark, ws, rows)
    assert len(got) == len(rows)
    assert next(r for r in got if r.conv_id == 3 and r.turn == 2).reply_to == 1
    assert all(r.formatted.startswith("<|user|>") for r in got if r.role is None)
    assert run(spark, ws, []) == []


def test_query_keeps_all_messages(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    got = qt.op9_quotation_linking(spark, folder)
    assert got.count() == table.count()
    # Without quotations the order is that of the turns and the texts stay.
    assert got.join(table.withColumnRenamed("text", "before"), ["conv_id", "turn", "role"]).where("text <> trim(before) or position <> turn").count() == 0
