from pyspark.sql import functions as F

from sparkgrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def rendered(turns, view):
    out, spans = "", []
    order = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, "unknown" if t[2] is None else t[2], t[3] or ""))
    for _, _, role, text in order:
        role = "unknown" if role is None else role
        head = "<|assistant|>\n" if role == view else f"<|user:{role}|>\n"
        spans.append((len(out), int(role == view)))
        out += head + (text or "") + chat.END
    return out, spans


def check(spark, turns):
    rows = chat.rotate(spark.createDataFrame(turns, SCHEMA)).collect()
    want = {}
    for conv in {t[0] for t in turns}:
        mine = [t for t in turns if t[0] == conv]
        for view in {"unknown" if t[2] is None else t[2] for t in mine}:
            want[conv, view] = rendered(mine, view)
    got = {}
    for key in want:
        parts = sorted((r for r in rows if (r["conv_id"], r["perspective"]) == key), key=lambda r: r["seq"])
        assert [r["seq"] for r in parts] == list(range(1, len(parts) + 1))
        got[key] = "".join(r["rendered"] for r in parts), [(r["begin_char"], r["mask"]) for r in parts]
    assert got == want and len(rows) == sum(len(s) for _, s in want.values())


def test_perspectives(spark):
    check(spark, [(1, 0, "ann", "hi"), (1, 1, "bob", "é \U0001f600"), (1, 2, "cy", "all"), (1, 3, "ann", "bye"), (2, 0, "ann", "alone")])


def test_odd_rows(spark):
    turns = [(1, 0, None, "x"), (1, None, "a", None), (None, 3, "a", "y"), (None, 3, "b", ""), (1, 0, "a", "t"), (1, 0, "a", "t"), (1, 0, "a", "s"), (5, 1, "", "w" * 100_000)]
    check(spark, turns)
    frame = spark.createDataFrame(turns, SCHEMA).withColumns({"seq": F.lit("mine"), "perspective": F.lit("p"), "_conv": F.lit(1)})
    assert chat.rotate(frame).count() == chat.rotate(frame.drop("seq", "perspective", "_conv")).count()
    assert chat.rotate(frame.limit(0)).count() == 0


def test_one_hot_dialogue(spark):
    check(spark, [(1, k % 50, "ab"[k % 2], f"t{k}") for k in range(400)])


def test_ties_go_by_text(spark):
    long = "x" * 300
    turns = [(k % 2, 0, "a", long + t) for k, t in enumerate(["b", "é", "a", "", "b", "zz"])] + [(None, None, "a", t) for t in ("q", "p", None)] + [(0, 1, "b", "end")]
    check(spark, turns)
