"""Views of conversations against a loop over turns."""

from quarterline.llm import perspectives as p

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "anna", "hi"), (1, 2, "ben", "hello anna"), (1, 3, "anna", ""), (1, 4, "cy", None),
    (2, 0, "user", "é" * 20000), (2, 700, "assistant", "yes"), (2, 701, "user", "again"), (2, 701, "user", "again"),
    (3, 0, "system", "alone"), (None, 0, "user", "no id"), (None, None, None, "nobody"),
]


def rendered(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            ((r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or "") for r in rows if r[0] == conv))
        for speaker in {t[2] for t in turns} - {"system"}:
            text, masks = "", []
            for _, _, role, words in turns:
                who = role if role == "system" else "assistant" if role == speaker else f"user name={role}"
                text += f"<|im_start|>{who}\n"
                if role == speaker:
                    masks.append((len(text), len(text) + len(words) + len("<|im_end|>")))
                text += f"{words}<|im_end|>\n"
            found[conv, speaker] = (text, masks)
    return found


def collected(df):
    views = {}
    for r in sorted(df.collect(), key=lambda r: r["position"]):
        text, masks = views.setdefault((r["conv_id"], r["speaker"]), ("", []))
        assert r["start"] == len(text) and r["length"] == len(r["segment"])
        if r["mask_start"] is not None:
            masks.append((r["mask_start"], r["mask_end"]))
        views[r["conv_id"], r["speaker"]] = (text + r["segment"], masks)
    return views


def test_views_equal_a_loop(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "5 AS speaker", "6 AS block")
    assert collected(p.views(df)) == rendered(ROWS)
    monkeypatch.setattr(p, "BLOCK", 2)
    assert collected(p.views(df)) == rendered(ROWS)
    assert p.views(df.filter("false")).collect() == []


def test_no_python(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    assert "Python" not in p.views(df)._jdf.queryExecution().executedPlan().toString()
