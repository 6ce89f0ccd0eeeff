from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import functions as F

from tidefold.llm import chat, queries

HARD = ["\\### Assistant: </turn> ok", "<next/>", "</turn>\n", "\\", "\\b", "\\h\\t\\m", "### a: b", "", None, "é\U0001f600 x", "#" * 9, "</turn", "a\nb"]
ROLES = ["user", "assistant", "system", None, "", "a: b", "### x", "\\z"]


def make(spark):
    rows = [(k, i, ROLES[(k * 3 + i * i) % len(ROLES)], HARD[(k + i * 5) % len(HARD)], "x") for k in range(12) for i in range(k)]
    rows += [(50, 1, "assistant", "same", "x")] * 3 + [(51, None, "user", "q", "x"), (None, 0, "assistant", "lost", "x")]
    rows += [(60, i, "assistant" if i % 2 else "user", HARD[i % len(HARD)], "x") for i in range(300)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_format_reads_back_and_masks(spark):
    rows, df = make(spark)
    out = chat.format_chat(df).select("conv_id", "formatted", "loss_spans", chat.parse_chat().alias("turns"), chat.loss_text().alias("loss")).collect()
    by = {k: list(g) for k, g in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)), key=lambda r: r[0])}
    assert {r.conv_id for r in out} == set(by)
    for r in out:
        want = [(t[2], t[3] or "") for t in by[r.conv_id]]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in want)
        assert r.formatted.count(chat.END) == sum(a[0] != b[0] for a, b in itertools.pairwise([(object(),), *want]))


def test_no_rows_no_conversations(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark, tmp_path):
    make(spark)[1].where("turn is not null").select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op1_chat_format(spark, str(tmp_path)).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert got.n_turns == 2 and got.loss_chars == len(text)
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_escape_round_trip(spark):
    texts = ["".join(p) for n in range(4) for p in itertools.product(["\\", "b", "h", "###", "</turn>", "<next/>", ":"], repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t"), chat.ROLE_CODES).alias("e"))
    bad = df.where((chat.unescape(F.col("e"), chat.ROLE_CODES) != F.col("t")) | F.col("e").contains("###") | F.col("e").contains("</turn>") | F.col("e").contains(":"))
    assert bad.count() == 0


def test_ties_go_by_plain_text(spark):
    rows = [(1, 0, "user", "Zed"), (1, 0, "user", "### x"), (1, 0, None, "y"), (1, None, "b", "c"), (1, 0, "user", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chat(df).select(chat.parse_chat().alias("t")).first().t
    assert [(t.role, t.text) for t in got] == [("b", "c"), (None, "y"), ("user", "### x"), ("user", "Zed"), ("user", "\\")]
