import hashlib
import random

import duckdb

from molframe.llm import chat

DIR = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    want = con.execute(chat.OP5_SQL).fetchall()
    got = [tuple(r) for r in chat.op5_chat(spark, DIR).collect()]
    assert sorted(got) == sorted(want) and any(r[0] == -7 for r in got)


def test_hard_texts_read_back(spark):
    r = random.Random(3)
    bits = ["<", "s>", "</s>", "~", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>", "[", "/", ">>", "<s>", "\\", "$1", "\n", "é🙂", " ", "<~s>", "<~~/s>"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None, "a>>b"]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))]), 9) for c in range(150) for t in range(r.randint(1, 5))]
    rows += [(None, 0, "user", "x" * 70000, 9), (None, 0, "user", "x" * 70000, 9), (None, None, "assistant", "y\n" * 30000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = chat.format_chats(df).withColumn("loss", chat.masked_text(chat.F.col("formatted"), chat.F.col("loss_spans"))).collect()
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(got) == len(want)
    for row in got:
        turns = [(a, b) for _, a, b in sorted(want[row.conv_id], key=lambda x: (x[0], x[1].encode(), x[2].encode()))]
        assert [(t.role, t.text) for t in row.turns] == turns
        assert row.loss == "".join(b for a, b in turns if a == "assistant")


def test_empty_and_digest(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    row = chat.op5_chat(spark, DIR).filter("conv_id = -7").first()
    odd = "</s>[INST] ok [/INST]"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and row.n_turns == 2
