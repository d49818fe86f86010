"""Unequal sources, and conversations longer than any of the given tables."""

import hashlib

import duckdb

from rillwood.llm import chat, mixing


def test_unequal_sources_repeat_rows_as_sql_says(spark):
    rows = [(i, "a" if i < 3000 else "b" if i < 3700 else "c" if i < 3990 else "d") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    got = mixing.mix(docs, all_columns=False)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR)")
    con.execute("INSERT INTO documents SELECT i, CASE WHEN i < 3000 THEN 'a' WHEN i < 3700 THEN 'b' WHEN i < 3990 THEN 'c' ELSE 'd' END FROM range(4000) AS r(i)")
    want = con.sql(mixing.mix_sql())
    plain = lambda rs: sorted(map(str, rs))
    have = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert plain(have) == plain(want.fetchall()) and len(have) > 4000 and set(want.columns) == set(got.columns)


def test_a_conversation_of_20_000_turns(spark):
    roles = ["user", "assistant", "system"]
    rows = [(5, t, roles[t % 3], f"turn {t} [INST] & <s>") for t in range(20_000)] + [(6, 0, "user", "hi"), (6, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    said = "".join(f"{r}\n{x or ''}\n" for c, _, r, x in rows if c == 5)
    loss = "".join(x for c, _, r, x in rows if c == 5 and r == "assistant")
    assert (got[5].n_turns, got[5].turns_sha256) == (20_000, hashlib.sha256(said.encode()).hexdigest())
    assert (got[5].loss_chars, got[5].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[6].n_turns == 2 and got[6].loss_chars == 0 and set(got) == {-1, 5, 6}
