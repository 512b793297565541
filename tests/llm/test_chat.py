import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumentrack.llm import chat

D = "/root/testdata/sf0.01/conversations.parquet"
BITS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[ROLE", "=x]", "[/ROLE]", "\\", "<", "[", "]", "s>", "a", " ", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", ""]), BITS), BITS), max_size=5))
def test_round_trip(turns):
    rendered = "".join(chat.render(r, t) for r, t in turns)
    assert [x[:2] for x in chat.parse(rendered)] == turns
    assert all(chat._ESCAPED.sub(r"\1", rendered[lo:hi]) == t for _, t, lo, hi in chat.parse(rendered))


def test_parser_is_strict():
    for bad in ("x", "<s>[INST]a", "<s>[INST]a</s>", "<s>[INST]a<s>[ANS]b</s>[/INST]", "<s>[ANS]a</s> "):
        with pytest.raises(chat.ParseError):
            chat.parse(bad)


def test_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{D}'")
    got = sorted(map(tuple, chat.read_back(chat.format_chat(chat.with_probe(spark.read.parquet(D)))).collect()))
    assert got == sorted(duckdb.sql(chat.ORACLE_SQL).fetchall())


def test_edges(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}\\[") for t in range(500)] + [(None, 0, None, None), (2, None, "tool", ""), (2, None, "tool", ""), (3, 0, "assistant", "x" * 300000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS rendered")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:500]).encode()).hexdigest()
    assert got[1].n_turns == 500 and got[1].turns_sha256 == want and got[2].n_turns == 2 and got[3].loss_chars == 300000 and got[None].n_turns == 1
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in rows[:500] if r == "assistant").encode()).hexdigest()
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
