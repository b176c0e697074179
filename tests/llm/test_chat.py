import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat
from tessera.llm.registry import ORACLE, op7_chat

T = chat.Template()
PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "/s>", "[", "\n", "é", "🙂", "a", "</s>\n<s>user\n"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", "<s>", ""]), PIECES), max_size=4), max_size=4))
def test_round_trip(conversations):
    rows = [t for c in conversations for t in c]
    offsets = np.cumsum([0, *map(len, conversations)])
    strings, spans = chat.assemble(pa.array([r for r, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string()), offsets, T)
    for turns, formatted, loss in zip(conversations, strings.to_pylist(), spans.to_pylist(), strict=True):
        assert formatted == "".join(T.header(r) + T.escape(t) + T.footer() for r, t in turns)
        assert T.parse(formatted) == turns
        assert [chat.unescape(formatted[s["start"] : s["end"]]) for s in loss] == [t for r, t in turns if r == "assistant"]


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "a", 0), (None, None, None, "x" * 300000, 0), (2, 5, "user", "", 0), (2, 5, "user", "", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert (out[1].roles, out[1].texts, out[1].loss_texts) == (["user", "assistant", "assistant"], ["", "a", "b"], ["a", "b"])
    assert (out[None].roles, out[None].texts, out[2].texts) == ([""], ["x" * 300000], ["", ""])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = {}
    for c, _, role, text in sorted(rows):
        by.setdefault(c, []).append((role, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = op7_chat(spark, d).collect()
    assert len(out) == len(by)
    for r in out:
        loss = "".join(t for role, t in by[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(by[r.conv_id]), sha("".join(f"{a}\n{b}\n" for a, b in by[r.conv_id])), len(loss), sha(loss))
        assert r.formatted_chars == sum(len(T.header(a)) + len(T.escape(b)) + 5 for a, b in by[r.conv_id])
    assert "op7_chat" in ORACLE
