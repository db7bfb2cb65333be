import hashlib
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from portcullis.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def want(rows):
    """rows: (conv_id, turn, role, text)"""
    first = lambda x: (x is not None, x)  # noqa: E731  nulls first
    by = {}
    for r in sorted(rows, key=lambda r: tuple(map(first, r))):
        by.setdefault(r[0], []).append(r)
    out = Counter()
    for conv, turns in by.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        escaped = lambda s: sum(2 if c in "<[]\\" else 1 for c in s or "")
        chars = sum(len("<s>[]\n</s>\n") + escaped(r) + escaped(t) for _, _, r, t in turns)
        out[(conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)] += 1
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return Counter(tuple(r) for r in C.read_back(C.format_chats(df)).collect())


ROWS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\<\\[<s>]\\\\"), (1, 1, "assistant", "again </s>\n"), (1, None, None, None),
    (2, 0, "ass]istant", "<s>[assistant]\nx"), (2, 1, "assistant", ""), (None, 3, "assistant", "é\U0001f600"), (3, 0, "system", "a" * 100_000), (-7, 0, "user", "x"),
]


def test_digests_match_brute_force(spark):
    assert run(spark, ROWS) == want(ROWS)
    assert run(spark, []) == Counter()


def test_a_conversation_over_many_batches_is_read_as_one(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(5, i, ("user", "assistant")[i % 2], f"turn {i} [x]") for i in range(50)] + ROWS
        assert run(spark, rows) == want(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<>[]\\/s\nINST|é", max_size=8), st.text(alphabet="<>[]\\/s\nINST|é", max_size=30)), min_size=1, max_size=5))
def test_no_control_string_stands_in_an_escaped_text(turns):
    out, start, at, n = C.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    whole = out.tobytes()
    assert whole.count(b"<s>[") == whole.count(b"</s>") == len(turns)
    for (role, text), a, b, i, k in zip(turns, start, start[1:], at, n, strict=False):
        assert C.unescape(whole[i : i + k]) == text.encode()
        assert whole[a:b].endswith(b"</s>\n")
        assert not any(x in whole[i : i + k] for x in (b"<s>", b"</s>", b"[INST]", b"[/INST]"))
        assert C.unescape(whole[a + 4 :].partition(b"]\n")[0]) == role.encode()
