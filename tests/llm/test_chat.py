"""Chat formatting against a plain formatter, whole conversations and cut ones."""

import hashlib
import re

import duckdb
import pytest

from edgeframe.llm import chat

ODD = ["", "<|im_end|>\n", "<", "|x", "<\\|im_sep|>", "a\nb", "<\\\\|", "<<|", "<n>", "é<|\U0001f600"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, segment int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    out = []
    for c in range(6):
        for k in range(3 * c):
            role = ["user", "assistant", "assistant", None, "sys\n<n><|"][(k * (c + 1) // 2) % 5]
            out.append((c, k, role, ODD[(k + c) % len(ODD)], "x", 3))
    out += [(None, None, "assistant", None, None, None), (None, 1, "assistant", "ö", None, None)]
    out += [(3, 2, "user", "again", "x", 1)] * 2      # repeated rows and a tie of turns
    out += [(7, 0, "assistant", "long " * 50_000, "x", 1)]
    return out


def by_conversation(data):
    convs = {}
    for c, turn, role, text, *_ in data:
        convs.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}


def mark(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def formatted(turns):
    out, last = "", None
    for role, text in turns:
        if role == last:
            out += "<|im_sep|>"
        else:
            out += "<|im_end|>\n" * (last is not None) + "<|im_start|>" + mark(
                re.sub(r"<(\\*)n>", r"<\\\1n>", role).replace("\n", "<n>")) + "\n"
        out, last = out + mark(text), role
    return out + "<|im_end|>\n"


@pytest.mark.parametrize("segment", [chat.SEGMENT, 2, 3, 1])
def test_against_plain_formatter(spark, segment):
    want = by_conversation(rows())
    made = chat.format_chat(spark.createDataFrame(rows(), SCHEMA), segment=segment)
    whole, spans = {}, {}
    for r in sorted(made.collect(), key=lambda r: r.segment):
        for s in r.loss:
            spans.setdefault(r.conv, []).append(r.formatted[s.start:s.end])
        whole[r.conv] = whole.get(r.conv, "") + r.formatted
    assert whole == {c: formatted(t) for c, t in want.items()}
    assert {c: s for c, s in spans.items()} == {
        c: [mark(t) for r, t in turns if r == "assistant"] for c, turns in want.items()
        if any(r == "assistant" for r, _ in turns)}
    got = {r.conv: r for r in chat.digests(made).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (
            len(turns), len(learned), len(formatted(turns)))
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r.loss_sha256 == sha(learned)


def test_query_and_sql_agree_on_odd_rows(spark):
    data = rows()
    got = chat.op11(spark.createDataFrame(data, SCHEMA))
    names = got.columns
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in data])
    cur = con.execute(chat.SQL)
    order = [[c[0] for c in cur.description].index(n) for n in names]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(
        repr(tuple(r[k] for k in order)) for r in cur.fetchall())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_chat(empty).count() == 0
    assert [r.conv_id for r in chat.op11(empty).collect()] == [-1]
