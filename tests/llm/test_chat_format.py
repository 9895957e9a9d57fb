"""Round trips through the template, budgets, loss masks, history."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat_format as chat

TURN = "conv_id bigint, turn bigint, role string, text string"
LOOKALIKE = r"\### Assistant: </turn> ok"


def rows() -> list[tuple]:
    out = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "system", "alone"), (3, 0, "user", None)]
    out += [(4, k, "assistant" if k % 2 else "user", f"word {k} " * (k % 40)) for k in range(700)]
    out += [(5, 0, "system", "s " * 30), *((5, k, "user" if k % 2 else "assistant", "long " * (400 if k % 9 == 0 else 20)) for k in range(1, 60))]
    out += [(-7, 0, "user", LOOKALIKE), (-7, 1, "assistant", LOOKALIKE), (6, 0, None, "### x:\n</turn>\n\\"), (6, 0, "a:b\n###", ""), (6, None, "assistant", "\\\\###")]
    out += [(7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (None, 0, "user", "nobody"), (None, None, None, None)]
    return out


def ordered() -> dict:
    by: dict = {}
    for c, t, r, x in rows():
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def turns(llm):
    return llm.createDataFrame(rows(), TURN).withColumns({c: F.lit(0) for c in ("place", "k", "seq", "tokens", "body")})


def test_read_back(llm):
    got = {r.conv_id: r for r in chat.read_back(chat.windows(turns(llm))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = ordered()
    assert got.keys() == want.keys()
    for name, said in want.items():
        loss = "".join(x for r, x in said if r == "assistant")
        r = got[name]
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{x}\n" for a, x in said))), name
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)), name


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (200, 40), (90, 10)])
def test_windows_keep_their_budget(llm, budget, history):
    made = chat.windows(turns(llm), budget, history).collect()
    alone = {len(said) for said in ordered().values()}
    assert alone
    for w in made:
        new = chat.read_turns(w.text)[w.repeated :]
        assert w.n_tokens <= budget or len(new) == 1 or w.conv_id == 5, (w.conv_id, w.n_tokens)
    for w in made:
        if w.conv_id == 5:
            assert w.text.startswith("### system:\ns s")
    firsts = {(w.conv_id, w.first_turn) for w in made}
    assert len(firsts) == len(made)


def test_history_repeats_the_turns_before(llm):
    said = ordered()[4]
    for w in chat.windows(turns(llm), 200, 40).where("conv_id = 4").collect():
        shown = chat.read_turns(w.text)
        begin = w.first_turn - w.repeated
        assert shown == said[begin : begin + len(shown)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="#\\</turn>:\n x", max_size=40))
def test_unescape_inverts(text):
    import re

    escaped = re.sub(chat._MARKED, lambda m: "\\" + m[0], text)
    assert chat.unescaped(escaped) == text
    assert chat.read_turns(f"### r:\n{escaped}\n</turn>\n") == [("r", text)]


def test_empty_table(llm):
    none = llm.createDataFrame([], TURN)
    assert chat.windows(none).count() == 0 and chat.read_back(chat.windows(none)).count() == 0
