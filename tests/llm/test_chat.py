from __future__ import annotations

import hashlib
import random

import pytest

from tallyframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, formatted int, n_turns string"


def brute(rows):
    """Per conversation the contract's figures, from the rows alone."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in (r[0], r[1], r[2] or "", r[3] or ""))):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        conv: (
            len(turns),
            sha("".join(f"{r}\n{t}\n" for r, t in turns)),
            sum(len(t) for r, t in turns if r == "assistant"),
            sha("".join(t for r, t in turns if r == "assistant")),
        )
        for conv, turns in out.items()
    }


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[", "<", "/", "\\[INST]", "[\\INST]", "ok", "ü中\U0001f600", "\n", " ", "INST]", "s>"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["system", "user", "assistant", "[INST]", "a\nb", "", None])
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))])
            rows.append((conv, turn, role, text))
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (3, None, "assistant", "first"), (4, 1, "user", "tie b"), (4, 1, "user", "tie a")]
    rows += rows[:9]  # repeated turns
    rows += [(70, t, "assistant", f"{t} long [INST]" * 4000) for t in range(90)]  # several pieces
    rows += [(71, 0, "assistant", "\\</s>" * 700_000)]  # one very long text
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "y") for r in rows], SCHEMA).repartition(5)


def test_report_against_brute_force(spark, talk):
    got = {r["conv_id"]: r for r in chat.chat_report(table(spark, talk)).collect()}
    want = brute([*talk, *chat.PROBE])
    assert got.keys() == want.keys()
    for conv, figures in want.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == figures, conv


def test_formatted_texts(spark, talk):
    rows = chat.formatted_conversations(table(spark, talk)).collect()
    t = chat.DEFAULT_TEMPLATE
    assert [r["piece"] for r in sorted((r for r in rows if r["conv_id"] == 70), key=lambda r: r["piece"])] == list(range(sum(r["conv_id"] == 70 for r in rows)))
    assert sum(r["conv_id"] == 70 for r in rows) > 1
    for r in rows:
        body = r["formatted"]
        assert body.startswith(t.begin) == (r["piece"] == 0)
        assert body.count(t.begin) == (r["piece"] == 0)
        assert all(body.count(c) == r["n_turns"] for c in (t.open, t.close, t.end))
        raw = body.encode()
        under = [chat.unescaped(raw[a:b].decode()) for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True)]
        assert under == [text for role, text in chat.turns_of(body) if role == "assistant"]


def test_read_back_of_scattered_pieces(spark, talk):
    whole = chat.formatted_conversations(table(spark, talk))
    key = lambda r: (r["conv_id"] is not None, r["conv_id"])
    assert sorted(chat.read_back(whole.repartition(7)).collect(), key=key) == sorted(chat.read_back(whole, arranged=True).collect(), key=key)


def test_empty_table(spark):
    none = table(spark, [(1, 0, "user", "x")]).where("conv_id > 5")
    assert chat.formatted_conversations(none).collect() == []
    assert [r["conv_id"] for r in chat.chat_report(none).collect()] == [-7]


def test_templates_that_would_not_come_back():
    for bad in ("x", "a\\b", "<a<b"):
        with pytest.raises(ValueError):
            chat.Template(begin=bad)


def test_other_template(spark, talk):
    template = chat.Template("@go!", "#turn ", "%text ", "~end ", ("user",))
    rows = chat.formatted_conversations(table(spark, talk), template)
    want = brute([(c, t, {"user": "assistant", "assistant": "user"}.get(r, r), x) for c, t, r, x in talk])
    got = {r["conv_id"]: r for r in chat.read_back(rows, template).collect()}
    assert all((got[c]["loss_chars"], got[c]["n_turns"]) == (want[c][2], want[c][0]) for c in want)
