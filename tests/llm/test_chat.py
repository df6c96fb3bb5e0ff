import hashlib
import random
import re

import pytest

from scholarlake.llm import chat, queries
from tests.oracle import compare, duck


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_escapes_are_reversible_and_hide_controls():
    t = chat.TEMPLATE
    armour, control = t.armour(), re.compile("|".join(map(re.escape, t.controls)))
    rnd = random.Random(2)
    bits = [*t.controls, "\\", "<", "[", "s>", "INST]", "/", "<<", "x", "SYS>>", ">>", "]"]
    for _ in range(5000):
        s = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
        e = chat.escaped(s, t, armour)
        assert chat.unescaped(e, t, armour) == s
        assert [m[0] for m in control.finditer(f"[INST]{e}[/INST]")] == ["[INST]", "[/INST]"]


def test_query_matches_sql(spark, sf_dir):
    compare(queries.op1_chat_formatting(spark, sf_dir), queries.SQL["op1_chat_formatting"], duck(sf_dir))


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a<s>b"), (1, 1, "assistant", "a<s>b"), (2, None, None, "x"), (3, 5, "tool", "[TEXT]"), (None, 0, "user", "hi")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\n" + "assistant\na<s>b\n" * 2)
    assert got[1].loss_chars == 10 and got[1].loss_sha256 == sha("a<s>b" * 2) and not got[1].valid
    assert got[2].turns_sha256 == sha("\nx\n") and got[3].turns_sha256 == sha("tool\n[TEXT]\n")
    assert got[None].n_turns == 1 and got[None].valid


def test_no_turns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).count() == 0


def test_overlapping_controls_are_refused():
    with pytest.raises(ValueError):
        chat.Template(before={"user": "<a"}, after={"user": "a<"}, loss=frozenset(), follows={})
