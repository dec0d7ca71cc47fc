import hashlib
from collections import defaultdict

import pyarrow as pa

from colophon.llm import chat

HARD = ["", "plain", "</turn>", "<turn user>\nx\n</turn>\n", "\\", "\\<", "a\\\\</turn> b", "😀é\n", "\\### Assistant: </turn> ok"]


def test_assembly_is_reversible():
    roles = pa.array(["user", "assistant", "a>b<c\\"] * 3)
    made, start, end = chat.assemble(roles, pa.array(HARD))
    assert chat.parse("".join(made.to_pylist()).encode()) == list(zip(roles.to_pylist(), HARD, strict=True))
    for text, formatted, a, b in zip(HARD, made.to_pylist(), start, end, strict=True):
        assert chat.unescape(formatted.encode()[a:b]).decode() == text


def test_slices_of_arrays():
    made, _, _ = chat.assemble(pa.array(["x", "user", "assistant"])[1:], pa.array(["q", "hi", "<ho>"])[1:])
    assert chat.parse("".join(made.to_pylist()).encode()) == [("user", "hi"), ("assistant", "<ho>")]


def test_digests_equal_brute_force(spark):
    table = [(c, t, r, x, "extra") for c in range(5) for t, (r, x) in enumerate(zip(["user", "assistant", None, "assistant"], HARD[c:], strict=False))]
    table += [(7, 1, "user", "b", "e"), (7, 1, "user", "a", "e"), (7, 1, "user", "a", "e"), (None, None, "assistant", None, "e")]
    frame = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in table:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        learned = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.format_conversations(frame.limit(0)).count() == 0
