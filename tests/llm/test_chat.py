import hashlib
import random

import pytest
from quarrysift.llm import chat as C

DDL = "conv_id long, turn long, role string, text string, part int, formatted string"


def slow(rows):
    """conv -> turns in order, straight from the rows."""
    out = {}
    key = lambda r: tuple((x is not None, x) for x in r[1:4])
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|im_end|>\n", "\\", "\n", "é", "😀", "ok ", "<", "|", "assistant"]
    text = lambda n: "".join(rnd.choice(bits) for _ in range(rnd.randrange(n)))
    out = [(c, t, rnd.choice(["user", "assistant", "system"]), text(12)) for c in range(200) for t in range(rnd.randrange(1, 7))]
    out += [(c, 3, "user", "tie") for c in range(0, 200, 20)] * 2
    out += [(500, t, "assistant" if t % 2 else "we\nird\\n<|im_end|>", text(40)) for t in range(5000)]
    out += [(None, 1, "assistant", "x"), (None, None, None, None), (501, 0, "user", None), (501, None, "assistant", ""), (502, 0, "assistant", "y" * 300_000)]
    return out


@pytest.mark.parametrize("part_bytes", [C.PART_BYTES, 20_000])
def test_round_trip_and_mask(spark, rows, part_bytes):
    df = spark.createDataFrame([(*r, 7, "f") for r in rows], DDL)
    out = C.format_chats(df, part_bytes=part_bytes)
    got, masks, sizes = {}, {}, {}
    for r in out.collect():
        assert r.part == sizes.get(r.conv_id, 0)
        sizes[r.conv_id] = r.part + 1
        got.setdefault(r.conv_id, []).extend(C.read_back(r.formatted))
        masks.setdefault(r.conv_id, []).extend(C.unescape_text(r.formatted[s.start : s.end]) for s in r.loss_spans)
        assert r.n_turns == len(C.read_back(r.formatted))
    want = slow(rows)
    assert got == want
    assert masks == {c: [t for role, t in v if role == "assistant"] for c, v in want.items()}
    assert (max(sizes.values()) > 1) == (part_bytes < C.PART_BYTES)
    digests = out.mapInArrow(C._digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()
    assert len(digests) == len(want)
    for d in digests:
        v = want[d.conv_id]
        loss = "".join(t for role, t in v if role == "assistant")
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in v).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(v), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    assert C.format_chats(spark.createDataFrame([], DDL)).count() == 0
