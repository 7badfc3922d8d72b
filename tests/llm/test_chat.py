"""The stream against a plain prefix tree, and the texts against what went in."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from firmweave.llm import chat
from tests.llm.samples import SF, collected

SCHEMA = "conv_id long, turn long, role string, text string, node string, place long, path string"
CONTROL = "</s>[INST] ok [/INST]"


def escape(text):
    text = text.replace("\\", "\\\\")
    for c in chat.CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def conversations(rows):
    """conv_id -> its turns (role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    return {
        c: [(r, t) for *_, r, t in sorted(turns, key=lambda x: (x[0], x[1], x[2].encode(), digest(*x[2:])))]
        for c, turns in out.items()
    }


def plain(rows):
    out = []
    for conv, turns in conversations(rows).items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        learnt = "".join(t for r, t in turns if r == "assistant")
        marked = "".join(chat.TURN + escape(r) + chat.SEP + escape(t) + chat.END for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt),
                    hashlib.sha256(learnt.encode()).hexdigest(), len(marked)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "p") for r in rows], SCHEMA)


def check(spark, rows, parts=3):
    made = chat.format_conversations(frame(spark, rows).repartition(parts))
    assert collected(chat.read_back(made)) == plain(rows)
    segments = sorted(chat.with_tokens(made.segments).collect(), key=lambda r: r.start)
    # every prefix is one segment
    prefixes = {}
    for conv, turns in conversations(rows).items():
        for k in range(len(turns)):
            prefixes.setdefault(tuple(turns[:k + 1]), set()).add(conv)
    assert len(segments) == len(prefixes)
    assert sorted(r.conversations for r in segments) == sorted(map(len, prefixes.values()))
    stream, known, stack = "", {}, []
    for r in segments:
        assert r.start == len(stream) and r.length == len(r.text)
        stream += r.text
        # depth first: the parent is the newest segment that is one turn shorter
        stack = stack[:r.depth]
        assert len(stack) == r.depth and r.parent_id == (stack[-1] if stack else None)
        stack.append(r.node_id)
        known[bytes(r.node_id)] = r
    for r in segments:
        seen = "".join(stream[a["from"]:a["to"]] for a in r.attention)
        above, at = [], r
        while at is not None:
            above.append(at.text)
            at = known[bytes(at.parent_id)] if at.parent_id else None
        assert seen == "".join(reversed(above))
        assert r.position_ids == list(range(len(seen) - r.length, len(seen)))
        assert all(x["to"] < y["from"] for x, y in zip(r.ancestors, r.ancestors[1:]))
        assert (r.loss_from is not None) == r.text.startswith(chat.TURN + "assistant" + chat.SEP)


def test_shared_turns(spark):
    """A first turn that half of the conversations share, exact copies, prefixes, deep branches."""
    rng = random.Random(1)
    rows = []
    for c in range(120):
        turns = ["system hello"] if c % 2 else []
        while rng.random() < 0.8 and len(turns) < 9:
            turns.append(rng.choice(["a", "b", "c"]))
        for k, t in enumerate(turns or ["a"]):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", t))
    check(spark, rows, 5)


def test_awkward_rows(spark):
    rows = [
        (1, 0, None, None), (1, 1, "assistant", None), (2, 0, "user", ""), (3, None, "user", "x"),
        (3, 0, "user", "y"), (3, 0, "user", "y"), (3, 0, "assistant", "y"), (None, 0, "user", "no id"),
        (None, 1, "assistant", "none"), (4, 0, "user", "long " * 40_000), (4, 1, "assistant", "é\U0001F600 " * 9_000),
        (5, 0, "ro\nle<|im_sep|>", "a<|im_end|>b"), (5, 1, "assistant", "\\"), (5, 2, "assistant", "\\\\<\\/s>"),
        (6, 0, "user", "<" + chat.TURN), (6, 1, "assistant", "<|im_en"), (-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL),
        *[(7, k, "assistant", "same") for k in range(300)],
    ]
    check(spark, rows)
    assert chat.read_back(chat.format_conversations(frame(spark, []))).count() == 0


def test_hot_nodes_get_several_keys(spark, monkeypatch):
    monkeypatch.setattr(chat, "SHARES", 7)
    rows = [(c, k, "user", t) for c in range(60) for k, t in enumerate(["one", "two", str(c % 5), str(c)])]
    check(spark, rows)


def test_with_a_tokenizer(spark):
    """Tokens stand once, conversations read as their turns' tokens, and the mask holds the learnt text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain_tokenizer = Tokenizer.from_file(path)
    rng = random.Random(3)
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", rng.choice(["Hello there", "é \\ <s>", "", "forty two words"]))
            for c in range(40) for k in range(1 + c % 5)]
    made = chat.format_conversations(frame(spark, rows).repartition(3), path)
    assert collected(chat.read_back(made)) == plain(rows)
    segments = sorted(chat.with_tokens(made.segments).collect(), key=lambda r: r.start)
    stream = [t for r in segments for t in r.tokens]
    nodes = {bytes(r.node_id): r for r in segments}
    for r in segments:
        assert r.start + r.length <= len(stream) and stream[r.start:r.start + r.length] == r.tokens
        assert r.tokens == plain_tokenizer.encode(r.text, add_special_tokens=False).ids
        above, at = [], r
        while at is not None:
            above = at.tokens + above
            at = nodes[bytes(at.parent_id)] if at.parent_id else None
        assert [t for a in r.attention for t in stream[a["from"]:a["to"]]] == above
        assert r.position_ids == list(range(len(above) - r.length, len(above)))
        if r.loss_tokens_from is not None:
            offsets = plain_tokenizer.encode(r.text, add_special_tokens=False).offsets
            begin, end = offsets[r.loss_tokens_from][0], offsets[r.loss_tokens_to - 1][1]
            assert r.text[begin:end].strip() == r.text[r.loss_from:r.loss_to].strip()
    assert any(r.loss_tokens_from is not None for r in segments)
    assert sum(r.length for r in segments) == len(stream)


def test_pieces_give_what_the_tokenizer_gives():
    import public_tokenizers

    pieces = chat.Pieces(public_tokenizers.path("word_bpe_49k.json"))
    assert pieces.cuts
    rng = random.Random(6)
    for _ in range(300):
        parts = rng.choices(["Hello", "wörld", "\\", "<|im_sep|>", " ", "\n", "\t\x0b", "\u3000", "\u00a0", "x" * 90, "don't", "7.5", "[INST]", "\U0001F600"], k=rng.randint(0, 14))
        text = "".join(parts)
        pieces.learn([text])
        ids, offsets = pieces.encode(text).ids, pieces.encode(text).offsets
        begin, end = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
        inside = [k for k, (a, b) in enumerate(offsets) if a >= begin and b <= end and a < b]
        got = pieces.tokens(text, begin, end)
        assert got[0] == ids and pieces.length(text) == len(ids)
        assert got[1:] == ((inside[0], inside[-1] + 1) if inside else (None, None)), text


def test_given_conversations(spark):
    given_rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in given_rows.collect()]
    check(spark, rows)


parts = st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "<", "[", "|", ">", "s>", "a", "\n", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(parts, max_size=12).map("".join))
def test_escaping_is_reversible(text):
    shown = escape(text)
    assert not any(c in shown for c in chat.CONTROLS)
    assert chat.unescaped(shown) == text


def test_the_escapes_of_both_sides_agree(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice([*chat.CONTROLS, "\\", "<", "x"]) for _ in range(8)) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    assert all(r.e == escape(r.t) for r in df.collect())


def test_overlapping_controls_are_refused():
    for bad in (("<s><", "<s>x"), ("a",), ("x\\y",)):
        with pytest.raises(ValueError):
            chat.check_controls(bad)
