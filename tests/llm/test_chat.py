import hashlib

from helpers import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from fairlead.llm import chat

text = st.lists(st.sampled_from(list("\\<>|/s[]INST\nendim_start ok") + list(chat.CONTROL)), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(text)
def test_escape_is_reversible_and_leaves_no_control_string(x):
    e = chat.escape(x)
    assert chat.unescape(e) == x
    assert not any(c in e for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(text, text), min_size=1, max_size=4))
def test_parse_reads_what_was_written(turns):
    window = "".join(chat._head(r) + chat.escape(t) + chat.END for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(window)] == turns


def rows():
    p = prose(9, 80, words=150)
    out = [(1, i, "user" if i % 2 == 0 else "assistant", p[i]) for i in range(60)]
    out += [(2, 0, "system", p[60]), *[(2, i, "assistant" if i % 2 == 0 else "user", p[60 + i % 9]) for i in range(1, 30)]]
    out += [(3, 0, "user", None), (3, 1, "assistant", None), (4, 5, None, "x"), (None, 1, "assistant", "no id"), (None, None, "user", "first")]
    out += [(5, 0, "assistant", "word " * 5000), (5, 1, "assistant", "after"), (6, 0, "user", "</s>[INST] ok [/INST]"), (6, 1, "assistant", "<|im_end|>\n<\\/s>")]
    out += [(7, 1, "user", "b"), (7, 1, "assistant", "a"), (7, 1, "assistant", "a")]
    return out


def want(all_rows):
    by = {}
    for c, t, r, x in all_rows:
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        turns, loss = hashlib.sha256(), "".join(x for *_, r, x in own if r == "assistant")
        for *_, r, x in own:
            turns.update(f"{r}\n{x}\n".encode())
        out[c] = (len(own), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    for budget in (2048, 300, 1):
        got = chat.read_back(chat.format_windows(df, budget=budget)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want(rows())


def test_windows(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, budget=400, history_tokens=150, history_turns=2).collect()
    assert len([w for w in windows if w.conv_id == 1]) > 3
    for w in windows:
        turns = list(chat.parse(w.formatted))
        assert w.n_tokens <= 400 or len(turns) - w.n_repeated == 1, "over the budget only with a single new turn"
        learned = {(a, b) for r, _, a, b in turns[w.n_repeated :] if r == "assistant"}
        assert {(s.start, s.end) for s in w.loss} == learned, "repeated targets are masked"
        if w.conv_id == 2:
            assert turns[0][0] == "system"
        assert w.window > 0 or w.n_repeated == 0
    assert any(w.n_repeated > 1 for w in windows if w.conv_id == 2), "system turn and history"


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_windows(df)).count() == 0


def test_windows_in_any_order_or_missing(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(c, t, ["system", "user", "assistant"][min(t, 1) + (t > 0 and t % 2 == 0)], f"{c} {t} {text}") for c in (1, 2, None) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, budget=400)
    want = sorted(map(tuple, chat.read_back(windows, in_order=True).collect()), key=str)
    written = spark.createDataFrame(windows.collect(), windows.schema)
    assert written.groupBy("conv_id").count().agg({"count": "min"}).first()[0] > 2
    for dealt in (written.repartition(5), written.orderBy("window", ascending=False)):
        assert sorted(map(tuple, chat.read_back(dealt).collect()), key=str) == want
    late = {r.conv_id: r.n_turns for r in chat.read_back(written.where("window > 0")).collect()}
    assert set(late) == {1, 2, None} and all(0 < n < 12 for n in late.values())
