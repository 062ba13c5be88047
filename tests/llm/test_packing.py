import random
import zlib
from itertools import combinations

import numpy as np
from helpers import AWKWARD, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fairlead.llm import packing
from fairlead.llm.common import WordTokens, tokenizer_path

TOKENIZER = Tokenizer.from_file(tokenizer_path())
FORGETFUL = WordTokens(tokenizer_path(), limit=0)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["It's 3,000.50 — can't, won't! 's", "Σας ΣΑΣ İx", "a　b c̈ ̈d", "q\x1cr\x85w​z", "<|endoftext|>x <|startoftext|>", "a ,. b's. ,x", "ﬁ ½ 12 ٣", "日本語 テキスト。", ".", ",", "a.b.c", "\n\n.x"]


def test_word_tokens_equal_the_tokenizer():
    w = WordTokens(tokenizer_path())
    texts = AWKWARD + ODD + prose(1, 20) + [t.replace(" ", ", ", 9).title() + "." for t in prose(2, 20)]
    for _ in range(2):  # cold and warm
        ids, offsets = w.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids_of(t)[:-1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé ,.'\n1½\x1c\u0308Σs-<|>"), max_size=20), max_size=5))
def test_word_tokens_of_any_text(texts):
    ids, offsets = FORGETFUL.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids_of(t)[:-1] for t in texts]


def test_word_tokens_of_every_letter():
    """Each letter and digit of the first two planes, and what may follow it."""
    w = WordTokens(tokenizer_path())
    texts = [f"Ab{c}{x}{'zu' * bool(x)}" for c in map(chr, range(0x20000)) if c.isalnum() for x in (",", ".", "7", "\n", "")]
    for i in range(0, len(texts), 2000):
        some = texts[i : i + 2000]
        ids, offsets = w.encode(some)
        want = [e.ids for e in TOKENIZER.encode_batch_fast(some, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["İ", "ŉ", "ǰ", "ΐ", "ẖ", "ß", "A", "b", ",", ".", " ", "\n", "9", "É"]), max_size=12).map("".join))
def test_word_tokens_of_letters_that_change_with_case(text):
    assert FORGETFUL.encode([text])[0].tolist() == ids_of(text)[:-1]


def check_pieces(rows, docs, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(docs)))
    for i, own in by_doc.items():
        ids, at = ids_of(docs[i]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lengths = []
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        lengths.append(at)
    return lengths


def test_min_slack_round_trip(spark):
    docs = AWKWARD + ODD + prose(3, 60, words=900)
    for capacity in (4096, 64):
        rows = packing.pack_min_slack(documents(spark, docs), capacity).collect()
        lengths = check_pieces(rows, docs, capacity)
        assert all(n == capacity or n & (n - 1) == 0 for n in lengths), "full, or a power of two"
    assert packing.pack_min_slack(documents(spark, docs).limit(0)).count() == 0


def test_min_slack_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "d e"), (1, "d e")], "doc_id long, text string")
    rows = packing.pack_min_slack(df).collect()
    assert sum(r.length for r in rows) == 4 + 3 + 3


def test_closest_subset_is_optimal():
    r = random.Random(1)
    for _ in range(60):
        items = [r.randint(1, 40) for _ in range(r.randint(1, 9))]
        capacity = r.randint(1, 120)
        best = max(s for k in range(len(items) + 1) for c in combinations(items, k) if (s := sum(c)) <= capacity)
        counts = {n: items.count(n) for n in items}
        chosen = packing.closest_subset(sorted(counts.items(), reverse=True), capacity)
        assert sum(n * k for n, k in chosen.items()) == best
        assert all(k <= counts[n] for n, k in chosen.items())


def test_min_slack_looks_at_few_lengths():
    """Of thousands of lengths that wait, a sequence asks for those that fill it and not for all."""
    asked = []

    class Counted(list):
        def __len__(self):
            asked.append(1)
            return super().__len__()

    packer = packing.MinSlack(4096)
    packer.waiting.default_factory = Counted
    for n in (*range(1, 1201), *range(2981, 3001)):
        packer.add(packing.Piece(n, 0, n, range(n)))
    asked.clear()
    filled = [packer.fill() for _ in range(20)]
    assert all(sum(map(len, s)) == 4096 for s in filled)
    assert len({p.doc for s in filled for p in s}) == sum(map(len, filled))
    assert packer.tokens == sum(packer.waiting) == sum(range(1, 1201)) + sum(range(2981, 3001)) - 20 * 4096
    assert len(asked) < 200


def test_free_capacity_tree():
    r, tree, rooms = random.Random(2), packing.FreeCapacity(100), []
    for _ in range(500):
        if rooms and r.random() < 0.4:
            room = rooms.pop(r.randrange(len(rooms)))
            tree.change(room, -1)
        else:
            rooms.append(r.randint(1, 100))
            tree.change(rooms[-1], 1)
        need = r.randint(1, 100)
        assert tree.smallest_from(need) == min((x for x in rooms if x >= need), default=None)


def test_best_fit_matrix_is_lossless(spark):
    docs = AWKWARD + ODD + prose(4, 40, words=900)
    for capacity in (4096, 64):
        back = {}
        for r in packing.pack_best_fit(documents(spark, docs), capacity).collect():
            ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
            assert len(ids) == len(positions) == capacity and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
            for doc, start, a, b in zip(r.segment_ids, r.segment_starts, r.cu_seqlens, r.cu_seqlens[1:]):
                assert positions[a:b].tolist() == list(range(b - a))
                back.setdefault(doc, []).append((start, ids[a:b].tolist()))
            assert not ids[r.n_tokens :].any() and not positions[r.n_tokens :].any()
        assert {k: [x for _, part in sorted(v) for x in part] for k, v in back.items()} == {i: ids_of(t) for i, t in enumerate(docs)}


def test_best_fit_is_decreasing_best_fit():
    r = random.Random(5)
    for _ in range(20):
        sizes = [r.randint(1, 50) for _ in range(40)]
        got = packing.best_fit([packing.Piece(i, 0, n, [0] * n) for i, n in enumerate(sizes)], 50)
        rooms = []
        for n in sorted(sizes, reverse=True):
            fit = min((x for x in rooms if x >= n), default=None)
            rooms.append((50 if fit is None else rooms.pop(rooms.index(fit))) - n)
        assert sorted(50 - sum(map(len, b)) for b in got) == sorted(rooms)


def test_ids_beyond_16_bits_are_kept(spark, tmp_path):
    """A vocabulary with an id of 70,000 is written with 32 bits."""
    import json

    vocab = json.loads(open(packing.tokenizer_path()).read())
    vocab["model"]["vocab"]["a</w>" if "a</w>" in vocab["model"]["vocab"] else next(iter(vocab["model"]["vocab"]))] = 70_000
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(vocab))
    assert packing.width_of(packing.tokenizer_path(), 4096) == "<u2" and packing.width_of(packing.tokenizer_path(), 1 << 17) == "<u4"
    assert packing.width_of(str(path), 4096) == "<u4"
    r = packing.pack_best_fit(documents(spark, ["a a"]), capacity=64, tokenizer=str(path)).first()
    ids = np.frombuffer(r.input_ids, "<u4")
    assert len(ids) == 64 and len(np.frombuffer(r.position_ids, "<u4")) == 64 and ids[: r.n_tokens].tolist() == [70_000, 70_000, 2]
