import re

from helpers import AWKWARD, ascii_lower, collect, documents, prose, sha

from fairlead.llm import decontaminate


def tokens(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text)) if w]


def brute(docs, items):
    out = {}
    windows = {}
    for k, t in items:
        w = tokens(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    for i, t in docs:
        w, hit, of = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    of |= found
        out[i] = (len(w), len(hit), len(of), sha(",".join(sorted(map(str, of)))), bool(hit))
    return out


def test_equals_brute_force(spark):
    base = prose(5, 14, words=60)
    items = [(10, base[0]), (2, base[1]), (3, base[0]), (4, None), (5, ""), (6, "just four little words"), (7, "Éa éa"), (8, "..."), (9, "one"), (11, "a " * 30)]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    docs = AWKWARD + base[2:] + [f"x {cut(base[0], 3, 13)} y", f"x {cut(base[0], 3, 12)} y", base[1].upper().replace(" ", ", "), f"{base[0]} {base[1]} {base[0]}", "and Just, FOUR little-words here", "éa éa", "Éa éa", "so one is here", "a " * 12, "a " * 9]
    docs += [f"{cut(base[1], i, i + 10)} tail" for i in range(8)]
    got = collect(decontaminate.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")))
    want = brute(list(enumerate(docs)), items)
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for i, r in got.items()} == want


def test_every_offset_of_a_shared_span_is_found(spark):
    import random

    r = random.Random(7)
    item = " ".join(f"w{r.randint(0, 5)}" for _ in range(40))  # few different words: many equal k-grams
    docs = [" ".join([f"p{i}" for i in range(k)] + item.split()[j : j + 10] + ["q"]) for k in range(0, 30, 7) for j in range(31)]
    got = collect(decontaminate.decontaminate(documents(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")))
    want = brute(list(enumerate(docs)), [(1, item)])
    assert {i: r["n_hit"] for i, r in got.items()} == {i: w[1] for i, w in want.items()}
    assert all(r["contaminated"] for r in got.values())


def test_edges(spark):
    docs, none = documents(spark, AWKWARD), spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, none).collect())
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    two = spark.createDataFrame([(1, text), (1, text), (None, text), (3, "clean")], "doc_id long, text string")
    got = decontaminate.decontaminate(two, spark.createDataFrame([(None, text)], "item_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_hit, r.n_items) for r in got) == [(False, 0, 0), (False, 20, 0), (False, 20, 0), (True, 20, 0)]
    kept = decontaminate.clean_documents(two, spark.createDataFrame([(9, text)], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [3]


def test_native(spark):
    docs = documents(spark, ["a"])
    plan = decontaminate.hits(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_without_an_id_or_with_one_twice_have_their_own_hits(spark):
    a, b, clean = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    docs = spark.createDataFrame([(None, a), (None, b), (None, clean), (7, a), (7, clean)], "doc_id long, text string")
    items = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    got = [(r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs.where("doc_id is null"), items).collect()]
    assert sorted(got) == [(0, 0), (12, 1), (12, 1)]
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.clean_documents(docs, items).collect()) == [(0, clean), (7, clean)]
