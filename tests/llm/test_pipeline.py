"""The pipeline against its stages in plain Python, on a small fixture."""

import random

import corpus_pipeline
from helpers import collect, prose, sha
from test_decontaminate import brute as hits_of
from test_jaccard import brute as groups_of
from test_lines import brute as lines_of
from test_packing import check_pieces, ids_of

from fairlead.llm import quality
from fairlead.llm.queries import oracle_sql, queries


def fixture(spark, tmp_path):
    r = random.Random(3)
    base = prose(21, 30, words=120)
    shared = "All the rights that there are in this text are reserved"
    texts = [t.replace(" ", "\n", 2) + ("\n" + shared if i % 3 == 0 else "") for i, t in enumerate(base)]
    texts += [base[4].replace(base[4].split()[7], "other", 1), base[5], base[5] + " end"]
    items = prose(22, 3, words=30)
    texts += [f"{prose(23, 1)[0]} {' '.join(items[0].split()[:14])}", "too short", None, "", "spam spam spam spam spam spam " * 10, " ".join(f"#{i} $$" for i in range(30)), "tail"]
    rows = [(i, t, "en", f"src{r.randint(0, 3)}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, list(enumerate(items)), str(tmp_path)


def test_stages_one_by_one_and_as_a_whole(spark, tmp_path):
    rows, items, path = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {i for i, x in collect(quality.quality_rules(docs)).items() if x["kept"]}
    text = {i: t for i, t, *_ in rows if i in kept}
    assert 0 < len(kept) < len(rows)
    stage = dict(corpus_pipeline.STAGES)

    docs = stage["quality rules"](spark, docs, path)
    assert docs.columns == columns and {x.doc_id: x.text for x in docs.collect()} == text

    docs = stage["line dedup"](spark, docs, path)
    got = collect(docs)
    assert docs.columns == columns and {i: sha(x["text"]) for i, x in got.items()} == {i: w[2] for i, w in lines_of(sorted(text.items())).items()}
    assert any(got[i]["text"] != t for i, t in text.items()) and all(x["n_chars"] == len(x["text"]) for x in got.values())
    text = {i: x["text"] for i, x in got.items()}

    order = sorted(text)
    least = {order[i] for i, (_, c) in groups_of([text[i] for i in order], 5, 80).items() if c == i}
    docs = stage["near duplicates"](spark, docs, path)
    assert docs.columns == columns and {x.doc_id for x in docs.collect()} == least and len(least) < len(text)

    clean = {i for i, x in hits_of([(i, text[i]) for i in sorted(least)], items).items() if not x[4]}
    docs = stage["decontamination"](spark, docs, path)
    assert docs.columns == columns and {x.doc_id for x in docs.collect()} == clean and len(clean) < len(least)

    for packed in (stage["packing"](spark, docs, path), corpus_pipeline.run(spark, path)):
        order = sorted(clean)
        renamed = [type("R", (), x.asDict() | {"doc_id": order.index(x.doc_id)}) for x in packed.collect()]
        assert sum(check_pieces(renamed, [text[i] for i in order], 4096)) == sum(len(ids_of(text[i])) for i in order)


def test_every_query_is_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(oracle_sql()) <= set(names)
