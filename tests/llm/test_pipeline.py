import random

import brute
import corpus_pipeline
import pytest

from foliant.llm import contamination, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(rng.randint(5, 200)) for _ in range(60)]
    toxic = [f"{text(30)} vileword {text(20)}" for _ in range(20)]
    items = [text(25) for _ in range(4)]
    leaks = [f"{text(20)} {rng.choice(items).upper()}. {text(10)}" for _ in range(8)]
    near = []
    for t in rng.sample(texts, 12):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    copies = [t.upper() for t in rng.sample(texts, 10)] + [None, "", None]
    every = texts + toxic + leaks + near + copies
    rng.shuffle(every)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(every)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vileword" in (t or ""))) for i, t, *_ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [contamination.normalised(r.text.encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = {
        "toxicity": lambda rows: [r for r in rows if "vileword" not in (r[1] or "")],
        "exact_dedup": lambda rows: [r for r, e in zip(rows, brute.exact(rows), strict=True) if e[3]],
        "near_dedup": lambda rows: [r for r, e in zip(rows, brute.near(rows, 5, 80), strict=True) if e[3]],
        "decontamination": lambda rows: [
            r
            for r in rows
            if not any(brute.edit_distance_in(i, contamination.normalised((r[1] or "").encode())) <= len(i) // 20 for i in items)
        ],
    }
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
        before, rows = len(rows), expected[name](rows)
        assert sorted((r.doc_id, r.text or "") for r in now.collect()) == sorted((i, t or "") for i, t in rows)
        assert len(rows) < before
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in rows}
    totals = {}
    for r in pieces:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert all(totals[r.doc_id] == r.doc_tokens for r in pieces)


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_unlabelled_documents_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.without_toxic(docs, toxicity.fit(docs, labels)).count() == 2
