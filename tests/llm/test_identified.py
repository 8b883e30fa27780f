"""Which documents the language stage keeps, and the pipeline over odd tables."""

import random

import numpy as np
import pytest

import corpus_pipeline
from concord.llm import langid

#: Sentences that no document of the tables is in.
FOREIGN = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 5,
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。" * 5,
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus. " * 3,
}


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs)


def test_unlearnt_languages_scripts_and_noise_are_not_identified(model):
    rnd = random.Random(1)
    noise = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(200))
    texts = [*FOREIGN.values(), noise, None, "", "12 34", "ο"]
    *_, known = langid.Labeller(model, 12.0)(texts)
    assert known.tolist() == [0.0] * len(texts)


def test_documents_of_learnt_languages_stay(docs, model):
    rows = [r for r in docs.select("text", "lang").collect() if r.text and any(map(str.isalpha, r.text))]
    *_, known = langid.Labeller(model, 12.0)([r.text for r in rows])
    assert (known >= corpus_pipeline.LEAST_LANGUAGE_SCORE).mean() >= 0.999


def test_a_language_left_out_is_rejected(docs):
    for lang in ("es", "fr"):
        *_, known = langid.Labeller(langid.train(docs.where(f"lang <> '{lang}'")), 12.0)([r.text for r in docs.where(f"lang = '{lang}'").collect()])
        assert (known < 0.5).mean() > 0.95


def test_mixed_texts_of_learnt_languages_stay(docs, model):
    parts = [r.text[:700] for lang in model.languages for r in docs.where(f"lang = '{lang}' and length(text) > 1000").orderBy("doc_id").limit(1).collect()]
    assert len(parts) > 2
    texts = ["\n".join(parts), "\n".join([*parts, FOREIGN["et"][:300]]), "\n".join([parts[0][:200], FOREIGN["ru"] * 3])]
    _, score, *_, known = langid.Labeller(model, 12.0)(texts)
    assert score[0] < 0.5 and known[0] > 0.9 and known[1] > 0.6 and known[2] < 0.5


def test_shares_do_not_depend_on_what_else_a_worker_has_seen(docs, model):
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + list(FOREIGN.values())
    *_, want = langid.Labeller(model, 12.0)(texts)
    few = langid.Labeller(model, 12.0, limit=50)
    assert np.allclose([few([t])[-1][0] for t in texts], want, atol=1e-6)


def test_pipeline_over_odd_tables(spark, sf, tmp_path):
    """Repeated rows, null ids, clashing columns, a very long text, ties; and no rows."""
    some = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 300").orderBy("doc_id").limit(12)
    text = [r.text for r in some.collect()]
    long = " ".join(random.Random(2).sample(" ".join(text).split(), 1500)) + " " + "zu " * 200_000
    more = spark.createDataFrame([(901, text[0]), (902, text[0]), (903, long), (None, text[1]), (904, None)], "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars")
    docs = some.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).unionByName(some.select("doc_id", "text", "lang", "source", "n_chars").limit(2))
    docs = docs.selectExpr("*", "1 id", "'r' root", "2 h", "3 cell", "4 score", "5 word", "6 item_id", "7 region")
    (tmp_path / "a").mkdir()
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for part in "ab":
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/{part}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.materialize(stage(spark, left, f"{tmp_path}/a"), "test")
        assert left.columns == docs.columns
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in left.collect())
    ids = [r.doc_id for r in out]
    first = min(r.doc_id for r in some.collect())
    assert ids.count(901) == ids.count(902) == ids.count(904) == 0 and (first not in ids or ids.count(first) == 2)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
