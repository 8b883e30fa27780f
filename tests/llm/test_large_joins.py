"""What the Jaccard join costs as its input grows: no second pass over all regions, no shuffle of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from concord.llm import jaccard
from tests.llm.test_overlap import brute, family


def unrelated(rnd, count, length, letters=6):
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(letters)) for _ in range(3000)]
    return [" ".join(rnd.choice(words) for _ in range(length)) for _ in range(count)] + family(rnd, words, 20, length, 3)


def families(rnd, count, size, length):
    words = ["w%d" % n for n in range(3000)]
    return [t for _ in range(count) for t in family(rnd, words, size, length, 2)]


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("most", [4, 4096])
def test_regions_keep_their_size(spark, monkeypatch, most):
    """With ``most`` pivots whatever the input, all regions pass their bound and are split."""
    rows = list(enumerate(families(random.Random(5), 90, 5, 60)))
    tags, write = [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, tag, *rest: (tags.append(tag), write(df, tag, *rest))[1])
    join = jaccard.Join(words=3, least=80, pivots=4, most_pivots=most, cell_shingles=4000, cell_work=10**9)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id bigint, text string"), join).collect()
    assert sorted((str(r.id), r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 80, 100)
    assert ("jaccard-split" in tags) == (most == 4)


def test_texts_that_meet_nothing_are_not_shuffled(spark, tmp_path):
    texts = unrelated(random.Random(6), 800, 200, letters=60)
    rows = [*enumerate(texts + texts[:30]), (None, texts[3]), (7, texts[8]), (-1, "")]
    spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id bigint, text string, other string").write.parquet(f"{tmp_path}/rows")
    before = shuffled(spark)
    kept = jaccard.representatives(spark.read.parquet(f"{tmp_path}/rows"), jaccard.Join(words=5, least=80))
    found = [r.doc_id for r in kept.collect()]
    others = {i for i, _, root in brute(rows, 5, 80, 100) if i != str(root)}
    assert sorted(map(str, found)) == sorted(str(i) for i, _ in rows if i is None or str(i) not in others)
    assert kept.columns == ["doc_id", "text", "other"] and len(others) == 30 + 19 + 1
    assert shuffled(spark) - before < sum(map(len, texts))


def test_ids_are_told_apart_by_a_bitmap(spark):
    rows = spark.range(0, 60_000).select((F.col("id") * 7).alias("doc_id"), F.lit("x").alias("id"), F.lit(1).alias("a.b"))
    ids = spark.range(0, 2000).select((F.col("id") * 70).alias("id"))
    sure, maybe = jaccard.parted(rows, "doc_id", ids)
    assert sure.columns == maybe.columns == rows.columns
    assert sure.count() + maybe.count() == 60_000 and 2000 <= maybe.count() < 2100
    assert maybe.where("doc_id % 70 = 0 and doc_id < 140000").count() == 2000
    sure, maybe = jaccard.parted(rows, "doc_id", ids.where("id < 0"))
    assert (sure.count(), maybe.count()) == (60_000, 0)
