"""The sample that the toxicity model learns from."""

import random

from ledgerscope.llm import toxicity


def test_scores_agree_below_and_above_the_cap(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(3000):  # one in ten is toxic; the words say little, so the prior counts
        y = int(i % 10 == 0)
        words = [f"w{rnd.randrange(40)}" for _ in range(8)] + ["sly" if rnd.random() < (0.5 if y else 0.1) else "mild"]
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, y int").cache()
    capped = toxicity.FtrlParams(rows=1000)
    drawn = toxicity.sample(labels, capped)
    assert drawn.count() == 1000 and 0.07 <= drawn.agg({"y": "avg"}).first()[0] <= 0.13
    few = toxicity.fit(docs, labels.where("doc_id < 1000"), capped)
    many = toxicity.fit(docs, labels, capped)
    mean = lambda m: sum(m.score(t) for _, t, _ in rows[:500]) / 500
    assert abs(mean(few) - mean(many)) < 0.08


def test_scores_do_not_hang_on_the_cluster(spark):
    """Other partitions of the rows, other numbers of shuffle partitions, as other clusters have: equal weights."""
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randrange(200)}" for _ in range(30)) + (" vile" if i % 6 == 0 and i % 4 else ""), int(i % 6 == 0)) for i in range(400)]
    rows += [(7, "another text of seven", 0), (8, rows[8][1], 0)]
    p = toxicity.FtrlParams(passes=3, bits=12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for parts, shuffles in ((1, 1), (4, 8), (9, 13)):
            spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
            docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(parts)
            labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, y int").repartition(parts + 1)
            got.append(toxicity.fit(docs, labels, p).w)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].any() and (got[0] == got[1]).all() and (got[0] == got[2]).all()


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, y int")
    model = toxicity.fit(docs, labels, toxicity.FtrlParams(passes=1, bits=10))
    assert model.score("any") == 0.5 and toxicity.score_toxicity(docs, model).count() == 0
