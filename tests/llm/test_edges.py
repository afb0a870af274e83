"""Edge cases that several operators share: clashing columns, very long texts, repeated ids, repeated rows."""

import math

from ledgerscope.llm import embeddings, langid, mixing, warc


def test_mixing_with_clashing_columns_and_a_very_long_text(spark):
    rows = [(i, f"a{i % 2}", "word " * (5 + i), "x", "y", "z", "v") for i in range(30)] + [(99, "a0", "long " * 200_000, "x", "y", "z", "v"), (98, None, None, "x", "y", "z", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string, block string, Epoch string, room string")
    out = mixing.mix_sources(docs).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    assert all(r["tokens"] == len((r["text"] or "").split()) for r in out)


def test_language_of_long_and_repeated_texts(spark):
    texts = {"en": "the house and the garden of the king", "de": "das haus und der garten des koenigs mit dem"}
    rows = [(i, texts[lang] + f" {i}", lang, "x") for i in range(40) for lang in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, LANG_PRED string")
    model = langid.fit(docs)
    asked = [(1, "the garden of the king " * 50_000, None, "q"), (2, "das haus des koenigs", "en", "q"), (2, "das haus des koenigs", "en", "q"), (3, "", None, "q"), (4, None, None, "q"), (5, "12 34 --", None, "q")]
    out = langid.predict(spark.createDataFrame(asked, docs.schema), model).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in out) == [(1, "en"), (2, "de"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert all(0 <= r["score"] <= 1 for r in out)


def test_vectors_with_clashing_columns_and_repeated_ids(spark):
    near = [1.0, 0.0, math.sqrt(1 / 0.95**2 - 1)]
    rows = [(1, [1.0, 0.0, 0.0], 5, "c", "c"), (1, [0.0, 1.0, 0.0], 5, "c", "c"), (2, near, 5, "c", "c"), (3, [0.0, 2.0, 0.0], 5, "c", "c"), (4, [1.0, 0.0, 0.0], 6, "c", "c")]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, Copies string")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_archives_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 2000, "c", "c"), (2, "http://b/", "x" * 2000, "c", "c"), (3, None, None, "c", "c")], "page_id long, url string, html string, payload string, digest string")
    out = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive(pages.select("page_id", "url", "html", "payload", "digest")).collect()}
    assert out == {1: ("revisit", 2, 2000), 2: ("response", None, 2000), 3: ("response", None, 0)}
