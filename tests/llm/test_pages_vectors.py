"""Page and vector operators against brute force, round trips, and the pipeline end to end."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerscope.llm import embeddings, html_text, queries, warc

SMALL = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><p>The site that has it all for everyone, today and tomorrow.</p></header>
<div id="cookie-notice"><p>We use cookies to make this site better for all of our many readers everywhere.</p></div>
<nav><ul><li><a href="/">Home</a><li><a href="/b">Long link text that goes on</a></ul></nav>
<{main}><h1>Title</h1><p>First para one two three four five six seven &amp; eight &eacute;&#233; nine<b> te</b>n.<p>Short.</p>
<aside>Related: <a href="x">foo</a></aside><div class="ad-slot">Buy now this and that for little money today only.</div>
<p>Last   para one two three
four five<br>six <a href="y">seven</a>.</p></{main}>
<section class="comments"><article><p>I think this is a good article with many many words in it.</p></article></section>
<form><label>Name</label><input></form><footer>&copy; Me and all my friends, who wrote all this together.</footer></body></html>"""
WANT = "Title\nFirst para one two three four five six seven & eight éé nine ten.\nShort.\nLast para one two three four five six seven."


def test_main_text(spark):
    pages = [PAGE.format(main="article"), PAGE.format(main="main"), None, "", "<p>", "<article><p>open <b>end", "plain words", "<article>" + "<p>x y</p>" * 3000]
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate(pages)], "page_id long, html string, TEXT int")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[0]["text"] == got[1]["text"] == WANT and got[0]["n_chars"] == len(WANT)
    assert got[2]["text"] == got[3]["text"] == got[4]["text"] == "" and got[5]["text"] == "open end"
    assert got[7]["text"] == "\n".join(["x y"] * 3000)
    assert html_text.extract(df.limit(0)).count() == 0


def follow(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def features_of(tree):
    return {html_text.FEATURES[tree[0]]} | features_of(tree[2]) | features_of(tree[3]) if isinstance(tree, tuple) else set()


def test_tree_fits_its_labels_and_needs_neighbours(spark):
    tree, rows = html_text.train(spark), html_text.labelled()
    assert all(follow(tree, x) == y for x, y in rows)
    around = [k for k, n in enumerate(html_text.FEATURES) if n.endswith(("_before", "_after"))]
    assert len({html_text.FEATURES[k] for k in around} & features_of(tree)) >= 2
    alone = lambda x: tuple(v for k, v in enumerate(x) if k not in around)
    seen = {}
    for x, y in rows:
        seen.setdefault(alone(x), set()).add(y)
    assert any(len(y) == 2 for y in seen.values())  # blocks that only their neighbours tell apart


def test_page_whose_names_tell_nothing(spark):
    words = lambda n, w="tide": " ".join([w] * n)
    html = (
        "<html><body><div>We use cookies to improve your visit. <a href='/ok'>OK</a></div>"
        "<div class='x1'><a href='/'>Start</a></div><div><a href='/b'>Boats</a></div><div>Menu</div><div><a href='/c'>Crews</a></div>"
        f"<h1>News of the harbour</h1><div>{words(35)}</div><div>Short one here.</div><div>{words(52, 'net')} &#8212; <a href='/z'>more</a></div>"
        "<div><a href='/1'>Older post about the tide</a></div><div><a href='/2'>Newer post about nets</a></div>"
        "<div>Copyright 2021 Harbour Press. All rights reserved.</div></body></html>"
    )
    got = html_text.extract(spark.createDataFrame([(1, html), (1, html)], "page_id long, html string")).collect()
    assert [r["text"] for r in got] == [f"News of the harbour\n{words(35)}\nShort one here.\n{words(52, 'net')} \u2014 more"] * 2


def test_white_space_and_references(spark):
    html = "<article><p> a&nbsp;b \t\n c&#32; d </p><p>&lt;p&gt; &eacute;</p></article>"
    got = html_text.extract(spark.createDataFrame([(html, "x", 3)], "html string, TEXT string, N_CHARS int")).collect()
    assert got[0]["text"] == "a\u00a0b c d\n<p> \u00e9" and got[0]["n_chars"] == 13


def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in html_text.extract(pages).collect():
        inside = r["html"][r["html"].index("<article>") : r["html"].index("<footer")]
        assert r["text"] == "\n".join(t for t, _ in html_text.blocks(inside))


def test_warc_round_trip(spark):
    big, other = "<p>é" + "x" * 2000, "WARC/1.1\r\n\r\n" * 200
    rows = [(1, "http://www.a.com/x?q=1", big), (2, "http://b.com/", big), (3, "http://a.com/a", big), (4, None, other), (5, "http://[bad", "small"), (6, "u", "small")]
    rows += [(7, "http://a.com/x", None), (None, "http://c.com", big), (3, "http://a.com/a", big), (8, "x\r\ny", "")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        body = payload[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        revisit = body == big.encode() and r["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
    keys = [(r["url_key"], r["capture_time"]) for r in got]
    assert keys == sorted(keys)


def test_warc_records_keep_the_standard(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 64_000)
    big = "<p>" + "x" * 3000
    rows = [(k, f"http://a.com/{k}", big if k < 3 else f"page {k}" * (1 + 4000 * (k == 5))) for k in range(8)] + [(None, None, None), (7, "http://a.com/7", "page 7")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    seen = {}
    for f in sorted((tmp_path / "w").glob("*/part-*")):
        content = f.read_bytes()
        found = list(warc.parse(content))
        assert len(content) < 64_000 + 1000 or len(found) == 1
        for at, h, block in found:
            assert content[at:].startswith(b"WARC/1.1\r\n") and h["warc-record-id"] not in seen
            seen[h["warc-record-id"]] = h
            assert {"warc-type", "warc-date", "content-length", "content-type"} <= set(h) and block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert len(seen) == len(rows)
    revisits = [h for h in seen.values() if h["warc-type"] == "revisit"]
    assert len(revisits) == 2 and all(h["warc-profile"] == warc.PROFILE and seen[h["warc-refers-to"]]["page-id"] == "2" for h in revisits)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    rnd = random.Random(1)
    for k in range(9):
        runs = [sorted((rnd.randrange(50), i) for _ in range(rnd.randrange(20))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_broken_archive_is_refused():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def brute(rows, cosine=0.93):
    ids, linked = [r[0] for r in rows], {}
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            sound = all(x and all(e is not None and np.isfinite(e) for e in x) and any(x) for x in (v, w)) and label is not None and label == other
            if i != j and sound and len(v) == len(w):
                a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    linked.setdefault(i, set()).add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in linked.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((ids[i], len(linked.get(i, ())), min(ids[j] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_embeddings_against_brute_force(spark, block):
    rnd = np.random.default_rng(2)
    centers = rnd.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centers[i % 12] + rnd.normal(size=8) * 0.25], i % 2) for i in range(150)]
    rows += [(200 + i, rows[3][1], 1) for i in range(9)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, rows[0][1], None), (304, [], 0), (305, [1.0, 2.0], 0), (306, [None] * 8, 0), (307, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df, embeddings.CoverParams(block=block, leaf=4)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_invariants():
    x = np.random.default_rng(1).normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    todo = [(embeddings.cover_tree(x, 4), np.inf)]
    while todo:
        node, above = todo.pop()
        assert (np.linalg.norm(x[node.members] - x[node.center], axis=1) <= node.radius + 1e-7).all() and node.radius <= above + 1e-9
        if node.children:
            assert sorted(i for c in node.children for i in c.members) == sorted(node.members) and node.center in [c.center for c in node.children]
            todo += [(c, max(node.radius, c.radius)) for c in node.children]


def test_pipeline_end_to_end(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 50 and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
