"""Document operators against brute force on small fixtures, and their edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ledgerscope.llm import langid, lines, mixing, packing, quality, simhash, toxicity
from ledgerscope.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    texts = ["\n".join(sentence(rnd, rnd.randint(4, 30)) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    texts += texts[:6]  # exact copies
    for t in texts[:8]:  # near copies
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "   \n", "one two", " sp ace word", "x " * 3000, "a" * 5000, "same line here again today\nsame line here again today"]
    rows = [(i, t, "en", f"s{i % 3 if i % 2 else 0}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chain_star_and_empty(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(50)}) == 1
    assert got[0] != got[1000] and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_figures(spark, docs, corpus):
    got = quality.score_quality(docs).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(corpus)
    for i, text, *_ in corpus:
        words, r = words_of(text), by_id[i]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        count = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(8)}
        seen, dups = set(), 0
        for line in (text or "").split("\n"):
            if words_of(line):
                dups += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(covered), dups)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])
    clean = "The committee met on Tuesday and agreed to publish the report in full, after a short discussion of its findings and costs.\n" * 1
    junk = "home | about | news | contact | help | login | shop | more | jobs | press | legal | terms | map | feed | faq | blog | wiki | talk | tags | end"
    more = spark.createDataFrame([(1, clean, 1), (2, junk, 2), (3, clean + junk[:20], 3)], "doc_id long, text string, KEPT int")
    out = {r["doc_id"]: r for r in quality.score_quality(more).collect()}
    assert out[1]["kept"] and not out[2]["kept"] and out[2]["clean_text"] == "" and not out[2]["base_failed"]
    assert quality.score_quality(docs.limit(0)).count() == 0


def test_simhash_against_brute_force(spark, docs, corpus):
    def print_of(text):
        words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: print_of(t) for i, t, *_ in corpus if i is not None}
    want = brute_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is not None:
            assert (int(r["fingerprint"], 16), r["component_id"]) == (prints[r["doc_id"]], want[r["doc_id"]])
    kept = simhash.deduplicate(docs.drop("n_chars"), shingle=3)
    assert kept.columns == ["doc_id", "text", "lang", "source"]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))


def test_close_pairs_connect_all_within_distance(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(6)} | set(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = components(simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), 2)).collect()
    want = brute_components(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    roots = {r["node"]: r["root"] for r in got}
    groups = lambda m: sorted(sorted(n for n in signed if m.get(n, n) == m.get(x, x)) for x in signed)
    assert groups(roots) == groups(want)
    with pytest.raises(ValueError):
        simhash.close_pairs(spark.range(1).toDF("fp"), 3)


def test_lines_against_brute_force(spark):
    rnd = random.Random(2)
    base = [sentence(rnd, rnd.randint(6, 40)) for _ in range(40)]
    rows, n = [], 0
    for line in base:
        for _ in range(rnd.randint(1, 4)):
            words = line.split(" ")
            if rnd.random() < 0.7:
                words[rnd.randrange(len(words))] = "zz" + str(rnd.randrange(99))
            rows.append((n, " ".join(words) + "\n\nshort\n" + base[0]))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "short"), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_lines int, other string")
    p = lines.LineDedup()
    sets = {}
    for _, text in rows:
        for line in (text or "").split("\n"):
            if line.strip():
                sets[line] = {line[k : k + 9] for k in range(len(line) - 8)}
    alike = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = brute_components(sorted(sets), alike)
    result = lines.dedup_lines(docs, p).collect()
    again = sorted((r["text"] for r in result if r["doc_id"] == rows[0][0]), key=len)
    assert len(again) == 2 and not again[0].strip()  # of two equal rows one loses its visible lines
    got = {r["doc_id"]: r for r in result if r["doc_id"] != rows[0][0] or r["text"] == again[1]}
    seen = {}
    for i, text in sorted({r[0]: r[1] for r in rows}.items()):
        kept = []
        for k, line in enumerate((text or "").split("\n")):
            if not line.strip() or seen.setdefault(want[line], (i, k)) == (i, k):
                kept.append(line)
        assert got[i]["text"] == (None if text is None else "\n".join(kept))
    assert lines.dedup_lines(docs, p).columns == ["doc_id", "text", "n_lines", "other", "n_chars", "n_removed"]
    assert lines.dedup_lines(docs.limit(0), p).count() == 0


def test_mixing_meets_repetition_and_budget(spark, docs, corpus):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 10 else f"small{i % 3}") for i in range(600)] + [(None, None, None), (9001, "x y", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(d).collect()
    by = Counter()
    for r in out:
        by[r["source"]] += r["tokens"]
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    passes = {s: by[s] / tokens[s] for s in tokens}
    assert min(passes.values()) >= 0.99 and max(passes.values()) <= 2.05 and passes["big"] < 1.02
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    keys = Counter((r["doc_id"], r["epoch"]) for r in out)
    assert max(keys.values()) == 1
    half = mixing.mix_sources(d, mixing.Mix(repetition=None, entropy=1.0, budget=300)).collect()
    assert abs(sum(r["tokens"] for r in half) - 300) <= 5 * 5
    assert mixing.mix_sources(d.limit(0)).count() == 0
    assert mixing.mix_sources(docs).count() >= len(corpus)


def test_packing_round_trip(spark, docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_paths()[0])
    got = packing.pack(docs, capacity=64).collect()
    want = Counter()
    for i, text, *_ in corpus:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.spans(len(ids), 64)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 64
    assert len(filled) <= 1.05 * -(-sum(filled.values()) // 64) + 1
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.spans(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.spans(1024, 1024) == [(0, 1024)]


def test_placement_against_brute_force():
    """Every placement makes the sum of squared counts of open sequences per gap as small as any choice would."""
    rnd = random.Random(4)
    for capacity, n in ((16, 60), (64, 200), (1024, 300)):
        lengths = np.array([rnd.randint(1, capacity - 1) for _ in range(n)])
        for target in (0, 5, n):
            bins = packing.sum_of_squares(lengths, capacity, target)
            where = {i: k for k, b in enumerate(bins) for i in b}
            assert sorted(where) == list(range(n))
            room: list[int] = []
            squares = lambda rooms: sum(c * c for g, c in Counter(rooms).items() if 0 < g)
            for i in np.argsort(-lengths, kind="stable"):
                options = {g: squares([*room[: room.index(g)], g - lengths[i], *room[room.index(g) + 1 :]]) for g in set(room) if g >= lengths[i]}
                if len(room) < target or not options:
                    options[capacity] = min(options.get(capacity, 10**9), squares([*room, capacity - lengths[i]]))
                at = where[i]
                gap = room[at] if at < len(room) else capacity
                assert options[gap] == min(options.values())
                if at == len(room):
                    room.append(capacity)
                room[at] -= lengths[i]
    lengths = np.array([rnd.randint(1, 1023) for _ in range(3000)])
    assert len(packing.fewest(lengths, 1024)) <= 1.01 * max(-(-lengths.sum() // 1024), (lengths > 512).sum())


def test_tokenizers_agree(spark):
    from tokenizers import Tokenizer

    paths = packing.vocabulary_paths()
    t = Tokenizer.from_file(paths[0])
    for text in ("", " ", "\n\n  a", "<|endoftext|> x", "a<|endoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "naïve Ünïcode 日本語 123456 don't", "a" * 3000, " " * 500 + "\tz", " x y"):
        assert packing.encoder(*paths)(text) == t.encode(text, add_special_tokens=False).ids


def test_language_id(spark):
    rnd = random.Random(3)
    parts = {"xx": ["ka", "mo", "ri", "tu"], "yy": ["schr", "eng", "olb", "upf"]}
    make = lambda lang, n: " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    model = langid.fit(spark.createDataFrame(rows[:80] + [(999, None, "xx"), (998, "a b", None)], "doc_id long, text string, lang string"))
    test = [*rows[80:], (1, None, None), (2, "", None), (3, "12 34 !!", None), (4, "schrengolbupfupfolb", "yy"), (5, "²", None)]
    out = langid.predict(spark.createDataFrame(test, "doc_id long, text string, score string"), model).collect()
    for (_, text, lang), r in zip(test, out):
        assert r["lang_pred"] == (lang or "und") and 0 <= r["score"] <= 1
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), empty).first()["lang_pred"] == "und"


def test_toxicity_learns_held_out(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        words = [rnd.choice(["sun", "tree", "house", "river", "stone", "walk", "green"]) + str(rnd.randrange(30)) for _ in range(40)]
        if i % 4 == 0:
            words[rnd.randrange(40)] = rnd.choice(["vileword", "badword"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(a, b, 7) for a, b, _ in rows] + [(9000, None, 7), (9001, "", 7)], "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(a, y) for a, _, y in rows[:300]] + [(None, 1), (5, None)], "doc_id long, y int")
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    right = sum(out[a]["predicted"] == y for a, _, y in rows[300:])
    assert right >= 95 and 0 <= out[9000]["score"] <= 1 and out[9000]["score"] == out[9001]["score"]
    assert (model.w != 0).sum() < 5000
    assert toxicity.ToxicModel(np.zeros((1 << 18) + 1), toxicity.FtrlParams()).score("x") == 0.5
