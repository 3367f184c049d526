"""The operators on small and awkward tables, against brute force and the libraries that they must equal."""

import base64
import collections
import hashlib
import itertools
import math
import random
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from cairn.llm import ann_search, byte_bpe, decontaminate, license_scan, line_dedup, lm_scoring, simhash_dedup, token_counts, toxicity, url_filter
from cairn.llm.common import materialise

KIND = "doc_id long, text string, lang string, source string, n_chars long, fp long, line int, score double"
LONG = "wörter und mehr " * 4000
TEXTS = [None, "", " \n\t ", "a", "the same text here and there", "the same text here and there", "don't, we'll\n\n  'tis  x", LONG, "x" * 5000, "Ünï\u2028 <|endoftext|> end", "line one is here\nline two\nLine  one is here"]


def table(spark, texts=TEXTS, repeat=True):
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[4], (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, KIND)


def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, library):
    want = sorted((str(i), hashlib.sha256(" ".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in [*enumerate(TEXTS), (4, TEXTS[4]), (None, "no id here")])
    got = byte_bpe.encode_texts(table(spark)).collect()
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert byte_bpe.encode_texts(empty(spark)).count() == 0


def fuzz(n=3000):
    r = random.Random(5)
    parts = [*"aabcdelrstmv'' \n\t!?12ñé漢🎉\x1c\x85", "'re", "'ll", "  ", "the", "====", "<|endoftext|>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_tree_joins_at_any_border(library):
    tree = byte_bpe.TreeBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), leaf=5, short=2)
    for t in [*fuzz(1500), "a" * 999, " " * 1001, "=" * 513 + "x", "ab" * 400]:
        assert tree.encode(t) == library.encode_ordinary(t)


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*fuzz(), "a" * 999, " " * 1001]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.Counter(path)
    assert counter.count(texts).tolist() == want
    counter.machine.limit = 10  # starts anew again and again
    assert [n for i in range(0, 900, 90) for n in counter.count(texts[i : i + 90])] == want[:900]
    assert token_counts.token_counts(table(spark)).count() == len(TEXTS) + 2
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_simhash_groups_equal_brute_force(spark):
    r = random.Random(3)
    base = [r.choice("abcdefghij") * 3 + str(i % 17) for i in range(400)]
    texts = [*TEXTS, " ".join(base)]
    for k in range(12):
        w = list(base)
        w[30 * k] = "changed"
        texts.append(" ".join(w))
    got = {(x.doc_id, x.fp & (2**64 - 1), x.component_id) for x in simhash_dedup.near_duplicate_groups(table(spark, texts, False)).collect()}
    fp = {}
    for i, t in enumerate(texts):
        h = simhash_dedup.shingle_hashes((t or "").encode(), 3, 42)
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    assert got == {(i, fp[i], group[i]) for i in fp}
    assert simhash_dedup.near_duplicate_groups(empty(spark)).count() == 0


def test_crowded_blocks_lose_no_link(spark):
    r = random.Random(1)
    values = [0, *{r.getrandbits(20) & r.getrandbits(20) & r.getrandbits(20) for _ in range(150)}]
    rows = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    from cairn.llm.components import connected_components
    from cairn.llm.gray_index import hamming_links

    got = {x.node: x.root for x in connected_components(hamming_links(rows, 3, most=8)).collect()}
    group = {v: v for v in values}
    for _ in range(6):
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    assert {v: got.get(v, v) for v in values} == group


def test_repeated_lines(spark):
    texts = ["alpha beta gamma delta\nonly here it is\n\n", "Alpha  BETA gamma delta\nonly there it was", None, "", "alpha beta gamma, delta\nalpha beta gamma delta"]
    got = {r.doc_id: r.lines for r in line_dedup.repeated_lines(table(spark, texts, False)).collect()}
    assert line_dedup.edit_distance("only here it is", "only there it was", 99) == 3  # of 17 characters: similar
    assert got == {1: [0, 1], 4: [0, 1]}
    out = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(table(spark, texts, False)).collect()}
    assert out == {0: texts[0], 1: "", 2: None, 3: "", 4: ""}
    assert line_dedup.without_repeated_lines(empty(spark)).count() == 0
    assert line_dedup.without_repeated_lines(table(spark)).count() == len(TEXTS) + 2


def test_edit_distance():
    r = random.Random(2)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        assert line_dedup.edit_distance(a, b, 99) == d[-1]


def test_batched_distances_equal_single_ones():
    r = random.Random(21)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    for low, high in ((1, 64), (65, 128), (300, 320)):
        pairs = []
        for _ in range(150):
            a = text(r.randint(low, high))
            b = list(a)
            for _ in range(r.randint(0, len(a) // 3)):
                k = r.randrange(len(b) + 1)
                b[k : k + r.randint(0, 1)] = text(r.randint(0, 2))
            b = "".join(b)[:high]
            pairs.append((a, b if len(b) >= low else a + "x"))
        d = [line_dedup.edit_distance(a, b, 999) for a, b in pairs]
        for slack in (0, 1):
            assert line_dedup.batch_within(pairs, [x - slack for x in d]) == [not slack] * len(pairs)


def test_decontamination_finds_replaced_words(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (20, 40, 15)]
    bench = spark.createDataFrame([*[(i, " ".join(w)) for i, w in enumerate(items)], (9, None), (None, "too short")], "item_id long, text string")
    spoilt = [x if i % 6 else "other" for i, x in enumerate(items[1])]
    texts = ["x y " + " ".join(items[0]).upper() + " z", " ".join(word() for _ in range(60)), " ".join(spoilt), None, ""]
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(table(spark, texts, False), bench).collect()}
    assert got == {(0, 0), (2, 1)}
    assert {x.doc_id for x in decontaminate.drop_contaminated(table(spark, texts, False), bench).collect()} == {1, 3, 4}
    assert decontaminate.overlaps(table(spark), bench.limit(0)).count() == 0


def test_toxicity_learns_and_scores_all(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["tree", "river", "stone", "cloud", "house"]) for _ in range(30)) + (" awful" if i % 4 == 0 else "") for i in range(400)]
    docs = table(spark, [*texts, None, ""], False)
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(400)] + [(None, 1), (401, None)], "doc_id long, toxic int")
    rows = toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 402
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)
    held = [x for x in rows if x.held_out and x.doc_id < 400]
    assert np.mean([x.predicted == (x.doc_id % 4 == 0) for x in held]) > 0.95
    assert toxicity.score_texts(docs, toxicity.fit(docs, labels.limit(0))).count() == 402


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7x?y", "x://com/en/", "https://m.example.net/de/81", "http://q.net/de/8", "ftp://org/es", "org/es/", None, "a://b?c", "http://example.org/es/1#f"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judge_urls(pages).collect()}
    assert got == {
        0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 1: ("com", "/en/", "com/en/", "block"), 2: ("m.example.net", "/de/81", "example.net/de/8", "block"),
        3: ("q.net", "/de/8", "net/de/", "allow"), 4: ("org", "/es", None, None), 5: ("", "", None, None), 6: ("", "", None, None), 7: ("b", "", None, None), 8: ("example.org", "/es/1", "org/es/", "block"),
    }
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_neighbours_recall(spark):
    x = np.random.default_rng(0).standard_normal((1500, 16))
    x[500:700] = x[500]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2050, [1.0])]
    rows = ann_search.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 1500, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = set(np.lexsort((np.arange(1500), -s))[:5].tolist())
        hit += len(want & {r.vec_id for r in rows if r.query_id == q})
    assert len(rows) == 150 and hit / 150 >= 0.9
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 500] == [501, 502, 503, 504, 505]


def test_recall_does_not_sink_with_the_batch(spark):
    x = np.random.default_rng(4).standard_normal((10_000, 32)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    try:
        got = ann_search.nearest(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 10_000, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 1000 and hit / 1000 >= 0.9


def test_licenses(spark):
    texts = ["before\nReleased under the MIT License.\nafter", "my permission slip\nand so on", "licensed  under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 1.1.", None, ""]
    got = {(r.doc_id, r.license) for r in license_scan.licenses(table(spark, texts, False)).collect()}
    assert got == {(0, "MIT"), (2, "Apache-2.0")}


def test_lm_base_equals_brute_force(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["The", "cat", "sat", "on", f"w{r.randint(0, 40)}"]) for _ in range(r.randint(0, 80))) for _ in range(120)] + [None, ""]
    rows = lm_scoring.score_texts(table(spark, texts, False), frequent=5).collect()
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for x in rows:
        t = tokens[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(x.score) and x.score <= 0
    assert lm_scoring.score_texts(empty(spark)).count() == 0


def test_changed_words_link_lines(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 7)))
    lines = [[word() for _ in range(n)] for n in (7, 9, 12, 15, 20, 30, 50, 90) for _ in range(12)]
    texts = [" ".join(w) for w in lines]
    for w in lines:
        at = min(range(len(w)), key=lambda i: len(w[i]))
        texts.append(" ".join([*w[:at], "xyzzy", *w[at + 1 :]]))
    n = len(lines)
    want = {n + i for i in range(n) if line_dedup.similar(texts[i], texts[n + i], 0.8)}
    got = {x.doc_id for x in line_dedup.repeated_lines(table(spark, texts, False)).collect()}
    assert len(want) > 80 and got <= want and len(got) >= 0.95 * len(want)


def test_one_letter_links_lines_of_any_length(spark):
    """Recall against brute-force edit similarity in each band of lengths, one letter changed."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8)))
    bands = [(2, 4), (5, 9), (10, 19), (20, 39), (40, 79), (80, 200)]
    lines = [(b, " ".join(word() for _ in range(r.randint(*band)))) for b, band in enumerate(bands) for _ in range(40)]
    texts = [x for _, x in lines]
    for _, x in lines:
        at = r.randrange(len(x))
        texts.append(x[:at] + "z" + x[at + 1 :])
    n = len(lines)
    got = {x.doc_id for x in line_dedup.repeated_lines(table(spark, texts, False)).collect()}
    for b in range(len(bands)):
        want = [n + i for i in range(n) if lines[i][0] == b and 1 / len(texts[i]) <= 0.2]
        assert len(set(want) & got) >= 0.9 * len(want), bands[b]


def test_line_groups_equal_brute_force():
    r = random.Random(13)
    lines = ["".join(r.choice("abc ") for _ in range(r.randint(3, 40))) for _ in range(60)]
    lines += [x[:k] + "z" + x[k:] for x in lines for k in (2,)] + [x[1:] for x in lines]
    lines = sorted({" ".join(x.split()) for x in lines} - {""}, key=len)
    group = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if group[i] != group[j] and line_dedup.edit_distance(x, lines[j], 99) <= 0.2 * max(len(x), len(lines[j])) + 1e-9:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert line_dedup.alike(lines, [len(lines)], 0.8).tolist() == group
    assert line_dedup.alike(lines * 2, [len(lines)] * 2, 0.8).tolist() == group + [len(lines) + g for g in group]


def test_lm_windows_hold_each_token_once():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding, size = lm_scoring.subwords(path)
    texts = [" ".join(f"w{i}x{k}" for k in range(n)).encode() for i, n in enumerate((0, 1, 30, 700))]
    w = lm_scoring.Windows(texts, lm_scoring.token_ids(path), size)
    got = [[] for _ in texts]
    for a in range(len(w.start)):
        ids, live = w.batch(np.array([a]))
        got[w.owner[a]] += ids[0, lm_scoring.CONTEXT + 1 :][live[0]].tolist()
    assert got == [[i for word in t.decode().split() for i in encoding.encode_ordinary(" " + word)] + [size] for t in texts]


def lm_of(texts):
    """A vocabulary and an untrained model over a few ids, counted by hand."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding, size = lm_scoring.subwords(path)
    n = np.zeros(size, np.int64)
    for t in texts:
        for w in t.split():
            np.add.at(n, encoding.encode_ordinary(" " + w), 1)
    pairs = np.log(np.random.default_rng(2).dirichlet(np.ones(lm_scoring.CLASSES), lm_scoring.CLASSES))
    return path, lm_scoring.Vocabulary(n, lm_scoring.starting_words(path)), lm_scoring.Attention(pairs)


def test_lm_probabilities_add_up_to_one():
    path, voc, model = lm_of(["the cat sat on the mat"] * 9)
    w = lm_scoring.Windows([b"the cat sat"], lm_scoring.token_ids(path), voc.end)
    ids, _ = w.batch(np.array([0]))
    c = voc.of[ids[:, lm_scoring.CONTEXT :]]
    x, before = voc.vector[ids[:, :-1]], c[:, :-1].ravel()
    total = np.zeros(len(before))
    for k in range(lm_scoring.CLASSES):
        total += np.exp(model.log_probabilities(x, before, np.full(len(before), k)))
    assert np.allclose(total, 1, atol=1e-5)
    assert np.allclose(np.bincount(voc.of, np.exp(voc.share), lm_scoring.CLASSES)[np.unique(voc.of)], 1)


def test_lm_gradients_equal_differences():
    path, voc, model = lm_of(["a few words and more of them"] * 5)
    w = lm_scoring.Windows([b"a few words and more " * 9], lm_scoring.token_ids(path), voc.end)
    ids, live = w.batch(np.arange(len(w.start)))
    c = voc.of[ids[:, lm_scoring.CONTEXT :]]
    args = (voc.vector[ids[:, :-1]], c[:, :-1].ravel(), c[:, 1:].ravel())
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.group, model.member, model.seen = (v.astype(np.float64) for v in (model.group, model.member, model.seen))
    loss = lambda: -(model.log_probabilities(*args) * live.ravel()).sum() / live.sum()
    d = model.gradients(*args, live.ravel().astype(np.float64))
    r = np.random.default_rng(3)
    for name, g in d.items():
        best = np.argsort(-np.abs(g.ravel()))[:20]
        for at in r.choice(best, 3, replace=False):
            flat = model.p[name].reshape(-1)
            old = flat[at]
            flat[at] = old + 1e-5
            high = loss()
            flat[at] = old - 1e-5
            low = loss()
            flat[at] = old
            assert math.isclose((high - low) / 2e-5, g.ravel()[at], rel_tol=2e-2, abs_tol=1e-6), name


def test_lm_score_does_not_depend_on_what_is_broadcast(spark):
    r = random.Random(14)
    texts = [" ".join(r.choice(["the", "cat", "sat", f"w{r.randint(0, 30)}", f"rare{i}"]) for _ in range(r.randint(5, 40))) for i in range(60)]
    docs = table(spark, texts, False)
    few, all_ = ({x.doc_id: x for x in lm_scoring.score_texts(docs, frequent=n).collect()} for n in (3, 100_000))
    for i, x in all_.items():
        assert math.isclose(few[i].score, x.score, rel_tol=1e-4) and few[i].n_known == x.n_known and math.isclose(few[i].base_score, x.base_score, rel_tol=1e-9)


def test_masks_hit_every_overlap():
    """All placements of the replaced tokens, for items of each length: some mask lies between them."""
    for n in range(1, 19):
        masks = [tuple(range(decontaminate.short_run(n, 0.8)))] if n < 13 else decontaminate.MASKS
        for out in itertools.combinations(range(n), int(0.2 * n + 1e-9)):
            assert any(not {a + o for o in m} & set(out) for m in masks for a in range(n - m[-1]))


def test_overlaps_of_repeated_words_and_many_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "tick " * 300), (2, " ".join(f"u{k}" for k in range(20)))], "item_id long, text string")
    docs = table(spark, ["tick " * 5000, " ".join(f"u{k}" for k in range(20)), None, ""], False)
    want = {(0, 1), (1, 2)}
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    monkeypatch.setattr(decontaminate, "HITS", 1000)
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, bench).collect()} == want
    assert {x.doc_id for x in decontaminate.drop_contaminated(docs, bench).collect()} == {2, 3}


def test_short_license_notices_inside_prose(spark):
    r = random.Random(15)
    prose = lambda n: " ".join("".join(r.choice("abcdefghinorst") for _ in range(6)) for _ in range(n))
    notices = {"MIT": "Released under the MIT License.", "BSD-3-Clause": "Released under the BSD 3-Clause License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    want = [(k, t) for k, t in notices.items() for _ in range(5)]
    texts = [f"{prose(n)}. {t} {prose(n)}" for n in (30, 60, 150) for _, t in want] + ["Released under the Foo License."]
    got = {(x.doc_id, x.license) for x in license_scan.licenses(table(spark, texts, False)).collect()}
    assert got == {(i, want[i % len(want)][0]) for i in range(3 * len(want))}


def test_wrapped_and_neighbouring_licenses(spark):
    full = {k: t for k, t in license_scan.TEMPLATES if t.startswith(("Permission is", "Redistribution and"))}
    wrapped = ["\n".join(f" * {x}" for x in textwrap.wrap(t, 60)) for t in full.values()]
    texts = [*wrapped, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "word " * 400 + wrapped[0]]
    got = sorted((x.doc_id, x.license) for x in license_scan.licenses(table(spark, texts, False)).collect())
    assert got == [(0, "MIT"), (1, "BSD-3-Clause"), (2, "Apache-2.0"), (2, "MIT"), (3, "MIT")]


def test_decontamination_finds_replaced_ends_and_short_items(spark):
    items = [[f"i{n}w{k}" for k in range(n)] for n in (1, 3, 5, 7, 10, 12, 13, 14, 15, 20)]
    bench = spark.createDataFrame([(len(w), " ".join(w)) for w in items], "item_id long, text string")
    places = {5: [(0,), (2,), (4,)], 7: [(0,), (3,)], 10: [(4, 5), (0, 9)], 12: [(0, 11), (4, 8)], 13: [(0, 12), (4, 8)], 14: [(0, 13)], 15: [(0, 1, 14), (3, 7, 11)]}
    texts, want = [], set()
    for w in items:
        for out in [(), *places.get(len(w), [])]:
            want.add((len(texts), len(w)))
            texts.append(" ".join(["before", *["other" if k in out else x for k, x in enumerate(w)], "after"]))
    texts.append(" ".join("other" if k in (0, 3, 6) else x for k, x in enumerate(items[4])))
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(table(spark, texts, False), bench).collect()}
    assert got == want


def test_trees_judge_urls_without_a_rule(spark):
    """Blocked hosts have many digits and long queries, others haven't; hosts without a rule are judged alike, by the trees alone."""
    r = random.Random(31)
    word = lambda n: "".join(r.choice("abcdefghikl") for _ in range(n))

    def url(bad, tld):
        host = f"{word(3)}{r.randint(1000, 9999)}.{tld}" if bad else f"{word(9)}.{tld}"
        return f"https://{host}/{word(5)}" + (f"?a={r.randint(0, 9999)}&b={r.randint(0, 9999)}&c=1" if bad else "")

    kinds = [(bool(i % 2), "bad" if i % 2 else "good") for i in range(600)] + [(bool(i % 2), "info") for i in range(300)]
    pages = spark.createDataFrame([(i, url(*k)) for i, k in enumerate(kinds)] + [(None, url(False, "info")), (0, "x")], "page_id long, url string")
    got = url_filter.judge_urls(pages, [("bad/", "block"), ("good/", "allow")]).collect()
    assert len(got) == len(kinds) + 2 and sum(x.page_id is None for x in got) == 1
    free = [x for x in got if x.rule is None and x.page_id is not None and x.host]
    assert len(free) == 300 and np.mean([(x.verdict == "block") == kinds[x.page_id][0] for x in free]) > 0.95
    assert all(x.verdict == ("block" if kinds[x.page_id][0] else "allow") for x in got if x.rule)
    alone = url_filter.judge_urls(pages, []).collect()
    assert {(x.rule, x.verdict, x.score) for x in alone} == {(None, "allow", 0.5)}


def test_url_shares_of_many_suffixes(spark):
    known = spark.createDataFrame([(f"h{i}.com", "/en/", i % 2) for i in range(1500)], "host string, path string, y int")
    rows = spark.createDataFrame([(i, f"a.h{i}.com", "/xx") for i in range(1501)], "page_id long, host string, path string")
    got = {r.page_id: r for r in url_filter.with_shares(rows, known).collect()}
    assert len(got) == 1501
    assert all(math.isclose(got[i].domain_share, (1 + i % 2) / 3) for i in range(1500))
    assert (got[1500].domain_share, got[0].last_share, got[0].part_share) == (0.5, 751 / 1502, 0.5)
    own = url_filter.with_shares(known.withColumn("n", known.y), known).collect()
    assert {x.domain_share for x in own} == {0.5}  # a labelled row's host isn't in its own share


def test_lanes_equal_single_distances():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdé 漢🎉\0") for _ in range(n))
    for low, high in ((0, 5), (1, 64), (60, 130), (300, 420), (700, 900)):
        pairs = []
        for _ in range(60):
            a = text(r.randint(low, high))
            b = list(a)
            for _ in range(r.randint(0, len(a) // 3)):
                k = r.randrange(len(b) + 1)
                b[k : k + r.randint(0, 1)] = text(r.randint(0, 2))
            pairs.append((a, "".join(b) if r.random() < 0.8 else text(r.randint(low, high))))
        d = [line_dedup.edit_distance(a, b, 10**6) for a, b in pairs]
        for slack in (-30, -1, 0, 1, 20):
            assert line_dedup.lanes_within(pairs, [x - slack for x in d]) == [slack <= 0] * len(pairs)
            assert [line_dedup.edit_distance(a, b, x - slack) <= x - slack for (a, b), x in zip(pairs, d, strict=True)] == [slack <= 0] * len(pairs)


def test_sieve_drops_rows_and_loses_none(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id * 7919 - 9 as k", "cast(id as string) as text")
    keys = spark.range(0, 4000, 20).selectExpr("id * 7919 - 9 as k").unionAll(spark.range(3).selectExpr("-id - 100 as k"))
    got = {r.text for r in line_dedup.sifted(rows, keys).collect()}
    assert {str(i) for i in range(0, 4000, 20)} <= got and len(got) < 800
    monkeypatch.setattr(line_dedup, "SIEVE", 15)  # too small for its keys
    assert len(line_dedup.sifted(rows, rows.select("k")).collect()) == 4000
    assert line_dedup.sifted(rows, rows.select("k").limit(0)).count() == 0


def test_written_tables_leave_no_shuffles(spark):
    held = lambda: spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    files = lambda: {x for x in held() if "shuffle_" in x}
    before = files()
    out, _ = materialise(spark.range(5000).repartition(3, "id"), "no-shuffles")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert out.count() == 5000


def test_components_by_both_ways_in_few_jobs(spark):
    from cairn.llm.components import connected_components

    r = random.Random(21)
    pairs = [(i, i + 1) for i in range(60)] + [(500, 500 + r.randint(1, 300)) for _ in range(400)] + [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(150)] + [(7, 7), (None, 8)]
    group = {v: v for p in pairs for v in p if None not in p and p[0] != p[1]}
    for _ in range(100):
        for a, b in pairs:
            if a in group and b in group:
                group[a] = group[b] = min(group[a], group[b])
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("few-components", "")
    got = {x.node: x.root for x in connected_components(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-components"))
    spark.sparkContext._jsc.clearJobGroup()
    assert got == group and jobs <= 8
    assert {x.node: x.root for x in connected_components(edges, together=20).collect()} == group
    names = connected_components(edges.selectExpr("encode(lpad(a, 8, '0'), 'UTF-8') a", "encode(lpad(b, 8, '0'), 'UTF-8') b")).collect()
    assert {int(x.node): int(x.root) for x in names} == group


def test_compression_decides_what_is_confirmed_and_which_template(monkeypatch):
    r = random.Random(31)
    word = lambda k: "".join(r.choice("abcdefghinorst") for _ in range(k))
    # One template lacks a long word of the text, the other two short ones: fewer words are missing in the first, the second saves more bytes.
    words = ["licensed", "under", "the", word(7), word(7), "ab", *[word(7) for _ in range(4)], "cd", word(7), word(7), word(7), word(40)]
    text = " ".join(words).encode()
    templates = [("long", " ".join([*words[:-1], "zz"])), ("short", " ".join(words).replace(" ab ", " xx ").replace(" cd ", " yy "))]
    assert [x[2] for x in license_scan.Scanner(templates, 0.8).judge(text)] == ["short"]
    # Only windows that a template shortens are compared with its wording; no changed notice is lost by that.
    scanner, compared, passed = license_scan.Scanner(license_scan.TEMPLATES, 0.8), [], []
    wordings = scanner.wordings
    monkeypatch.setattr(scanner, "wordings", lambda i, words: (compared.append(len(words)), wordings(i, words))[1])
    for name, notice in license_scan.TEMPLATES:
        for _ in range(4):
            w = notice.split()
            for _ in range(len(w) // 5):
                k = r.randrange(len(w))
                if not any(c.isdigit() for c in w[k]) and w[k].lower().strip('.,();"') not in license_scan.NAMES:
                    w[k] = word(5)
            text = " ".join([*[word(6) for _ in range(40)], *w, *[word(6) for _ in range(40)]]).encode()
            monkeypatch.setattr(license_scan, "SAVED", -math.inf)
            compared.clear()
            want, whole = scanner.judge(text), sum(compared)
            monkeypatch.undo()
            monkeypatch.setattr(scanner, "wordings", lambda i, words: (compared.append(len(words)), wordings(i, words))[1])
            compared.clear()
            assert scanner.judge(text) == want
            passed.append(sum(compared) / whole)
    assert sum(passed) / len(passed) < 0.5


def test_counts_of_letters_bound_the_distance():
    r = random.Random(41)
    lines = ["".join(r.choice("abcdeé 漢") for _ in range(r.choice([0, 1, 2, 3, 40, 90]))) for _ in range(600)]
    triples, letters = line_dedup.letter_counts(lines)
    assert triples.sum(1).tolist() == [max(0, len(x) - 2) for x in lines] and letters.sum(1).tolist() == [len(x) for x in lines]
    assert (line_dedup.letter_counts(lines[300:301])[0] == triples[300]).all()
    for x, y in zip(range(600), range(1, 600), strict=False):
        d, m = line_dedup.edit_distance(lines[x], lines[y], 999), max(len(lines[x]), len(lines[y]))
        assert np.minimum(letters[x], letters[y]).sum() >= m - d and np.minimum(triples[x], triples[y]).sum() >= m - 2 - 3 * d
    pairs = [(lines[0] * 3 + "q" * k, lines[0] * 3 + "z" * k) for k in range(12)]
    for a, b in pairs:
        assert (line_dedup.alike([a, b], [2], 0.8)[1] == 0) == (1 - line_dedup.edit_distance(a, b, 999) / max(1, len(a)) >= 0.8)


def test_lines_are_written_small(spark, monkeypatch):
    written, materialise_ = [], line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda *a: (written.append(x := materialise_(*a)), x)[1])
    monkeypatch.setattr(line_dedup, "discard", lambda *a: None)
    assert line_dedup.repeated_lines(table(spark)).count() > 0
    names = [f.split("/")[-1] for f in written[0][0].inputFiles()]
    assert names and all(".zstd." in f for f in names)


def test_lm_encodes_each_word_once_as_the_library_does(library, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["Don't stop DON'T  stop\n", None, "", "a b \u0085  x \x1c y1'll İ", " the\x0bend ", "the end " * 50]
    words, at, owner = lm_scoring.words_of(pa.array(texts))
    split = [(t or "").encode().lower().split() for t in texts]
    assert [words[i].encode() for i in at] == [w for s in split for w in s] and owner.tolist() == [i for i, s in enumerate(split) for _ in s] and len(set(words)) == len(words)
    seen, encoded = [], lm_scoring.encoded
    monkeypatch.setattr(lm_scoring, "encoded", lambda path, words: seen.extend(words) or encoded(path, words))
    got = lm_scoring.token_ids(path).packed(words, at, owner, len(texts)).to_pylist()
    assert [np.frombuffer(x, np.uint16).tolist() for x in got] == [[i for w in s for i in library.encode_ordinary(" " + w.decode())] for s in split]
    assert seen[: len(words)] == words  # then once more those without white space of their own


def test_lm_blocks_of_attention_equal_plain_attention():
    _, _, model = lm_of(["one two three"])
    r, d, size = np.random.default_rng(8), lm_scoring.WIDTH, lm_scoring.BLOCK
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.p["P"] = r.standard_normal(model.p["P"].shape)
    x = r.integers(0, lm_scoring.VECTORS, (2, lm_scoring.WINDOW))
    got = model.forward(x)[-1].reshape(2, lm_scoring.STRIDE, d)
    p = model.p
    for b in range(2):
        e = p["E"][x[b]]
        for t in range(lm_scoring.CONTEXT, lm_scoring.WINDOW):
            first = t // size * size - size
            w = np.exp(np.array([e[t] @ p["Q"] @ e[j] + p["P"][t % size, j - first] for j in range(first, t + 1)]))
            h = e[t] + (w / w.sum()) @ e[first : t + 1] @ p["V"]
            assert np.allclose(got[b, t - lm_scoring.CONTEXT], h + np.maximum(h @ p["A"] + p["a"], 0) @ p["B"], atol=1e-5)


def test_shared_words_prove_similarity_without_exact_distances(monkeypatch):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 5)))
    for _ in range(500):
        v = [word() for _ in range(r.randint(1, 25))]
        w = [x for x in v if r.random() > 0.15]
        for _ in range(r.randint(0, 3)):
            w.insert(r.randint(0, len(w)), word())
        if r.random() < 0.2:
            r.shuffle(w)
        a, b = " ".join(v), " ".join(w)
        d = line_dedup.edit_distance(a, b, 999)
        assert not line_dedup.patched(a, b, d - 1) and line_dedup.patched(a, b, len(a) + len(b))
    monkeypatch.setattr(line_dedup, "within", None)
    line = [f"word{k}" for k in range(60)]
    assert line_dedup.similar(" ".join(line), " ".join(["new", *line[:20], "other", "words", *line[24:50], *line[51:]]), 0.8)
