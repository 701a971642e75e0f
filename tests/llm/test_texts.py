"""Operators on single texts and pages against their brute-force versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tallyframe.llm import bpe, decontaminate, html, langid, licenses, quality, texts

from . import brute

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_words_are_those_of_the_pattern(corpus_rows):
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in corpus_rows])], names=["text"])
    for members, lower, pattern in ((texts.SPACED, False, brute.SPACED), (texts.LETTERED, True, brute.LETTERED)):
        got, codes = [], {}
        for chunk in texts.chunks(iter([batch]), limit=4000):
            found = texts.words(chunk, members, lower)
            data = chunk.bytes.tobytes()
            for row in range(len(found.first) - 1):
                span = slice(found.first[row], found.first[row + 1])
                own = [data[a:b].decode() for a, b in zip(found.start[span], found.end[span], strict=True)]
                own = [brute.lower(w) for w in own] if lower else own
                for w, c in zip(own, found.codes[span].tolist(), strict=True):
                    assert codes.setdefault(w, c) == c
                got.append(own)
        assert got == [pattern.findall(brute.lower(t) if lower else t or "") for _, t in corpus_rows]
        assert len(set(codes.values())) == len(codes)


def test_sliding_min_and_inner_windows():
    values = np.random.default_rng(3).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 13, 200):
        assert texts.sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(200 - width + 1)]
    assert texts.inner_windows(np.array([0, 3, 3, 8, 9]), 3).tolist() == [0, 3, 4, 5]


@pytest.mark.parametrize("name", ["corpus", "messy", "nothing"])
def test_licenses(name, request):
    table = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = licenses.license_report(table).collect()
    want = Counter((i, *brute.licenses(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_wording_with_changes(spark):
    mit = next(t.text for t in licenses.TEMPLATES if t.text.startswith("permission"))
    words = mit.split()
    changed = " ".join(w for i, w in enumerate(words) if i not in (9, 30)).replace("software", "program", 1)
    rows = [(1, f"before {changed.upper()} after"), (2, "permission is hereby granted to enter"), (3, "licensed under cc by-nc 4.0 indeed")]
    got = {r.doc_id: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and 0.9 < got[1].score < 1 and got[1].n_base == 0
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "cc-by,cc-by-nc"


@pytest.mark.parametrize("name", ["corpus", "messy", "nothing"])
def test_quality(name, request):
    table = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = quality.quality_report(table).collect()
    want = Counter()
    for i, t in rows:
        m = brute.measures(t)
        want[(i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality.kept_documents(table)
    assert kept.columns == table.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_hosts_are_shrunk_and_judged(spark):
    """A host of junk is held to the stricter limits; one of two documents is not."""
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("aeiourtnls") for _ in range(5)) for _ in range(60))
    mild = lambda: good() + " ### ### ### ### ###"  # noqa: E731  between the two limits
    junk = "a b c"
    rows = [(i, junk, "bad") for i in range(90)] + [(100 + i, mild(), "bad") for i in range(5)] + [(110, good(), "bad")]
    rows += [(200 + i, good(), f"h{i % 10}") for i in range(300)] + [(600, junk, "tiny"), (601, mild(), "tiny")]
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[100].host_rejected and not got[100].kept and got[110].kept
    assert not got[601].host_rejected and got[601].kept


def test_overlaps_tolerate_substitutions(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (40, 40, 30, 8, 2)]
    noise = lambda n: [word() for _ in range(n)]
    swapped = [w if i % 7 else word() for i, w in enumerate(items[1])]
    rows = [
        (1, " ".join([*noise(50), *items[0], *noise(50)])),
        (2, " ".join([*noise(10), *swapped, *noise(10)]).upper()),
        (3, " ".join([*noise(30), *items[2][5:25], *noise(30)])),
        (4, " ".join([*noise(30), *items[2][5:12], *noise(30)])),
        (5, " ".join([*noise(9), *items[3], *noise(9)])),
        (6, " ".join([*items[4], *noise(20)])),
        (7, None), (8, ""), (1, " ".join(noise(40))), (None, " ".join(items[0])),
    ]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (9, "")], "item_id long, text string")
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination_report(documents, benchmark).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (5, 3), (None, 0)}
    assert got[1, 0].n_matched == 40 and (got[1, 0].first_word, got[1, 0].end_word) == (50, 90)
    assert got[3, 2].n_matched == 20
    clean = decontaminate.clean_documents(documents, benchmark)
    assert sorted((r.doc_id for r in clean.collect()), key=str) == [1, 4, 6, 7, 8]
    assert decontaminate.contamination_report(documents, benchmark.limit(0)).collect() == []
    assert decontaminate.contamination_report(documents.limit(0), benchmark).collect() == []


def test_tokens_are_those_of_the_library(corpus_rows, corpus):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = Counter(tuple(r) for r in bpe.token_digests(corpus, RANKS, public_tokenizers.PATTERN).collect())
    want = Counter()
    for r in corpus.select("doc_id", "text").collect():
        ids = encoding.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha(r.text or ""))] += 1
    assert got == want


def test_long_words_merge_alike():
    rng = random.Random(4)
    ranks = bpe.load_ranks(RANKS)
    for _ in range(200):
        word = "".join(rng.choice("theinar ") for _ in range(rng.randint(2, 400))).encode()
        assert bpe._merge_long(word, ranks) == bpe._merge_short(word, ranks)


def test_encoding_keeps_columns(corpus, nothing):
    out = bpe.decode(bpe.encode(corpus, RANKS, public_tokenizers.PATTERN), RANKS)
    assert set(out.columns) == {*corpus.columns, "decoded"} - {"ids"}
    assert all((r.text or "").encode() == bytes(r.decoded) for r in out.select("text", "decoded").collect())
    assert bpe.token_digests(nothing, RANKS, public_tokenizers.PATTERN).collect() == []


def test_languages_held_out(spark):
    rng = random.Random(6)
    syllables = {"aa": "ka to mi ru se no ha".split(), "bb": "schen ung ver lich keit er".split(), "cc": "tion ment eau que les oi".split()}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(25))
    rows = [(i, make(lang), lang) for i, lang in enumerate(rng.choices(list(syllables), k=600))]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ²³ !?", "cc"), (1003, make("aa"), None), (None, make("bb"), "bb")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = langid.language_report(table).collect()
    assert len(got) == len(rows)
    truth = dict((r[0], r[2]) for r in rows)
    out = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(out) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    named = {r.doc_id: r for r in got}
    assert [(named[i].lang_pred, named[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert named[1003].lang_pred == "aa"
    assert all(r.held_out == (r.doc_id is not None and _crc(r.doc_id) % 4 == 2) for r in got)


def _crc(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


def test_language_bounds_and_no_training(spark, nothing):
    assert langid.language_report(nothing).collect() == []
    table = spark.createDataFrame([(i, "some words here", None) for i in range(5)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.language_report(table).collect()} == {("und", 0.0)}
    rows = [(i, f"wort{i % 7} nicht und", "de") for i in range(300)] + [(1000 + i, f"word{i % 5} the and", "en") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, langid.Bounds(rows_per_language=40, words_per_language=3, grams_per_language=40))
    assert model.languages == ["de", "en"] and {"nicht", "und", "the", "and"} <= set(model.words) and len(model.words) <= 6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies for many good reasons which we list here at some length for you.</p></div>
<article class="post"><h1>A &amp; B&nbsp;title</h1><p>First <b>bold</b> para<br>graph.<p>One.<div class="ad">Buy now</div>
<form><label>Mail</label><input></form><ul><li>item <a href="/y">link</a></ul></article>
<div class="comments"><article><p>Great article, thank you so much for all the work that went into this text.</p></article></div>
<aside><p>Related reading of some length that is not part of the article at all, really.</p></aside>
<!-- <p>gone</p> --><footer>&copy; 2020</footer></body></html>"""


def test_pages(spark):
    words = "Plain pages have no article element but long paragraphs of text in which few words are links at all. "
    plain = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h1>Heading</h1><p>{words * 2}</p><p>Short.</p><p>{words}</p><div>Contact</div>"
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", plain), (None, "u", "<p>"), (5, "u", "<a href='" * 50), (1, "u", PAGE), (6, "u", "<!-- open")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.page_texts(table).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == "A & B title\nFirst bold para graph.\nOne.\nitem link"
    assert by_id[4].split("\n") == ["Heading", (words * 2).strip(), "Short.", words.strip()]
    assert [by_id[i] for i in (2, 3, None, 6)] == [""] * 4
    assert html.page_texts(table.limit(0)).collect() == []
    kept = html.extract(table.withColumn("text", table.url).withColumn("words", table.page_id))
    assert kept.columns == ["page_id", "url", "text", "words"]


def test_tree_fits_its_table():
    table = np.array(html.LABELLED, dtype=float)
    tree = html.default_tree()
    assert all(html.classify(tree, row[:-1].tolist()) == bool(row[-1]) for row in table)


def test_digest_helper():
    assert brute.sha("x") == hashlib.sha256(b"x").hexdigest()


def test_only_texts_with_runs_of_a_license_move(spark):
    rows = [(1, "all rights reserved here"), (2, "nothing of the kind " * 50), (3, None), (4, "rights all reserved")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.packed is not None) for r in licenses.candidate_texts(documents, licenses.TEMPLATES).collect()}
    assert got == {1: (4, True), 2: (200, False), 3: (0, False), 4: (3, False)}
    assert {r.doc_id: r.n_words for r in licenses.license_report(documents).collect()} == {1: 4, 2: 200, 3: 0, 4: 3}


def test_unpacked_batches_are_bounded_by_their_texts():
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    given = [b"x" * 600, None, b"y" * 500, b"", b"z" * 5000, b"w" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array([None if t is None else pack(t) for t in given], pa.binary())], names=["packed"])
    parts = [b.column(0).to_pylist() for b in texts.unpacked(iter([batch]), limit=1000)]
    assert [t for part in parts for t in part] == given
    assert all(len(part) == 1 or sum(len(t or b"") for t in part) <= 1000 for part in parts)
