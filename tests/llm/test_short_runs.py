"""Short line runs that hold many words, against brute force."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from tallyframe.llm import lines

from . import brute


def wordy_runs(rows, run, min_words):
    """{(doc_id, text): numbers of the lines with a word that go}"""
    seen, out = {}, {}
    for doc_id, text in brute.documents(rows):
        worded = [x for x in (y.strip(" \t\n\r\x0b\x0c") for y in (text or "").split("\n")) if x]
        gone = set()
        for n in range(1, run + 1):
            for i in range(len(worded) - n + 1):
                key = tuple(worded[i : i + n])
                if n == run or sum(len(brute.SPACED.findall(x)) for x in key) >= min_words:
                    if seen.setdefault(key, (doc_id, text, i)) != (doc_id, text, i):
                        gone |= set(range(i, i + n))
        out[doc_id, text] = len(worded), len(gone), [x for i, x in enumerate(worded) if i not in gone]
    return out


@pytest.mark.parametrize("name", ["corpus", "messy"])
def test_wordy_runs(name, request):
    table = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    rows += [(1000 + i, f"{t}\nown line {i}") for i, t in enumerate(x for _, text in rows[:20] for x in (text or "").split("\n")[:2])]
    more = table.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = wordy_runs(rows, 3, 8)
    bare = lambda t: [x for x in (y.strip(" \t\n\r\x0b\x0c") for y in (t or "").split("\n")) if x]
    got = [(r.doc_id, r.n_lines, r.n_removed, str(bare(r.text))) for r in lines.line_report(more, min_words=8).collect()]
    assert Counter(got) == Counter((r[0], *want[r][:2], str(want[r][2])) for r in rows)


def test_stage_takes_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(20))
    half, other = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    texts = [long, long, f"{long}\nshort", f"x\n{half}\n{other}", f"{half}\n{other}\ny", f"{half}\nz", " ".join(f"w{i}" for i in range(19))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert left == {0: long, 2: "short", 3: texts[3], 4: "y", 5: texts[5], 6: texts[6]}
