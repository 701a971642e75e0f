from __future__ import annotations

import random
from itertools import permutations

import pytest

from tallyframe.llm import audit

from .brute import SPACED

LABELS = "doc_id long, quality int, toxic int, mask int, n string"


def brute(rows, labels):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc_id, text, lang in rows:
        t = text or ""
        w = SPACED.findall(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and doc_id > least[t],
        }
        parts.setdefault(lang or "", []).append((frozenset(f for f in fails if fails[f]), doc_id in good, doc_id in toxic))
    out = []
    for part, docs in parts.items():
        removed_of, block = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                earlier = set(order[:step])
                here = [d for d in docs if f in d[0] and not d[0] & earlier]
                removed_of[f] += len(here)
                block.append((
                    part, "".join(order), step + 1, sum(not d[0] & {*earlier, f} for d in docs), len(here),
                    sum(f in d[0] and bool(d[0] & earlier) for d in docs), sum(d[0] == {f} for d in docs),
                    sum(d[1] for d in here), sum(d[2] for d in here), f,
                ))
        out += [(*r[:-1], removed_of[r[-1]]) for r in block]
    return sorted(out)


@pytest.fixture(scope="module")
def labels(corpus_rows):
    rng = random.Random(2)
    ids = [i for i, _ in corpus_rows]
    return [(rng.choice(ids), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1), (99999, 1, 1)]


def run(spark, df, labels):
    got = audit.filter_audit(df, spark.createDataFrame([(*r, 3, "x") for r in labels], LABELS))
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("trie_bytes", [audit.TRIE_BYTES, 3_000, 0])
def test_against_brute_force(spark, messy, labels, monkeypatch, trie_bytes):
    monkeypatch.setattr(audit, "TRIE_BYTES", trie_bytes)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in messy.collect()]
    assert run(spark, messy, labels) == brute(rows, labels)


def test_each_filter_at_its_limit(spark, labels):
    words = [f"w{i}" for i in range(100)]
    texts = [
        " ".join(words), " ".join(words[:99]), " ".join(words[:80] + words[:20]), " ".join(words[:79] + words[:21]),
        "A" + "b" * 9, "AA" + "b" * 9, "É" * 50 + "AAAAA", "x # y", "x ~ y", "", None, " ".join(words),
    ]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert run(spark, df, labels) == brute(rows, labels)


def test_hot_text_and_shared_prefixes(spark):
    head = "Shared header of all texts, longer than the prefix that orders them among each other. " * 3
    rng = random.Random(1)
    rows = [(i, head + ("same" if i % 3 else str(i % 40)), "en") for i in range(3_000)]
    rows += [(i, "y" * 3_000_000 + str(i % 2), "de") for i in range(4_000, 4_004)]  # very long texts
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9)
    assert run(spark, df, [(1, 1, 1), (2, 1, 0)]) == brute(rows, [(1, 1, 1), (2, 1, 0)])


def test_hot_text_leaves_a_task_once(spark):
    rows = [(5_000 - i, "the very same text " * 50, "en") for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").coalesce(1)
    audit.ship(spark)
    out = df.mapInArrow(audit._local_minima(audit.DEFAULT_RULES), audit._TERMINALS)
    assert out.where("held").count() == 1 and out.where("not held").count() == 3_999


def test_empty_tables(spark, corpus, labels):
    none = corpus.where("doc_id < -1")
    assert run(spark, none, labels) == []
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in corpus.collect()]
    assert run(spark, corpus, []) == brute(rows, [])


def test_trie():
    rng = random.Random(8)
    texts = {bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)}
    trie = audit.Trie()
    for t in texts:
        trie.terminal(t).held = audit.Held(len(t), 0)
    assert {t: node.held.doc_id for t, node in trie.terminals()} == {t: len(t) for t in texts}
    assert trie.bytes < sum(map(len, texts))
    assert all(len(n.children) != 1 or n.held is not None for n in _below(trie.root) if n is not trie.root)


def _below(node):
    yield node
    for child in node.children.values():
        yield from _below(child)
