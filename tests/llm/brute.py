"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else bytes(data)).hexdigest()


def documents(rows):
    """Distinct (doc_id, text), in order: null ids last."""
    return sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def licenses(text):
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    words = LETTERED.findall(lower(text))
    places = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def measures(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def first_occurrences(rows, window):
    """{(doc_id, text): (n_words, n_removed, sha)}"""
    seen, out = {}, {}
    for doc_id, text in documents(rows):
        words = SPACED.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i : i + window]), (doc_id, text, i)) != (doc_id, text, i):
                gone[i : i + window] = [True] * window
        out[doc_id, text] = len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def repeated_bytes(rows, length):
    docs = {r: (r[1] or "").encode() for r in documents(rows)}
    often = Counter(b[i : i + length] for b in docs.values() for i in range(len(b) - length + 1))
    out = {}
    for key, b in docs.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def shingles(text, k):
    words = SPACED.findall(lower(text))
    if len(words) >= k:
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def near_components(rows, k, percent):
    """{(doc_id, text): (set size, smallest id reachable)}, for tables whose ids are all known."""
    docs = documents(rows)
    sets = [shingles(text, k) for _, text in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[i]), docs[find(i)][0]) for i, d in enumerate(docs)}


def line_runs(rows, run):
    """{(doc_id, text): (n_lines, n_removed, text left)}"""
    seen, out = {}, {}
    for doc_id, text in documents(rows):
        lines = (text or "").split("\n")
        bare = [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate(lines)]
        worded = [(i, x) for i, x in bare if x]
        gone = [False] * len(worded)
        for n in range(len(worded) - run + 1):
            key = tuple(x for _, x in worded[n : n + run])
            if seen.setdefault(key, (doc_id, text, n)) != (doc_id, text, n):
                gone[n : n + run] = [True] * run
        state = {i: g for (i, _), g in zip(worded, gone, strict=True)}
        left = []
        for i, line in enumerate(lines):
            if i in state:
                keep = not state[i]
            else:
                before = [state[j] for j in range(i - 1, -1, -1) if j in state][:1]
                after = [state[j] for j in range(i + 1, len(lines)) if j in state][:1]
                keep = not (before == [True] and after == [True])
            if keep:
                left.append(line)
        out[doc_id, text] = len(worded), sum(gone), None if text is None else "\n".join(left)
    return out
