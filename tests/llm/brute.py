"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    starts = {}
    for i in range(len(words) - 7):
        starts.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in starts.values() if len(at) > 1 for i in at for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered), failed,
    )


def substring_kept(rows, window=20):
    """[(n_words, kept words)] of (doc_id, text) rows."""
    below = -(1 << 63)
    rows = [(below if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, words in rows:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, words in rows:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        out.append((len(words), [w for i, w in enumerate(words) if i not in gone]))
    return out


def shingles(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard_pairs(sets):
    """Linked pairs of (id, set) rows, a < b, found through shared shingles."""
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    both = {}
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                key = (min(a, b), max(a, b))
                both[key] = both.get(key, 0) + 1
    return {(a, b) for (a, b), k in both.items() if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k)}


def rebuilt(conversations):
    """Conversations whose first turns are those of the first of their twenty."""
    out = {}
    for conv, turns in conversations.items():
        head = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20 if conv >= 0 else -(abs(conv) % 20))
        out[conv] = conversations.get(base, [])[:head] + turns[head:]
    return out


def variants(rows, least_letters=7, least_count=2, ratio=10):
    """{word: (form, root, n, n_near, form_n)} of (id, text) rows."""
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    near = near_words(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def near_words(words):
    """{word: words within one edit}"""
    near, less = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            less.setdefault((i, rest), []).append(w)
            if rest in near:
                near[w].add(rest)
                near[rest].add(w)
    for alike in less.values():
        for w in alike:
            near[w].update(x for x in alike if x != w)
    return near
