"""Plain versions of what the operators compute, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text):
    return WORD.findall(text or "")


def exact(rows):
    """[(doc_id, text)] with distinct ids -> {doc_id: (keep_id, group_size, kept, sha)}"""
    groups = defaultdict(list)
    for i, text in rows:
        groups["".join(words(text))].append((-len(text or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, sha(bare)) for bare, g in groups.items() for _, i in g}


def fingerprint(text):
    found = words((text or "").translate(LOWER))
    if not found:
        return 0
    shingles = [" ".join(found[i: i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, distance=3):
    """[(doc_id, text)] -> {doc_id: (hex, component)}"""
    ids = sorted(i for i, _ in rows)
    of = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (of[a] ^ of[b]).bit_count() <= distance and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{of[i]:016x}", find(i)) for i in ids}


def repeats(rows, length):
    """[(doc_id, text)] -> {doc_id: (n_bytes, n_removed, n_spans, sha of the rest)}"""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k: k + length] for _, b in data for k in range(len(b) - length + 1))
    out = {}
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k: k + length]] > 1:
                gone[k: k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    found, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(found[i: i + 3]) for i in range(len(found) - 2))
    again = {i + k for i in range(len(found) - 2) if windows[tuple(found[i: i + 3])] > 1 for k in range(3)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def only_digits(match):
    return re.sub("[^0-9]", "", match)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m)) <= 15),
)


def pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PII for m in re.finditer(p, text or "") if ok(m[0])]


def base_scores(rows, training):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}; ``training`` tells which ids are learned from."""
    tokens = {i: words((t or "").translate(LOWER)) + ["\n"] for i, t in rows}
    counts = Counter(w for i, found in tokens.items() if training(i) for w in found)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (len(f), sum(counts[w] > 0 for w in f), n, sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in f))
        for i, f in tokens.items()
    }
