"""Plain single-process forms of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def substring_dedup(docs, width=35):
    words = [BLANK.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def byte_dedup(docs, width=200):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for (doc, _), d in zip(docs, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone, strict=True) if not g))))
    return out


def lower_ascii(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, k=5):
    words = BLANK.findall(lower_ascii(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, percent=75):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(d for d in sets if sets[d])
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = roots(sets, links)
    return [(d, len(sets[d]), root[d]) for d in sets]


def decontaminate(docs, items, width=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {}
    for item, text in items:
        w = word.findall(lower_ascii(text or ""))
        if w:
            for i in range(max(1, len(w) - width + 1)):
                phrases.setdefault(tuple(w[i : i + width]), set()).add(item)
    lengths = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        w = word.findall(lower_ascii(text or ""))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if items_of := phrases.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= items_of
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), sha(names.encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def spelled_words(docs):
    """Occurrences of the words of op11, with the planted misspellings."""
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2 and len(w) >= 7}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def spelling_groups(words, ratio=10):
    """Plain comparison of all pairs of words."""
    near = {w: [] for w in words}
    ordered = sorted(words)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return out


def word_runs(words, min_length=6, min_exponent=4):
    """Every run as start, length and period: each period's maximal stretches, the smallest period of each stretch."""
    out = {}
    for q in range(len(words) // min_exponent, 0, -1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                out[i, j + q - i] = q
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted_runs(docs):
    """Rows of op13."""
    out = []
    for doc, text in docs:
        w = BLANK.findall(text or "")
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = word_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        milli = None if not runs else 1_000 * best[1] // best[2]
        out.append((doc, len(runs), *best, milli, sha(lines.encode()), sha(collapsed(w, runs).encode())))
    return out
