"""Plain Python versions of what the operators compute, for small tables."""

import collections
import hashlib
import itertools
import re
import zlib


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def ws_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def contamination(docs, items, window=13):
    wins = collections.defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            wins[tuple(w[i : i + window])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                own = wins.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        names = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def exact_groups(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in enumerate(t for _, t in docs)}
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[norm[i]].append(d)
    out = []
    for i, (d, _) in enumerate(docs):
        g = groups[norm[i]]
        keep = min((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256(norm[i].encode()).hexdigest()))
    return out


def near_groups(docs, k=3, percent=85):
    sets = {}
    for d, t in docs:
        w = ws_words(folded(t))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [(d, len(sets[d]), find(d), find(d) == d) for d in sets]


def removed_words(docs, window=50):
    seen, out = {}, []
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = ws_words(t)
        covered = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen.get(tuple(w[i : i + window]), d) < d:
                covered[i : i + window] = [True] * window
            else:
                seen.setdefault(tuple(w[i : i + window]), d)
        kept = " ".join(x for x, c in zip(w, covered) if not c)
        out.append((d, len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_scores(docs, held):
    import math

    tokens = {d: [*ws_words(folded(t)), None] for d, t in docs}
    counts = collections.Counter(x for d, w in tokens.items() if not held(d) for x in w)
    n, v = sum(counts.values()), len(counts)
    return {d: (held(d), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for d, w in tokens.items()}


def held_out(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b
