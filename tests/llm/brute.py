"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import collections
import hashlib
import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def decontaminated(docs, items, n=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = alnum(text)
        k = min(n, len(words))
        for at in range(len(words) - k + 1 if words else 0):
            windows[tuple(words[at : at + k])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = alnum(text), set(), set()
        for k in lengths:
            for at in range(len(words) - k + 1):
                if (own := windows.get(tuple(words[at : at + k]))) is not None:
                    hit.update(range(at, at + k))
                    found |= own
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(words), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def repeats(docs, n=13):
    first = {}
    for doc, text in docs:
        if doc is not None:
            words = spaced(text)
            for at in range(len(words) - n + 1):
                key = tuple(words[at : at + n])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in docs:
        words, gone = spaced(text), set()
        for at in range(len(words) - n + 1 if doc is not None else 0):
            if first[tuple(words[at : at + n])] < doc:
                gone.update(range(at, at + n))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def components(docs, n=5):
    sets, parent = [], {}
    for _, text in docs:
        words = spaced(lower(text or ""))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    for doc, _ in docs:
        parent[doc] = doc

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if None in (docs[i][0], docs[j][0]):
                continue
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(docs[i][0]), find(docs[j][0])
                parent[max(a, b)] = min(a, b)
    return [(doc, len(s), None if doc is None else find(doc), True if doc is None else find(doc) == doc) for (doc, _), s in zip(docs, sets, strict=True)]
