"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

BLANK = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = BLANK.findall((text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similar(a, b, percent=80):
    return bool(a) and 100 * len(a & b) >= percent * len(a | b)


def groups(names, linked):
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in names}


def ngram_join(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similar(sets[a], sets[b], percent)]
    found = groups(ids, linked)
    return {(d, len(sets[d]), found[d]) for d in ids}


def quality(text):
    text = text or ""
    words = BLANK.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def contamination(docs, items, window=10):
    out = set()
    asked = [(i, ALNUM.findall((t or "").translate(UPPER))) for i, t in items]
    for d, t in docs:
        words = ALNUM.findall((t or "").translate(UPPER))
        hit, names = set(), set()
        for i, x in asked:
            size = min(len(x), window)
            for k in range(len(x) - size + 1) if size else ():
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == x[k : k + size]:
                        hit |= set(range(j, j + size))
                        names.add(str(i))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.add((d, len(words), len(hit), len(names), digest, bool(hit)))
    return out


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def repeated_words(docs, size=50):
    """Words of each document inside a window of `size` words that comes again, not overlapping in its own document."""
    places = {}
    for d, t in docs:
        words = BLANK.findall((t or "").translate(UPPER))
        for k in range(len(words) - size + 1):
            places.setdefault(tuple(words[k : k + size]), []).append((d, k))
    out = {}
    for at in places.values():
        (d, low), (e, high) = min(at), max(at)
        if d != e or high - low >= size:
            for x, k in at:
                out.setdefault(x, set()).update(range(k, k + size))
    return out
