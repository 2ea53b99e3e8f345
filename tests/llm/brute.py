"""Plain Python versions of what the operators must return."""

import hashlib
import re
from collections import defaultdict
from itertools import pairwise

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i:i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def shingles(text, k=5):
    words = SPACE.findall(low(text))
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def near_components(rows, percent=85):
    """doc_id -> smallest id reachable."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for at in where.values():
        at.sort()
        for a in range(len(at)):
            for b in range(a + 1, len(at)):
                common[at[a], at[b]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def contamination(rows, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(low(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if words else ():
            wins[tuple(words[i:i + size])].add(str(item))
    sizes = {len(w) for w in wins}
    out = {}
    for i, text in rows:
        words = ALNUM.findall(low(text))
        hit, found = set(), set()
        for size in sizes:
            for p in range(len(words) - size + 1):
                if items_here := wins.get(tuple(words[p:p + size])):
                    hit.update(range(p, p + size))
                    found |= items_here
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def base_licenses(text):
    words = ALNUM.findall(low(text))
    places = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))



def license_spans(words, templates, required, absent, changes, gram=4, slack=3, cover=0.6):
    """(template, start, end, score) of every span, by loops over lists."""
    out = set()
    for n, (label, text) in enumerate(templates):
        t, found, changed = text.split(), [], []
        hits = sorted((a, p) for p in range(len(t) - gram + 1) for a in range(len(words) - gram + 1) if words[a:a + gram] == t[p:p + gram])
        groups, last = [], None
        for d, h in sorted((a - p, (a, p)) for a, p in hits):
            if last is None or d - last > slack:
                groups.append([])
            groups[-1].append(h)
            last = d
        for k, (a, p) in enumerate(hits):
            if k == 0 or p <= hits[k - 1][1] or a - hits[k - 1][0] - gram > len(t):
                groups.append([])
            groups[-1].append((a, p))
        for g in groups:
            mine, there = {p + j for _, p in g for j in range(gram)}, {a + j for a, _ in g for j in range(gram)}
            start, end = min(there), max(there) + 1
            if len(mine) / len(t) < cover or any(w in required.get(label, []) and k not in mine for k, w in enumerate(t)):
                continue
            if any(words[k] in changes for k in range(start, end) if k not in there):
                changed.append((start, end))
            if not set(words[start:end + 1]) & set(absent.get(label, [])):
                found.append((n, start, end, round(len(mine) / (len(t) + end - start - len(there)), 9)))
        out |= {x for x in found if not any(a <= x[1] and x[2] <= b for a, b in changed)}
    return out


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    m = re.search(r"[/?#]", rest)
    host = low(rest[:m.start()] if m else rest)
    path = re.split(r"[?#]", rest[m.start():] if m else "", maxsplit=1)[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


def gapless(values):
    values = sorted(values)
    return not values or values[0] == 0 and all(b == a + 1 for a, b in pairwise(values))
