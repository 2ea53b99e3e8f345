"""Plain Python versions of conversation repair, collocations and SimHash groups."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import xxhash
from llm.brute import SPACE, low

_MARK = re.compile(r"[^\x20\x09-\x0D]")


def repaired(rows):
    """conv -> expected columns, by Dijkstra over (turn, state) with (cost, letters) as distance; rows are (conv, turn, role, text)."""
    def one(x):
        return " " if x is None else str(x)

    conv = defaultdict(list)
    for c, turn, role, text in rows:
        held = conv[c]
        kind = zlib.crc32(f"{one(c)}:{one(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else one(role), "" if kind == 1 else one(text)
        text = re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: _repair(v) for c, v in conv.items()}


def _repair(v):
    v = sorted(v, key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.md5(f"{z[1]}\0{z[2]}".encode()).hexdigest()))
    turns = [z[0] for z in v if z[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, state = set(), []
    for _, role, text in v:
        marks = _MARK.findall(text)
        state.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in v]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    done, heap = set(), [(0, "", 0, 0, ())]
    while heap:
        cost, letters, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(v) and q in (0, 3):
            break
        want, to = ("assistant", 3) if q == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 3, letters + "I", i, to, (*out, f"{want}:")))
        if i < len(v):
            _, role, text = v[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, q, out))
            if state[i] not in ("b", "d"):
                more = 3 if state[i] == "t" else 0
                heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, to, (*out, f"{want}:{text}")))
                if role[:1] == want[0] or (role[:1] == "s" and q == 0):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, to if role[:1] == want[0] else 1, (*out, f"{role}:{text}")))
    return gaps, state.count("b"), state.count("d"), state.count("t"), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()


def collocations(rows, support=10, top=2000, longest=3):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= support}
    gone = {(lang, p[i:i + k]) for (lang, p), c in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= 50 * f[lang, p[i:i + k]]}
    by = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, cut = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    for lang, x in by.items():
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)]
    return sorted(out)


def fingerprint(text, k=4):
    w = SPACE.findall(low(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(len(w) - k + 1, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def simhash_groups(prints, distance=4):
    """id -> smallest id reachable, from id -> fingerprint."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}
