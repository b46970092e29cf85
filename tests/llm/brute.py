"""Plain one-machine versions of the operators' contracts."""

import hashlib
from collections import Counter, defaultdict


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def _covered(seqs, length):
    count = Counter(s[i : i + length] for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        flag = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[s[i : i + length]] > 1:
                flag[i : i + length] = [True] * length
        out.append(flag)
    return out


def op1(rows, length=200):
    seqs = [(t or "").encode() for _, t in rows]
    res = []
    for (i, _), s, f in zip(rows, seqs, _covered(seqs, length)):
        spans = sum(1 for k in range(len(f)) if f[k] and (k == 0 or not f[k - 1]))
        res.append((i, len(s), sum(f), spans, sha(bytes(b for b, x in zip(s, f) if not x))))
    return res


def op6(rows, length=35):
    seqs = [tuple((t or "").encode().split()) for _, t in rows]
    return [(i, len(s), sum(f), sha(b" ".join(w for w, x in zip(s, f) if not x))) for (i, _), s, f in zip(rows, seqs, _covered(seqs, length))]


def op2(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower()
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").encode().split(b"\n"):
            if len(key(line).decode()) >= min_chars:
                held[key(line)].add(i)
    res = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if not (len(h := held.get(key(x), ())) >= min_docs and max(h) != i)]
        res.append((i, len(lines), len(lines) - len(kept), sha(b"\n".join(kept))))
    return res


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def op3(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for r, s in enumerate(sets):
        for g in s:
            index[g].append(r)
    common = Counter()
    for r, s in enumerate(sets):
        near = Counter(q for g in s for q in index[g] if q < r)
        for q, n in near.items():
            if 100 * n >= 85 * (len(s) + len(sets[q]) - n):
                parent[find(r)] = find(q)
    low = {}
    for r in range(len(rows)):
        if rows[r][0] is not None:
            low[find(r)] = min(low.get(find(r), rows[r][0]), rows[r][0])
    return [(i, len(s), low.get(find(r))) for r, ((i, _), s) in enumerate(zip(rows, sets))]
