"""Plain versions of the operators, written for clearness; slow."""

import hashlib
import re
import zlib
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, span=20):
    """docs: (doc_id, text) with distinct ids."""
    first, out = {}, {}
    words = {d: SPACE_WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        w = words[d]
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            if key in first:
                gone[i : i + span] = [True] * span
            else:
                first[key] = (d, i)
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def pii(text):
    text = text or ""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        if kind == "phone":
            return 9 <= len(digits) <= 15
        return True

    spans = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text) if ok(k, m[0])]
    counts = tuple(sum(s[0] == k for s in spans) for k in kinds)
    return counts, ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def components(ids, pairs):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard(docs, k=4, percent=85):
    sets = {}
    for d, t in docs:
        w = SPACE_WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    common = defaultdict(int)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                common[a, b] += 1
    pairs = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    of = components(sets, pairs)
    return {d: (len(sets[d]), of[d], links[d]) for d in sets}


def decontaminate(docs, items, span=13):
    windows = defaultdict(set)
    for item, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        n = min(len(w), span)
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out[d] = (len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def least_capacity(sizes, shards):
    """sizes of groups in order."""

    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def crc(text):
    return zlib.crc32((text or "").encode())
