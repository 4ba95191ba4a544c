"""Plain single-process versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

UPPER = {c: c + 32 for c in range(65, 91)}
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def contamination(docs, items, n=10):
    known = defaultdict(set)
    for key, text in items:
        words = ITEM_WORD.findall((text or "").translate(UPPER))
        for i in range(max(1, len(words) - n + 1) if words else 0):
            known[tuple(words[i : i + n])].add(key)
    out = []
    for doc_id, text in docs:
        words = ITEM_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for size in {len(k) for k in known}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in known:
                    hit.update(range(i, i + size))
                    found |= known[tuple(words[i : i + size])]
        ids = sorted(str(k) for k in found if k is not None)
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            rest -= out[s]
        open_ -= full
    return out


def near_components(docs, least=75, n=5):
    """doc_id -> (n_shingles, component_id)."""
    sets = {}
    for doc_id, text in docs:
        words = WORD.findall((text or "").translate(UPPER))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    under = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            under[g].add(d)
    seen = Counter()
    for ds in under.values():
        ds = sorted(ds)
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                seen[a, b] += 1
    for (a, b), common in seen.items():
        if 100 * common >= least * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats(docs, n=100):
    """Rows doc_id, n_bytes, n_removed, n_spans, kept_sha256 in doc_id order."""
    seen, out = set(), []
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - n + 1):
            s = data[i : i + n]
            if s in seen:
                gone[i : i + n] = b"\x01" * n
            else:
                seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    twice = set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            twice.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)


def crc(text):
    return zlib.crc32(text.encode())


def alignment(docs, pair):
    """Rows doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; each text is encoded whole."""
    found, seen = [], Counter()
    for doc_id, text in docs:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            if not b"".join(pair.bytes_a[x] for x in a) == (" " + text).encode() == b"".join(pair.bytes_b[x] for x in b):
                a, b = [], []
        i = j = 0
        own, other = [], []
        left_a = left_b = 0
        while i < len(a) or j < len(b) or left_a or left_b:
            if not left_a:
                left_a = len(pair.bytes_a[a[i]])
                own.append(a[i])
                i += 1
            if not left_b:
                left_b = len(pair.bytes_b[b[j]])
                other.append(b[j])
                j += 1
            links.append((own[-1], other[-1]))
            both = min(left_a, left_b)
            left_a, left_b = left_a - both, left_b - both
            if not left_a and not left_b:
                groups.append(",".join(map(str, own)) + "|" + ",".join(map(str, other)))
                own, other = [], []
        found.append((doc_id, len(a), len(b), len(groups), links, groups))
        seen.update(set(links))
    best = Counter()
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(d, na, nb, len(g), len(ls), sum(seen[x] == best[x[0]] for x in ls), sum(seen[x] for x in ls), digest(g)) for d, na, nb, _, ls, g in found]


def trie(turns):
    """turns: (conv_id, turn, role, text). Rows conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    original = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            original[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    original = {c: [x[2:] for x in sorted(t)] for c, t in original.items()}
    rebuilt = {}
    for c, own in original.items():
        h = crc(str(c)) % 4
        base = c - (abs(c) % FAMILY) * (1 if c >= 0 else -1)
        rebuilt[c] = original.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1].decode())) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * words
    ends = {n: hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(n)).encode()).hexdigest() for n, m in members.items()}
    return [(m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), leaves[n], saved[n], ends[n]) for n, m in members.items()]


FAMILY = 20
