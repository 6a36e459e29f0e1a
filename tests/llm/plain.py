"""Plain Python versions of the contracts, for tests: one document at a time, all pairs."""

import hashlib
import re
import zlib
from collections import defaultdict

WORDS = r"[^\x20\x09-\x0D]+"


def hexed(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def lowered(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def op2(docs, bench):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    windows = defaultdict(set)
    for item, t in bench:
        w = find(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, t in docs:
        w, hit, items = find(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[x]
        named = ",".join(sorted(map(str, items)))
        out[doc] = (len(w), len(hit), len(items), hexed(named.encode()), bool(hit) and 20 * len(hit) >= len(w))
    return out


def op2_left(text, bench):
    """Words outside windows of the items."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    w, hit = find(text), set()
    for _, t in bench:
        x = find(t)
        for i in range(max(1, len(x) - 12) if x else 0):
            y = x[i : i + 13]
            hit.update(k for j in range(len(w)) if w[j : j + len(y)] == y for k in range(j, j + len(y)))
    return " ".join(x for i, x in enumerate(w) if i not in hit)


def op5(docs):
    out = {}
    for doc, t in docs:
        t = t or ""
        w = re.findall(WORDS, t)
        lines = [x for x in t.split("\n") if re.search(WORDS, x)]
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        rep = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        out[doc] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))
    return out


def op6(docs):
    sets = {}
    for doc, t in docs:
        w = re.findall(WORDS, lowered(t or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    where = defaultdict(set)
    for d in ids:
        for s in sets[d]:
            where[s].add(d)
    for d in ids:
        near = defaultdict(int)
        for s in sets[d]:
            for e in where[s]:
                if e < d:
                    near[e] += 1
        for e, both in near.items():
            if 100 * both >= 75 * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in ids}


def op7(docs):
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = {}
    for doc, t in docs:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        named = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        out[doc] = (*(sum(k == i for _, k, _ in found) for i in range(3)), hexed(named.encode()))
    return out


def near_words(x: list, y: list) -> bool:
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def left_lines(docs):
    """Lines that stay, by document: copies of any line that isn't empty go, near copies from 5 words."""
    out, seen, earlier = {}, set(), defaultdict(list)
    for doc, t in sorted(docs):
        out[doc] = []
        for raw in (t or "").split("\n"):
            line = raw.lower().strip(" \t\r")
            w = line.split(" ")
            near = len(w) >= 5 and any(near_words(w, e) for n in (-1, 0, 1) if len(w) + n >= 5 for e in earlier[len(w) + n])
            if not line or line not in seen and not near:
                out[doc].append(raw)
            if line and line not in seen:
                seen.add(line)
                earlier[len(w)].append(w)
    return out


def op9(docs):
    left, texts = left_lines(docs), dict(docs)
    return {d: [len((texts[d] or "").split("\n")) - len(x), hexed("\n".join(x).encode())] for d, x in left.items()}


def op13(rows):
    """rows: (conv_id, turn, role, text). (conv_id, depth) -> the other columns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn, told, role, text))
    own = {c: [x[3:] for x in sorted(r)] for c, r in own.items()}
    made = {}
    for c, r in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + r[h:]
    members = defaultdict(list)
    for c, r in made.items():
        for d in range(len(r) + 1):
            members[tuple(r[:d])].append(c)
    kids = defaultdict(set)
    for n in members:
        if n:
            kids[n[:-1]].add(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(who) - 1) * len(n[-1][1].encode()) if n else 0
    return {
        (min(who), len(n)): (
            min(members[n[:-1]]) if n else None, len(who), len(kids[n]) if n in kids else 0, leaves[n], saved[n],
            hexed(",".join(str(c) for c in sorted(who) if len(made[c]) == len(n)).encode()),
        )
        for n, who in members.items()
    }


def op11_edits(rows):
    """Cost and least audit of the cheapest edits of (initial, must go, cut off), by dynamic programming over whole prefixes."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    forced = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(ways):
        for _ in range(3):
            for q, (c, t) in list(ways.items()):
                new = (c + 3, t + "I")
                ways[forced[q]] = min(ways.get(forced[q], new), new)
        return ways

    ways = inserted({"": (0, "")})
    for initial, must, cut in rows:
        made = {}

        def put(q, c, t):
            made[q] = min(made.get(q, (c, t)), (c, t))  # noqa: B023

        for q, (c, t) in ways.items():
            put(q, c + 4, t + "D")
            if not must:
                put(forced[q], c + 3 + 3 * cut, t + "R")
                if initial in follow[q]:
                    put(follow[q][initial], c + 3 * cut, t + "K")
        ways = inserted(made)
    return min(ways[q] for q in ("", "a") if q in ways)


def op11(rows):
    """rows: (conv_id, turn, role, text). conv_id -> the other columns."""
    kept = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        kept[c] += [] if m == 0 else [(turn, "user" if m == 4 else role, text)] * (2 if m == 3 else 1)
    out = {}
    for c, r in kept.items():
        r.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in r:
            body = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in r if t is not None}
        cost, audit = op11_edits([(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(r, faults, strict=True)])
        left, at, now = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else r[at][1:]
            at += e != "I"
            if e != "D":
                role = role if e == "K" else "assistant" if now == "u" else "user"
                now = role[:1]
                left.append(f"{role}:{text}")
        pairs = [x[1][:1] + y[1][:1] for x, y in zip(r, r[1:], strict=False)]
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hexed("\n".join(left).encode()),
        )
    return out


def op12(rows, least=0.9):
    """rows: (vec_id, vector), all pairs. One (vec_id, n_links, component_id) each, in order; ids may come again."""
    import numpy as np

    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if s else None for s, (_, v) in zip(sound, rows, strict=True)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, u in enumerate(unit):
        for j in range(i):
            if u is not None and unit[j] is not None and len(u) == len(unit[j]) and u @ unit[j] >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[top(i)] = top(j)
    name = {}
    for i, (k, _) in enumerate(rows):
        t = top(i)
        name[t] = k if name.get(t) is None else name[t] if k is None else min(k, name[t])
    return [(k, n[i], name[top(i)]) for i, (k, _) in enumerate(rows)]
