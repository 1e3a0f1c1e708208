"""Plain Python versions of the contracts, to hold the Spark queries against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(d: str) -> bool:
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def op1(text: str | None):
    """(n_email, n_ip, n_card, n_phone, base_sha256)"""
    text = text or ""
    found = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, p, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ):
        found += [(kind, m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])]
    n = Counter(k for k, _, _ in found)
    return n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{s}:{e}" for k, s, e in found))


def shingles(text: str | None) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def op2(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].add(k)
    pairs = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= 80 * len(s | t):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def op4(docs: list[tuple[int, str | None]], tokenizer) -> list[tuple]:
    import struct

    out, start = [], 0
    for i, t in sorted(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def op8(text: str | None):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    rep = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def op9(docs: list[tuple[int, str | None]], n: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            x = b[s : s + n]
            if x in seen:
                gone[s : s + n] = b"\x01" * n
            else:
                seen.add(x)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(kept))
    return out


def merkle_tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def merkle_path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for nodes in levels[:-1]:
        run = i // 16 * 16
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        i //= 16
    return out


def op11(docs: list[tuple]) -> list[tuple]:
    """docs: (doc_id, source, lang, n_chars, text)"""
    import zlib

    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: sha("".join(map(shown, d)))
    by = defaultdict(list)
    for d in docs:
        found = leaf(d)
        if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0:
            found = leaf((*d[:4], None if d[4] is None else d[4].translate(LOWER)))
        by[d[1]].append((d[0] is not None, d[0] or 0, leaf(d), found, d[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: merkle_tree([x[2] for x in sorted(by[s])]) for s in names}
    top = merkle_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, found, ident) in enumerate(sorted(by[s])):
            path = merkle_path(trees[s], i) + merkle_path(top, k)
            for before, after in path:
                found = sha(before + found + after)
            out.append((ident, own, trees[s][-1][0], top[-1][0], sha("".join(b + a for b, a in path)), found, found == top[-1][0]))
    return out


def op12(rows: list[tuple]) -> list[tuple]:
    """rows: (conv_id, turn, role, text). Searches forwards, with whole audits and texts."""
    import zlib

    convs: dict = {}
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        own = convs.setdefault(c, [])
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            own += [(t, "user" if k == 4 else r, x)] * (1 + (k == 3))
    out = []
    for c, own in convs.items():
        own.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), hashlib.md5(y[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in own:
            bare = x.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (r, x) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] or " " for _, r, _ in own]

        def better(into: dict, q: int, found: tuple) -> None:
            if q not in into or found[:2] < into[q][:2]:
                into[q] = found

        def with_inserts(best: dict) -> dict:
            for _ in range(3):
                for q, (cost, audit, lines) in list(best.items()):
                    to, name = (3, "assistant") if q == 2 else (2, "user")
                    better(best, to, (cost + 5, audit + "I", (*lines, name + ":")))
            return best

        best = with_inserts({0: (0, "", ())})
        for (_, r, x), fault, initial in zip(own, faults, initials, strict=True):
            then: dict = {}
            for q, (cost, audit, lines) in best.items():
                better(then, q, (cost + 2, audit + "D", lines))
                if fault in ("b", "d"):
                    continue
                more = 5 * (fault == "t")
                to, name = (3, "assistant") if q == 2 else (2, "user")
                if q == 0 and initial == "s":
                    better(then, 1, (cost + more, audit + "K", (*lines, f"{r}:{x}")))
                if initial == name[0]:
                    better(then, to, (cost + more, audit + "K", (*lines, f"{r}:{x}")))
                better(then, to, (cost + more + 1, audit + "R", (*lines, f"{name}:{x}")))
            best = with_inserts(then)
        cost, audit, lines = min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(lines))))
    return out


def op13_base(docs: list[tuple]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score); docs: (doc_id, text)"""
    import math
    import zlib

    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    c = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for (i, _), t, h in zip(docs, tokens, held, strict=True)]


def op8_figures(text: str | None) -> tuple:
    """All figures that quality rules read, in the order of quality.FIGURES."""
    text = text or ""
    words = WORD.findall(text)
    lines, dup, seen = [x for x in text.split("\n") if WORD.search(x)], 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    letters = re.findall("[A-Za-z]", text)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(re.findall("[A-Z]", text)), len(letters), len(lines),
        sum(len(w.encode()) <= 3 for w in words), sum(bool(re.search(r"[A-Za-z\u0080-\U0010ffff]", w)) for w in words), sum(len(re.findall(r"[\x00-\x7f]", re.sub("[A-Za-z0-9]", "", w))) for w in words),
    )
