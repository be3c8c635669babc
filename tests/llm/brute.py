"""Brute-force versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def exact_dedup(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = set()
    for norm, members in groups.items():
        keep = min(members)[1]
        out |= {(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members}
    return out


def passages(docs: dict[int, bytes], length: int = 100):
    seen, out = set(), {}
    for d in sorted(docs):
        t = docs[d]
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


def substrings(rows, length: int = 35):
    texts = {d: words(t) for d, t in rows}
    count = Counter(tuple(w[i : i + length]) for w in texts.values() for i in range(len(w) - length + 1))
    out = {}
    for d, w in texts.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def fingerprint(text: str | None) -> int:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def components(ids, prints, radius: int = 2):
    fp = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= radius
    label = np.array(ids)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def lines(rows, align):
    """doc_id to (text left, lines removed), pair by pair; ``align`` names the aligned places of the later document."""
    texts = {d: t for d, t in rows if t is not None}
    first_of: dict[str, int] = {}
    for d in sorted(texts):
        first_of.setdefault(texts[d], d)
    split = {d: texts[d].split("\n") for d in first_of.values()}
    places = {d: {x: [i for i, y in enumerate(ls) if y == x] for x in ls if x.strip()} for d, ls in split.items()}
    holder: dict[str, int] = {}
    for d in sorted(split):
        for x in places[d]:
            holder.setdefault(x, d)
    out = {d: (None, 0) for d, t in rows if t is None}
    for d, t in texts.items():
        ls = t.split("\n")
        if first_of[t] != d:
            left = [x for x in ls if not x.strip()]
        else:
            gone = set()
            for b in {holder[x] for x in places[d]} - {d}:
                gone |= set(align([(at, places[b][x]) for x, at in places[d].items() if x in places[b]]))
            left = [x for i, x in enumerate(ls) if i not in gone]
        out[d] = ("\n".join(left), len(ls) - len(left))
    return out


def fragments(seed: int, n: int, alphabet, sep: str, most: int):
    """n texts stitched from shared fragments, some periodic, some null."""
    rng = random.Random(seed)
    base = [[rng.choice(alphabet) for _ in range(rng.randrange(20, most))] for _ in range(25)]
    rows = []
    for i in range(n):
        t = []
        for _ in range(rng.randrange(0, 5)):
            b = rng.choice(base)
            s = rng.randrange(len(b))
            t += b[s : s + rng.randrange(10, most)]
        if rng.random() < 0.2:
            t += list(alphabet[: rng.randrange(1, 4)]) * rng.randrange(0, 120)
        rows.append((i * 3 + 1, sep.join(t) if rng.random() > 0.04 else None))
    return rows
