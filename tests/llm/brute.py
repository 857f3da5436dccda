"""Plain Python versions of the operators of the llm package, for small inputs."""

from __future__ import annotations

import random
import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACES.findall((text or "").translate(FOLD))


def shingles(ws, k=5):
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def similar(a, b, percent=75):
    shared = len(a & b)
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def classes(rows):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(words(t)) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s), label[i]) for i, s in sets.items()}


def kept_lines(rows, k=5):
    """doc_id -> (lines, removed, text left)."""
    lines = [(i, n, line) for i, t in rows if t is not None for n, line in enumerate(t.split("\n"))]
    sets = {(i, n): shingles(words(line), k) for i, n, line in lines}
    gone = {at for at, s in sets.items() if s and any(o and before < at and similar(s, o) for before, o in sets.items())}
    out = {}
    for i, t in rows:
        parts = t.split("\n") if t is not None else []
        left = [p for n, p in enumerate(parts) if (i, n) not in gone]
        out[i] = (len(parts), len(parts) - len(left), None if t is None else "\n".join(left))
    return out


def without_repeats(rows, length=50):
    """doc_id -> (bytes, removed, runs, bytes left)."""
    first = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i, b in data.items():
        for s in range(len(b) - length + 1):
            first[b[s:s + length]] = min(first.get(b[s:s + length], i), i)
    out = {}
    for i, b in data.items():
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < i:
                covered[s:s + length] = b"\1" * length
        runs = sum(1 for j, c in enumerate(covered) if c and not (j and covered[j - 1]))
        out[i] = (len(b), sum(covered), runs, bytes(x for x, c in zip(b, covered) if not c))
    return out


def corpus(seed=1, n=60):
    """Random texts with copies, edited copies, shared passages and odd cases."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 7))) for _ in range(150)]

    def prose(size):
        return " ".join(draw.choice(vocabulary) + draw.choice(["", "", "", ".", ",", "\n"]) for _ in range(size))

    passage = prose(30)
    texts = [prose(draw.randint(0, 120)) for _ in range(n)]
    for i in range(n // 3):
        parts = draw.choice(texts).split(" ")
        for _ in range(draw.randint(0, 4)):
            parts[draw.randrange(len(parts))] = draw.choice(vocabulary)
        texts.append(" ".join(parts))
    texts += [prose(20) + "\n" + passage + "\n" + prose(10) for _ in range(6)]
    texts += ["", " \t\n", None, "one two", "ONE two", "a" * 300, "a" * 120 + "b", "x " * 80, "y\n" * 40, prose(3000)]
    draw.shuffle(texts)
    return list(enumerate(texts))
