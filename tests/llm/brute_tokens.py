"""Brute-force versions of operators 11 to 13."""

from collections import Counter
from fractions import Fraction
from hashlib import sha256
import re

import public_tokenizers as P


def alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    name = {i: t for t, i in a_side.get_vocab().items()}
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    grouped = []
    for t in texts:
        grouped.append(None)
        if not t:
            continue
        a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
        a_bytes, b_bytes = [bytes(byte[c] for c in name[i]) for i in a], [piece(i) for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            continue
        def ends(parts):
            out, at = [], 0
            for p in parts:
                at += len(p)
                out.append(at)
            return out
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        cuts = sorted(set(a_ends) & set(b_ends))
        grouped[-1] = [([i for i, e in zip(a, a_ends) if lo < e <= hi], [i for i, e in zip(b, b_ends) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
    count = Counter()
    for groups in grouped:
        count.update({(x, y) for ga, gb in groups or [] for x in ga for y in gb})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for groups in grouped:
        if groups is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), sha256(text.encode()).hexdigest()))
    return out


def collocations(rows, min_count, limit, longest=5):
    """(lang, rank, phrase, a, l, r, n, score) of ``(lang, text)`` rows."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for part in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", part)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        dropped = {p[i:i + m] for p, a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= counts[p[i:i + m]]}
        found = []
        for p, a in often.items():
            if p not in dropped:
                score, k = min((int(Fraction(1000 * a * total[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:limit]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)
