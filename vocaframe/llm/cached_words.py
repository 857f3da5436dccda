"""Ids of a ``tokenizers`` file, each distinct run of a text encoded once.

A text is cut where its pre-tokenizer cuts in any case, so that a run's ids do
not depend on what stands around it: between white space (``APART``, for files
that drop white space); there and between letters, single digits and other
signs (``SIGNS``, for files whose pattern is ``SIGN_PATTERN``), or before white
space that follows anything else (``LEADING``, for byte-level files, whose
pieces hold white space only in front).  Equal runs of a slice are found by their bytes and remembered over
slices, up to a bound.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa

from . import kernel as K

APART, SIGNS, LEADING = "apart", "signs", "leading"
#: Fixed value: the pattern of files that ``SIGNS`` is for.
SIGN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Bytes of the longest run that is remembered, runs remembered, and characters
#: of new runs that the tokenizer gets at a time.
LONGEST, KEPT, TOGETHER = 64, 1 << 18, 1 << 14

_BLANK = K._lut(b" \t\n\r\x0b\x0c")
_PLAIN = np.arange(256) < 0x80
# first bytes of two-byte characters that are no white space (U+0085 and
# U+00A0 begin with 0xC2; other white space has three bytes)
_TWO = (np.arange(256) > 0xC2) & (np.arange(256) < 0xE0)


def leading_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where runs begin: at each text, and at ASCII white space after a
    character that is surely none."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    if len(data) > 1:
        solid = _PLAIN[data] & ~_BLANK[data]
        solid[1:] |= ~_PLAIN[data[1:]] & _TWO[data[:-1]]
        first[1:] |= _BLANK[data[1:]] & solid[:-1]
    return np.flatnonzero(first)


# kinds of bytes in words that SIGNS may cut: letters, digits, other printable
# signs; an apostrophe, "<" (a special token's string may follow), control
# characters and everything beyond ASCII keep a word whole
_LETTER, _DIGIT, _SIGN, _WHOLE = range(4)
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x27, 0x3C]] = _WHOLE


def sign_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where runs begin in words that stand one after the other."""
    kind = _KIND[data]
    first = np.zeros(len(data) + 1, bool)
    first[edges[:-1]] = True
    first = first[:-1]
    whole = np.add.reduceat(kind == _WHOLE, edges[:-1]) > 0
    inner = np.zeros(len(data), bool)
    inner[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    return np.flatnonzero(first | inner & np.repeat(~whole, np.diff(edges)))


def _byte_strings(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column without nulls, faster than by ``to_pylist``."""
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    flat = column.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes()
    edges = (edges - edges[0]).tolist()
    return [flat[s:e] for s, e in zip(edges, edges[1:])]


class Cached:
    def __init__(self, tokenizer, cut: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.cut = tokenizer, cut
        #: number of each remembered run; the ids of runs by number
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def dropping_space(cls, content: bytes) -> Cached:
        """For a file that drops white space, cut as finely as it allows."""
        from tokenizers import Tokenizer

        parsed = json.loads(content)
        rules = parsed.get("pre_tokenizer") or {}
        rules = rules.get("pretokenizers", [rules])
        normal = parsed.get("normalizer") or {}
        lower = any(n.get("type") == "Lowercase" for n in normal.get("normalizers", [normal]))
        pattern = rules[0].get("pattern", {}).get("Regex") if rules[0].get("type") == "Split" else None
        fine = lower and pattern == SIGN_PATTERN and all("<" in t["content"][:1] for t in parsed.get("added_tokens", []))
        return cls(Tokenizer.from_buffer(content), SIGNS if fine else APART)

    def _numbers(self, runs: list[bytes]) -> np.ndarray:
        """The number of each run; new ones are encoded."""
        out = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [runs[i] for i in missing.tolist()]
            kept = len(self.known)  # what stands beyond belonged to the last call
            used = int(self.begin[kept - 1] + self.count[kept - 1]) if kept else 0
            ids, counts = self._encoded(new)
            self.ids = np.concatenate((self.ids[:used], ids))
            self.count = np.concatenate((self.count[:kept], counts))
            self.begin = np.concatenate((self.begin[:kept], used + np.cumsum(counts) - counts))
            out[missing] = kept + np.arange(len(new))
            # remembered up to the bound, and up to the first very long run
            fit = next((i for i, r in enumerate(new) if len(r) > LONGEST), len(new))
            fit = max(0, min(fit, KEPT - kept))
            self.known.update(zip(new[:fit], range(kept, kept + fit)))
        return out

    def _encoded(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each run's) of new runs."""
        words = [r.decode() for r in runs]
        if self.cut == LEADING:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            counts = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum())), counts
        # white space is dropped, so that runs with a space between keep their
        # ids; a token's place in the text tells its run
        ids, counts, at = [], [], 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (size < TOGETHER or end == at):
                size += len(words[end])
                end += 1
            some = words[at:end]
            at = end
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0, *[len(w) + 1 for w in some[:-1]]])
            place = np.fromiter(map(itemgetter(0), got.offsets), np.int64, len(got.ids))
            ids.append(np.array(got.ids, np.int32))
            counts.append(np.bincount(np.searchsorted(starts, place, "right") - 1, minlength=len(some)))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts in one array of bytes."""
        n = len(offsets) - 1
        if self.cut == LEADING:
            starts = leading_starts(data, offsets)
            edges, raw = np.append(starts, len(data)), np.ascontiguousarray(data)
            first = np.searchsorted(starts, offsets)
        else:
            starts, ends, first = K.word_spans(data, offsets, _BLANK)
            sizes = ends - starts
            edges = np.concatenate(([0], np.cumsum(sizes)))
            raw = data[np.repeat(starts - edges[:-1], sizes) + np.arange(edges[-1])]
            if self.cut == SIGNS and len(starts):
                raw = K.FOLD[raw]  # the file's normalizer makes lower case
                starts, size = sign_starts(raw, edges), len(raw)
                first = np.searchsorted(starts, edges[first])
                edges = np.append(starts, size)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        number = self._numbers(_byte_strings(coded.dictionary))
        own = number[coded.indices.to_numpy()]
        count = self.count[own]
        done = np.cumsum(count)
        ids = self.ids[np.repeat(self.begin[own] - (done - count), count) + np.arange(done[-1])].astype(np.int64)
        return ids, np.diff(np.concatenate(([0], done))[first])
