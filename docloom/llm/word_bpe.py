"""Encoding texts with a BPE that marks word ends, many at a time.

The tokenizer library spends most of its time on normalising and on single calls.  For texts of ASCII and Latin letters the
pieces that its pattern finds are runs of one kind of byte, so all pieces of many texts are found, hashed and looked up as
arrays; each worker keeps the ids of pieces it has seen in a table of fixed size, and runs the merges of new ones together.
Other texts, and very long pieces, go to the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from docloom.llm.arrays import Spans

#: Bytes of the longest piece that is merged here.
LONGEST = 48
#: Each worker keeps the ids of up to 2 ** _SLOT_BITS pieces, one for each slot that their hashes lead to, _POOL ids in all.
_SLOT_BITS, _POOL = 21, 1 << 23
#: Lower-cased UTF-8 that goes to the library: any letter beyond U+027F, U+0080 to U+00BF, and the two signs among the letters.
_ODD = re.compile(rb"[\xc2\xca-\xff]|\xc3[\x97\xb7]")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[range(48, 58)] = _DIGIT
_NONE = np.int64(1 << 40)


def _byte_symbols() -> list[str]:
    """The usual printable stand-in of each byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, vocab = made["model"], made["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.known = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.offset, self.count = np.zeros(1 << _SLOT_BITS, np.int64), np.zeros(1 << _SLOT_BITS, np.int32)
        self.pool, self.used = np.zeros(_POOL, np.uint32), 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def _merge(self, rows: list[bytes]) -> list[bytes]:
        """The ids of words of similar length: in each round every word makes its first merge, the leftmost of the least rank."""
        sizes = np.array([len(r) for r in rows])
        width = int(sizes.max())
        sym = np.full((len(rows), width + 1), -1, np.int64)
        inside = np.arange(width + 1) < sizes[:, None]
        sym[inside] = self.inner[np.frombuffer(b"".join(rows), np.uint8)]
        lasts = np.array([r[-1] for r in rows])
        sym[np.arange(len(rows)), sizes - 1] = self.final[lasts]
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        places, live, counts = np.arange(width), np.arange(len(rows)), sizes.copy()
        while len(live):
            own = rank[live]
            pos = own.argmin(axis=1)
            best = own[np.arange(len(live)), pos]
            live, pos, best = live[best < _NONE], pos[best < _NONE], best[best < _NONE]
            if not len(live):
                break
            s, r = sym[live], rank[live]
            shift = np.minimum(places + (places > pos[:, None]), width)
            s[:, :-1] = np.take_along_axis(s, shift, axis=1)
            s[:, -1] = -1
            each = np.arange(len(live))
            s[each, pos] = self.result[best]
            r = np.take_along_axis(np.concatenate([r, np.full((len(live), 1), _NONE)], axis=1), shift, axis=1)
            r[each, pos] = self._rank(s[each, pos], s[each, pos + 1])
            before = pos > 0
            r[each[before], pos[before] - 1] = self._rank(s[each[before], pos[before] - 1], s[each[before], pos[before]])
            sym[live], rank[live] = s, r
            counts[live] -= 1
        flat, step = sym.astype("<u4").tobytes(), 4 * (width + 1)
        return [flat[i * step : i * step + 4 * n] for i, n in enumerate(counts.tolist())]

    def _learn(self, raw: list[bytes]) -> list[bytes]:
        """The ids of pieces: short ones together, the others by the library."""
        out: list[bytes] = [b""] * len(raw)
        order = sorted((i for i, r in enumerate(raw) if len(r) <= LONGEST), key=lambda i: len(raw[i]))
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            for i, ids in zip(part, self._merge([raw[i] for i in part])):
                out[i] = ids
        for i, r in enumerate(raw):
            if len(r) > LONGEST:
                out[i] = self._whole(r.decode())
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of lower-cased plain text begin and end."""
        kind = _KIND[raw]
        first = np.empty(len(raw), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == _DIGIT
        for at in np.flatnonzero((raw[:-1] == 39) & first[:-1] & (kind[1:] == _LETTER)).tolist():
            tail = raw[at + 1 : at + 3].tobytes()
            long = 2 if tail in (b"re", b"ve", b"ll") else 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 0
            if long:
                first[at + 1] = False
                if at + 1 + long < len(raw):
                    first[at + 1 + long] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(raw))
        words = kind[starts] != _SPACE
        return starts[words], ends[words]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased texts of ASCII and Latin letters: all pieces of all texts at once."""
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        starts, ends = self._pieces(raw)
        hashes = Spans(raw).hash(starts, ends)
        slots = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        hit = self.known[slots] == hashes
        offset, count = self.offset[slots], self.count[slots]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            new, where, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            where = miss[where]
            ids = self._learn([joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            if self.used + int(sizes.sum()) > len(self.pool):  # start anew, with what this batch needs
                keep = np.unique(slots[hit])
                old = self.pool[_spread(self.offset[keep], self.count[keep])]
                self.known[:] = 0
                self.pool = np.zeros(max(_POOL, 2 * (len(old) + int(sizes.sum()))), np.uint32)
                self.pool[: len(old)] = old
                self.offset[keep] = np.cumsum(self.count[keep]) - self.count[keep]
                self.known[keep] = hashes[hit][np.unique(slots[hit], return_index=True)[1]]
                self.used, offset = len(old), self.offset[slots]
            at = self.used + np.cumsum(sizes) - sizes
            self.pool[self.used : self.used + int(sizes.sum())] = np.frombuffer(b"".join(ids), "<u4")
            self.used += int(sizes.sum())
            own = (new >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            offset[miss], count[miss] = at[inverse], sizes[inverse]
            self.known[own], self.offset[own], self.count[own] = new, at, sizes
        flat = self.pool[_spread(offset, count)].astype("<u4", copy=False).tobytes()
        limits = np.cumsum([0] + [len(t) + 1 for t in texts])
        before = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, limits)] * 4
        return [flat[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        batch, size = [], 0
        for i, text in enumerate(texts):
            low = text.lower().encode()
            if low.isascii() or not _ODD.search(low):
                batch.append((i, low))
                size += len(low)
            else:
                out[i] = self._whole(text)
            if batch and (size > 1 << 20 or i + 1 == len(texts)):
                for (k, _), ids in zip(batch, self._plain([x for _, x in batch])):
                    out[k] = ids
                batch, size = [], 0
        if batch:
            for (k, _), ids in zip(batch, self._plain([x for _, x in batch])):
                out[k] = ids
        return out


def _spread(offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions offset, offset + 1, ... of each run, one run after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(offset - (ends - count), count)


_made: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The tokenizer of a file, made once in each process."""
    if path not in _made:
        _made[path] = WordBpe(path)
    return _made[path]
