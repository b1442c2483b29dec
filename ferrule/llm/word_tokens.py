"""Token ids of whole texts under a word-level BPE: lower case, white space dropped, words closed by a suffix.

No token crosses white space, so a text's ids are those of its words.  A chunk of texts is split into words and
its distinct words are encoded, all side by side: every round merges, in each piece, the leftmost pair of least
rank, as the library does in each piece alone.  That path takes words of ASCII and of the Latin letters whose
lower case is one letter again, up to 64 bytes; every other word goes to the library in its original form, before any
normalisation, so the library's own tables of characters decide.  Words met before are looked up in a bounded
table by 64 bits of hash over their bytes and length; it forgets those that it was not asked for again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ferrule.llm.hashing import Spans, in_chunks, mix, ranges
from ferrule.llm.memory import cache

NEVER = np.int32(2**31 - 1)
#: Latin letters of two bytes that the side-by-side path takes: from here up to 0x180.
_FIRST, _LAST = 0xC0, 0x180
#: White space of more than one byte (fixed values: the Unicode property White_Space).
_WIDE = [c.encode() for c in "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: What str.split() takes for white space and the library does not.
_ODD = (0x1C, 0x1F)
_SPACES = np.zeros(256, bool)
_SPACES[[*range(0x09, 0x0E), 0x20]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[x[0] for x in _WIDE]] = True
#: Bytes of a word that is remembered, and of text handled at once.
REMEMBERED, CHUNK = 64, 1 << 21
_EMPTY = np.uint64(0)


class Slots:
    """A map from 64-bit keys to small numbers, for many keys at once: open addressing, one slot after the other."""

    def __init__(self, room: int, absent: int):
        bits = max(8, int(room * 2).bit_length())
        self.shift, self.mask, self.absent = np.uint64(64 - bits), (1 << bits) - 1, absent
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, absent, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are new, different and not 0."""
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = todo[self.keys[slot[todo]] == _EMPTY]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        same = found == keys
        out = np.where(same, self.values[slot], np.int32(self.absent))
        todo = np.flatnonzero(~same & (found != _EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            same = found == keys[todo]
            out[todo[same]] = self.values[slot[todo[same]]]
            todo = todo[~same & (found != _EMPTY)]
        return out


class Merges:
    """Ranks of pairs of ids, and the id that each pair becomes."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        if len(pairs) >= 1 << 16:
            raise ValueError("more merges than ranks of 16 bits")
        self.merged = np.append(merged, 0).astype(np.int32)
        keys = pairs[:, 0].astype(np.uint64) << np.uint64(16) | pairs[:, 1].astype(np.uint64)
        # a pair and its rank in one number; an empty slot belongs to a pair of ids that there is not
        bits = max(8, int(len(pairs) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, ~np.uint64(0))
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = todo[self.table[slot[todo]] == ~np.uint64(0)]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.table[slot[free]] = keys[free] << np.uint64(16) | free.astype(np.uint64)
            todo = todo[self.table[slot[todo]] >> np.uint64(16) != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = self.table[slot]
        other = found >> np.uint64(16) != keys
        out = (found & np.uint64(0xFFFF)).astype(np.int32)
        out[other] = NEVER
        todo = np.flatnonzero(other & (found != ~np.uint64(0)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.table[slot[todo]]
            same = found >> np.uint64(16) == keys[todo]
            out[todo[same]] = found[same] & np.uint64(0xFFFF)
            todo = todo[~same & (found != ~np.uint64(0))]
        return out

    def apply(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of ``sizes`` ids each, merged as far as they go: all ids, and the new sizes."""
        piece = np.flatnonzero(sizes > 0)
        lens = sizes[piece].astype(np.int32)
        rank = np.full(len(ids), NEVER, np.int32)
        if len(ids) > 1:
            rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[np.cumsum(lens) - 1] = NEVER
        done, out_sizes = [], np.zeros(len(sizes), np.int64)
        while len(piece):
            starts = np.cumsum(lens) - lens
            least = np.minimum.reduceat(rank, starts)
            live = least < NEVER
            if not live.all():
                here = np.repeat(live, lens)
                done.append((piece[~live], lens[~live], ids[~here]))
                out_sizes[piece[~live]] = lens[~live]
                ids, rank, piece, lens, least = ids[here], rank[here], piece[live], lens[live], least[live]
                if not len(piece):
                    break
                starts = np.cumsum(lens) - lens
            hit = np.flatnonzero(rank == np.repeat(least, lens))
            if len(hit) > len(lens):  # the leftmost of each piece
                owner = np.searchsorted(starts, hit, "right")
                hit = hit[np.append(True, owner[1:] != owner[:-1])]
            ids[hit] = self.merged[least]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, rank, lens = ids[keep], rank[keep], lens - 1
            at, starts = hit - np.arange(len(hit)), starts - np.arange(len(starts))
            inner = at[at < starts + lens - 1]
            rank[at] = NEVER
            rank[inner] = self.rank(ids[inner], ids[inner + 1])
            inner = at[at > starts]
            rank[inner - 1] = self.rank(ids[inner - 1], ids[inner])
        out = np.empty(int(out_sizes.sum()), np.int32)
        begins = np.cumsum(out_sizes) - out_sizes
        for p, n, x in done:
            out[ranges(begins[p], n)] = x
        return out, out_sizes


def _one(text: np.ndarray) -> pa.Array:
    """An array of one text, over its bytes."""
    return pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(np.ascontiguousarray(text))])


class WordTokens:
    """Encodes texts as arrays of 16-bit ids."""

    def __init__(self, path: str, cache_size: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"] or not suffix:
            raise ValueError("only word-level vocabularies in lower case")
        vocab = spec["model"]["vocab"]
        if max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) >= 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = Merges(np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64), np.array([vocab[a + b] for a, b in merges], np.int32))
        # the ids of single bytes: inside a piece, and at its end; of letters, the pieces of the character
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        name = [""] * 256
        for c in [chr(c) for c in range(0x80)] + [chr(c) for c in range(0x80, 0x800, 0x40)] + [chr(0xC0 + i) for i in range(64)]:
            shown = level.pre_tokenize_str(c)
            for b, x in zip(c.encode(), "".join(s for s, _ in shown)):
                name[b] = x
        self.inside = np.array([vocab.get(x, 0) if x else 0 for x in name], np.int32)
        self.closing = np.array([vocab.get(x + suffix, 0) if x else 0 for x in name], np.int32)
        marks = set(map(ord, "".join(t["content"][0] for t in spec["added_tokens"]) + "'"))
        # kinds of bytes: letters, digits, other marks; 3: not for this path
        self.kind = np.full(256, 3, np.uint8)
        self.kind[0x21:0x7F] = 2
        self.kind[[*range(0x30, 0x3A)]] = 1
        self.kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = 0
        self.kind[list(marks)] = 3
        lower = [chr(c).lower() for c in range(_FIRST, _LAST)]
        usual = [chr(_FIRST + i).isalpha() and len(x) == 1 and _FIRST <= ord(x) < _LAST for i, x in enumerate(lower)]
        self.lower = np.array([ord(x) if ok else 0 for x, ok in zip(lower, usual)], np.int64)
        self.cache_size = cache_size
        # the table of words: their ids lie in the pool, from ``at`` on
        self.slots = Slots(cache_size, -1)
        self.keys, self.pool = np.empty(0, np.uint64), np.empty(0, np.uint16)
        self.at, self.sizes, self.asked = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def _plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words in ``data`` the side-by-side path takes, their ids one after the other, how many of each."""
        starts, sizes = bounds[:-1], np.diff(bounds)
        full = (sizes > 0) & (sizes <= REMEMBERED)  # a longer one would take as many rounds
        ends = starts + sizes
        bad = np.append(self.kind[data] == 3, False).astype(np.int64)
        two = np.flatnonzero(data >= 0xC0)
        two = two[two + 1 < len(data)]
        code = ((data[two].astype(np.int64) & 0x1F) << 6 | data[two + 1] & 0x3F) - _FIRST
        low = self.lower[np.clip(code, 0, _LAST - _FIRST - 1)]
        bad[two] |= (code < 0) | (code >= _LAST - _FIRST) | (low == 0)
        ok = full.copy()
        if full.any():
            ok[full] = np.add.reduceat(bad, np.stack([starts, ends], 1)[full].ravel())[::2] == 0
        data = data.copy()
        capital = (data >= 0x41) & (data <= 0x5A)
        data[capital] += 32
        data[two], data[two + 1] = 0xC0 | low >> 6, 0x80 | low & 0x3F
        places = ranges(starts[ok], sizes[ok])
        data, sizes = data[places], sizes[ok]
        if not len(data):
            return ok, np.empty(0, np.int32), np.zeros(0, np.int64)
        kind = self.kind[data]
        opens = np.empty(len(data), bool)
        opens[0], opens[1:] = True, (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        opens[np.cumsum(sizes) - sizes] = True
        begins = np.flatnonzero(opens)
        lens = np.diff(np.append(begins, len(data)))
        ids = self.inside[data]
        last = begins + lens - 1
        ids[last] = self.closing[data[last]]
        out, counts = self.merges.apply(ids, lens)
        of_word = np.cumsum(opens)[np.cumsum(sizes) - sizes] - 1  # each word's first piece
        return ok, out, np.add.reduceat(counts, of_word)

    def _new(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in ``data``, one after the other, and how many each has."""
        ok, ids, counts = self._plain(data, bounds)
        if ok.all():
            return ids.astype(np.uint16), counts
        sizes = np.zeros(len(ok), np.int64)
        sizes[ok] = counts
        rest, raw = np.flatnonzero(~ok), data.tobytes()
        words = [raw[bounds[i] : bounds[i + 1]].decode("utf-8", "replace") for i in rest.tolist()]
        others = [np.array(e.ids, np.uint16).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        sizes[rest] = [len(x) // 2 for x in others]
        at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint16)
        out[ranges(at[ok], sizes[ok])] = ids
        out[ranges(at[rest], sizes[rest])] = np.frombuffer(b"".join(others), np.uint16)
        return out, sizes

    def _forget(self) -> None:
        """Leave only words that were asked for again, at most half of what there is room for."""
        kept = np.flatnonzero(self.asked & (self.keys != _EMPTY))[-(self.cache_size // 2) :]
        self.pool, self.sizes, self.keys = self.pool[ranges(self.at[kept], self.sizes[kept])], self.sizes[kept], self.keys[kept]
        self.asked, self.at = np.zeros(len(kept), bool), np.cumsum(self.sizes) - self.sizes
        self.slots = Slots(self.cache_size, -1)
        self.slots.put(self.keys, np.arange(len(kept), dtype=np.int32))

    def _learn(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.cache_size:
            self._forget()
        if len(self.keys) + len(keys) > self.cache_size:
            return
        n = len(self.keys)
        known = np.flatnonzero(keys != _EMPTY)
        self.slots.put(keys[known], (n + known).astype(np.int32))
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(sizes) - sizes])
        self.pool, self.sizes, self.keys = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes]), np.concatenate([self.keys, keys])
        self.asked = np.concatenate([self.asked, np.zeros(len(keys), bool)])

    @staticmethod
    def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end; none crosses a bound."""
        space = _SPACES[data]
        for at in np.flatnonzero(_LEADS[data]).tolist() if _LEADS[data].any() else ():
            for x in _WIDE:
                if data[at : at + len(x)].tobytes() == x:
                    space[at : at + len(x)] = True
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        word = ~space
        before = np.append(True, space[:-1]) | cut[:-1]
        after = np.append(space[1:], True) | cut[1:]
        return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1

    def _chunk(self, data: np.ndarray, bounds: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data``, each followed by ``close``, and how many each text has."""
        starts, ends = self._words(data, bounds)
        n, room = len(starts), ends - starts
        keys = mix(Spans(data).hash(starts, ends) + room.astype(np.uint64)) | np.uint64(1)
        long = np.flatnonzero(room > REMEMBERED)
        keys[long] = np.arange(1, len(long) + 1, dtype=np.uint64) << np.uint64(1)  # even: each a word of its own
        found = self.slots.get(keys)
        known = found >= 0
        self.asked[found[known]] = True
        pool, at, sizes = self.pool, np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # the last is what closes a text
        at[:-1][known], sizes[:-1][known] = self.at[found[known]], self.sizes[found[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            new, first, each = np.unique(keys[missing], return_index=True, return_inverse=True)
            rows = missing[first]
            cuts = np.zeros(len(rows) + 1, np.int64)
            np.cumsum(room[rows], out=cuts[1:])
            ids, counts = self._new(data[ranges(starts[rows], room[rows])], cuts)
            at[missing], sizes[missing] = (len(pool) + np.cumsum(counts) - counts)[each], counts[each]
            pool = np.concatenate([pool, ids])
            short = room[rows] <= REMEMBERED
            self._learn(np.where(short, new, _EMPTY), ids, counts)
        at[-1], sizes[-1] = len(pool), len(close)
        pool = np.concatenate([pool, close])
        upto = np.searchsorted(starts, bounds[1:])  # words before the end of each text
        order = np.insert(np.arange(n), upto, n)
        sizes = sizes[order]
        total = np.append(0, np.cumsum(sizes))
        text_ends = total[upto + np.arange(1, len(upto) + 1)]
        return pool[ranges(at[order], sizes)], np.diff(text_ends, prepend=0)

    @staticmethod
    def _spaces(data: np.ndarray) -> list[int]:
        """Where to cut a long text: at spaces about a chunk apart, as far as there are any."""
        cuts = [0]
        while cuts[-1] + CHUNK < len(data):
            at = cuts[-1] + CHUNK
            while at < len(data) and not len(found := np.flatnonzero(_SPACES[data[at : at + CHUNK]])):
                at += CHUNK
            if at >= len(data):
                break
            cuts.append(at + int(found[0]))
        return [*cuts, len(data)]

    def encode_array(self, texts: pa.Array, close: tuple[int, ...] = ()) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(slice, ids, sizes) over an array of texts without nulls: the 16-bit ids of some texts, each with ``close``
        after it, and how many each text has."""
        end, texts = np.array(close, np.uint16), texts.cast(pa.large_string())
        if not len(texts):
            return
        _, offsets, raw = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        for part in in_chunks(np.diff(bounds).tolist(), CHUNK):
            cuts = bounds[part.start : part.stop + 1]
            some = data[cuts[0] : cuts[-1]]
            if len(some) > 2 * CHUNK and len(at := self._spaces(some)) > 2:  # one long text: words are whole on both sides of a space
                found = [ids for a, b in zip(at[:-1], at[1:]) for _, ids, _ in self.encode_array(_one(some[a:b]))]
                ids = np.concatenate([*found, end])
                yield part, ids, np.array([len(ids)], np.int64)
                continue
            marked = np.flatnonzero((some >= _ODD[0]) & (some <= _ODD[1]))
            cuts = cuts - cuts[0]
            if not len(marked):
                yield part, *self._chunk(some, cuts, end)
                continue
            # the library takes these marks for no white space: their texts are its own
            odd = np.unique(np.searchsorted(cuts, marked, "right") - 1)
            plain, room = np.ones(len(some), bool), np.diff(cuts)
            for i in odd.tolist():
                plain[cuts[i] : cuts[i + 1]] = False
            room[odd] = 0
            ids, sizes = self._chunk(some[plain], np.append(0, np.cumsum(room)), end)
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in odd.tolist():
                own = self.library.encode(some[cuts[i] : cuts[i + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
                parts[i] = np.concatenate([np.array(own, np.uint16), end])
            yield part, np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 16-bit numbers of the machine's byte order; special strings count as their tokens."""
        out = []
        for _, ids, sizes in self.encode_array(pa.array(texts, pa.string())):
            ends = np.cumsum(sizes)
            out += [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
        return out


_workers: dict[str, WordTokens] = {}
cache("word tokens", _workers.clear)


def worker(path: str) -> WordTokens:
    """One encoder for each vocabulary and Python worker."""
    if path not in _workers:
        _workers[path] = WordTokens(path)
    return _workers[path]
