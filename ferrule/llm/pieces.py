"""SentencePiece encoding by a max-plus parallel scan, and decoding.

A byte-pair model's encoding of a text is the one chain of pieces in which every two neighbours are compatible:
their joint text encodes to just the two.  That makes it a best path, with weight 0 between compatible neighbours
and minus infinity between others.

A long text is cut into chunks anywhere.  At a cut the state is the piece that reaches or crosses it; a chunk
yields a transfer matrix: the best weight from each state at its left cut to each state at its right cut.
Max-plus products of matrices are associative, so chunks are worked on apart and combined in any grouping.  The
combined matrices fix the state at each cut, and each chunk is backtraced on its own between its two states.
A text of one chunk has a matrix of one row.  No piece joins the end of a word to the mark that opens the next,
so there the only state is the piece before it, and words already seen come from the worker's cache.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from ferrule.llm.memory import cache

SPACE = "▁"
NEVER = -np.inf
#: An encoder's caches: words and their ids, compatible pairs.
WORDS, PAIRS = 1_000_000, 2_000_000

State = tuple[int, int, int]  # begin, end, id (below 0: a character outside the vocabulary)


class Pieces:
    """The vocabulary of a .model file, encoding and decoding as its library does."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = pb.ModelProto.SentencePiece
        if spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not spec.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback that leave texts as they are")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with pieces of the user's own, or unused ones")
        self.names = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("pieces that join words")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else n.replace(SPACE, " ").encode() if n in self.ids else b"" for i, n in enumerate(self.names)]
        #: Beginnings of pieces, with the id of the piece or -1.
        self.prefixes = {n[:k]: -1 for n in self.ids for k in range(1, len(n))} | self.ids
        self.longest = max(map(len, self.ids))
        norm.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    # -- weights

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a."""
        if a < 0 or b < 0:
            return True
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found = self.library.encode(self.names[a] + self.names[b]) == [a, b]
        return found

    def opens(self, a: int) -> bool:
        """Whether a text may begin with a."""
        if a < 0:
            return True
        key = -1 - a
        if key not in self.pairs:
            self.pairs[key] = self.library.encode(self.names[a]) == [a]
        return self.pairs[key]

    def _starting(self, s: str, i: int) -> list[tuple[int, int]]:
        """End and id of the pieces that begin at i."""
        found = [(j, t) for j in range(i + 1, min(len(s), i + self.longest) + 1) if (t := self.ids.get(s[i:j])) is not None]
        return found if found and found[0][0] == i + 1 else [(i + 1, -1 - ord(s[i])), *found]

    # -- one chunk

    def states(self, s: str, cut: int) -> list[State]:
        """The pieces that begin before a cut and reach or cross it."""
        return [(i, j, t) for i in range(max(0, cut - self.longest), cut) for j, t in self._starting(s, i) if j >= cut]

    def transfer(self, s: str, right: int, before: list[State | None], after: list[State]) -> np.ndarray:
        """Best weights between the states at a chunk's left cut (None: the text begins) and at its right one."""
        n = len(before)
        at: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        for k, state in enumerate(before):
            one = np.full(n, NEVER)
            one[k] = 0.0
            i, j, t = state or (-1, 0, 0)
            at.setdefault(j, {})[(i, t)] = one
        place = min(at) if at else right
        while place < right:
            here = at.pop(place, None)
            if here:
                for j, t in self._starting(s, place):
                    ways = [w for (i, a), w in here.items() if (self.opens(t) if i < 0 else self.fits(a, t))]
                    if ways:
                        best = ways[0] if len(ways) == 1 else np.maximum.reduce(ways)
                        known = at.setdefault(j, {})
                        known[(place, t)] = best if (place, t) not in known else np.maximum(best, known[(place, t)])
            place += 1
        out = np.full((n, len(after)), NEVER)
        for k, (i, j, t) in enumerate(after):
            if (i, t) in at.get(j, ()):
                out[:, k] = at[j][(i, t)]
        return out

    def backtrace(self, s: str, right: int, before: State | None, after: State) -> list[int]:
        """The ids from after one state to the other, it included."""
        i, j, t = before or (-1, 0, 0)
        if before == after:
            return []
        chain: dict[tuple[int, int, int], tuple | None] = {(i, j, t): None}
        ends: dict[int, list] = {j: [(i, j, t)]}
        for place in range(j, right):
            for state in ends.pop(place, ()):
                for q, u in self._starting(s, place):
                    if (place, q, u) not in chain and (self.opens(u) if state[0] < 0 else self.fits(state[2], u)):
                        chain[(place, q, u)] = state
                        ends.setdefault(q, []).append((place, q, u))
        out, state = [], after
        while state != (i, j, t):
            out += reversed(self._spell(state[2]))
            state = chain[state]
        return out[::-1]

    def _spell(self, t: int) -> list[int]:
        return [t] if t >= 0 else [self.bytes[b] for b in chr(-1 - t).encode("utf-8", "surrogatepass")]

    # -- texts

    @staticmethod
    def prepared(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _word(self, s: str) -> bytes:
        """The ids of a chunk that is a whole word: one row, so a single best piece at each place."""
        n = len(s)
        last, begin = [0] * (n + 1), [-1] * (n + 1)
        get, pairs, fits = self.prefixes.get, self.pairs, self.fits
        for i in range(n):
            if i and begin[i] < 0:
                continue
            before = last[i]
            j = i + 1
            t = get(s[i:j])
            if t is None or t < 0:  # a character that is no piece
                if begin[j] < 0:
                    last[j], begin[j] = -1 - ord(s[i]), i
                if t is None:
                    continue
            while t is not None:
                if t >= 0 and begin[j] < 0:
                    if i:
                        ok = pairs.get(before << 20 | t)
                        if ok is None:
                            ok = fits(before, t)
                    else:
                        ok = self.opens(t)
                    if ok:
                        last[j], begin[j] = t, i
                if j == n:
                    break
                j += 1
                t = get(s[i:j])
        out, j = [], n
        while j:
            t = last[j]
            if t >= 0:
                out.append(t)
            else:
                out += reversed(self._spell(t))
            j = begin[j]
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids (32 bits each) of a text of one chunk."""
        words, out = self.words, []
        parts = _WORDS.findall(self.prepared(text))
        for w in parts:
            ids = words.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= 64:
                    if len(words) >= WORDS:
                        words.clear()
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def combine(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut (the last one the end) on the best path through a text's chunks.

    Products of neighbouring matrices form a tree; going down it, each product's middle state is the one that its
    best way between its two ends passes.
    """

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, :, None] + b[None, :, :]).max(axis=1)

    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([product(m[i], m[i + 1]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
    end = int(np.argmax(levels[-1][0][0]))
    if levels[-1][0][0, end] == NEVER:
        raise ValueError("no path: not a model of compatible pairs")
    ends = [(0, end)]  # states at both ends of each product
    for m in reversed(levels[:-1]):
        down = []
        for k, (a, b) in enumerate(ends):
            if 2 * k + 1 < len(m):
                middle = int(np.argmax(m[2 * k][a] + m[2 * k + 1][:, b]))
                down += [(a, middle), (middle, b)]
            else:
                down.append((a, b))
        ends = down
    return [b for _, b in ends]


_workers: dict[str, Pieces] = {}
cache("pieces", _workers.clear)


def worker(path: str) -> Pieces:
    """One vocabulary for each Python worker."""
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]
