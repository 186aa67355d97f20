"""The ids of a lower-casing word tokenizer, piece by piece: equal to the library's, at a fraction of its time."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from .bpe import WHITE

#: Pieces that a worker remembers, each of at most LONGEST characters: at most some 100 MB.
MEMO, LONGEST = 500_000, 64


def _characters() -> list[str]:
    """Latin characters and punctuation that normalisation leaves alone and that lower case maps one to one, in either case."""
    import unicodedata

    alone = lambda c: len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c
    letters = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]) if alone(c) and ord(c.lower()) < 0x250]
    return sorted({*letters, *map(str.lower, letters)}) + [c for c in map(chr, range(0x2010, 0x20D0)) if alone(c) and unicodedata.category(c)[0] in "PS"]


def _plain_characters() -> tuple[str, str, str]:
    """Regex classes of _characters(): all of them, the letters in lower case, and the numbers."""
    import unicodedata

    plain, low = _characters(), [c for c in _characters() if c == c.lower()]
    return tuple("".join(map(re.escape, some)) for some in (plain, [c for c in low if unicodedata.category(c)[0] == "L"], [c for c in low if unicodedata.category(c)[0] == "N"]))


class Memo:
    """Ids of short texts, as bytes: up to twice MEMO of them; what was not asked for since the last change of generation is forgotten."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def ids(self, lists: list[list[str]]) -> list[bytes]:
        """The joined ids of each list of texts; make is called once for all that are not known."""
        if len(self.young) >= MEMO:
            self.young, self.old = {}, self.young
        get = self.young.get
        found = [list(map(get, some)) for some in lists]
        holes: list[tuple[list, int, str]] = []
        for some, got in zip(lists, found):
            at = -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                holes.append((got, at, some[at]))
        if holes:
            lost = {text for _, _, text in holes}
            known = {text: self.old[text] for text in lost if text in self.old}
            new = list(lost.difference(known))
            known.update(zip(new, self.make(new)))
            for got, at, text in holes:
                got[at] = known[text]
            self.young.update(known if max(map(len, lost)) <= LONGEST else {text: ids for text, ids in known.items() if len(text) <= LONGEST})
        return list(map(b"".join, found))


class Table:
    """Ids of short pieces by a 64-bit hash, in arrays: an open hash table of slots and a pool of ids.

    Keys are sums of random numbers for each character and place, so that different pieces share one with a probability
    of about 2^-64. When MEMO pieces are held, those that were not asked for since the last time are forgotten.
    """

    def __init__(self):
        self.bits = max(10, (2 * MEMO).bit_length())
        self.clear()

    def clear(self) -> None:
        slots = 1 << self.bits
        self.keys, self.used = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=bool)
        self.start, self.count = np.zeros(slots, dtype=np.int32), np.zeros(slots, dtype=np.int32)
        self.pool, self.filled, self.held = np.zeros(1 << 16, dtype="<u4"), 0, 0

    def _slots(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        out = self._slots(keys, 0)
        there = self.keys[out]
        todo = np.flatnonzero((there != keys) & (there != 0))
        out[there == 0] = -1
        step = 1
        while len(todo):
            slots = self._slots(keys[todo], step)
            there = self.keys[slots]
            out[todo] = np.where(there == 0, -1, slots)
            todo = todo[(there != keys[todo]) & (there != 0)]
            step += 1
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Different keys that aren't held yet, with their ids one behind the other."""
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.pool[self.filled : self.filled + len(ids)] = ids
        starts = self.filled + np.cumsum(counts) - counts
        self.filled += len(ids)
        self.held += len(keys)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slots = self._slots(keys[todo], step)
            free = self.keys[slots] == 0
            self.keys[slots[free]] = keys[todo[free]]
            mine = free & (self.keys[slots] == keys[todo])
            self.start[slots[mine]], self.count[slots[mine]], self.used[slots[mine]] = starts[todo[mine]], counts[todo[mine]], True
            todo, step = todo[~mine], step + 1

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in these slots, one behind the other, and how many each has."""
        counts = self.count[slots]
        before = np.cumsum(counts, dtype=np.int64) - counts
        return self.pool[np.repeat(self.start[slots] - before, counts) + np.arange(before[-1] + counts[-1] if len(slots) else 0)], counts

    def forget(self) -> None:
        keep = np.flatnonzero(self.used & (self.keys != 0))
        if len(keep) > MEMO // 2:
            keep = keep[:0]
        keys = self.keys[keep]
        ids, counts = self.take(keep)
        self.clear()
        self.add(keys, ids, counts)
        self.used[:] = False


#: The last of the plain characters.
_LAST = 0x20CF


@lru_cache(maxsize=1)
def word_encoder(tokenizer_path: str):
    """encode(list of texts) -> little-endian id bytes of each; a worker process keeps it, with its memos, for later tasks.

    The tokenizer drops white space and no token spans it. Texts of plain characters are cut into the
    tokenizer's own pieces, which are encoded once and remembered: all texts of a call together, with arrays. Of other texts
    the plain chunks between white space go by pieces and the others as a whole, one by one.
    """
    from array import array

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True
    plain, letters, numbers = _plain_characters()
    chunks_of = re.compile(f"[^{WHITE}]+").findall
    is_plain = re.compile(f"[{plain}{WHITE}]*").fullmatch
    pieces_of = re.compile(f"[{letters}]+|[{numbers}]|'s|'t|'re|'ve|'m|'ll|'d|[^{letters}{numbers}{WHITE}]+").findall
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    # The merges alone, for pieces that are lower case already and written in the vocabulary's signs for bytes.
    rules = json.loads(tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
    merges = Tokenizer.from_str(json.dumps(rules))
    written = str.maketrans({c: "".join(sign for sign, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)) for c in _characters() if not c.isascii()})

    def one_by_one(texts: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(pieces: list[str]) -> list[bytes]:
        """Many pieces as one text, cut where tokens end a word."""
        out: list[bytes] = []
        for k in range(0, len(pieces), 10_000):
            part = pieces[k : k + 10_000]
            ids = np.array(merges.encode_batch_fast([" ".join(part).translate(written)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(part):
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *cuts], cuts)]
            else:
                out += one_by_one(part)
        return out

    pieces, chunks = Memo(together), Memo(one_by_one)

    def encode_any(texts: list[str]) -> list[bytes]:
        easy = [is_plain(text) is not None for text in texts]
        cut = iter(pieces.ids([pieces_of(text.lower()) for text, some in zip(texts, easy) if some]))
        rest = [chunks_of(text) for text, some in zip(texts, easy) if not some]
        # Of the other texts the plain chunks go by pieces, too, all kinds of chunks in one call each.
        seen = list(dict.fromkeys(chunk for some in rest for chunk in some))
        kinds = [is_plain(chunk) is not None for chunk in seen]
        by_piece = iter(pieces.ids([pieces_of(chunk.lower()) for chunk, kind in zip(seen, kinds) if kind]))
        whole = iter(chunks.ids([[chunk] for chunk, kind in zip(seen, kinds) if not kind]))
        ids_of = {chunk: next(by_piece if kind else whole) for chunk, kind in zip(seen, kinds)}
        other = iter([b"".join(map(ids_of.__getitem__, some)) for some in rest])
        return [next(cut if some else other) for some in easy]

    codes = np.arange(_LAST + 2)
    kinds, lower = np.full(_LAST + 2, 4, dtype=np.uint8), codes.astype(np.uint32)
    kinds[[ord(c) for c in _characters()]] = 3
    lower[[ord(c) for c in _characters()]] = [ord(c.lower()) for c in _characters()]
    for kind, some in ((1, letters), (2, numbers)):
        kinds[[k for k in codes[kinds == 3] if re.match(f"[{some}]", chr(lower[k]))]] = kind
    kinds[[k for k in codes if re.match(f"[{WHITE}]", chr(k))]] = 0
    rng = np.random.default_rng(29)
    by_code = rng.integers(1, 1 << 63, _LAST + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    by_place = rng.integers(1, 1 << 63, LONGEST + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    table = Table()

    def cut(chars: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the tokenizer's pieces: runs of letters or of other signs, single numbers, and contractions."""
        breaks = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)])
        starts, ends = breaks, np.r_[breaks[1:], len(kind)]
        some = kind[starts] != 0
        starts, ends = starts[some], ends[some]
        at = np.flatnonzero((chars[starts[:-1]] == 39) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1]) & (kind[starts[1:]] == 1))
        if len(at):
            first = chars[starts[at + 1]]
            second = np.where(ends[at + 1] - starts[at + 1] > 1, chars[np.minimum(starts[at + 1] + 1, len(chars) - 1)], 0)
            one, two = np.isin(first, [ord(c) for c in "stmd"]), np.zeros(len(at), dtype=bool)
            for x, y in ("re", "ve", "ll"):
                two |= (first == ord(x)) & (second == ord(y))
            taken = one + 2 * two
            ends[at] += taken
            starts[at + 1] += taken
            some = starts < ends
            starts, ends = starts[some], ends[some]
        return starts, ends

    def encode_plain(texts: list[str]) -> list[bytes | None]:
        """None for texts with other characters, or with a piece of more than LONGEST."""
        joined = "\n".join(texts)
        chars = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"), _LAST + 1)
        if not len(chars):
            return [b""] * len(texts)
        kind = kinds[chars]
        bounds = np.cumsum([0, *(len(text) + 1 for text in texts)])
        odd = np.add.reduceat(kind == 4, bounds[:-1].clip(max=len(kind) - 1)) > 0
        if odd.any():
            kept = iter(encode_plain([text for text, some in zip(texts, odd) if not some]) if not odd.all() else [])
            return [None if some else next(kept) for some in odd]
        chars = lower[chars]
        starts, ends = cut(chars, kind)
        if not len(starts):
            return [b""] * len(texts)
        size = ends - starts
        if size.max() > LONGEST:
            long = np.zeros(len(texts), dtype=bool)
            long[np.searchsorted(bounds, starts[size > LONGEST], side="right") - 1] = True
            kept = iter(encode_plain([text for text, some in zip(texts, long) if not some]) if not long.all() else [])
            return [None if some else next(kept) for some in long]
        begin = np.cumsum(size) - size
        inside = np.arange(begin[-1] + size[-1]) - np.repeat(begin, size)
        with np.errstate(over="ignore"):
            mixed = by_code[chars[np.repeat(starts, size) + inside]] * by_place[inside]
            keys = np.add.reduceat(mixed, begin) + by_place[-1] * size.astype(np.uint64)
            keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
        slots = table.find(keys)
        lost = np.flatnonzero(slots < 0)
        if len(lost):
            if table.held >= MEMO:
                table.forget()
                slots = table.find(keys)
                lost = np.flatnonzero(slots < 0)
            new, at = np.unique(keys[lost], return_index=True)
            low = joined.lower()
            ids = together([low[x:y] for x, y in zip(starts[lost[at]].tolist(), ends[lost[at]].tolist())])
            table.add(new, np.frombuffer(b"".join(ids), dtype="<u4"), np.array([len(x) // 4 for x in ids], dtype=np.int32))
            slots[lost] = table.find(keys[lost])
        table.used[slots] = True
        ids, counts = table.take(slots)
        until = np.r_[0, np.cumsum(counts, dtype=np.int64)][np.searchsorted(starts, bounds)] * 4
        data = ids.tobytes()
        return [data[x:y] for x, y in zip(until.tolist(), until[1:].tolist())]

    def encode(texts: list[str]) -> list[bytes]:
        out = encode_plain(texts) if texts else []
        slow = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(slow, encode_any([texts[k] for k in slow])):
            out[k] = ids
        return out

    return encode
