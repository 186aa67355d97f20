"""Exact byte-level BPE in linear time: longest matches, backtracking and memoised adjacent-token checks."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession

from .shared import map_texts, read_table

#: Unicode White_Space as a character class; the tokenizer's \s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pattern whose matches can be found between white space; with others the whole text is matched.
SPLITTING = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker remembers in each of two generations: those not asked for in the last one are forgotten.
MEMO = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class ByteBPE:
    """Encodes a piece of bytes exactly as repeated lowest-rank merging does.

    A token sequence is the one that merging yields if and only if each two neighbours stay apart when
    they are merged alone. So the encoder takes the longest token at each position, and falls back to a
    shorter one, or undoes the last token, where the neighbours are not compatible. A position that was
    left once is never entered again, which bounds the work by the length times the longest token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
            elif not self._split(token, rank):
                continue  # merging never makes it
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.apart.clear()

    def _split(self, token: bytes, rank: int) -> bool:
        left = self.shorter[rank]
        while left != -1:
            right = self.ranks.get(token[len(self.bytes_of[left]) :], -1)
            if right in self.halves and left in self.halves and left < rank and right < rank and self._stay_apart(left, right):
                self.halves[rank] = (left, right)
                self.joined[left, right] = rank
                return True
            left = self.shorter[left]
        return False

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undoes the merges of both sides, the latest first; a merge across the gap that was due earlier joins them."""
        limit = 1 << 62
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) >= MEMO:
                self.apart.clear()
            known = self.apart[left, right] = self._stay_apart(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, bytes_of, shorter = len(piece), self.bytes_of, self.shorter
        longest = [-1] * size
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - len(bytes_of[rank])
            if longest[start] == -1 or len(bytes_of[longest[start]]) < end + 1 - start:
                longest[start] = rank
        open_ = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0] if size else -1
        while at < size:
            last = out[-1] if out else -1
            while token != -1:
                end = at + len(bytes_of[token])
                if open_[end] and (last == -1 or self.compatible(last, token)):
                    break
                token = shorter[token]
            if token == -1:
                open_[at] = 0
                token = out.pop()
                at -= len(bytes_of[token])
            else:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
        return out


def _own_white(pattern: str) -> str:
    r"""The pattern with \s and \S by the Unicode White_Space property, inside and outside of brackets."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{WHITE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            k -= 1
        k += 2
    return "".join(out)


def codec(ranks_path: str, pattern: str):
    """encode(text) -> ids as little-endian bytes, and decode(ids) -> bytes, with bounded memos."""
    import re
    from array import array

    import regex

    bpe = ByteBPE(read_ranks(ranks_path))
    pieces_of = regex.compile(_own_white(pattern)).findall
    # By this pattern white space after other characters always begins a piece, so such units can be encoded apart.
    units_of = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall if pattern == SPLITTING else None
    units: dict[str, bytes] = {}
    pieces: dict[str, bytes] = {}
    before: dict[str, bytes] = {}

    def piece_ids(piece: str) -> bytes:
        nonlocal pieces, before
        known = pieces.get(piece)
        if known is None:
            if len(pieces) >= MEMO:
                pieces, before = {}, pieces
            known = before.get(piece)
            if known is None:
                known = array("I", bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
            if len(piece) < 100:
                pieces[piece] = known
        return known

    class Units(dict):
        old: dict[str, bytes] = {}

        def __missing__(self, unit: str) -> bytes:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            ids = self.old.get(unit)
            if ids is None:
                ids = b"".join(map(piece_ids, pieces_of(unit)))
            if len(unit) < 100:
                self[unit] = ids
            return ids

    units = Units()
    get = units.__getitem__
    token = bpe.bytes_of.__getitem__

    def encode(text: str) -> bytes:
        return b"".join(map(get, units_of(text)) if units_of else map(piece_ids, pieces_of(text)))

    def decode(ids: bytes) -> bytes:
        return b"".join(map(token, memoryview(ids).cast("I")))

    return encode, decode


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes each text by the ranks, piece by piece of the pattern, and decodes the ids again.

    A null text counts as empty: no tokens and the hash of no bytes. Repeated rows, null ids and ties stay
    as they are, one output row for each input row; other columns of docs are not read. keep_ids adds the
    ids themselves. Each row depends on itself alone, so there is no shuffle.
    """

    def make():
        encode, decode = codec(ranks_path, pattern)

        def run(texts: list[str]):
            ids = [encode(text) for text in texts]
            columns = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(decode(x)).hexdigest() for x in ids]]
            return columns + [[memoryview(x).cast("I").tolist() for x in ids]] * keep_ids, None

        return run

    return map_texts(docs, {id_col: id_col}, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, make)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
