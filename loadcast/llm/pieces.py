"""SentencePiece encoding and decoding of whole texts by a batched Viterbi pass over distinct words."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, numbered
from .tokens import Memory, joined, places

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Piece types of a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Places of the table of neighbouring pieces that are known to stand or not; older answers are overwritten.
PAIRS = 1 << 20
#: Bits of a substring's hash that tell at once that no piece has it.
OCCUPIED = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OPEN: dict[str, "PieceModel"] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Settings:
    """What of a model file decides how a text is cut."""

    kind: int = UNIGRAM
    byte_fallback: bool = False
    normalizer: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True


def read_model(path: str) -> tuple[list[tuple[str, float, int]], Settings]:
    """Pieces (text, score, type) in the order of their ids, and settings."""
    pieces, settings = [], Settings()
    with open(path, "rb") as file:
        data = file.read()
    for field, value in _fields(data):
        if field == 1:
            found = dict(_fields(value))
            pieces.append((found[1].decode(), struct.unpack("<f", found.get(2, bytes(4)))[0], found.get(3, NORMAL)))
        elif field == 2:
            found = dict(_fields(value))
            settings.kind, settings.byte_fallback = found.get(3, UNIGRAM), bool(found.get(35, 0))
        elif field == 3:
            found = dict(_fields(value))
            settings.normalizer, settings.dummy_prefix = found.get(1, b""), bool(found.get(3, 1))
            settings.squeeze = bool(found.get(4, 1))
    return pieces, settings


class PieceModel:
    """Encoder and decoder of one model file, of the unigram or the BPE kind.

    Words of equal length form the rows of a matrix and advance together, one character at a time. At every end all
    substrings up to the longest piece are looked up by a rolling hash among the sorted piece keys, and the best way
    to get there is stored as a back-pointer. Unigram: the way with the largest sum of scores. BPE: merging pairs by
    rank leaves exactly one last piece for every prefix of a word, the one that stands next to the last piece of the
    shorter prefix without the two being merged or cut otherwise; it is the maximum of a score of 1 for neighbours
    that stand and 0 for others.
    """

    def __init__(self, path: str) -> None:
        self.pieces, self.settings = read_model(path)
        if self.settings.normalizer != b"identity" or self.settings.squeeze:
            raise ValueError("only models that keep the text as it is are supported")
        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.score = np.array([p[1] for p in self.pieces])
        self.byte_id = np.full(256, self.unknown, np.int64)
        raw = []
        for i, (text, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_id[int(text[3:5], 16)] = i
                raw.append(bytes([int(text[3:5], 16)]))
            else:
                raw.append(b"" if kind == CONTROL else text.encode())
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        normal = [(i, p[0]) for i, p in enumerate(self.pieces) if p[2] == NORMAL]
        self.longest = max(len(t) for _, t in normal)
        self.powers = _ODD ** np.arange(self.longest + 1, dtype=np.uint64)
        chars = np.zeros((len(normal), self.longest), np.uint32)
        for k, (_, text) in enumerate(normal):
            chars[k, : len(text)] = np.frombuffer(text.encode("utf-32-le"), "<u4")
        size = np.array([len(t) for _, t in normal])
        key = np.zeros(len(normal), np.uint64)
        for k in range(self.longest):
            key = np.where(k < size, key * _ODD + self._mixed(chars[:, k]), key)
        order = np.argsort(key)
        self.key, self.chars, self.size = key[order], chars[order], size[order]
        self.ids = np.array([i for i, _ in normal])[order]
        self.occupied = np.zeros(1 << OCCUPIED, bool)
        self.occupied[(self.key >> np.uint64(64 - OCCUPIED)).astype(np.int64)] = True
        self.by_text = {t: i for i, t in normal}
        inner = any(SPACE in t.lstrip(SPACE) for _, t in normal)
        feed = any("\n" in t for _, t in normal)
        # pieces have white space only in front, and no line feed: words can be cut there
        self.words = re.compile("(?s:.+)" if inner else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if feed
                                else f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.pair_key = np.full(PAIRS, -1, np.int64)
        self.pair_stands = np.zeros(PAIRS, bool)
        self.memory = Memory()

    @staticmethod
    def _mixed(chars: np.ndarray) -> np.ndarray:
        x = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def _merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours into the piece of the highest score, leftmost first, as long as there is one."""
        score, known = self.score, self.by_text
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = known.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves two neighbouring pieces as they are; ``left`` -1 is the start of a word."""
        count = len(self.pieces) + 1
        pair = (left + 1) * count + right
        slot = ((pair.astype(np.uint64) * _ODD) >> np.uint64(44)).astype(np.int64) & (PAIRS - 1)
        missing = np.unique(pair[self.pair_key[slot] != pair])
        answers = np.empty(len(missing), bool)
        for k, p in enumerate(missing.tolist()):
            a, b = divmod(p, count)
            second = self.pieces[b][0]
            if a == 0:
                answers[k] = self._merged(list(second)) == [second]
            elif a - 1 == self.unknown:
                answers[k] = True
            else:
                first = self.pieces[a - 1][0]
                answers[k] = self._merged(list(first + second)) == [first, second]
        if not len(missing):
            return self.pair_stands[slot]
        known = self.pair_key[slot] == pair
        out = np.where(known, self.pair_stands[slot], answers[np.minimum(np.searchsorted(missing, pair), len(missing) - 1)])
        at = ((missing.astype(np.uint64) * _ODD) >> np.uint64(44)).astype(np.int64) & (PAIRS - 1)
        self.pair_key[at], self.pair_stands[at] = missing, answers
        # two pairs of this call may share a slot: the last written one holds it
        self.pair_stands[at] = np.where(self.pair_key[at] == missing, answers, self.pair_stands[at])
        return out

    def _lookup(self, key: np.ndarray, chars: np.ndarray, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose substring of ``size`` characters before ``end`` is a piece, and its id."""
        rows = np.flatnonzero(self.occupied[(key >> np.uint64(64 - OCCUPIED)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.key, key[rows]), len(self.key) - 1)
        good = (self.key[at] == key[rows]) & (self.size[at] == size)
        rows, at = rows[good], at[good]
        same = (self.chars[at, :size] == chars[rows, end - size : end]).all(axis=1)
        return rows[same], self.ids[at[same]]

    def _viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Size and id of the last piece of each prefix, for words of equal length (rows of code points)."""
        n, length = chars.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for k in range(length):
            prefix[k + 1] = prefix[k] * _ODD + self._mixed(chars[:, k])
        sizes = np.zeros((length + 1, n), np.int32)
        last = np.full((length + 1, n), -1, np.int64)
        bpe = self.settings.kind == BPE
        total = np.zeros((length + 1, n))
        lowest = self.score.min() - 10
        for end in range(1, length + 1):
            best = np.zeros(n) if bpe else np.full(n, -np.inf)
            for size in range(min(self.longest, end), 0, -1):
                key = prefix[end] - prefix[end - size] * self.powers[size]
                rows, ids = self._lookup(key, chars, end, size)
                if size == 1:
                    single = np.zeros(n, bool)
                    single[rows] = True
                    other = np.flatnonzero(~single)
                    rows, ids = np.append(rows, other), np.append(ids, np.full(len(other), self.unknown))
                if bpe:
                    # a way once found is the only one
                    open_ = best[rows] == 0
                    rows, ids = rows[open_], ids[open_]
                    before = last[end - size][rows]
                    value = np.where(ids == self.unknown, True, False)
                    rest = np.flatnonzero(~value)
                    value[rest] = self._stand(before[rest], ids[rest])
                    better = value
                    value = value.astype(float)
                else:
                    value = total[end - size][rows] + np.where(ids == self.unknown, lowest, self.score[ids])
                    better = value > best[rows]
                rows, ids, value = rows[better], ids[better], value[better]
                best[rows], sizes[end][rows], last[end][rows] = value, size, ids
            total[end] = best
        return sizes, last

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the number of ids of each word; unknown characters become their bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == length)
            if not length:
                continue
            chars = np.frombuffer("".join(words[i] for i in which).encode("utf-32-le", "surrogatepass"),
                                  "<u4").reshape(len(which), length)
            sizes, last = self._viterbi(chars)
            end = np.full(len(which), length)
            live = np.arange(len(which))
            step = 0
            while len(live):
                ids, size = last[end[live], live], sizes[end[live], live]
                end[live] -= size
                unknown = (ids == self.unknown) & self.settings.byte_fallback
                if unknown.any():
                    for row in live[unknown].tolist():
                        point = chr(chars[row, end[row]])
                        for byte in reversed(point.encode("utf-8", "surrogatepass")):
                            found.append((which[row : row + 1], np.array([step]), self.byte_id[byte : byte + 1]))
                            step += 1
                found.append((which[live[~unknown]], np.full(int((~unknown).sum()), step), ids[~unknown]))
                step += 1
                live = live[end[live] > 0]
        if not found:
            return np.zeros(0, np.int64), counts
        owner, back, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-back, owner))
        return ids[order], np.bincount(owner, minlength=len(words)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        front = SPACE if self.settings.dummy_prefix else ""
        split = [self.words.findall(front + t.replace(" ", SPACE)) if t else [] for t in texts]
        of_text = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for s in split for w in s]
        codes, distinct = numbered(words)
        # what was encoded lately is remembered
        raw = [w.encode("utf-8", "surrogatepass") for w in distinct]
        _, data, begin = joined(raw)
        ids, sizes = self.memory.ids_of(data, begin, np.fromiter(map(len, raw), np.int64, len(raw)),
                                        lambda at: self.encode_words([distinct[i] for i in at.tolist()]))
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        owner = np.repeat(np.arange(len(texts)), of_text)
        return ids[places(starts[codes], n)], np.bincount(owner, n, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Text of each run of ids, in UTF-8: pieces and bytes in order, spaces for their sign, without the first one."""
        sizes = self.raw_size[ids]
        raw = self.raw[places(self.raw_start[ids], sizes)].tobytes()
        owner = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(np.bincount(owner, sizes, len(counts)).astype(np.int64)).tolist()
        sign = SPACE.encode()
        skip = 1 if self.settings.dummy_prefix else 0
        return [raw[a:b].replace(sign, b" ")[skip:] for a, b in zip([0, *ends], ends, strict=False)]


def model(path: str) -> PieceModel:
    """The model of this process for a file."""
    if path not in _OPEN:
        _OPEN[path] = PieceModel(path)
    return _OPEN[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids (little-endian 32 bits), decoded (the text from the ids).

    Null and empty texts have no pieces. The decoded text is the text itself, but that the sign for a space in a
    text becomes a space. Repeated rows get equal results; an empty table gives no rows.
    """

    def work(texts: list[bytes]) -> list:
        one = model(path)
        ids, counts = one.encode([t.decode("utf-8", "replace") for t in texts])
        cuts = (4 * np.cumsum(counts)).tolist()
        data = ids.astype("<u4").tobytes()
        return [counts, [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)],
                [t.decode("utf-8", "replace") for t in one.decode(ids, counts)]]

    return map_texts(docs, id_col, text_col, work, "n_pieces bigint, ids binary, decoded string")
