"""Token ids of whole texts, by a public tokenizer file and the tokenizers library."""

from __future__ import annotations

import os
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from .common import numbered

#: Bytes of text whose distinct words are encoded together, and of those whose ids are laid out at once.
STEP_BYTES, PART_BYTES = 8_000_000, 2_000_000
#: Remembered words, and the bytes of the longest of them, 16 at most.
REMEMBERED, SHORT = 1 << 20, 16
#: Texts in one call of the library, whose results take many times their size.
CALL = 1_000
#: Texts in which a space is followed by white space or ends the text; there a token may span words.
_SPANNING = re.compile(r" (?=[\s᠎​﻿]|\Z)")
#: Bytes after a space that may begin white space.
_DOUBTFUL = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: ASCII bytes: punctuation, and letters and numbers; every byte in lower case.
_PUNCTUATION = np.isin(np.arange(256), list(string.punctuation.encode()))
_ALNUM = np.isin(np.arange(256), list((string.ascii_letters + string.digits).encode()))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Letters below are letters in every version of Unicode, and composed already.
_COMMON = "\u0250"
#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_OPEN: dict[tuple[str, bool], "WordEncoder"] = {}


class Memory:
    """Ids of short words seen lately, as a table sorted by the words' hashes.

    Words are compared byte by byte. When they are too many, those go that were not asked for the longest.
    """

    def __init__(self) -> None:
        #: hash, bytes (two numbers), size, number of ids, and when last asked for
        self.table = [np.zeros(0, kind) for kind in ("u8", "u8", "u8", "u1", "i4", "i4")]
        self.starts, self.ids, self.time = np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def ids_of(self, data: np.ndarray, start: np.ndarray, size: np.ndarray,
               encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, which are different, and the number of ids of each.

        ``encode`` takes the numbers of the words that are not known, and returns the same of these. ``data`` has eight
        more bytes behind the last word.
        """
        self.time += 1
        short = np.flatnonzero(size <= SHORT)
        entry = _short_words(data, start[short], size[short])
        at = np.searchsorted(self.table[0], entry[0])
        same = at < len(self.table[0])
        for column, asked in zip(self.table, entry[:4], strict=False):
            same[same] = column[at[same]] == asked[same]
        at = at[same]
        self.table[5][at] = self.time
        known = np.zeros(len(size), bool)
        known[short[same]] = True
        missing = np.flatnonzero(~known)
        ids, n = encode(missing)
        sizes = np.empty(len(size), np.int64)
        sizes[missing], sizes[known] = n, self.table[4][at]
        ends = np.cumsum(sizes)
        found = np.empty(int(sizes.sum()), np.int64)
        found[places(ends[missing] - n, n)] = ids
        found[places((ends - sizes)[known], sizes[known])] = self.ids[places(self.starts[at], sizes[known])]
        new = ~same
        self._add([x[new] for x in entry], sizes[short[new]], found, (ends - sizes)[short[new]])
        return found, sizes

    def _add(self, entry: list[np.ndarray], n: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        # of words with one hash the first is remembered
        key, of = np.unique(entry[0], return_index=True)
        at = np.searchsorted(self.table[0], key)
        new = np.ones(len(key), bool)
        new[at < len(self.table[0])] = self.table[0][at[at < len(self.table[0])]] != key[at < len(self.table[0])]
        at, of = at[new], of[new]
        added = [*(x[of] for x in entry), n[of], np.full(len(of), self.time)]
        begin = len(self.ids) + np.cumsum(n[of]) - n[of]
        self.ids = np.concatenate([self.ids, ids[places(starts[of], n[of])].astype(np.uint32)])
        self.starts = np.insert(self.starts, at, begin)
        self.table = [np.insert(column, at, x) for column, x in zip(self.table, added, strict=True)]
        if len(self.starts) > REMEMBERED:
            used = self.table[5]
            # the newer half stays, and nothing where that is not less
            stay = used > np.partition(used, len(used) // 2)[len(used) // 2]
            self.table = [column[stay] for column in self.table]
            n = self.table[4].astype(np.int64)
            self.ids = self.ids[places(self.starts[stay], n)]
            self.starts = np.cumsum(n) - n


def _short_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Hash, first and last eight bytes, and size of words of up to 16 bytes."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    first = eight[start] & _LOW[np.minimum(size, 8)]
    second = eight[np.minimum(start + 8, len(eight) - 1)] & _LOW[np.maximum(size - 8, 0)]
    key = (first ^ size.astype(np.uint64) * _OTHER) * _ODD
    key = (key ^ key >> np.uint64(29) ^ second) * _OTHER
    return [key ^ key >> np.uint64(32), first, second, size.astype(np.uint8)]


class WordEncoder:
    """Encodes each distinct word of many texts once.

    Byte-level and word-level pre-tokenizers begin a new token at a space that is followed by anything but white
    space, so the ids of a text are those of its first word and of every other word with its space. Texts with
    other spacing are encoded whole. Punctuation at the end of a word is a token of its own, and word-level
    tokenizers lower-case, so words that differ in these only are encoded once. Special tokens in a text are found
    as the library finds them.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        """``spaced``: a space belongs to the word after it (byte-level) or to none (word-level)."""
        # every core has a task of its own already; read by the library when it first encodes
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lead = " " if spaced else ""
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.memory = Memory()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the number of ids of each, one call of the library per text."""
        made: list[int] = []
        ends = [0]
        for at in range(0, len(texts), CALL):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False):
                made += e.ids
                ends.append(len(made))
        return np.array(made, np.int64), np.diff(ends)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and the number of ids of each.

        What is all letters is one token of the pre-tokenizer and goes to the library's model as that token, which
        spares the way through normalising and splitting; other words go all the way.
        """
        model = self.tokenizer.model.tokenize
        ids: list[int] = []
        # lists of lists would keep the collector of cycles busy
        ends, rest = [0], []
        for word in words:
            bare = word[1:] if word[0] == 32 else word
            if bare.isalpha():
                ids += [t.id for t in model(word.decode().replace(" ", "Ġ"))]
            elif bare.isascii():
                rest.append(len(ends) - 1)
            else:
                text = bare.decode()
                # lower case before or after normalising is the same for these
                if not self.lead and "Σ" not in text and unicodedata.is_normalized("NFC", text):
                    text = text.lower()
                if text.isalpha() and max(text) < _COMMON:
                    raw = word if self.lead else text.encode()
                    ids += [t.id for t in model(raw.decode("latin-1").translate(_VISIBLE))]
                else:
                    rest.append(len(ends) - 1)
            ends.append(len(ids))
        found = np.array(ids, np.int64)
        sizes = np.diff(ends)
        if not rest:
            return found, sizes
        rest_ids, rest_sizes = self._whole([words[i].decode() for i in rest])
        starts = np.array(ends[:-1])
        starts[rest] = len(found) + np.cumsum(rest_sizes) - rest_sizes
        sizes[rest] = rest_sizes
        return np.concatenate([found, rest_ids])[places(starts, sizes)], sizes

    def _distinct(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, which are ``size`` bytes at ``start``, and the number of ids of each.

        A word is put together from its core and the punctuation at its end, if the core ends in a letter or number:
        only then the punctuation is sure to be a token of its own.
        """
        owner, start, size, spaced = self._pieces(data, start, size)
        core, live = size.copy(), np.arange(len(size))
        while len(live):
            live = live[_PUNCTUATION[data[start[live] + core[live] - 1]]]
            core[live] -= 1
            live = live[core[live] > 0]
        last = data[start + np.maximum(core, 1) - 1]
        sure = (core > 0) & _ALNUM[last]
        for i in np.flatnonzero((core < size) & (last > 127)).tolist():
            sure[i] = data[start[i] : start[i] + core[i]].tobytes().decode()[-1].lower()[-1].isalnum()
        core = np.where(sure, core, size)
        if self.lead:
            lower, begin = data, start - spaced
        else:
            # words of ASCII alone are taken from a copy in lower case
            wide = np.concatenate([[0], np.cumsum(data > 127, dtype=np.int32)])
            lower = np.concatenate([data, _LOWER[data]])
            begin = np.where(sure & (wide[start + size] == wide[start]), start + len(data), start)
        code, of = distinct_words(lower, begin, core + spaced)
        tail_code, tail_of = distinct_words(data, start + core, size - core)
        ids, sizes = self.memory.ids_of(lower, begin[of], (core + spaced)[of],
                                        lambda at: self._encoded(cut(lower, begin[of][at], (core + spaced)[of][at])))
        tails, tail_sizes = self._whole([t.decode() for t in cut(data, (start + core)[tail_of], (size - core)[tail_of])])
        starts = np.stack([(np.cumsum(sizes) - sizes)[code], (len(ids) + np.cumsum(tail_sizes) - tail_sizes)[tail_code]], 1)
        both = np.stack([sizes[code], tail_sizes[tail_code]], 1)
        per_word = np.bincount(owner, both.sum(1)).astype(np.int64)
        return np.concatenate([ids, tails])[places(starts.ravel(), both.ravel())], per_word

    def _pieces(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words cut at the line ends in them: number of the word, place and size of each piece, and 1 where the space
        before it belongs to it.

        Byte-level pre-tokenizers make tokens of one or two line ends between other signs than white space. Words with
        more in a row, with one at an end, or that may hold other white space stay whole.
        """
        start, size = start.astype(np.int64), size.astype(np.int64)
        whole = np.arange(len(size)), start, size, np.full(len(size), int(bool(self.lead)))
        if not self.lead or not len(size):
            return whole
        line = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)])
        odd = np.concatenate([[0], np.cumsum(_DOUBTFUL[data] & (data != 10), dtype=np.int32)])
        end = start + size
        some = np.flatnonzero((line[end] > line[start]) & (odd[end] == odd[start])
                              & (data[start] != 10) & (data[end - 1] != 10))
        at, own = places(start[some], size[some]), np.repeat(some, size[some])
        here = data[at] == 10
        # no word begins or ends with one, so three in a row are in one word
        three = own[2:][here[2:] & here[1:-1] & here[:-2]]
        keep = ~np.isin(own, three)
        at, own, here = at[keep], own[keep], here[keep]
        if not len(at):
            return whole
        first = np.diff(own, prepend=-1) != 0
        cut = np.flatnonzero(first | here | np.concatenate([[False], here[:-1]]))
        count = np.ones(len(size), np.int64)
        words, n = np.unique(own[cut], return_counts=True)
        count[words] = n
        made = [np.repeat(x, count) for x in whole]
        to = places((np.cumsum(count) - count)[words], n)
        made[1][to], made[2][to], made[3][to] = at[cut], np.diff(cut, append=len(at)), first[cut]
        return tuple(made)

    def _spanning(self, data: np.ndarray, texts: list[bytes], begin: np.ndarray) -> list[int]:
        """Texts that have to be encoded whole."""
        found = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if self.lead:
            space = np.flatnonzero(data[:-8] == 32)
            doubtful = np.unique(np.searchsorted(begin, space[_DOUBTFUL[data[space + 1]]], side="right") - 1)
            found += [i for i in doubtful.tolist() if _SPANNING.search(texts[i].decode())]
        return found

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of UTF-8 texts in one array, and the number of ids of each."""
        made = list(self.encoded(texts))
        if not made:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, ids, sizes = zip(*made, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)

    def encoded(self, texts: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Slices of the texts with their ids in one array and the number of ids of each text."""
        if not texts:
            return
        raw, data, begin = joined(texts)
        whole = self._spanning(data, texts, begin)
        heads = [b""] * len(texts)
        for i in whole:
            heads[i] = texts[i]
        if whole:
            raw, data, begin = joined([b"" if heads[i] else t for i, t in enumerate(texts)])
        parts, found = _parts(begin, len(data)), []
        for part, a, b in parts:
            gap = data[a:b] == 32 if self.lead else (data[a:b] == 32) | (data[a:b] == 10)
            edge = np.flatnonzero(np.diff(gap, prepend=True, append=True)).astype(np.int32) + np.int32(a)
            start, size = edge[::2], np.diff(edge)[::2]
            many = np.diff(np.searchsorted(start, begin[part]), append=len(start))
            owner = np.repeat(np.arange(part.start, part.stop, dtype=np.int32), many)
            if self.lead:
                # the first word of a text has no space before it
                first = start == begin[owner]
                for i, n in zip(owner[first].tolist(), size[first].tolist(), strict=True):
                    heads[i] = texts[i][:n]
                start, size, owner = start[~first], size[~first], owner[~first]
            # first the distinct words of this part, then those of all parts
            code, of = distinct_words(data, start, size)
            found.append((code, owner, start[of], size[of]))
        start, size = (np.concatenate([f[k] for f in found]) for k in (2, 3))
        codes, of = distinct_words(data, start, size)
        flat, sizes = self._distinct(data, start[of], size[of])
        del raw, data
        starts, base = np.cumsum(sizes) - sizes, 0
        for (part, _, _), (code, owner, own, _) in zip(parts, found, strict=True):
            code, base = codes[base : base + len(own)][code], base + len(own)
            head_ids, head_sizes = self._whole([h.decode() for h in heads[part]])
            n = sizes[code]
            # what is encoded without a space goes before the words
            at = np.searchsorted(owner, np.arange(part.start, part.stop))
            order = np.insert(starts[code], at, len(flat) + np.cumsum(head_sizes) - head_sizes)
            per_text = np.bincount(owner - part.start, n, part.stop - part.start).astype(np.int64) + head_sizes
            yield part, np.concatenate([flat, head_ids])[places(order, np.insert(n, at, head_sizes))], per_text


def _visible() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


_VISIBLE = _visible()


def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The bytes of each word."""
    raw = data.tobytes()
    return [raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts with a space after each and eight spaces more, the same as numbers, and where each text begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = b" ".join([*texts, b" " * 8])
    return raw, np.frombuffer(raw, np.uint8), np.cumsum(sizes) - sizes


def _parts(begin: np.ndarray, end: int) -> list[tuple[slice, int, int]]:
    """Slices of texts of about ``PART_BYTES`` bytes, one text at least, and where their bytes lie."""
    found, start = [], 0
    while start < len(begin):
        stop = max(start + 1, int(np.searchsorted(begin, begin[start] + PART_BYTES)))
        found.append((slice(start, stop), int(begin[start]), int(begin[stop]) if stop < len(begin) else end - 8))
        start = stop
    return found


def distinct_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of ``size`` bytes at ``start``, equal for equal words, and a place of each distinct word.

    Words are hashed eight bytes at a time and compared with the chosen place of their number; should two words
    share a hash, all are compared as they are. ``data`` has eight more bytes behind the last word.
    """
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    block = 1 << 18

    def chunks(a: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Of a block the words that reach so far, the place in them, and masks of what is theirs, for each eight bytes."""
        live, at = np.arange(a, min(a + block, len(size))), 0
        while len(live):
            yield live, at, _LOW[np.minimum(size[live] - at, 8)]
            live, at = live[size[live] > at + 8], at + 8

    blocks = range(0, len(size), block)
    key = size.astype(np.uint64) * _ODD
    for a in blocks:
        for live, at, mask in chunks(a):
            mixed = (key[live] ^ eight[start[live] + at] & mask) * _ODD
            key[live] = mixed ^ mixed >> np.uint64(29)
    codes, of = _classes(key)
    del key
    same = all(np.array_equal(size[a : a + block], size[of[codes[a : a + block]]]) and all(
        np.array_equal(eight[start[live] + at] & mask, eight[start[of[codes[live]]] + at] & mask)
        for live, at, mask in chunks(a)) for a in blocks)
    if not same:
        raw = data.tobytes()
        codes, words = numbered([raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)])
        of = np.empty(len(words), np.int64)
        of[codes] = np.arange(len(codes))
    return codes, of


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, equal for equal keys, and a place of each.

    Keys are thrown into as many slots as there are keys, where one of each slot stays; those that differ from the one in
    their slot are thrown again by other bits.
    """
    codes, number = np.empty(len(key), np.int32), np.empty(len(key), np.int32)
    live, found, count = np.arange(len(key), dtype=np.int32), [np.zeros(0, np.int32)], 0
    while len(live):
        bits = max(len(live).bit_length(), 8)
        slot = (key >> np.uint64(64 - bits)).astype(np.int64)
        last = np.empty(1 << bits, np.int32)
        last[slot] = np.arange(len(live), dtype=np.int32)
        chosen = last[slot]
        same = key[chosen] == key
        stay = np.flatnonzero(chosen == np.arange(len(live)))
        number[stay] = np.arange(count, count + len(stay))
        codes[live[same]] = number[chosen[same]]
        found.append(live[stay])
        count += len(stay)
        live, key = live[~same], key[~same]
        key = (key ^ key >> np.uint64(29)) * _OTHER
    return codes, np.concatenate(found).astype(np.int64)


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``s, s + 1, ..., s + n - 1`` for every start and size, one after the other."""
    some = sizes > 0
    s, n = starts[some], sizes[some]
    if not len(n):
        return np.zeros(0, np.int64)
    step = np.ones(int(n.sum()), np.int64)
    begin = np.cumsum(n) - n
    step[begin] = s
    step[begin[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(step)


def encoder(path: str, spaced: bool) -> WordEncoder:
    """The encoder of this process for a tokenizer file."""
    if (path, spaced) not in _OPEN:
        _OPEN[path, spaced] = WordEncoder(path, spaced)
    return _OPEN[path, spaced]


def end_each(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each text, and the new sizes."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
