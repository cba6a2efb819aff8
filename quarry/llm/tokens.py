"""Token ids of whole texts by the tokenizers library, with a memo of the words between spaces and line ends.

A byte-level BPE tokenizer cuts its text before it merges, and no piece goes on over a space that stands between
two other characters, nor over a single line end. So a text without other white space is encoded word by word,
and a word met before needs no second encoding: a slice's distinct words are looked up by hash, and by all their bytes,
and new ones are encoded together. Texts with other white space, two of them in a row, a space at an
end, or the special token's string are encoded as one.

Words are cut once more where a mark follows an ASCII letter or digit: a piece ends there in any case, and there are
fewer distinct words without the marks at their ends. New words of letters only are one piece each, so the library's
model gets them as they are, without the pattern that would cut them.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from quarry.llm import textscan
from quarry.llm.common import HELD

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_SPACE, _LINE = 32, 10
_BAD = np.zeros(256, np.bool_)
_BAD[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = True
_ASCII = np.arange(256)
_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122) & (_ASCII < 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
#: ASCII marks except the apostrophe, which may begin a piece that goes on with letters.
_MARK = (_ASCII > 32) & (_ASCII < 127) & (_ASCII != 39) & ~_LETTER & ~_DIGIT
#: First bytes of U+00C0 to U+023F: letters, but for two signs.
_LATIN = (_ASCII >= 0xC3) & (_ASCII <= 0xC8)
#: Fixed: the character by which byte-level vocabularies write each byte.
_KEPT = (_ASCII > 32) & (_ASCII < 127) | (_ASCII > 0xA0) & (_ASCII != 0xAD)
_WRITTEN = np.where(_KEPT, _ASCII, 255 + np.cumsum(~_KEPT)).astype("<u4")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places start .. start + size, one range after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class _Table:
    """Words by sorted hash: the place and number of their bytes in one pool and of their ids in another."""

    def __init__(self):
        self.keys, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.from_, self.length, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def find(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Row of each word, -1 where it is unknown; all bytes are compared."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        order = np.argsort(keys)  # sorted keys are found faster
        row = np.empty(len(keys), np.int64)
        row[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        size = np.diff(offsets)
        same = np.flatnonzero((self.keys[row] == keys) & (self.length[row] == size))
        n = size[same]
        differs = np.append(0, np.cumsum(self.bytes[_ranges(self.from_[row[same]], n)] != data[_ranges(offsets[same], n)]))
        ends = np.cumsum(n)
        same = same[differs[ends] == differs[ends - n]]
        out = np.full(len(keys), -1)
        out[same] = row[same]
        return out

    def add(self, keys: np.ndarray, words: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, from_ = np.cumsum(sizes) - sizes + len(self.pool), np.cumsum(lengths) - lengths + len(self.bytes)
        keys = np.append(self.keys, keys)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.at, self.size = np.append(self.at, at)[order], np.append(self.size, sizes.astype(np.int32))[order]
        self.from_, self.length = np.append(self.from_, from_)[order], np.append(self.length, lengths.astype(np.int32))[order]
        self.pool, self.bytes = np.append(self.pool, ids.astype(np.uint32)), np.append(self.bytes, words)

    def rows(self) -> tuple[np.ndarray, ...]:
        """What add() takes."""
        return self.keys, self.bytes[_ranges(self.from_, self.length)], self.length, self.pool[_ranges(self.at, self.size)], self.size


class Encoder:
    """Ids of texts. words: about how many the memo holds before it starts anew; ids don't depend on it."""

    def __init__(self, path: str, words: int = 400_000, recent: int = 50_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._pieces = Tokenizer(self._tokenizer.model)  # for words that are one piece, as the vocabulary writes them
        self._pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self._bound, self._recent_bound = words, recent
        self._main, self._recent = _Table(), _Table()
        pre = self._tokenizer.pre_tokenizer
        self._plain = self._tokenizer.normalizer is None and pre is not None and "ByteLevel(add_prefix_space=False" in repr(pre) and "use_regex=True" in repr(pre)
        self._spaced = np.array([(self._tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(self._tokenizer.get_vocab_size())])
        line = self._whole("\n")
        self._line = int(line[0]) if len(line) == 1 else -1
        self._plain &= self._line >= 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _joined(self, words: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of words that each stand after the mark; a space belongs to the word, a line end doesn't."""
        sizes, out = [], []
        for at in range(0, len(words), 400):
            part = words[at : at + 400]
            ids = np.array(self._tokenizer.encode_batch_fast([mark + mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            starts = self._spaced[ids] if mark == " " else ids == self._line
            place = np.flatnonzero(starts)
            if len(place) == len(part) and place[0] == 0:
                size = np.diff(np.append(place, len(ids)))
                if mark != " ":
                    ids, size = ids[~starts], size - 1
                sizes.append(size)
                out.append(ids)
            else:
                own = [self._whole((mark if mark == " " else "") + w) for w in part]
                sizes.append(np.array([len(x) for x in own]))
                out += own
        return np.concatenate(sizes), np.concatenate(out)

    def _lettered(self, words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of words that are a space and letters."""
        n = len(cuts) - 1
        text = np.full(len(words) + n, _SPACE, "<u4")  # a space apart, which belongs to none
        text[np.arange(len(words)) + np.repeat(np.arange(1, n + 1), np.diff(cuts))] = _WRITTEN[words]
        sizes, out = [], []
        for at in range(0, n, 2000):
            to = min(at + 2000, n)
            part = text[cuts[at] + at : cuts[to] + to].tobytes().decode("utf-32-le")
            out.append(np.array(self._pieces.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32))
            place = np.flatnonzero(self._spaced[out[-1]])
            if len(place) != to - at or place[0]:
                raise ValueError("a word's space begins no id of its own")
            sizes.append(np.diff(np.append(place, len(out[-1]))))
        return np.concatenate(sizes), np.concatenate(out)

    def _tidy(self) -> None:
        """Move what is recent to the main table; start anew with what is recent when both are full."""
        if len(self._main.keys) + len(self._recent.keys) > self._bound:
            self._main, self._recent = self._recent, _Table()
        elif len(self._recent.keys) > self._recent_bound:
            self._main.add(*self._recent.rows())
            self._recent = _Table()

    def _ids(self, words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has) of words with the space before them, if there is one, and of line ends."""
        begin, length = cuts[:-1], np.diff(cuts)
        spaced, lines = words[begin] == _SPACE, (words[begin] == _LINE) & (length == 1)
        # a space, then letters: ASCII ones, or two bytes each
        after = np.append(words[1:], np.uint8(0))
        latin = _LATIN[words] & ~((words == 0xC3) & ((after == 0x97) | (after == 0xB7)))
        letter = _LETTER[words] | latin | np.append(False, latin[:-1])
        counted = np.append(0, np.cumsum(letter))
        lettered = spaced & (length > 1) & (counted[cuts[1:]] - counted[begin] == length - 1)
        order, sizes, out = [np.flatnonzero(lines)], [np.ones(lines.sum(), np.int64)], [np.full(lines.sum(), self._line, np.uint32)]
        for mark, some in (("", np.flatnonzero(lettered)), (" ", np.flatnonzero(spaced & ~lettered)), ("\n", np.flatnonzero(~spaced & ~lines))):
            if len(some):
                if mark:
                    size, ids = self._joined([words[a:b].tobytes().decode() for a, b in zip((begin[some] + (mark == " ")).tolist(), cuts[some + 1].tolist(), strict=True)], mark)
                else:
                    size, ids = self._lettered(words[_ranges(begin[some], length[some])], np.append(0, np.cumsum(length[some])))
                order.append(some)
                sizes.append(size)
                out.append(ids)
        size, ids, where = np.concatenate(sizes), np.concatenate(out), np.argsort(np.concatenate(order))
        return ids[_ranges((np.cumsum(size) - size)[where], size[where])], size[where]

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that can't be encoded word by word."""
        n = len(data)
        odd = np.zeros(len(offsets) - 1, np.bool_)
        if not n:
            return odd
        white = (data == _SPACE) | (data == _LINE)
        bad = _BAD[data]
        after, third = np.append(data[1:], np.uint8(0)), np.append(data[2:], np.zeros(min(2, n), np.uint8))
        bad |= white & np.append(white[1:], False)
        bad |= (data == 60) & (after == 124)
        # white space beyond ASCII, in UTF-8
        high = data >= 0xC2
        if high.any():
            bad |= (data == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (data == 0xE1) & (after == 0x9A) & (third == 0x80)
            bad |= (data == 0xE2) & ((after == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (after == 0x81) & (third == 0x9F))
            bad |= (data == 0xE3) & (after == 0x80) & (third == 0x80)
        odd[np.unique(np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1)] = True
        some = np.flatnonzero(np.diff(offsets) > 0)
        odd[some] |= (data[offsets[some]] == _SPACE) | (data[offsets[some + 1] - 1] == _SPACE)
        return odd

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = self._odd(data, offsets) if self._plain else np.diff(offsets) > 0
        if odd.any():  # one by one around the odd rows
            flat, sizes, at = [], [], 0
            for i in [*np.flatnonzero(odd).tolist(), len(odd)]:
                if i > at:
                    ids, n = self._words(data[offsets[at] : offsets[i]], offsets[at : i + 1] - offsets[at])
                    flat.append(ids)
                    sizes.append(n)
                if i < len(odd):
                    flat.append(self._whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()))
                    sizes.append(np.array([len(flat[-1])]))
                at = i + 1
            return np.concatenate(flat), np.concatenate(sizes)
        return self._words(data, offsets)

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        # pieces without gaps: a line end, a word with the space before it, or what follows in it from a mark on
        begins = (data == _SPACE) | (data == _LINE)
        begins[1:] |= (data[:-1] == _LINE) | _MARK[data[1:]] & (_LETTER | _DIGIT)[data[:-1]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        place, words = coded.indices.to_numpy(), coded.dictionary
        cuts = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        body = np.frombuffer(words.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
        cuts = cuts - cuts[0]
        keys = textscan.tabulated(body, cuts[:-1], cuts[1:])
        self._tidy()
        main, recent = self._main.find(keys, body, cuts), self._recent.find(keys, body, cuts)
        size = np.zeros(len(keys), np.int64)
        new, old = np.flatnonzero((main < 0) & (recent < 0)), np.flatnonzero(main >= 0)
        late = np.flatnonzero((main < 0) & (recent >= 0))
        size[old], size[late] = self._main.size[main[old]], self._recent.size[recent[late]]
        made = np.zeros(0, np.uint32)
        if len(new):
            n = np.diff(cuts)[new]
            fresh = body[_ranges(cuts[new], n)]
            made, size[new] = self._ids(fresh, np.append(0, np.cumsum(n)))
        # the slice's own pool, in the order of its dictionary
        begin = np.cumsum(size) - size
        own_pool = np.zeros(size.sum(), np.uint32)
        own_pool[_ranges(begin[new], size[new])] = made
        for rows, table, at in ((old, self._main, main), (late, self._recent, recent)):
            own_pool[_ranges(begin[rows], size[rows])] = table.pool[_ranges(table.at[at[rows]], size[rows])]
        if len(new):
            self._recent.add(keys[new], fresh, n, made, size[new])
        n = size[place]
        flat = own_pool[_ranges(begin[place], n)]
        total = np.append(0, np.cumsum(n))[np.searchsorted(start, offsets)]
        return flat, np.diff(total)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, as unsigned 32-bit integers, and how many each text has. Null texts are empty."""
        parts = [self._slice(data, offsets) for _, data, offsets in textscan.slices(texts, texts)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in HELD:
        HELD[path] = Encoder(path)
    return HELD[path]


def with_end(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """As encode(), with an end id after each text."""
    ids, sizes = encoder(path).encode(texts)
    last = np.cumsum(sizes)
    return np.insert(ids, last, end).astype("<u4"), sizes + 1
