"""Byte-level BPE ids of whole texts through the tokenizers library, one library call per distinct word.

Merges never cross a pre-token, so texts are cut into pre-tokens, each distinct one goes to the library
once per worker, and the ids of a text are those of its pre-tokens in a row. Texts of common characters are cut
for a whole block at once from the classes of their bytes, and a pre-token is known by a 64-bit hash of its
bytes. Other texts are cut before spaces that follow a character other than white space, where no
pre-token crosses and no look-ahead sees past; their chunks go through the pattern, or to the library as they
are.
"""
from __future__ import annotations

import re
from itertools import chain

import numpy as np

from .shingles import byte_sums, mix

#: Characters that some regular-expression engine counts as white space.
SPACES = ("\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003"
          "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff")
#: Letters among the common characters, which are printable ASCII, tab, newline and U+00C0 to U+024F.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_COMMON = re.compile("[ -~\n\t\u00c0-\u024f]*").fullmatch
#: The published pre-tokenizer pattern of the byte-level vocabularies, for common characters only.
PATTERN = (f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^ \n\t{LETTERS}0-9]+"
           r"|[ \n\t]+(?![^ \n\t])|[ \n\t]+")
_CUT = re.compile("(?<=[^" + re.escape(SPACES) + "])(?= )")


def byte_alphabet() -> list[str]:
    """Character that stands for each byte: itself if printable, else the next from 256 upwards."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


BLOCK = 1 << 20
_ALPHABET = np.array([ord(c) for c in byte_alphabet()], "<u4")
_KEPT: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most
        self.pattern = re.compile(PATTERN)
        self.known: dict[str, bytes] = {}   # a pre-token, or a chunk of uncommon characters -> its ids
        self._forget()
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        plain = [(i, t) for i, t in added.items() if not (t.single_word or t.lstrip or t.rstrip or t.normalized)]
        self.mark_id, self.mark = (plain[0][0], plain[0][1].content) if plain else (None, None)

    def _library(self, words: list[str]) -> dict[str, bytes]:
        """Words go to the library many at a time, held apart by a special token: the library
        splits at special tokens before anything else, so each word is encoded as on its own."""
        got, apart = {}, []
        for w in words:
            if self.mark is None or any(s in w for s in self.specials):
                got[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                apart.append(w)
        for i in range(0, len(apart), 2048):
            part = apart[i:i + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast(
                [self.mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                got[w] = raw[4 * at:4 * end]
                at = end + 1
        return got

    def _words(self, text: str) -> list[str]:
        special = any(s in text for s in self.specials)
        if not special and _COMMON(text):
            return self.pattern.findall(text)
        words = []
        for chunk in _CUT.split(text):
            if _COMMON(chunk) and not (special and any(s in chunk for s in self.specials)):
                words += self.pattern.findall(chunk)
            else:
                words.append(chunk)
        return words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        common, rest = [], []
        for i, t in enumerate(texts):
            plain = _COMMON(t) and not any(s in t for s in self.specials)
            (common if plain else rest).append(i)
        block, held = [], 0
        for i in common:
            block.append(i)
            held += len(texts[i])
            if held >= BLOCK:
                self._block(texts, block, out)
                block, held = [], 0
        if block:
            self._block(texts, block, out)
        for i, ids in zip(rest, self._one_by_one([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        cut = [self._words(t) for t in texts]
        wanted = set().union(*cut)
        missing = wanted - self.known.keys()
        if len(self.known) + len(missing) > self.most // 4:
            self.known.clear()
            missing = wanted
        self.known.update(self._library(list(missing)))
        known = self.known.__getitem__
        return [b"".join(map(known, w)) for w in cut]

    def _block(self, texts: list[str], block: list[int], out: list) -> None:
        raw = [texts[i].encode() for i in block]
        sizes = np.array([len(r) for r in raw], np.int64)
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(sizes)
        if not len(data):
            for i in block:
                out[i] = b""
            return
        start = pretoken_starts(data, (ends - sizes)[sizes > 0])
        st = np.flatnonzero(start)
        en = np.append(st[1:], len(data))
        sums, back = byte_sums(data)
        hashed = mix((sums[en] - sums[st]) * back[st])
        at = self._rows(hashed)
        new, first = np.unique(hashed[at < 0], return_index=True)
        if self.count and self.count + len(new) > self.most:
            self._forget()
            at[:] = -1
            new, first = np.unique(hashed, return_index=True)
        if len(new):
            miss = np.flatnonzero(at < 0)
            self._learn(new, data, st[miss[first]], en[miss[first]])
            at[miss] = self._rows(hashed[miss])
        lens, offs = self.lens[at], self.offs[at]
        upto = np.cumsum(lens)
        ids = self.flat[np.repeat(offs - (upto - lens), lens) + np.arange(int(upto[-1]))]
        cuts = np.concatenate([[0], upto])[np.searchsorted(st, np.concatenate([[0], ends]))]
        whole = ids.astype("<u4").tobytes()
        for i, a, b in zip(block, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[i] = whole[4 * a:4 * b]

    def _learn(self, new: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Takes in the pre-tokens from ``begin`` to ``end``, whose hashes ``new`` are distinct and not known."""
        sizes = end - begin
        upto = np.cumsum(sizes)
        letters = _ALPHABET[data[np.repeat(begin - (upto - sizes), sizes) + np.arange(int(upto[-1]))]].tobytes().decode("utf-32-le")
        model = self.tokenizer.model     # these are whole pre-tokens, so the library's merges are all that is left
        pieces = [[t.id for t in model.tokenize(letters[a:b])] for a, b in zip((upto - sizes).tolist(), upto.tolist())]
        ids = np.fromiter(chain.from_iterable(pieces), np.uint32)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = self.count
        while n + len(lens) > len(self.lens):
            self.lens, self.offs = (np.concatenate([x, np.empty_like(x)]) for x in (self.lens, self.offs))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.lens[n:n + len(lens)] = lens
        self.offs[n:n + len(lens)] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.count += len(lens)
        if 2 * self.count > len(self.slots):
            old = self.slots >= 0
            keys, rows = self.keys[old], self.slots[old]
            size = len(self.slots)
            while 2 * self.count > size:
                size *= 2
            self.keys, self.slots = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self._put(keys, rows)
        self._put(new, np.arange(n, self.count, dtype=np.int32))

    def _rows(self, hashed: np.ndarray) -> np.ndarray:
        """Row of each hash in the arrays of ids; -1 if it is not known."""
        last = len(self.slots) - 1
        spot = (hashed & np.uint64(last)).astype(np.int64)
        rows = self.slots[spot]
        off = np.flatnonzero((rows >= 0) & (self.keys[spot] != hashed))    # another hash has the slot: try the next
        while len(off):
            spot[off] = (spot[off] + 1) & last
            rows[off] = self.slots[spot[off]]
            off = off[(rows[off] >= 0) & (self.keys[spot[off]] != hashed[off])]
        return rows

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Stores distinct new hashes, each in the first free slot from its own on."""
        last = len(self.slots) - 1
        spot = (keys & np.uint64(last)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.slots[spot] < 0)
            self.slots[spot[free]] = rows[free]                 # of several for one slot the last one stays
            self.keys[spot[free]] = keys[free]
            left = self.slots[spot] != rows
            keys, rows, spot = keys[left], rows[left], (spot[left] + 1) & last

    def _forget(self) -> None:
        self.count = 0                     # rows of the arrays of ids
        self.slots = np.full(1 << 16, -1, np.int32)    # by the low bits of a pre-token's hash: its row below
        self.keys = np.zeros(1 << 16, np.uint64)       # and the hash itself
        self.flat = np.empty(1 << 16, np.uint32)
        self.lens = np.empty(1 << 14, np.int64)
        self.offs = np.empty(1 << 14, np.int64)
        self.used = 0


#: Classes of bytes of common characters: letter (all beyond ASCII), digit, white space, other.
_KIND = np.full(256, 4, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 32]] = 3


def pretoken_starts(data: np.ndarray, openings: np.ndarray) -> np.ndarray:
    """Where pre-tokens of PATTERN start in texts of common characters laid end to end.

    A pre-token is a run of one class. The last of several white-space characters before other text stands
    apart, and if it is a space it opens the pre-token behind it. An apostrophe that opens a pre-token takes one of
    the listed endings with it.
    """
    n = len(data)
    kind = _KIND[data]
    first = np.zeros(n + 3, bool)
    first[openings] = True
    first[n:] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(start[:n + 1])
    blank = np.flatnonzero(kind[at[:-1]] == 3)
    stop = at[blank + 1]
    stop = stop[~first[stop]]                 # runs with text behind them
    start[stop - 1] = True
    start[stop[data[stop - 1] == 32]] = False
    quote = np.flatnonzero((data == 39) & start[:n])
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    one, two = padded[quote + 1], padded[quote + 2]
    here = ~first[quote + 1]
    short = here & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = here & ~first[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                                      | ((one == ord("l")) & (two == ord("l"))))
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 3] = True
    return start[:n]


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for ``path``; tasks that follow reuse what it has seen."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _KEPT:
        _KEPT[path] = ChunkEncoder(path)
    return _KEPT[path]
