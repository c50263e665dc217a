"""BPE encoding and decoding with a pair occurrence index, for vocabularies with word ends.

A task gathers the distinct words it meets. All their symbols lie in one linked list; an index maps
every pair that has a merge to all its positions. The active ranks are taken in ascending order:
one step applies a merge at all positions of its pair, in every word at once, and
files the pairs that it makes under their own ranks.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re

from pyspark.sql import DataFrame

from .chunk_encoder import LETTERS, byte_alphabet
from .common import per_batch, slices

_KEPT: dict[str, "WordBpe"] = {}
_COMMON = re.compile("[ -~\\n\\t\\r\\u00c0-\\u024f]*").fullmatch
#: The vocabulary's pre-tokenizer pattern, for common characters in lower case.
_PATTERN = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \n\t\r{LETTERS}0-9]+")


class PairIndex:
    """Merges of one vocabulary. The same token must not be needed before it can be made, which
    holds for trained merges and is checked, so ranks may be applied to all words in one sweep."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        first: dict[int, int] = {}
        for r, (_, _, made) in enumerate(self.pairs):
            first.setdefault(made, r)
        if any(first.get(x, -1) >= r for r, (a, b, _) in enumerate(self.pairs) for x in (a, b)):
            raise ValueError("a merge comes before the merge that makes one of its parts")

    def encode(self, words: list[str]) -> list[list[int]]:
        symbols: list[int] = []
        following: list[int] = []
        leading: list[int] = []
        starts = []
        for w in words:
            starts.append(len(symbols))
            ids = [self.vocab[c] for c in w[:-1]] + [self.vocab[w[-1] + self.suffix]]
            n = len(symbols)
            symbols += ids
            following += range(n + 1, n + len(ids) + 1)
            following[-1] = -1
            leading += range(n - 1, n + len(ids) - 1)
            leading[n] = -1
        rank = self.rank.get
        index: dict[int, list[int]] = {}
        for p, q in enumerate(following):
            if q >= 0 and (r := rank((symbols[p], symbols[q]))) is not None:
                index.setdefault(r, []).append(p)
        active = list(index)
        heapq.heapify(active)
        while active:
            at = heapq.heappop(active)
            left, right, made = self.pairs[at]
            positions = index.pop(at)
            if left == right:
                positions.sort()
            for p in positions:
                q = following[p]
                if q < 0 or symbols[p] != left or symbols[q] != right:
                    continue
                symbols[p], symbols[q] = made, -1
                after = following[p] = following[q]
                if after >= 0:
                    leading[after] = p
                    if (r := rank((made, symbols[after]))) is not None:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heapq.heappush(active, r)
                before = leading[p]
                if before >= 0 and (r := rank((symbols[before], made))) is not None:
                    if r in index:
                        index[r].append(before)
                    else:
                        index[r] = [before]
                        heapq.heappush(active, r)
        ends = [*starts[1:], len(symbols)]
        return [[s for s in symbols[a:b] if s >= 0] for a, b in zip(starts, ends)]


class WordBpe:
    """Ids and decoded text of whole texts. White space separates words and is dropped; each distinct word
    is encoded once per worker."""

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.index = PairIndex(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.library = Tokenizer.from_file(path)  # its normaliser and pre-tokenizer, for uncommon characters
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.names = {i: t for t, i in {**model["vocab"], **self.specials}.items()}
        self.digits = {i: str(i).encode() for i in self.names}
        self.alphabet = byte_alphabet()
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}       # a word -> its place in the two lists
        self.ids: list[bytes] = []         # decimal ids with a space between them
        self.decoded: list[bytes] = []
        for mark, i in self.specials.items():
            self.at["\0" + mark] = len(self.ids)
            self.ids.append(self.digits[i])
            self.decoded.append(mark.encode())

    def _cut(self, text: str) -> list[str]:
        """Words of a text; those of common characters in lower case, others in the byte alphabet behind
        a mark, special tokens behind a mark of their own."""
        # some common capitals have an uncommon lower case, so both are looked at
        low = text.lower()
        if _COMMON(text) and _COMMON(low) and "<|" not in text:
            return _PATTERN.findall(low)
        out: list[str] = []
        for chunk in text.split(" "):
            low = chunk.lower()
            if _COMMON(chunk) and _COMMON(low) and "<|" not in chunk:
                out += _PATTERN.findall(low)
                continue
            for piece in self.apart.split(chunk):
                if piece in self.specials:
                    out.append("\0" + piece)
                elif piece:
                    plain = self.library.normalizer.normalize_str(piece)
                    out += ["\1" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def _bytes(self, word: str) -> str:
        if word[0] == "\1":
            return word[1:]
        return word if word.isascii() else "".join([self.alphabet[b] for b in word.encode()])

    def _places(self, texts: list[str]) -> list[list[int]]:
        cut = [self._cut(t) for t in texts]
        wanted = set().union(*cut)
        missing = wanted - self.at.keys()
        if len(self.at) + len(missing) > self.most:
            self._forget()
            missing = wanted - self.at.keys()
        new = list(missing)
        for word, ids in zip(new, self.index.encode([self._bytes(w) for w in new])):
            self.at[word] = len(self.ids)
            self.ids.append(b" ".join([self.digits[i] for i in ids]))
            self.decoded.append(" ".join([self.names[i] for i in ids]).encode())
        at = self.at.__getitem__
        return [list(map(at, w)) for w in cut]

    def digest(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Per text: number of ids, and digests of the ids and of the decoded text."""
        counts, of_ids, of_text = [], [], []
        for places in self._places(texts):
            ids = b" ".join(map(self.ids.__getitem__, places))
            counts.append(ids.count(b" ") + 1 if ids else 0)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(b" ".join(map(self.decoded.__getitem__, places))).hexdigest())
        return counts, of_ids, of_text

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for p in places for i in self.ids[p].split()] for places in self._places(texts)]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: tokens with a space between them, unknown ids left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def coder(path: str) -> WordBpe:
    if path not in _KEPT:
        _KEPT[path] = WordBpe(path)
    return _KEPT[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text. A null or empty text has no ids; doc_id may be null or
    repeat; other columns are not read."""
    def work(batch):
        for part in slices(batch, "text"):
            yield {"doc_id": part.column("doc_id"),
                   "ids": coder(path).encode([t or "" for t in part.column("text").to_pylist()])}

    return per_batch(docs.select("doc_id", "text"), "doc_id long, ids array<int>", work)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids decode to the empty text."""
    def work(batch):
        yield {"doc_id": batch.column("doc_id"),
               "text": [coder(path).decode(i or []) for i in batch.column("ids").to_pylist()]}

    return per_batch(encoded.select("doc_id", "ids"), "doc_id long, text string", work)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, in one pass and without a shuffle; cases
    as in ``encode_documents``."""
    def work(batch):
        for part in slices(batch, "text"):
            counts, ids, decoded = coder(path).digest([t or "" for t in part.column("text").to_pylist()])
            yield {"doc_id": part.column("doc_id"), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}

    return per_batch(docs.select("doc_id", "text"),
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
