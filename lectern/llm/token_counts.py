"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton of the vocabulary reads a word once and names every piece that ends at each
character. Dynamic programming carries the best score and the piece count there. Ties
follow the tokenizer: of equal scores the piece that starts first stays, and the unknown piece, which
only stands where no piece of one character fits, comes last. Unknown characters cost their bytes where
the vocabulary has all byte pieces.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import per_batch, slices

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
UNKNOWN_PENALTY = 10.0
_KEPT: dict[str, "Counter"] = {}


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores in id order, and the unknown id, of a sentencepiece file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], most: int = 600_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece crosses from one word into the next")
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.most = most
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces on the best path through ``word``."""
        n = len(word)
        score = [0.0] * (n + 1)
        pieces = [0] * (n + 1)
        stray = [False] * (n + 1)
        found = iter(self.automaton.iter(word))
        at = next(found, None)
        for end in range(1, n + 1):
            best, many, single = None, 0, False
            while at is not None and at[0] == end - 1:   # longest piece first
                size, worth = at[1]
                start = end - size
                reached = worth + score[start]
                if best is None or reached > best:
                    best, many = reached, pieces[start] + 1
                single = single or size == 1
                at = next(found, None)
            if not single:
                reached = self.unknown + score[end - 1]
                if best is None or reached > best:
                    best, stray[end] = reached, True
                    if self.bytes:
                        many = pieces[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        many = pieces[end - 1] + (not stray[end - 1])
            score[end], pieces[end] = best, many
        return pieces[n]

    def totals(self, texts: list[str]) -> list[int]:
        """Pieces per text. Spaces are marks, and a text that does not begin with one gets one in front. A run of marks and
        the word behind it are a unit: no piece has a mark behind another character, so none crosses from one unit
        into the next, and a unit counts once however often it occurs."""
        parts = [_UNIT.findall(t if t[0] == SPACE else SPACE + t) for t in (t.replace(" ", SPACE) for t in texts if t)]
        wanted = set().union(*parts)
        missing = wanted - self.known.keys()
        if len(self.known) + len(missing) > self.most:
            self.known.clear()
            missing = wanted
        for w in missing:
            self.known[w] = self.count(w)
        known = self.known.__getitem__
        found = iter(parts)
        return [int(sum(map(known, next(found)))) if t else 0 for t in texts]


def counter(path: str) -> Counter:
    if path not in _KEPT:
        _KEPT[path] = Counter(vocabulary(path)[0])
    return _KEPT[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_words of every whole text.

    A null or empty text has no tokens. A run of spaces and the word behind it are one dynamic programme, so a long text
    costs time in proportion; so does a word of any length. ``n_words`` counts what stands between white space. doc_id may be
    null or repeat; other columns are not read. One pass, no shuffle.
    """
    def work(batch):
        for part in slices(batch, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield {"doc_id": part.column("doc_id"), "n_tokens": counter(path).totals(texts),
                   "n_words": [len(t.split()) for t in texts]}

    return per_batch(docs.select("doc_id", "text"), "doc_id long, n_tokens long, n_words long", work)
