"""Exact token counts of every prefix, by dynamic programming over the word BPE.

Byte-pair encodings have a local property: a sequence of tokens is the encoding of its text exactly when
every two neighbours are what the merges make of their joint text. So the encoding of a prefix ends in
the one token that is compatible with the last token of the shorter prefix before it, and

    count(prefix) = count(prefix without its last token) + 1.

Words are done once each; a text's table holds the running count at each word's end, and the count at
any place inside a word follows from that word's own prefixes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.encoding import byte_letters
from cohortry.llm.words import slices
from cohortry.llm.worker_memory import kept

_END = "</w>"
# any prefix of such a piece is one piece
_RUN = regex.compile(r"\p{L}+|[^\s\p{L}\p{N}]+")


def _suffixes(tokens: list[str]) -> dict[str, bool]:
    found = {token[k:]: False for token in tokens for k in range(1, len(token))}
    return found | dict.fromkeys(tokens, True)


class PrefixCounter:
    """Counts for one file of the ``tokenizers`` library with a word-end suffix."""

    def __init__(self, path: str, limit: int = 300_000) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        if model.get("end_of_word_suffix") != _END:
            raise ValueError("a word BPE is needed")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        # what each token is merged from; a vocabulary where that is not one pair, made of earlier tokens, is not known here
        self.halves = {x + y: (x, y) for x, y in pairs}
        if len(self.halves) < len(pairs) or any(self.rank[self.halves[half]] > k for k, pair in enumerate(pairs) for half in pair if half in self.halves):
            raise ValueError("merges have to make each token once, from earlier ones")
        # suffixes of all tokens: true for those that are tokens themselves; those that end a word carry a sign
        self.limit = limit
        self.edges: dict[tuple[str, int], list[tuple[str, float]]] = {}
        reached = [t for t in model["vocab"] if self._reached(t)]  # others never come about
        self.inner = _suffixes([t for t in reached if not t.endswith(_END)])
        self.final = _suffixes([t[: -len(_END)] for t in reached if t.endswith(_END)])
        self.letters = byte_letters()
        tokenizer = Tokenizer.from_file(path)
        self.normalise = tokenizer.normalizer.normalize_str
        self.pattern = regex.compile(held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in held["added_tokens"]))
        self.words: dict[str, int] = {"": 0}
        self.pieces: dict[str, int] = {}
        self.pairs: dict[tuple[str, str, bool], bool] = {}

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The symbols at one side of a token while its letters merge, and the rank of the merge that ends each."""
        key = (token, side)
        known = self.edges.get(key)
        if known is None:
            known, until = [], math.inf
            while True:
                known.append((token, until))
                if token not in self.halves:
                    break
                halves = self.halves[token]
                token, until = halves[side], self.rank[halves]
            known.reverse()
            if len(self.edges) >= self.limit:
                self.edges.clear()
            self.edges[key] = known
        return known

    def _stands(self, left: str, right: str, ends: bool) -> bool:
        """Whether the merges leave ``left`` (empty: nothing) and ``right`` as they are.

        Until a merge joins the two, each merges as if alone, lowest rank first. So only symbols that touch at some
        time can join: they are met by walking along both edges in the order of ranks. At equal rank the left side goes
        first, then the pair across, then the right side.
        """
        known = self.pairs.get((left, right, ends))
        if known is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            token = right + _END if ends else right
            known = self.pairs[left, right, ends] = not left or self._joined(left, token) is None
        return known

    def _joined(self, left: str, right: str) -> int | None:
        """Rank of the first merge across two neighbouring tokens, if there is one."""
        rank, x_edge, y_edge = self.rank, self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = x_edge[i], y_edge[j]
            joined = rank.get((x, y))
            if joined is not None and joined < x_until and joined <= y_until:
                return joined
            if x_until > y_until:
                j += 1
            elif x_until < math.inf:
                i += 1
            else:
                return None

    def _reached(self, token: str) -> bool:
        """Whether a token's letters merge to it: its halves are reached, and nothing joins across before they do."""
        halves = self.halves.get(token)
        return halves is None or all(map(self._reached, halves)) and self._joined(*halves) == self.rank[halves]

    def inner_prefixes(self, piece: str) -> tuple[list[str], list[int]]:
        """Last token and token count of every prefix of a piece, as far as the word goes on after it."""
        inner, pairs = self.inner, self.pairs
        last, count = [""], [0]
        for end in range(1, len(piece) + 1):
            begin = end
            while begin:  # one token only stands behind the prefix before it, so the shortest are tried first
                begin -= 1
                token = piece[begin:end]
                is_token = inner.get(token)
                if is_token:
                    before = last[begin]
                    stands = pairs.get((before, token, False))
                    if stands or stands is None and self._stands(before, token, False):
                        break
                elif is_token is None:
                    raise ValueError("letters outside the vocabulary")
            last.append(token)
            count.append(count[begin] + 1)
        return last, count

    def closed(self, piece: str, end: int, last: list[str], count: list[int]) -> int:
        """Tokens of ``piece[:end]`` as a word of its own: its last token carries the suffix."""
        begin = end
        while begin:
            begin -= 1
            is_token = self.final.get(piece[begin:end])
            if is_token and self._stands(last[begin], piece[begin:end], True):
                return count[begin] + 1
            if is_token is None:
                break
        raise ValueError("letters outside the vocabulary")

    def _piece(self, piece: str) -> int:
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            letters = "".join([self.letters[b] for b in piece.encode()])
            known = self.pieces[piece] = self.closed(letters, len(letters), *self.inner_prefixes(letters[:-1]))
        return known

    def _normal(self, part: str) -> str:
        """Of plain letters and signs the normal form is lower case."""
        return part.lower() if part.isascii() and part.isprintable() else self.normalise(part)

    def word(self, word: str) -> int:
        """Tokens of a text without blanks and line breaks at which words are cut."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= self.limit:
                self.words.clear()
                self.words[""] = 0
            parts = self.special.split(word) if "<|" in word else [word]
            known = len(parts) - 1 + sum(self._piece(p) for part in parts for p in self.pattern.findall(self._normal(part)))
            self.words[word] = known
        return known

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character positions at which words end, and the tokens of the text up to there."""
        words = text.replace("\n", " ").split(" ")
        known = self.words
        counts = [known[w] if w in known else self.word(w) for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return np.cumsum(lengths + 1) - 1, np.cumsum(np.array(counts, np.int64))

    def at(self, text: str, ends: np.ndarray, counts: np.ndarray, place: int) -> int:
        """Tokens of ``text[:place]``, read from its table; only the word that is cut is looked at."""
        k = int(np.searchsorted(ends, place))
        begin, before = (int(ends[k - 1]) + 1, int(counts[k - 1])) if k else (0, 0)
        if k < len(ends) and ends[k] == place:
            return int(counts[k])
        return before + self.word(text[begin:place])

    def _inside(self, word: str) -> np.ndarray:
        """Tokens of every prefix of a text without blanks, the empty one included.

        Pieces that end before a cut are those of the whole word. A run of letters or signs is cut to one piece,
        counted by its prefixes; words whose letters do not stand alone in normal form, and cuts in other
        pieces, are counted anew.
        """
        out = np.zeros(len(word) + 1, np.int64)
        normal = self.normalise(word)
        if "<|" in word or "\u03a3" in word or [*normal] != [self.normalise(c) for c in word]:
            out[1:] = [self.word(word[:end]) for end in range(1, len(word) + 1)]
            return out
        before = 0
        done = 0
        for match in self.pattern.finditer(normal):
            begin, end = match.span()
            out[done : begin + 1] = before
            if _RUN.fullmatch(match.group()):
                letters = "".join([self.letters[b] for b in match.group().encode()])
                tables, cut = self.inner_prefixes(letters), 0
                for place in range(begin + 1, end + 1):
                    cut += len(normal[place - 1].encode())
                    out[place] = before + self.closed(letters, cut, *tables)
            else:
                for place in range(begin + 1, end + 1):
                    out[place] = before + self.word(word[begin:place])
            before, done = int(out[end]), end
        out[done:] = before
        return out

    def longest_prefix(self, text: str, ends: np.ndarray, counts: np.ndarray, budget: int) -> int:
        """The largest place with at most ``budget`` tokens before it, be it inside a word."""
        k = int(np.searchsorted(counts, budget, "right"))
        if k == len(ends):
            return int(ends[-1])
        # words add up, so what fits ends in the word that crosses the budget; inside it counts can fall again
        begin, before = (int(ends[k - 1]) + 1, int(counts[k - 1])) if k else (0, 0)
        fits = np.flatnonzero(before + self._inside(text[begin : int(ends[k])]) <= budget)
        return begin + int(fits[-1]) if len(fits) else 0


def counter(path: str) -> PrefixCounter:
    """One counter per Python worker and file; its words serve all later tasks."""
    return kept(("counter", path), lambda: PrefixCounter(path))


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, ends, counts: the prefix table of every whole text, one row per row of ``docs``.

    ``ends`` are the places (in characters) where words end, ``counts`` the tokens of the text up to
    each; the last one is the text's own count. A null text is empty and has the table ([0], [0]).
    Repeated rows and doc_ids each give a row; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for batch in slices(batches, limit=1 << 20):
            tables = [counts.table(text) for text in batch.column("text").fill_null("").to_pylist()]
            bounds = pa.array(np.append(0, np.cumsum([len(e) for e, _ in tables])), pa.int32())
            ends, held = (pa.array(np.concatenate(x), pa.int32()) for x in zip(*tables, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.ListArray.from_arrays(bounds, ends), pa.ListArray.from_arrays(bounds, held)],
                names=["doc_id", "n_bytes", "ends", "counts"],
            )

    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), "text").mapInArrow(
        count, "doc_id long, n_bytes long, ends array<int>, counts array<int>"
    )
