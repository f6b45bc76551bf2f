"""Token ids by the ``tokenizers`` library, each distinct word encoded once.

Texts are cut where a token can never reach across, so the words' ids one after another are those of
the whole text. Two kinds of files are known, told apart by their word-end suffix:

* word BPE (white space dropped): words end at each blank and line break;
* byte-level BPE (white space kept): a word is a run of white space and the run of other characters
  behind it; the library's own pattern always breaks between a character and white space after it.

Words of plain Latin letters are cut further by the file's own pattern into pieces, which go straight to
the library's BPE model, each distinct piece once. Words with anything else in them (special strings,
control characters, letters that normalisation might change) are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from itertools import chain, compress, islice

import numpy as np
import regex

from cohortry.llm.worker_memory import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# white space as the library's pattern has it: without the separators U+001C to U+001F
_BYTE_WORD = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


# letters and signs that normalisation leaves alone, but for lower case
_PLAIN = re.compile("[!-~\xa1-\u024f]+")
_PLAIN_AFTER_BLANK = re.compile("[ \n]?[!-~\xa1-\u024f]+")
_PLAIN_TEXT = re.compile("[ \n!-~\xa1-\u024f]*")
# the library's pattern with letters, the most frequent, tried first; none of the first three begins as another does
_BYTE_PATTERN = r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"


def _plain_pattern(pattern: str) -> str:
    """The pattern for plain texts (with what lower case makes of them), without properties of characters."""
    signs = [*range(0x21, 0x7F), *range(0xA1, 0x250)]
    for kind in "LN":
        members = "".join(re.escape(chr(c)) for c in signs if unicodedata.category(chr(c))[0] == kind)
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"\\p{{{kind}}}").replace(f"[^\\s\\p{{L}}\\p{{N}}]", "\\O")
        pattern = pattern.replace(f"\\p{{{kind}}}", f"[{members}]")
    both = "".join(re.escape(chr(c)) for c in signs if unicodedata.category(chr(c))[0] in "LN")
    return pattern.replace("\\O", rf"[^\s{both}]")


# so many pieces go to the model one by one
FEW = 16


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class WordEncoder:
    """Ids (little-endian 32-bit) of texts; up to ``limit`` words seen last are kept, and a quarter as many pieces of words.

    Plain texts are cut into pieces at once, which are kept as words: a letters' piece is shared by all words that only
    differ in the signs around it.

    Words are kept in two generations: when the younger is full it becomes the older, whose words move back when they
    are seen again. Words seen once, most of a corpus, go without those that every text has. A caller that forgets words
    gives ``pieces``: so many are kept, words of one piece among them.
    """

    def __init__(self, path: str, limit: int = 400_000, pieces: int | None = None) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.word_kind = bool(held["model"].get("end_of_word_suffix"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pattern = held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.word_kind else _BYTE_PATTERN
        # words are cut many at a time, with a zero byte after each
        self.cut = regex.compile("\\0|" + pattern.replace(r"[^\s", r"[^\0\s")).findall
        self.cut_text = re.compile(_plain_pattern(pattern)).findall
        self.plain = (_PLAIN if self.word_kind else _PLAIN_AFTER_BLANK).fullmatch
        self.special = "<|"
        # pieces are parted by blanks, which no letter is
        self.letters = np.array([" ", *byte_letters()[1:]], "<U1").view("<u4")
        self.model = self.tokenizer.model
        self.model_alone = Tokenizer(self.model)
        self.model_alone.pre_tokenizer = CharDelimiterSplit(" ")
        suffix, vocab = held["model"].get("end_of_word_suffix") or "", held["model"]["vocab"]
        self.token_letters = np.zeros(max(vocab.values()) + 1, np.int64)
        self.token_letters[list(vocab.values())] = [len(token.removesuffix(suffix)) for token in vocab]
        self.limit = limit
        self.most_pieces = limit // 4 if pieces is None else pieces
        self.whole_words = pieces is not None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if self.word_kind:
            return text.replace("\n", " ").split(" ")
        return _BYTE_WORD.findall(text)

    def _tokenized(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, many in one call to the library: the letters of its tokens say where each piece ends."""
        joined = self.letters[np.frombuffer("\0".join(pieces).encode(), np.uint8)].tobytes().decode("utf-32-le")
        letters = joined.split(" ")
        if len(letters) > FEW:
            ids = np.array(self.model_alone.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter(map(len, letters), np.int64, len(letters)))
            reached = np.cumsum(self.token_letters[ids])
            if len(ids) and reached[-1] == ends[-1]:  # else a letter has no token, and its place is not known
                packed, cuts = ids.tobytes(), (4 * np.searchsorted(reached, ends, "right")).tolist()
                return [packed[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return [pack_ids([token.id for token in self.model.tokenize(piece)]) for piece in letters]

    def _joined(self, pieces: list[str]) -> bytes:
        """Ids of a word's pieces. A word that is one piece is kept as a word only, unless words are forgotten."""
        held = self.pieces
        if len(pieces) == 1 and not self.whole_words:
            return held.get(pieces[0]) or self._tokenized(pieces)[0]
        parts = []
        for piece in pieces:
            ids = held.get(piece)
            if ids is None:
                if len(held) >= self.most_pieces:
                    held.clear()
                ids = held[piece] = self._tokenized([piece])[0]
            parts.append(ids)
        return b"".join(parts)

    def _new(self, words: set[str]) -> set[str]:
        """Make room for these words; those that were not kept."""
        if len(self.known) + len(words) > self.limit // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        again = [word for word in words if word in older]
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        return words.difference(again) if again else words

    def learn(self, words: set[str]) -> None:
        """Have the ids of all these words at hand."""
        new, known = self._new(words), self.known
        plain = [word for word in new if self.plain(word) and self.special not in word]
        joined = "\0".join([*plain, ""])
        pieces, done = [], []
        for piece in self.cut(joined.lower() if self.word_kind else joined):
            if piece == "\0":
                done.append(self._joined(pieces))
                pieces = []
            else:
                pieces.append(piece)
        known.update(zip(plain, done, strict=True))
        for word in new.difference(plain):
            known[word] = pack_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def forget(self) -> None:
        """Let go of the words; pieces stay."""
        self.known, self.older = {}, {}

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words as ``split`` gives them."""
        ids = list(map(self.known.get, words))
        missing = [i for i, held in enumerate(ids) if held is None]
        if missing:
            self.learn({words[i] for i in missing})
            known = self.known
            for i in missing:
                ids[i] = known[words[i]]
        return ids

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        if self.whole_words:
            return [self._joined([piece]) for piece in pieces]
        ids = list(map(self.known.get, pieces))
        missing = [i for i, held in enumerate(ids) if held is None]
        if missing:
            new = list(self._new({pieces[i] for i in missing}))
            known = self.known
            if new:
                known.update(zip(new, self._tokenized(new), strict=True))
            for i in missing:
                ids[i] = known[pieces[i]]
        return ids

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. All plain ones are looked up at once, and what is new in them goes to the library at once."""
        plain = [self.special not in text and _PLAIN_TEXT.fullmatch(text) is not None for text in texts]
        cuts = [self.cut_text(text.lower() if self.word_kind else text) for text in compress(texts, plain)]
        ids = iter(self._of_pieces(list(chain.from_iterable(cuts))))
        sizes = iter(map(len, cuts))
        return [b"".join(islice(ids, next(sizes)) if easy else self.words(self.split(text))) for text, easy in zip(texts, plain, strict=True)]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), "<u4")


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file; its words serve all later tasks."""
    return kept(("encoder", path), lambda: WordEncoder(path))
