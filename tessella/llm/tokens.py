"""Token ids of whole texts, as the tokenizers library makes them, and cheaper on large corpora.

White space always separates tokens of a word vocabulary, so a text's ids are its
words' ids in a row. Arrow splits a batch of texts, numbers the distinct words and
parts them into lower-case cores and the marks after them; each worker keeps the ids
of recent cores in two generations, only new ones go to the tokenizer, and Arrow
lays the ids of all words end to end.
"""

from __future__ import annotations

import json
import os
from functools import cache
from itertools import pairwise
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of Latin-1, as a regular expression's class.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"


class WordEncoder:
    """For byte-level vocabularies that lower the case, drop white space and close words with a suffix."""

    def __init__(self, path: str, kept: int):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The model alone, for words that are written in its alphabet already.
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Ids of runs of ASCII marks, which are one token run wherever they follow letters.
        self.tails: dict[str, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        #: Bytes that the byte-level alphabet writes as other characters: from 256 on, in order; 10 parts the words.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.alphabet = "".join(chr(256 + odd.index(b)) if b in odd and b != 10 else chr(b) for b in range(256))
        sample = ["àßÿéª", "words"]
        self.direct = bool(suffix) and self._direct(sample) == list(map(self._whole, sample))

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _direct(self, words: list[str]) -> list[bytes]:
        """The ids of words of lower-case Latin-1 letters, which nothing but the alphabet changes before the model."""
        written = "\n".join(words)
        if not written.isascii():
            written = written.encode().decode("latin-1").translate(self.alphabet)
        model, ids, ends = self.model.tokenize, [], [0]
        for word in written.split("\n"):
            ids += [token.id for token in model(word)]
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return [data[a:b] for a, b in pairwise(ends)]

    def _learn(self, words: list[str]) -> None:
        """Adds words to the young generation."""
        young, new, odd = self.young, [], []
        for word, ids in zip(words, map(self.old.get, words)):
            if ids is not None:
                young[word] = ids
            elif self.direct and word.isalpha() and (word.isascii() or max(word) < "Ā"):
                new.append(word)
            else:
                odd.append(word)
        for part in ([w for w in new if w.isascii()], [w for w in new if not w.isascii()]):
            for k in range(0, len(part), 2048):
                young.update(zip(part[k : k + 2048], self._direct(part[k : k + 2048])))
        for word, made in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False)):
            young[word] = np.asarray(made.ids, "<u4").tobytes()

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each word; the model sees new ones only."""
        ids = list(map(self.young.get, words))
        if None in ids:
            self._learn([w for w, i in zip(words, ids) if i is None])
            ids = list(map(self.young.__getitem__, words))
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        return ids

    def _tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._whole(marks)
            if len(self.tails) < 10_000:
                self.tails[marks] = ids
        return ids

    def _distinct(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of each word. Words that differ in case or in the marks after them share their core's."""
        if not self.direct:
            return _lists(self._known(words.to_pylist()))
        stems = pc.utf8_rtrim(words, characters=punctuation)
        plain = pc.match_substring_regex(stems, f"^[{LETTERS}]+$")
        cores = pc.if_else(plain, pc.utf8_lower(stems), words).dictionary_encode()
        tailed = pc.and_(plain, pc.less(pc.binary_length(stems), pc.binary_length(words)))
        where = np.flatnonzero(tailed.to_numpy(zero_copy_only=False))
        lengths = pc.utf8_length(stems.filter(tailed)).to_pylist()
        tails = pa.array([w[n:] for w, n in zip(words.filter(tailed).to_pylist(), lengths)], pa.string()).dictionary_encode()
        known = self._known(cores.dictionary.to_pylist())
        table = _lists([*known, b"", *map(self._tail, tails.dictionary.to_pylist())])
        parts = np.full((len(words), 2), len(known))
        parts[:, 0] = cores.indices.to_numpy()
        parts[where, 1] = tails.indices.to_numpy() + len(known) + 1
        both = table.take(pa.array(parts.reshape(-1)))
        return pa.LargeListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.values)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text begins in them, and the end). Null is empty."""
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        numbered = words.flatten().dictionary_encode()
        laid = self._distinct(numbered.dictionary).take(numbered.indices)
        bounds = laid.offsets.to_numpy()[np.concatenate(([0], np.cumsum(counts)))]
        return laid.flatten().to_numpy(), bounds


def _lists(ids: list[bytes]) -> pa.LargeListArray:
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) >> 2)))
    return pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(ids), "<u4")))


#: Cores kept in each of two generations: about 60 MB a hundred thousand.
KEPT = 300_000


@cache
def encoder(path: str, kept: int = KEPT) -> WordEncoder:
    """One encoder for a worker process."""
    return WordEncoder(path, kept)
