"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per task."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np

from locusframe.llm.byte_bpe import make_room

#: Encoded words that a task holds, and words of one call of the library.
CACHE, TOGETHER = 450_000, 2_000
MARKS = ".,;:!?"
#: Kind of each Latin-1 character: a letter or digit, a blank, a mark that may be cut off, another one.
KINDS = bytes(ord("a" if chr(b).isalnum() else " " if chr(b) in " \n" else "," if chr(b) in ",." else "x") for b in range(256))

# The settings under which words may be encoded by themselves.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


@lru_cache(maxsize=2)
def _library(path: str):
    """The file's tokenizer; if it goes by words also a shorter one for plain words, and which ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    spec = json.loads(whole.to_str())
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if steps != NORMALIZER or splits[:1] != [SPLIT] or spec["model"].get("end_of_word_suffix") != WORD_END:
        return whole, None, None
    plain = Tokenizer(whole.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(whole.get_vocab_size(), bool)
    ends[[i for token, i in whole.get_vocab().items() if token.endswith(WORD_END)]] = True
    return whole, plain, ends


def vocabulary_size(path: str) -> int:
    return _library(path)[0].get_vocab_size()


class WordCoder:
    """Encoder of one task: ``ids`` gives little-endian unsigned 32-bit ids of each text, without special tokens added.

    A tokenizer that drops white space, lower-cases and splits letters,
    digits and marks (the settings above) never looks across a blank, so a
    text is encoded word by word; words of Latin-1 letters go to the library
    many at a time without the normaliser, which would leave them as they
    are.  With any other file whole texts go to the library.
    """

    def __init__(self, path: str):
        self.whole, self.plain, self.ends = _library(path)
        self.known = {"": b""}

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.plain is None:
            return self._whole(texts)
        make_room(self.known, CACHE)
        known = self.known
        parts = list(map(words_of, texts))
        fresh = set(chain.from_iterable(parts)).difference(known)
        simple, marked, rest = [], {}, []
        for word in fresh:
            if _simple(word):
                simple.append(word)
            else:
                head = word.rstrip(MARKS)
                if head != word and _simple(head):
                    marked[word] = head
                else:
                    rest.append(word)
        heads = set(marked.values()).difference(known, simple)
        tails = {word[len(head):] for word, head in marked.items()}.difference(known, rest)
        simple += heads
        rest += tails
        for at in range(0, len(simple), TOGETHER):
            self._add(simple[at:at + TOGETHER])
        known.update(zip(rest, self._whole(rest)))
        for word, head in marked.items():
            known[word] = known[head] + known[word[len(head):]]
        return [b"".join(map(known.__getitem__, words)) for words in parts]

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Encode a few at a time: the library's results are many times as large as the ids."""
        return [np.array(x.ids, "<u4").tobytes() for at in range(0, len(texts), TOGETHER)
                for x in self.whole.encode_batch_fast(texts[at:at + TOGETHER], add_special_tokens=False)]

    def _add(self, words: list[str]) -> None:
        """Encode words of letters together; each has exactly one id that ends a word."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the tokenizer does not end every word of letters by one id")
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        self.known.update((word, data[a:b]) for word, a, b in zip(words, [0, *cuts], cuts))


def _simple(word: str) -> bool:
    """Letters of Latin-1 in lower case."""
    return word.isalpha() and word == word.lower() and (word.isascii() or max(word) <= "ÿ")


def words_of(text: str) -> list[str]:
    """Parts of a text that can be encoded one by one.

    A text of Latin-1 characters is lower-cased at once, and a comma or full
    stop between a letter or digit and a blank becomes a part of its own; where
    one follows another mark, marks stay together.
    """
    if "<|" in text:  # special tokens depend on case
        return text.replace("\n", " ").split(" ")
    try:
        kinds = text.encode("latin-1").translate(KINDS)
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    text = text.lower().replace("\n", " ")
    if b",," not in kinds and b"x," not in kinds:
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")
