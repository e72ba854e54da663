"""Token ids of whole texts as bytes, with a cache over blank-separated chunks.

The tokenizer lower-cases, drops white space and never joins characters across it, so a
text's ids are the concatenated ids of its chunks; test_tokens.py holds this against the
library's own encoding of whole texts. Vocabulary files stay where they are installed.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import filterfalse, islice

import public_tokenizers

TOKENIZER = "word_bpe_49k.json"
CACHE_BYTES = 160 << 20  # what one worker's cache may take, by the estimate of Chunks.size
ENTRY = 200  # bytes of an entry beside its characters and ids
TAILED = re.compile(r"([^\W\d_]+)([^\w\s'<|\u0300-\U0010ffff]+)")
#: A full stop or comma that may be part of a longer run of marks: what stands before it is no letter, digit or blank.
JOINED = re.compile(r"[.,](?<![a-z0-9 ].)", re.A)


class Chunks(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes.

    Above `limit` bytes the later half of the entries goes: what came first is what is
    frequent, and the rest makes way for what the texts hold now.
    """

    def __init__(self, path: str, specials_as_text: bool = False, limit: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.size = Tokenizer.from_file(path), limit, 0
        self.tokenizer.encode_special_tokens = specials_as_text
        self.model = self.tokenizer.model
        # Every word is asked for once, so the library's own small cache only costs.
        self.model._resize_cache(0)
        # Every pre-token ends with one id of this set, so words encoded together come apart again.
        self.ends = frozenset(i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>"))

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.replace("\n", " ").replace("\t", " ")
        if "<|" in text:
            return text.split(" ")
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split(" ")
        text = text.lower()
        if not JOINED.search(text):  # a lone mark after a word is a pre-token of its own
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def _learn(self, missing: set[str]) -> None:
        # A word and its trailing symbols are two pre-tokens, so only the word may be new.
        tailed = {x: m.groups() for x in missing if not x.isalpha() and (m := TAILED.fullmatch(x)) and m[1].isalpha() and max(x) < "\u0130"}
        if tailed:
            missing = missing.difference(tailed).union(y for pair in tailed.values() for y in pair if y not in self)
        # One ASCII letter run is one pre-token, which only lower-casing changes.
        model, rest = self.model, []
        for x in missing:
            if x.isascii() and x.isalpha():
                self[x] = array("I", [t.id for t in model.tokenize(x.lower())]).tobytes()
            else:
                rest.append(x)
        # Other letters too, but as bytes; without combining marks nothing normalises across words.
        letters = [x for x in rest if x.isalpha() and max(x) < "\u0130"]
        for at in range(0, len(letters), 1000):
            some = letters[at : at + 1000]
            ids = array("I", self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids)
            data, k, ends = ids.tobytes(), 0, self.ends
            cuts = [4 * i for i, x in enumerate(ids, 1) if x in ends]
            for x, end in zip(some, cuts, strict=True):
                self[x] = data[k:end]
                k = end
        for x in set(rest).difference(letters):
            self[x] = array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes()
        for x, (word, tail) in tailed.items():
            self[x] = self[word] + self[tail]
        self.size += sum(ENTRY + 5 * len(x) for x in missing) + sum(ENTRY + 5 * len(x) for x in tailed)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty."""
        split = [self._split(t) for t in texts]
        missing: set[str] = set()
        for words in split:
            missing.update(filterfalse(self.__contains__, words))
        if missing:
            self._learn(missing)
        out = [b"".join(map(self.__getitem__, words)) for words in split]
        if self.size > self.limit:
            self._trim()
        return out

    def _trim(self) -> None:
        for x in list(islice(self, len(self) // 2, None)):
            del self[x]
        self.size = sum(ENTRY + 5 * len(x) for x in self)


@lru_cache(maxsize=2)
def chunks(name: str = TOKENIZER, specials_as_text: bool = False) -> Chunks:
    """One cache a worker process and tokenizer file."""
    return Chunks(name if os.path.isabs(name) else public_tokenizers.path(name), specials_as_text)
