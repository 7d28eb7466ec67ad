"""Encoding whole texts inside tasks, with a bounded cache of independent chunks.

Both public vocabularies are BPE behind a splitter that no token crosses.  Where every character of
a text is in SAFE, a text falls into chunks whose encodings simply follow each other:

* byte vocabulary: at each space that is followed by a character that is no white space, because
  the splitter always starts a match there;
* word vocabulary: at white space, which the splitter drops.

A chunk that ends in a letter or digit and one mark of END has the ids of what stands before the mark,
then the mark's, because both splitters part there; so only the words before it are encoded.

Other texts, and those that name a special token, are encoded whole by the library.  Either way the
ids are the library's own: the cache is filled by it.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

UNSAFE = re.compile("[^\n\r\t -~¡-¬®-ɏ‐-‧€]")
SPACE_START = re.compile(r"(?= [^\s])")
END = ".,;:!?"
CACHE_CHUNKS = 1_000_000  # twice as many with those of before; a worker keeps them, whatever stage it serves next
CACHED_LENGTH = 64


@lru_cache(maxsize=4)
def encoder(path: str, most: int = CACHE_CHUNKS) -> Encoder:
    return Encoder(path, most)


class Encoder:
    def __init__(self, path: str, most: int = CACHE_CHUNKS) -> None:
        import json
        import os

        from tokenizers import Tokenizer

        # a task has one core; the library's threads would only cost it time
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.drops_space = (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel"
        self.most = most
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, chunk: str) -> str:
        """What of a chunk has to be encoded: without its end mark, and in lower case where case is dropped anyway."""
        if len(chunk) > 1 and chunk[-1] in END and chunk[-2].isalnum():
            chunk = chunk[:-1]
        return chunk.lower() if self.drops_space and chunk.isascii() else chunk

    def chunks(self, text: str) -> list[str] | None:
        """None where the text has to be encoded whole."""
        if UNSAFE.search(text) or any(s in text for s in self.special):
            return None
        if self.drops_space:
            return text.split()
        if "  " in text or " \n" in text or " \t" in text or " \r" in text or text.endswith(" "):
            return SPACE_START.split(text)
        parts = text.split(" ")
        return [parts[0], *map(" ".__add__, parts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.chunks(t) for t in texts]
        cache = self.cache
        if len(cache) > self.most:
            self.before, self.cache = cache, {}
            cache = self.cache
        missing = list(set().union(*filter(None, split)).difference(cache))
        words = [self.word(c) for c in missing]
        # what the cache before the last clearing still knows is taken over
        before, known = self.before, {}
        for w in {*words, *END}:
            found = cache.get(w) or before.get(w)
            if found:
                known[w] = found
        unknown = list({*words, *END}.difference(known))
        for i in range(0, len(unknown), 20_000):
            some = unknown[i : i + 20_000]
            for w, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()
        cache.update(known)
        for c, w in zip(missing, words, strict=True):
            cache[c] = known[w] if len(c) == len(w) else known[w] + known[c[-1]]
        out = [self.whole(t) if s is None else b"".join(map(cache.__getitem__, s)) for t, s in zip(texts, split, strict=True)]
        for c in missing:
            if len(c) > CACHED_LENGTH:
                cache.pop(c, None)
                cache.pop(self.word(c), None)
        return out
