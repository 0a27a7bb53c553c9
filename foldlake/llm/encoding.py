"""Token ids of whole texts, made inside tasks.

The vocabulary file is a parameter. Its merges are run by the faster of two libraries that give the same ids; texts
the faster one cannot take (white space runs beyond its stack, added tokens of the vocabulary) go to the other.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
_LONG_BLANK = re.compile(r"\s{5000}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256, 257, ..."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    letters.update({chr(256 + k): b for k, b in enumerate(rest)})
    return letters


class Encoder:
    """Ids of texts as ``tokenizers`` gives them, added tokens of the vocabulary inside a text included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary = described["model"]["vocab"]
        added = [re.escape(token["content"]) for token in described.get("added_tokens", []) if token["content"]]
        self._added = re.compile("|".join(added)) if added else None
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): number for piece, number in vocabulary.items()}
        self._fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._path = path
        self._plain: Tokenizer | None = None

    def _by_merges(self, text: str) -> bool:
        """Whether merges alone give the ids, and the faster library can run them."""
        return not (self._added and self._added.search(text)) and (len(text) < 5000 or not _LONG_BLANK.search(text))

    def ids(self, text: str) -> list[int]:
        if self._by_merges(text):
            return self._fast.encode_ordinary(text)
        if self._plain is None:
            self._plain = Tokenizer.from_file(self._path)
        return self._plain.encode(text, add_special_tokens=False).ids

    def array(self, text: str):
        """The same ids as an unsigned 32-bit array."""
        if self._by_merges(text):
            return self._fast.encode_to_numpy(text, disallowed_special=())
        import numpy as np

        return np.asarray(self.ids(text), dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and worker process."""
    return Encoder(path)
