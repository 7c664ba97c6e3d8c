"""Token ids of a public byte-level BPE file, inside tasks.

The ids are those of the ``tokenizers`` library for the file. For most texts they are computed by
``tiktoken`` from the vocabulary of the same file, which is several times faster and splits and
merges alike: ``tests/llm/test_encoder.py`` compares both for every character of Unicode. Texts
with a special token's string, or that the fast engine refuses, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

# Fixed value: how byte-level BPE files of this family split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such a file: itself where it prints, else
    the next unused character from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in prints}
    for i, b in enumerate(b for b in range(256) if b not in set(prints)):
        letters[chr(256 + i)] = b
    return letters


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.exact = Tokenizer.from_str(json.dumps(spec))
        self.plain = Tokenizer.from_str(json.dumps(spec))
        self.plain.encode_special_tokens = True
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = self._fast(spec, special)

    @staticmethod
    def _fast(spec: dict, special: dict[str, int]):
        model = spec["model"]
        plain = (
            model["type"] == "BPE"
            and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
            and not spec["pre_tokenizer"].get("add_prefix_space")
            and spec.get("normalizer") is None
            and not model.get("dropout")
        )
        if not plain:
            return None
        import tiktoken

        letters = byte_letters()
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in model["vocab"].items()
            if token not in special
        }
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if model["vocab"].get(a + b) != 256 + i:
                return None  # ids do not follow the order of merges
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit numbers; none for a null."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast and not (self.special and self.special.search(text)):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the engine gives up on some very long runs
                if type(e).__name__ != "PanicException":
                    raise
        ids = self.exact.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, np.uint32)

    def encode_plain(self, text: str) -> np.ndarray:
        """As ``encode``, but the string of a special token is plain text."""
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # as above
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)
