"""Ids of a byte-level merge tokenizer, read from its ``tokenizers`` file.

When the file is a plain byte-level merge model (no normaliser, the usual split pattern, no
prefix space, one merge per id in order), texts are encoded by ``tiktoken`` from the same
vocabulary, which gives the same ids in a quarter of the time. Any other file is encoded by
``tokenizers`` itself.
"""

from __future__ import annotations

import json

import numpy as np

# fixed value: the split pattern of ByteLevel(use_regex=True)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """``special``: whether the strings of special tokens in a text become these tokens."""

    def __init__(self, path: str, special: bool) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_of_letter()
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = {bytes(letters[c] for c in token): k for token, k in vocab.items() if token not in added}
        #: bytes of each id; none for special tokens
        self.raw = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, k in own.items():
            self.raw[k] = token
        for token, k in added.items():
            self.raw[k] = token.encode()
        self.special, self.path = special, path
        self.fast = self.slow = None
        if _plain(spec, own, letters):
            import tiktoken
            marks = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=own, special_tokens=marks)

    def whole(self, text: str) -> list[int]:
        """Ids by ``tokenizers``."""
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = not self.special
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.fast is None:
            return self.whole(text)
        try:
            return self.fast.encode(text, allowed_special="all") if self.special else self.fast.encode_ordinary(text)
        except ValueError:  # a run of white space too long for the pattern's stack
            return self.whole(text)


def _plain(spec: dict, own: dict[bytes, int], letters: dict[str, int]) -> bool:
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    usual = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
             and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
    if not usual:
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = np.array([own[bytes(letters[c] for c in a + b)] for a, b in pairs])
    return bool((np.diff(made) > 0).all()) and len(made) + 256 == len(own) and int(made[0]) == 256


_OPEN: dict[tuple[str, bool], ByteBpe] = {}


def tokenizer(path: str, special: bool = True) -> ByteBpe:
    """One per worker process and file."""
    if (path, special) not in _OPEN:
        _OPEN[path, special] = ByteBpe(path, special)
    return _OPEN[path, special]
