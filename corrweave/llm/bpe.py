"""Token ids of a byte-level BPE file, as the `tokenizers` library gives them.

A text of common characters without special strings goes through `tiktoken` with the same file's vocabulary, which
is several times faster and gives the same ids; every other text goes through `tokenizers` itself.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np

# Fixed value: the byte-level split pattern of the tokenizer file's `ByteLevel(use_regex=true)`.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: What could be split differently by libraries with different Unicode tables or look-ahead limits.
_UNUSUAL = re.compile("[^\\x00-˿Α-ωЀ-џ‐-‧€]|\\s{200}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def version_digest(path: str) -> str:
    """Names the tokenizer by its content, so that a changed file never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet's rule: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        self.fast = self._fast(spec)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.path)

    @staticmethod
    def _fast(spec: dict):
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        alphabet, added = _byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids) or ids and ids[0] < 256:  # ids must rank as the merges do
            return None
        import tiktoken

        return tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=vocab, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _UNUSUAL.search(text) or self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)

    def count(self, text: str) -> int:
        if self.fast is None or _UNUSUAL.search(text) or self.special.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(text))


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One tokenizer for each worker process."""
    return ByteBpe(path)
