"""Byte-level BPE from a tokenizers .json file, for use inside tasks.

The rules of the file (merges and the pre-token pattern) are run by tiktoken,
which is several times faster; ids equal those of the tokenizers library, which
tests compare, and texts with characters whose class differs between libraries
are split by the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

#: Fixed value: the pre-token pattern of byte-level BPE files of this kind.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters only, in classes that all libraries agree on.
LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼½¾]+"
                   r"| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ɏ²³¹¼½¾]+|\s+(?!\S)|\s+")
#: Characters outside what ``LATIN`` covers.
OTHER = re.compile("[^\x00-\x1b\x20-ɏ -⁯€]")


def _byte_of() -> dict[str, int]:
    """The letters that byte-level files write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if (spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["model"].get("dropout") or spec["model"].get("ignore_merges")
                or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space")):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        letters = _byte_of()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.path = path
        self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.is_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    @functools.cached_property
    def library(self):
        """The tokenizers library's form of the file; read once a text needs it."""
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if OTHER.search(text) or self.is_special.search(text):
            import numpy as np

            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()

    def pieces(self, text: str) -> Iterator[str] | list[str]:
        """The text's pre-tokens in order; a special string is one."""
        if OTHER.search(text) or self.is_special.search(text):
            return self._by_library(text)
        return LATIN.findall(text)

    def _by_library(self, text: str) -> Iterator[str]:
        at = 0
        for found in [*self.is_special.finditer(text), None]:
            part = text[at:found.start() if found else len(text)]
            for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(part):
                yield part[i:j]
            if found:
                yield found[0]
                at = found.end()

    def count(self, piece: str) -> int:
        """Tokens of one pre-token."""
        if piece in self.special or len(piece) == 1 and piece.isascii():
            return 1
        if OTHER.search(piece):
            return len(self.library.encode(piece, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(piece))


@functools.lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBpe:
    """The encoder of a file; one for each worker process."""
    return ByteBpe(path)
