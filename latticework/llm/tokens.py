"""Token ids of whole texts with a byte-level BPE vocabulary file; the file's path is a parameter."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: The pattern with which byte-level BPE of this family splits text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from U+0100 in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes as the ``tokenizers`` library does with the same file, without special tokens being added.

    Where the vocabulary is a plain byte-level BPE whose ids are in merge order, a rank-table encoder gives the same ids several
    times faster. Texts that hold an added token's string, and vocabularies of any other kind, go to the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.fast = self._ranked(spec) if self._plain(spec) else None

    def _plain(self, spec: dict) -> bool:
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return False
        if spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return False
        merged = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
        merged = [m.replace(" ", "") for m in merged]
        ids = [model["vocab"].get(m, -1) for m in merged]
        # Tokens that no merge makes are never made by the library; ranks alone would make them.
        if {t for t in model["vocab"] if len(t) > 1} - set(merged) - set(self.added):
            return False
        return ids == sorted(ids) and -1 not in ids and len(set(ids)) == len(ids)

    def _ranked(self, spec: dict):
        import tiktoken

        symbol, added = _bytes_of_symbols(), set(self.added)
        ranks = {bytes(symbol[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)
