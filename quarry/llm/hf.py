"""The tokenizers library behind the batch encoder: each distinct word is encoded once."""

from __future__ import annotations

from functools import cache

import numpy as np

from quarry.llm.pretoken import BatchEncoder


def _byte_signs() -> dict[int, str]:
    """The printable sign by which byte-level vocabularies write each byte: itself where
    Latin-1 can print it, otherwise the next sign from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + k) for k, b in enumerate(hidden)}


@cache
def encoder(path: str) -> BatchEncoder:
    """One encoder per worker process and vocabulary file.

    Right for byte-level vocabularies whose pre-tokenizer is the pattern of
    ``pretoken`` without a leading space; other files are refused.
    """
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: only byte-level vocabularies without normaliser are encoded word by word")
    tok = Tokenizer.from_file(path)  # special tokens are cut out before words are split
    tokenize = tok.model.tokenize
    signs = _byte_signs()
    space = signs[0x20]

    def words(items: list[str]):
        out: list[int] = []
        count = np.empty(len(items), np.int64)
        for k, item in enumerate(items):
            plain = item.isascii() and item.isprintable()
            got = tokenize(item.replace(" ", space) if plain else item.encode().decode("latin-1").translate(signs))
            count[k] = len(got)
            out += [t.id for t in got]
        return np.array(out, np.uint32), count

    return BatchEncoder(words, {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special")})
