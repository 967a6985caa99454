"""Encoders made from tokenizer files: their bytes are read by the driver and shipped, so executors need no file.

A byte-level vocabulary whose ids stand in merge order has one possible split of a
word, which a rank encoder finds several times faster. ``byte_bpe`` checks that the
file is of that kind and otherwise, or for a text that the rank encoder refuses,
uses the file's own tokenizer.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from .common import ship
from .tokens import byte_alphabet

ship(__name__)

# Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_file(path: str) -> bytes:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer at {path}; set ADJUDICA_VOCABULARY or ADJUDICA_PIECES to its path")
    with open(path, "rb") as f:
        return f.read()


def token_bytes(raw: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level JSON vocabulary; special entries stand for their own text."""
    spec, letters = json.loads(raw), byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    out = [b""] * (1 + max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"]), 0))
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    for entry, i in spec["model"]["vocab"].items():
        if entry not in special:
            out[i] = bytes(letters[c] for c in entry)
    return out


def in_merge_order(spec: dict) -> bool:
    """Whether ids are ranks: single bytes, then one id a merge, in order, behind the plain byte-level splitter."""
    vocab, model, pre = spec["model"]["vocab"], spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
    options = any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
    strips = any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or options or strips or model.get("type") != "BPE":
        return False
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return sorted(vocab.get(c, -1) for c in byte_alphabet()) == list(range(256)) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))


def byte_bpe(raw: bytes, special: bool = True) -> Callable[[list[str]], list[list[int]]]:
    """texts -> ids. special: strings of special entries inside a text become those entries, else plain text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    own: list[Tokenizer] = []

    def exact(text: str) -> list[int]:
        if not own:
            own.append(Tokenizer.from_str(raw.decode()))
            own[0].encode_special_tokens = not special
        return own[0].encode(text, add_special_tokens=False).ids

    spec = json.loads(raw)
    if not in_merge_order(spec):
        return lambda texts: [exact(t) for t in texts]
    import tiktoken

    entries, added = token_bytes(raw), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {b: i for i, b in enumerate(entries) if i < 256 + len(spec["model"]["merges"])}
    fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added if special else {})

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            try:
                out.append(fast.encode(text, allowed_special="all") if special else fast.encode_ordinary(text))
            except ValueError:  # white space too long for its pattern engine
                out.append(exact(text))
        return out

    return encode
