"""Token ids of whole texts, as the tokenizers library gives them for a vocabulary file.

A byte-level vocabulary whose ids follow its merges is what tiktoken works on
too, with the same results in a fifth of the time, so its ranks are handed over
to it; any other is encoded by the tokenizers library itself. The strings of
added tokens are tokens in a text.
"""

from __future__ import annotations

import json
import os

import numpy as np

# White_Space of Unicode, as the tokenizer's own pattern takes it.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: the pre-tokeniser pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_state: dict = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_ranks(path: str):
    """A tiktoken encoding, if the vocabulary is byte-level and its ids follow its merges; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and whole.get("normalizer") is None
    if model.get("type", "BPE") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges") or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in whole["added_tokens"]):
        return None
    added = {a["content"]: a["id"] for a in whole["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab.get(t) for t in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
        return None
    alphabet = byte_alphabet()
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks={bytes(alphabet[c] for c in t): i for t, i in vocab.items()}, special_tokens=added)


def _ready(path: str) -> dict:
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _state.update(path=path, tokenizer=t, added={a.content: i for i, a in t.get_added_tokens_decoder().items()}, ranks=_by_ranks(path))
    return _state


def added_tokens(path: str) -> dict[str, int]:
    return _ready(path)["added"]


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers; null as empty."""
    state = _ready(path)
    if ranks := state["ranks"]:
        return [ranks.encode_to_numpy(t or "", allowed_special="all", disallowed_special=()).astype("<u4").tobytes() for t in texts]
    return [np.array(e.ids, "<u4").tobytes() for e in state["tokenizer"].encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def counts(texts: list[str], path: str) -> list[int]:
    """How many ids each text has."""
    state = _ready(path)
    if ranks := state["ranks"]:
        return [len(ranks.encode(t, allowed_special="all", disallowed_special=())) for t in texts]
    return [len(e.ids) for e in state["tokenizer"].encode_batch_fast(texts, add_special_tokens=False)]
