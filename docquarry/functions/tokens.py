"""Tokenizers: encode text to ids and back, made once per Python worker."""

from __future__ import annotations

import base64
import functools
import re
from typing import Protocol

from docquarry.errors import ConfigurationError


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


class PieceTokenizer:
    """Words with the blank before them, other characters, and line ends; decoding is joining."""

    _PIECE = re.compile(r" ?\w+|\s|[^\w\s]")

    def encode(self, text: str) -> list[str]:
        return self._PIECE.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


class RankTokenizer:
    """tiktoken over a rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self._enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._enc.encode_ordinary(text)

    def decode(self, tokens: list[int]) -> str:
        return self._enc.decode(tokens)


class FileTokenizer:
    """A tokenizers (JSON) file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Reader

        self._t = Reader.from_file(path)

    def encode(self, text: str) -> list[int]:
        return self._t.encode(text).ids

    def decode(self, tokens: list[int]) -> str:
        return self._t.decode(tokens, skip_special_tokens=True)


class EncodingTokenizer:
    """A named tiktoken encoding or model; it must be on this machine."""

    def __init__(self, model: str):
        import tiktoken

        try:
            self._enc = tiktoken.encoding_for_model(model)
        except KeyError:
            self._enc = tiktoken.get_encoding(model)

    def encode(self, text: str) -> list[int]:
        return self._enc.encode(text, disallowed_special=())

    def decode(self, tokens: list[int]) -> str:
        return self._enc.decode(tokens)


DEFAULT_PATTERN = r"\p{L}+| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


@functools.lru_cache(8)
def _made(name: str, model: str | None, pattern: str) -> Tokenizer:
    try:
        if name == "pieces":
            return PieceTokenizer()
        if name == "ranks":
            return RankTokenizer(model or "", pattern)
        if name == "tokenizers":
            return FileTokenizer(model or "")
        return EncodingTokenizer(model or "cl100k_base")
    except Exception as e:
        raise ConfigurationError(f"tokenizer {name} ({model}) can't be made: {e}") from e


def get_tokenizer(config: dict | None) -> Tokenizer:
    """By {"name": pieces | ranks | tokenizers | tiktoken, "model": file or name}; None is pieces."""
    if config is None:
        config = {"name": "pieces"}
    if not isinstance(config, dict) or "name" not in config:
        raise ConfigurationError("a tokenizer is given as a dictionary with a name")
    name = config["name"]
    if name not in ("pieces", "ranks", "tokenizers", "tiktoken"):
        raise ConfigurationError(f"unknown tokenizer: {name}")
    if name != "pieces" and not config.get("model"):
        raise ConfigurationError(f"tokenizer {name} needs a model")
    return _made(name, config.get("model"), config.get("pattern", DEFAULT_PATTERN))
