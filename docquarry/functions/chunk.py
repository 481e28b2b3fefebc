"""Chunking: text to rows.

Character chunks are a Catalyst expression.  The other strategies depend on what came before
in the same text, so they run as Arrow batches in Python, a text at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.tokens import Tokenizer, get_tokenizer

Chunk = tuple[str, str]  # text to embed, text to store
STRATEGIES = ("character", "token", "paragraph", "semantic", "recursive")
SEPARATORS = ("\n\n", "\nclass ", "\ndef ", "\n", " ", "")
CHUNK_TYPE = "array<struct<vector_text string, storage_text string>>"


def character_chunks(text: Column, size: int, overlap: int, before: int = 0, after: int = 0) -> Column:
    """Array of chunks as an expression: windows of size characters, each beginning overlap before the last one's end."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")

    def window(i: Column) -> Column:
        start = F.greatest(F.lit(0), i * step - before)
        end = F.least(n, i * step + size + after)
        return F.struct(F.substring(text, i * step + 1, F.lit(size)).alias("vector_text"), F.substring(text, start + 1, end - start).alias("storage_text"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.array().cast(CHUNK_TYPE))


def paragraphs_of(text: str) -> list[str]:
    return [p for p in (x.strip() for x in re.split(r"\n\s*\n", text)) if p]


def sentences_of(text: str) -> list[str]:
    return re.split(r"(?<=[.!?])\s+", text)


def _pack(parts: list[str], size: int, length: Callable[[str], int]) -> Iterator[list[str]]:
    """Runs of parts of at most that length together; a longer part is a run of its own."""
    held, total = [], 0
    for part in parts:
        n = length(part)
        if held and total + n > size:
            yield held
            held, total = [], 0
        held.append(part)
        total += n
    if held:
        yield held


def _by_character(text: str, size: int, overlap: int, before: int, after: int) -> list[Chunk]:
    last = max(0, math.ceil((len(text) - size) / (size - overlap))) if text else -1
    starts = [k * (size - overlap) for k in range(last + 1)]
    return [(text[s : s + size], text[max(0, s - before) : s + size + after]) for s in starts]


def _by_token(text: str, size: int, overlap: int, before: int, after: int, tokenizer: Tokenizer) -> list[Chunk]:
    """Windows of tokens that end after a line end if one lies in their last quarter; the next
    window starts overlap before, also after the last full one, whose tail is a chunk of its own."""
    ids, out, at = tokenizer.encode(text), [], 0
    while at < len(ids):
        end = min(at + size, len(ids))
        piece = tokenizer.decode(ids[at:end])
        line = piece.rfind("\n")
        if end < len(ids) and line > 0.75 * len(piece):
            piece = piece[: line + 1]
            end = at + len(tokenizer.encode(piece))
        out.append((piece, tokenizer.decode(ids[max(0, at - before) : end + after])))
        at = end - overlap if end - overlap > at else max(at + 1, end)
    return out


def _by_paragraph(text: str, size: int, overlap: int, length: Callable[[str], int], strict: bool) -> list[Chunk]:
    out: list[str] = []
    held: list[str] = []

    def total() -> int:
        return sum(map(length, held))

    for para in paragraphs_of(text):
        n = length(para)
        if held and total() + n > size:
            out.append("\n\n".join(held))
            tail: list[str] = []
            for p in reversed(held):
                if sum(map(length, tail)) + length(p) > overlap:
                    break
                tail.insert(0, p)
            held = tail if sum(map(length, tail)) + n <= size else []
        if not held and n > size:
            out += [" ".join(s) for s in _pack(sentences_of(para), size, length)] if strict else [para]
        else:
            held.append(para)
    if held:
        out.append("\n\n".join(held))
    return [(c, c) for c in out]


def _similarity(a, b) -> float:
    na, nb = math.sqrt(sum(float(x) ** 2 for x in a)), math.sqrt(sum(float(x) ** 2 for x in b))
    return sum(float(x) * float(y) for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0


def _by_meaning(text: str, size: int, length, embed: Callable, threshold: float, first: int, strict: bool) -> list[Chunk]:
    """Paragraphs join the chunk before them as long as they are similar to it and it doesn't become too long."""
    out, held = [], []
    for para in paragraphs_of(text):
        if len(held) < first:
            held.append(para)
            continue
        now = "\n\n".join(held)
        if _similarity(*embed([now, para])) >= threshold and not (strict and length(now) + length(para) > size):
            held.append(para)
        else:
            out.append(now)
            held = [para]
    if held:
        out.append("\n\n".join(held))
    return [(c, c) for c in out]


def _split_down(text: str, size: int, length: Callable[[str], int], separators: tuple[str, ...]) -> list[str]:
    """Pieces between the first separator that the text has, joined again up to the size; longer ones are cut by the later separators."""
    k = next((i for i, s in enumerate(separators) if not s or s in text), None)
    sep, later = (separators[k], separators[k + 1 :] if separators[k] else ()) if k is not None else ("", ())
    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in text.split(sep) if sep else list(text):
        n = length(piece)
        if n > size:
            if held:
                out.append(sep.join(held))
                held, total = [], 0
            out += _split_down(piece, size, length, later) if later else [piece]
        elif total + n + (len(sep) if held else 0) > size:
            out.append(sep.join(held))
            held, total = [piece], n
        else:
            held.append(piece)
            # every appended piece carries a joiner, the first one too
            total += n + len(sep)
    if held:
        out.append(sep.join(held))
    return out


def generate_chunks(
    text: str, strategy: str, chunk_size: int, chunk_overlap: int, expand_before: int = 0, expand_after: int = 0, tokenizer: Tokenizer | None = None,
    vectorizer_fn: Callable | None = None, similarity_threshold: float = 0.5, initial_semantic_blocks: int = 3, strict_size: bool = True,
) -> list[Chunk]:
    """(text to embed, text to store) of each chunk of one text.  Lengths are in tokens if there is a tokenizer, else in characters."""
    length = (lambda s: len(tokenizer.encode(s))) if tokenizer is not None else len
    if strategy in ("character", "token") and chunk_overlap >= chunk_size:
        raise ValueError("the overlap must be smaller than the chunk size")
    if strategy == "character":
        return _by_character(text, chunk_size, chunk_overlap, expand_before, expand_after)
    if strategy == "token":
        if tokenizer is None:
            raise ValueError("token chunks need a tokenizer")
        return _by_token(text, chunk_size, chunk_overlap, expand_before, expand_after, tokenizer)
    if strategy == "paragraph":
        return _by_paragraph(text, chunk_size, chunk_overlap, length, strict_size)
    if strategy == "semantic":
        if vectorizer_fn is None:
            raise ValueError("semantic chunks need a vectorizer")
        return _by_meaning(text, chunk_size, length, vectorizer_fn, similarity_threshold, initial_semantic_blocks, strict_size)
    if strategy == "recursive":
        return [(c, c) for c in _split_down(text, chunk_size, length, SEPARATORS)]
    raise ValueError(f"unknown chunking strategy: {strategy!r}")


def chunk(df: DataFrame, strategy: str = "token", size: int = 384, overlap: int = 50, text: str = "text", tokenizer: dict | None = None, vectorizer=None, **options) -> DataFrame:
    """df without its text, with chunk_seq, vector_text and storage_text: a row per chunk."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy!r}")
    rest = [c for c in df.columns if c != text]
    if strategy == "character":
        chunks = character_chunks(F.coalesce(F.col(text), F.lit("")), size, overlap, options.get("expand_before", 0), options.get("expand_after", 0))
        return df.select(*rest, F.posexplode(chunks).alias("chunk_seq", "c")).select(*rest, "chunk_seq", "c.*")
    if strategy == "token" and overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")
    if strategy == "semantic" and vectorizer is None:
        raise ValueError("semantic chunks need a vectorizer")
    get_tokenizer(tokenizer)

    def run(batches):
        tok = get_tokenizer(tokenizer)
        embed = vectorizer.vectorize if vectorizer is not None else None
        for batch in batches:
            for row, t in enumerate(batch.column(text).to_pylist()):
                found = generate_chunks(t or "", strategy, size, overlap, tokenizer=tok, vectorizer_fn=embed, **options)
                if found:
                    kept = batch.select(rest).take(pa.array([row] * len(found)))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(range(len(found)), pa.int32()), pa.array([v for v, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], names=[*rest, "chunk_seq", "vector_text", "storage_text"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.mapInArrow(run, f"{fields}{', ' if fields else ''}chunk_seq int, vector_text string, storage_text string")
