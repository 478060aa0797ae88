"""Embedding and generation behind plain callables, with deterministic offline stand-ins.

Both run as Arrow functions over batches, retry with growing pauses, and never retry a wrong size."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed
from tessera.params import DEFAULTS, Params

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]


class ContextExhausted(Exception):
    """The server found the prompt too long."""


def is_context_error(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(False)
    for sign in fixed.CONTEXT_ERRORS:
        out = out | F.contains(low, F.lit(sign))
    return out


def hashing_embedder(dim: int = 64) -> Embed:
    """Signed hashed words; equal texts have equal vectors, texts with shared words are close."""

    def run(texts: list[str]) -> list[list[float]]:
        import numpy as np

        from tessera.functions.batches import word_hashes, words_of

        data, starts, ends, rows = words_of([text.lower() for text in texts])
        h = word_hashes()(data, starts, ends)
        cell = rows * dim + (h % np.uint64(dim)).astype(np.int64)
        return np.bincount(cell, np.where(h >> np.uint64(63), 1.0, -1.0), minlength=dim * len(texts)).reshape(-1, dim).tolist()

    return run


def echo_generator(prompts: list[str]) -> list[str]:
    """Answers with the first line of the first source, and cites it.  Earlier labels are those of the worked example."""
    out = []
    for p in prompts:
        _, found, rest = p.rpartition(f"{fixed.LABEL_WORD} 1:\n")
        out.append(f"{rest.splitlines()[0].strip()} ({fixed.LABEL_WORD} 1)." if found and rest.strip() else "")
    return out


def with_retries(call: Callable, batch: list, params: Params, wait: Callable[[float], None] = time.sleep):
    for attempt in range(params.embed_retries):
        try:
            return call(batch)
        except ValueError:
            raise
        except Exception:
            if attempt + 1 == params.embed_retries:
                raise
            wait(2**attempt)


def embed(text: Column, call: Embed, params: Params = DEFAULTS) -> Column:
    """array<float> of each text, params.embed_batch texts at a time, in order; null stays null."""

    def run(column):
        import pyarrow as pa

        texts = column.to_pylist()
        some = [k for k, t in enumerate(texts) if t is not None]
        out: list = [None] * len(texts)
        for at in range(0, len(some), params.embed_batch):
            part = some[at : at + params.embed_batch]
            for k, v in zip(part, with_retries(call, [texts[k] for k in part], params), strict=True):
                if params.embedding_dim is not None and len(v) != params.embedding_dim:
                    raise ValueError(f"vector of size {len(v)}, expected {params.embedding_dim}")
                out[k] = v
        return pa.array(out, pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(text)


def generate(prompt: Column, call: Generate) -> Column:
    """(text, error) of each prompt; null prompts aren't sent and give nulls."""

    def run(column):
        import pyarrow as pa

        texts, errors = [], []
        for p in column.to_pylist():
            text = error = None
            if p is not None:
                try:
                    text = call([p])[0]
                except Exception as e:  # told to the caller row by row, as one prompt's failure isn't another's
                    error = str(e) or type(e).__name__
            texts.append(text)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"])

    return F.arrow_udf(run, "struct<text:string,error:string>")(prompt)
