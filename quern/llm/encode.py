"""Encoding of texts with a public byte-level BPE tokenizer.

Every text is cut into overlapping chunks, which are pre-tokenised in parallel: by tasks, and by threads inside a task. Pre-tokenising has no
memory: from a position at which one pre-token ends, everything that follows depends on the text from there on only. So where the
boundaries found in two neighbouring chunks agree inside their overlap, the later chunk is right from there on, and the text may be
cut there. The pieces between these cuts are encoded one by one and their ids put together again. Decoding concatenates the bytes
of the tokens. A text of one chunk has no overlap and is one piece.

Defined results: null and empty texts give the empty list; repeated rows and rows with a null id each give a row; columns other than
the id and the text are ignored; where two chunks never
agree (a run of letters longer than the overlap) no cut is made and both are pre-tokenised again as one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.runtime import table

TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
#: The pre-tokenising pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the tokenizer's library sees it, spelt out for the library that marks the chunks.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARKING = PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
CHUNK, OVERLAP, THREADS = 4096, 512, 4
_encoders: dict[str, object] = {}


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The tokenizer, loaded once a process from its public file of ranks."""
    import tiktoken

    if (path := os.path.join(folder, f"{name}.tiktoken")) not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def decode(ids: list[int], folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    e = encoder(folder, name)
    return b"".join(e.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def chunks_of(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """Start and text of each chunk; a chunk repeats the last ``overlap`` code points of the one before."""
    step = chunk - overlap
    return [(at, text[at : at + chunk]) for at in range(0, max(len(text) - overlap, 1), step)]


def boundaries(part: str, start: int) -> list[int]:
    """Pre-token ends of a chunk, as positions in the text.

    The last two of the chunk depend on what follows it and are left out. So are those behind white space: how a run of it is parted
    depends on whether anything follows, so a piece must not end with one.
    """
    import regex

    ends = [m.end() for m in regex.finditer(MARKING, part, concurrent=True)][:-2]
    return [start + x for x in ends if part[x - 1] not in _SPACES]


def pieces_of(text: str, chunk: int, overlap: int, marked: list[list[int]]) -> list[str]:
    """The text cut where neighbouring chunks agree; ``marked``: the boundaries of each chunk but the only one of a short text.

    A chunk is right from the first boundary on that it shares with a right one. Where two chunks share none, both are marked again as one.
    """
    cuts, right = [0], marked[0] if marked else []
    step = chunk - overlap
    for i in range(1, len(marked)):
        start, end = i * step, min((i - 1) * step + chunk, len(text))
        mine = set(marked[i])
        agreed = next((x for x in right if start < x <= end and x in mine), None)
        if agreed is None:
            right = boundaries(text[cuts[-1] : i * step + chunk], cuts[-1])
        else:
            cuts.append(agreed)
            right = marked[i]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _encode_column(folder: str, name: str, chunk: int, overlap: int):
    """Replaces the text column of each batch by the list of ids; the chunks of many texts are pre-tokenised side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = [t or "" for t in part.column("text").to_pylist()]
                    chunks = [chunks_of(t, chunk, overlap) for t in texts]
                    # only overlaps need boundaries: the chunk of a short text has none
                    marks = [[pool.submit(boundaries, c, s) for s, c in some] if len(some) > 1 else [] for some in chunks]
                    pieces = [pieces_of(t, chunk, overlap, [m.result() for m in some]) for t, some in zip(texts, marks)]
                    ids = [[i for p in some for i in e.encode_ordinary(p)] for some in pieces]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def encode(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_col`` and ``ids`` (the list of token ids, without special tokens) of each row.

    Texts are encoded where they are read: nothing is shuffled, and every text goes the same way, whatever its length.
    """
    if not 0 < 2 * overlap < chunk:
        raise ValueError("the overlap must be less than half a chunk")
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_encode_column(folder, name, chunk, overlap), f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")
