"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

A piece of text is encoded from its longest vocabulary matches, found by an Aho-Corasick automaton over the bytes mapped
to Latin-1 characters. A sequence of tokens is what the merges would have made exactly if every two neighbours alone
are, so the encoder goes back to shorter matches until all neighbours fit; which tokens fit is remembered.
"""

from __future__ import annotations

import base64
import itertools
import os

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.tasks import per_slice, spread

#: Folder of the public vocabulary files; a parameter of every function that reads them.
VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: The pattern the vocabulary's publisher splits text with before merging; fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers, and the longest piece worth remembering.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 64


class Pieces(dict):
    """Ids of the pieces met so far; looks them up and fills itself as a plain dict would."""

    def __init__(self, encode_piece):
        self.encode_piece = encode_piece

    def __missing__(self, piece: str) -> list[int]:
        found = self.encode_piece(piece.encode("utf-8", "replace").decode("latin-1"))
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Token ids of one vocabulary; ``ranks`` maps token bytes to ids, a lower id being an earlier merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for token in self.ids:
            self.automaton.add_word(token, len(token))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self.encode_piece)
        self.split = regex.compile(PIECES).findall

    def merged(self, text: str) -> list[int]:
        """The merges carried out one by one, lowest id first: for two neighbouring tokens."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.ids.get(a + b) for a, b in itertools.pairwise(parts)]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two neighbours as they are."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of Latin-1 characters, by backtracking from the longest matches."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        matches: list[list[int]] = [[] for _ in piece]  # lengths by start, growing
        for end, length in self.automaton.iter(piece):
            matches[end - length + 1].append(length)
        reachable = bytearray(b"\x01") * (len(piece) + 1)
        found: list[int] = []
        tried: list[int] = []  # which of the matches at its start each token of found is
        at, choice = 0, len(matches[0]) - 1
        while at < len(piece):
            while choice >= 0:
                length = matches[at][choice]
                token = self.ids[piece[at : at + length]]
                if reachable[at + length] and (not found or self.compatible(found[-1], token)):
                    break
                choice -= 1
            if choice >= 0:
                found.append(token)
                tried.append(choice)
                at += length
                choice = len(matches[at]) - 1 if at < len(piece) else -1
            else:  # nothing fits behind the last token: a shorter one in its place
                reachable[at] = 0
                at -= len(self.tokens[found.pop()])
                choice = tried.pop() - 1
        return found

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text; null and empty texts have none."""
        return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def _vocabulary(df: DataFrame, folder: str, name: str):
    """The file's bytes for the tasks: under 1 MB, whatever the corpus."""
    with open(os.path.join(folder, name), "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, name: str = BYTE_BPE) -> DataFrame:
    """(key, ids array<int>), one row per input row; null and empty texts give an empty list, repeated rows repeat."""
    data = _vocabulary(documents, folder, name)

    def work():
        encoder = Encoder(read_ranks(data.value))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, ends[-1])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=[key, "ids"])

        return apply

    source = documents.select(F.col(key), F.col(text).cast("string"))
    return per_slice(spread(source), work, f"{key} {dict(source.dtypes)[key]}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", folder: str = VOCABULARIES, name: str = BYTE_BPE) -> DataFrame:
    """The columns ``keep`` and n_tokens bigint per input row, 0 for null and empty texts."""
    data = _vocabulary(documents, folder, name)

    def work():
        encoder = Encoder(read_ranks(data.value))
        count = lambda t: sum(map(len, map(encoder.pieces.__getitem__, encoder.split(t)))) if t else 0

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = pa.array([count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], names=[*keep, "n_tokens"])

        return apply

    source = documents.select(*keep, F.col(text).cast("string").alias("__text"))
    types = dict(source.dtypes)
    return per_slice(spread(source), work, ", ".join(f"{k} {types[k]}" for k in keep) + ", n_tokens bigint")
