"""Token ids of whole texts by a public tokenizer whose tokens never span white space."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarterline.llm.words import sliced

#: parts of words a worker remembers before it starts afresh; bounds its memory
PARTS = 600_000
#: bytes of text encoded at once
BATCH_BYTES = 1 << 20

# fixed values: how the tokenizer cuts a text, written for Latin letters, digits and ASCII signs
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ \t-\r]*")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9 \t-\r]+")

# byte-level vocabularies spell byte b as character b where that is visible, else as one from 256 on
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def _whole(text: str) -> bool:
    """Whether only the tokenizer itself can cut the text."""
    return "<|" in text or not _PLAIN.fullmatch(text)


class PartEncoder:
    """Ids of texts; each distinct part of a text is encoded once.

    Valid where the tokenizer lower-cases, drops white space and cuts a text into parts before
    anything else, so that the ids of a text are those of its parts one after the other.
    Text of Latin letters, digits and ASCII signs is cut here the way the tokenizer does it, and its parts go
    straight to the tokenizer's byte-level model; a word with any other character, or one that may
    hold a special token, is a part of its own that the whole tokenizer encodes.
    """

    def __init__(self, path: str) -> None:
        # tasks already share the cores; the library must not start threads of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self._places: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._bounds = np.zeros(1 << 16, np.int64)
        self._used = 0

    def parts(self, text: str) -> list[str]:
        if not _whole(text):
            return _PART.findall(text.lower())
        found: list[str] = []
        for raw in text.encode("utf-8", "replace").split():
            word = raw.decode("utf-8")
            found += [word] if _whole(word) else _PART.findall(word.lower())
        return found

    def _learn(self, fresh: list[str]) -> None:
        spelled = array("I")
        ends = []
        tokenize = self._model.tokenize
        for part in fresh:
            if _whole(part):
                spelled.extend(self._tokenizer.encode(part, add_special_tokens=False).ids)
            else:
                spelled.extend([token.id for token in tokenize(part.encode().decode("latin-1").translate(_SIGNS))])
            ends.append(len(spelled))
        place = len(self._places)
        while self._used + len(spelled) > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
        while place + len(fresh) + 1 > len(self._bounds):
            self._bounds = np.concatenate((self._bounds, np.zeros_like(self._bounds)))
        self._ids[self._used: self._used + len(spelled)] = spelled
        self._bounds[place + 1: place + 1 + len(fresh)] = np.array(ends, np.int64) + self._used
        self._used += len(spelled)
        self._places.update(zip(fresh, range(place, place + len(fresh))))

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each part has."""
        if len(self._places) > PARTS:
            self._forget()
        at = np.fromiter(map(self._places.get, parts, repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missed = [parts[k] for k in unknown]
            self._learn(list(set(missed)))
            at[unknown] = np.fromiter(map(self._places.__getitem__, missed), np.int64, len(missed))
        begins = self._bounds[at]
        sizes = self._bounds[at + 1] - begins
        shifts = np.repeat(begins - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if len(at) else begins
        return self._ids[np.arange(len(shifts)) + shifts], sizes


_encoders: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def documents_ids(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """Ids of each text; a NULL text is empty."""
    own = encoder(path)
    run: list[list[str]] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        ids, sizes = own.encode(list(chain.from_iterable(run)))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = 0
        for parts in run:
            yield ids[ends[at]: ends[at + len(parts)]]
            at += len(parts)

    for text in texts:
        run.append(own.parts(text or ""))
        size += len(text or "")
        if size >= BATCH_BYTES:
            yield from flush()
            run, size = [], 0
    yield from flush()


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, which ends with ``end_id``.

    One row per piece: doc_id, piece (from 0), start (ids of the document before it), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), and ``ids`` if asked for.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            rows: list[list] = [[], [], [], [], [], []][: 6 if with_ids else 5]
            for doc_id, ids in zip(part.column(0).to_pylist(), documents_ids(part.column(1).to_pylist(), path)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start: start + capacity]
                    for column, value in zip(rows, (doc_id, piece, start, len(own), crc32(own.tobytes()), own)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(rows, kinds[: len(names)])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<bigint>" if with_ids else ""))
