"""Packing: sum-of-squares online packing of tokenised documents into fixed windows.

Each task streams its documents in scan order. A document's tokens fill whole windows first; the rest (shorter than
a window) goes to the fill level that minimises the sum over levels of (number of partially filled windows)², kept in a
level array, ties to the fullest level. When the stream ends, the emptiest open windows are cut up to fill the fullest;
what remains of the last one is cut at powers of two, so no sequence needs padding. Open windows hold at most the ids of
the task's own split. Nothing is shuffled: a rerun of a lost task reads the same split and gives the same sequences.

Defined results: null text is an empty document (its end token only); rows with equal ids are packed separately;
an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import table

#: Fixed value: the pre-tokenisation pattern of byte-level BPE, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = re.compile(r"\s{2000}")
_ENCODERS: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """ids(text) equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    Texts are encoded by tiktoken over the file's own vocabulary (four times as fast); a text that holds a special
    token's string goes through tokenizers itself. A file that is no byte-level BPE uses tokenizers for every text.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    spec = json.loads(open(path, encoding="utf-8").read())
    special = [t["content"] for t in spec.get("added_tokens") or []]
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    pre = spec.get("pre_tokenizer") or {}
    plain = spec["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain:
        _ENCODERS[path] = slow
        return slow
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[ch] for ch in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        # the fast encoder's pattern matcher overflows its stack on very long runs of white space
        return slow(text) if any(s in text for s in special) or LONG_SPACE.search(text) else fast.encode_ordinary(text)

    _ENCODERS[path] = ids
    return ids


class LevelPacker:
    """Open windows by fill level; ``place`` and ``close`` return finished windows (lists of pieces).

    A piece is (document, first token, ids, tokens of the document).
    """

    def __init__(self, size: int):
        self.size = size
        self.stacks: list[list[list]] = [[] for _ in range(size + 1)]
        self.gain_to = np.ones(size + 1, np.int64)  # (n + 1)² - n² at the level reached; a full window counts nothing
        self.gain_to[size] = 0
        self.gain_from = np.full(size + 1, np.iinfo(np.int64).max // 4)  # (n - 1)² - n² at the level left; no window, no choice
        self.gain_from[0] = 0

    def _count(self, level: int) -> None:
        n = len(self.stacks[level])
        if 0 < level < self.size:
            self.gain_to[level] = 2 * n + 1
            self.gain_from[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4

    def place(self, piece: tuple) -> list[list]:
        n = len(piece[2])
        if n == self.size:
            return [[piece]]
        cost = self.gain_to[n:] + self.gain_from[: self.size + 1 - n]
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if level:
            window = self.stacks[level].pop()
            self._count(level)
        else:
            window = []
        window.append(piece)
        if level + n == self.size:
            return [window]
        self.stacks[level + n].append(window)
        self._count(level + n)
        return []

    def close(self) -> list[list]:
        """Pour the emptiest open windows into the fullest; the last one is cut at powers of two."""
        left = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.stacks[level]]
        for level in range(1, self.size):
            self.stacks[level] = []
            self._count(level)
        done, donor = [], []
        fullest, emptiest, spare = 0, len(left) - 1, 0
        while fullest <= emptiest or spare:
            if fullest <= emptiest:
                level, window = left[fullest]
                fullest += 1
            else:
                level, window, donor, spare = spare, donor, [], 0
            while level < self.size:
                if not spare:
                    if fullest > emptiest:
                        break
                    spare, donor = left[emptiest]
                    emptiest -= 1
                doc, start, ids, total = donor.pop()
                take = min(len(ids), self.size - level)
                window.append((doc, start, ids[:take], total))
                if take < len(ids):
                    donor.append((doc, start + take, ids[take:], total))
                level, spare = level + take, spare - take
            if level == self.size:
                done.append(window)
            else:
                done += self._powers(level, window)
        return done

    @staticmethod
    def _powers(level: int, window: list) -> list[list]:
        out = []
        for bit in reversed(range(level.bit_length())):
            room, own = level & (1 << bit), []
            while room:
                doc, start, ids, total = window.pop(0)
                take = min(room, len(ids))
                own.append((doc, start, ids[:take], total))
                if take < len(ids):
                    window.insert(0, (doc, start + take, ids[take:], total))
                room -= take
            if own:
                out.append(own)
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (``with_ids``) the ids."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    schema = f"`{id_col}` {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, first = encoder(path), LevelPacker(size), TaskContext.get().partitionId() << 36
        made, out, id_type = 0, [], None

        def emit(windows: list[list]) -> None:
            nonlocal made
            for w in windows:
                offset = 0
                for doc, start, ids, total in w:
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + made, offset, ids))
                    offset += len(ids)
                made += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            arrays = [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in cols[7]]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[7]).astype(np.int32))))
                names.append("ids")
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), end_id], "<u4")
                for start in range(0, len(ids), size):
                    emit(packer.place((doc, start, ids[start : start + size], len(ids))))
                if len(out) >= 2000:
                    yield flush()
        emit(packer.close())
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
