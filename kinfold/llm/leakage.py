"""Evaluation passages that stand in a corpus: Wu-Manber multi-pattern search over normalised words.

Patterns are all runs of min_words consecutive words of the items. A block is two adjacent words. The shift table tells
for a block's hash how far the end of the nearest pattern may be, so positions that no pattern can end at are skipped
(most blocks are in no pattern and skip min_words - 1 words); a shift of 0 selects the bucket of patterns with that suffix
hash, the hash of the prefix block narrows it, and comparing the words confirms.

Words are runs of letters and digits in lower case. Hyphens, apostrophes and points inside numbers join what they stand
between, a hyphen at the end of a line also joins over the break; markup commands count as blanks, likewise comment signs
and all other punctuation. Items with fewer than min_words words can't be found; items with equal words all count. Null
and empty texts hold nothing. Repeated rows give one result; other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: The tables of a block of items take at most so many bytes (some 12 bytes a character of passage), on the driver, in a
#: broadcast and in each Python worker. Each block is a pass over the corpus.
TABLE_BYTES = 64 << 20

_COMMAND = re.compile(r"\\(?:(?:begin|end|label|eqref|ref|pageref|cite[a-z]*)\*?(?:\[[^\]{}]*\])*\{[^{}]*\}|[a-z@]+\*?)")
_BREAK = re.compile(r"-[ \t]*\r?\n[\s%]*")
_POINT = re.compile(r"[.,](?=\d)(?<=\d.)")
_STRANGE = re.compile(r"[^\w\s\x00-\x7f]+")
_BLANK = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def normal_words(text: str) -> list[bytes]:
    t = text.lower()
    if "-" in t:
        t = _BREAK.sub("", t.replace("\\-", ""))
    t = _POINT.sub("", _COMMAND.sub(" ", t))
    if not t.isascii():
        t = _STRANGE.sub(" ", t.replace("\u2010", "").replace("\u2011", "").replace("\u2019", "").replace("\xad", ""))
        t = " ".join(t.split())  # blanks outside ASCII
    return t.encode("utf-8", "replace").translate(_BLANK, b"-'").split()


def _hash(a: bytes, b: bytes) -> int:
    return crc32(a + b" " + b)


class WuManber:
    """Patterns of m words and blocks of two, in flat arrays: a byte of shift for each block hash, the patterns sorted by
    the hash of their suffix block, the hash of their prefix block, and the items' words in one string. items are
    (ids, words) with m words or more; size tells the bytes ahead."""

    def __init__(self, items: list[tuple[list[int], list[bytes]]], m: int = MIN_WORDS):
        self.m, self.ids = m, [ids for ids, _ in items]
        words = [w for _, ws in items for w in ws]
        first = np.cumsum([0, *(len(ws) for _, ws in items)])
        place = np.concatenate([np.arange(len(ws)) for _, ws in items]) if items else np.zeros(0, np.int64)  # of a word in its item
        left = np.repeat(np.diff(first), np.diff(first)) - place  # words from here to the item's end
        self.mask = (1 << max(10, (2 * len(words)).bit_length())) - 1
        ends = np.cumsum([0, *(len(w) + 1 for w in words)])
        self.text, self.at = b" ".join(words), array("q", ends.tobytes())
        blocks = np.array([_hash(x, y) for x, y in zip(words, words[1:])] + [0], np.uint32)[: len(words)]
        # a block with j words behind it in the pattern allows a shift of j; blocks that share a hash the least of theirs
        real = left > 1
        reach = np.maximum(0, m - 2 - place)
        shift = np.full(self.mask + 1, m - 1, np.uint8 if m < 256 else np.uint16)
        np.minimum.at(shift, (blocks & self.mask)[real], reach[real].astype(shift.dtype))
        self.shift = shift.tobytes() if m < 256 else array("H", shift.tobytes())
        starts = np.flatnonzero(left >= m)
        suffix = blocks[starts + m - 2] & self.mask
        order = np.argsort(suffix, kind="stable")
        self.start = array("i", starts[order].astype(np.int32).tobytes())
        self.prefix = array("I", blocks[starts[order]].tobytes())
        self.item = array("i", (np.searchsorted(first, starts[order], "right") - 1).astype(np.int32).tobytes())
        self.bucket = array("i", np.searchsorted(suffix[order], np.arange(self.mask + 2)).astype(np.int32).tobytes())

    @staticmethod
    def size(words: int, characters: int) -> int:
        """Most bytes of the tables for so many words of so many characters."""
        return characters + words + 8 * (words + 1) + 12 * words + (1 << max(10, (2 * words).bit_length())) * 6

    def nbytes(self) -> int:
        arrays = (self.at, self.start, self.prefix, self.item, self.bucket)
        return len(self.text) + len(self.shift) * (1 if self.m < 256 else 2) + sum(len(a) * a.itemsize for a in arrays)

    def find(self, text: str) -> list[int]:
        w, m, mask, found = normal_words(text), self.m, self.mask, set()
        shift, bucket, prefix, crc = self.shift, self.bucket, self.prefix, crc32
        i, n = m - 1, len(w)
        while i < n:
            h = crc(w[i - 1] + b" " + w[i]) & mask
            step = shift[h]
            if step:
                i += step
                continue
            p, end = bucket[h], bucket[h + 1]
            if p < end:
                first = i - m + 1
                head = crc(w[first] + b" " + w[first + 1])
                run = None
                while p < end:
                    if prefix[p] == head and self.item[p] not in found:
                        s = self.start[p]
                        run = run or b" ".join(w[first : i + 1])
                        if self.text[self.at[s] : self.at[s + m] - 1] == run:
                            found.add(self.item[p])
                    p += 1
            i += 1
        return [item for k in found for item in self.ids[k]]


def _blocks(items: DataFrame, m: int, most: int) -> Iterator[WuManber]:
    """Search tables of at most `most` bytes each. A passage that alone takes more goes on in the next table, m - 1 words
    of it in both."""
    block: dict[tuple[bytes, ...], list[int]] = {}
    words = characters = 0
    step = max(m, most // 64)  # words of a part
    for item_id, passage in items.toLocalIterator():
        w = normal_words(passage)
        for at in range(0, max(1, len(w) - m + 1), step):
            part = tuple(w[at : at + step + m - 1])
            if len(part) < m:
                continue
            n, c = len(part), sum(map(len, part))
            if block and WuManber.size(words + n, characters + c) > most:
                yield WuManber([(ids, list(p)) for p, ids in block.items()], m)
                block, words, characters = {}, 0, 0
            if part not in block:
                words, characters = words + n, characters + c
            block.setdefault(part, []).append(item_id)
    if block:
        yield WuManber([(ids, list(p)) for p, ids in block.items()], m)


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, item_id) for each document that holds min_words (two or more) consecutive words of an item's passage."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and text <> ''")
    out = spark.createDataFrame([], "doc_id long, item_id int")
    for block in _blocks(items.select("item_id", "passage").where("passage is not null"), min_words, table_bytes):
        search = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            find = search.value.find
            for b in batches:
                ids, found = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    for item in find(t.as_py()):
                        ids.append(i)
                        found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int32())], ["doc_id", "item_id"])

        out = out.unionByName(texts.mapInArrow(scan, "doc_id long, item_id int"))
    return out.distinct()
