"""Texts over a token limit cut into pieces: a hierarchy of separators and greedy packing.

A piece takes as much as the limit allows and ends at the last boundary of the highest kind that lies in reach: section,
paragraph, formula or environment, sentence, word, part of a word, and where none of these is in reach, character. The
next piece starts at the last seam of words that leaves overlap tokens or more shared with the piece before, so
consecutive pieces share overlap_tokens, rounded up to parts of words. The pieces without what they share give the text.

The limit holds for each piece encoded alone by the tokenizer (a single character of more tokens is a piece). Where it
can't hold otherwise, within words cut by character, overlap is given up. A text within the limit is one piece; null and empty texts
give none. Repeated documents give their pieces again; other columns are not looked at. An overlap of the limit or more
is an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import tokens

#: A piece may end where a run of blanks begins, so blanks stay with the piece behind them and the tokens of a piece are
#: those it has within the text. Kinds of such places, from the highest:
SECTION = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph|appendix|bibliography)\b|\\begin\{(?:abstract|document|thebibliography)\}")
PARAGRAPH = re.compile(r"\n[ \t\r]*%?[ \t\r]*\n|\\par\b")
FORMULA = re.compile(r"\\(?:begin\{|\[|item\b|bibitem\b)|\$\$")
FORMULA_END = re.compile(r"\\(?:end\{[^{}]*\}|\])")
SENTENCE = re.compile(r"[.!?…。！？][.!?\"')\]}”’»$]*(?=\s)")
#: A word of more tokens (or of half of what a piece has beside its overlap) may be cut within.
LONG_WORD = 64
MAX_PROFILES = 1000
#: Texts of so many characters make an output batch.
BATCH_CHARACTERS = 8 << 20


class Text:
    """A text as parts (words with the space ahead, and blanks): offsets and tokens ahead of each part."""

    def __init__(self, text: str, vocabulary: tokens.Vocabulary, long_word: int = LONG_WORD):
        self.text, self.vocabulary = text, vocabulary
        parts = tokens.PARTS.findall(text)
        counts = list(map(vocabulary.__getitem__, parts))
        self.n = sum(counts)
        self.inner: list[int] = []  # parts that begin within a word, ascending
        if counts and max(counts) > long_word:
            parts, counts = self._break(parts, counts, long_word)
        self.parts = parts
        self.at = list(accumulate(map(len, parts), initial=0))
        self.sum = list(accumulate(counts, initial=0))
        self.kinds: list[list[int]] | None = None

    def _break(self, parts: list[str], counts: list[int], long_word: int) -> tuple[list[str], list[int]]:
        out, n, run = [], [], max(1, long_word // 8)
        for p, c in zip(parts, counts):
            runs = [p] if c <= long_word else [p[i : i + run] for i in range(0, len(p), run)]
            self.inner += range(len(out) + 1, len(out) + len(runs))
            out += runs
            n += [c] if len(runs) == 1 else map(self.vocabulary.__getitem__, runs)
        return out, n

    def prepare(self) -> None:
        """Find the places; only texts over a limit need them."""
        t = self.text
        end = len(t)

        def before(o: int) -> int:
            while o > 0 and t[o - 1].isspace():
                o -= 1
            return o

        found = [
            [before(m.start()) for m in SECTION.finditer(t)],
            [before(m.start()) for m in PARAGRAPH.finditer(t)],
            [before(m.start()) for m in FORMULA.finditer(t)] + [o for m in FORMULA_END.finditer(t) if (o := m.end()) < end and t[o].isspace()],
            [m.end() for m in SENTENCE.finditer(t)],
        ]
        self.kinds = []
        for offsets in found:
            kind = [k for o in offsets if self.at[k := bisect_left(self.at, o)] == o and self.place(k)]
            kind.sort()
            self.kinds.append(kind)

    def place(self, k: int) -> bool:
        """Does a run of blanks begin here?"""
        return 0 < k < len(self.parts) and self.parts[k][0].isspace() and not self.parts[k - 1][-1].isspace()

    def broken(self, s: int, e: int) -> bool:
        """Is a word that is cut within among parts s to e?"""
        k = bisect_left(self.inner, s)
        return k < len(self.inner) and self.inner[k] <= e

    def shared_start(self, e: int, overlap: int) -> tuple[int, int, int]:
        """The last seam of words with overlap tokens or more up to e: (offset, tokens ahead of the next part, next part)."""
        k = bisect_right(self.sum, self.sum[e] - overlap) - 1
        if k < 0:
            return 0, 0, 0
        lack = overlap - (self.sum[e] - self.sum[k + 1])  # tokens wanted of part k
        if self.sum[k] + overlap == self.sum[e] or self.broken(k, k + 1):
            return self.at[k], 0, k
        offset, head = self.at[k + 1], 0
        for w in reversed(self.vocabulary.words(self.parts[k])):
            offset, head = offset - len(w), head + self.vocabulary[w]
            if head >= lack:
                break
        return offset, head, k + 1

    def pieces(self, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
        """(start offset, end offset, tokens, tokens shared with the piece before)."""
        if self.n <= limit:
            yield 0, len(self.text), self.n, 0
            return
        if self.kinds is None:
            self.prepare()
        last, done = len(self.parts), 0
        x, head, s = 0, 0, 0  # the piece begins at offset x, with head tokens ahead of part s
        while done < last:
            e = bisect_right(self.sum, self.sum[s] + limit - head) - 1
            if e < last:
                for kind in self.kinds:
                    k = bisect_right(kind, e) - 1
                    if k >= 0 and kind[k] > done:
                        e = kind[k]
                        break
                else:
                    k = e
                    while k > done and not self.place(k):
                        k -= 1
                    e = k if k > done else max(e, done + 1)
            size = head + self.sum[e] - self.sum[s]
            # not cut at blanks: what is next to the cut may be encoded otherwise
            if size > limit or (e < last and not self.place(e)) or self.inner and self.broken(s, e):
                size = self.vocabulary.count(self.text[x : self.at[e]])
                while size > limit and e > done + 1:
                    e -= 1
                    size = self.vocabulary.count(self.text[x : self.at[e]])
                while size > limit and x < self.at[done]:  # give up overlap rather than the limit
                    x, head, s = (self.at[s + 1], 0, s + 1) if not head else (self.at[s], 0, s)
                    size = self.vocabulary.count(self.text[x : self.at[e]])
            yield x, self.at[e], size, head + self.sum[done] - self.sum[s] if x < self.at[done] else 0
            done = e
            x, head, s = self.shared_start(e, overlap) if overlap and e < last else (self.at[e], 0, e)


SCHEMA = "profile string, doc_id long, piece_no int, start_char int, end_char int, n_tokens int, overlap_tokens int, piece_text string"
ARROW = pa.schema(
    [("profile", pa.string()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()),
     ("n_tokens", pa.int32()), ("overlap_tokens", pa.int32()), ("piece_text", pa.string())]
)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def split_documents(documents: DataFrame, profiles: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """The pieces of all documents for all profiles (profile, max_tokens, overlap_tokens; at most MAX_PROFILES rows)."""
    plans = [tuple(r) for r in profiles.select("profile", "max_tokens", "overlap_tokens").distinct().limit(MAX_PROFILES + 1).collect()]
    if len(plans) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    for p, limit, overlap in plans:
        if not 0 <= overlap < limit:
            raise ValueError(f"profile {p}: overlap_tokens must be at least 0 and below max_tokens")

    # what a word is cut within for depends on a profile's own limit, never on the other profiles
    by_word: dict[int, list[tuple]] = {}
    for plan in plans:
        by_word.setdefault(min(LONG_WORD, max(1, (plan[1] - plan[2]) // 2)), []).append(plan)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.load(vocabulary)
        for b in batches:
            rows, size = [], 0
            for i, t in zip(b.column(0), b.column(1)):
                text, i = t.as_py(), i.as_py()
                for long_word, same in by_word.items():
                    doc = Text(text, known, long_word)
                    for name, limit, overlap in same:
                        for k, (x, y, n, shared) in enumerate(doc.pieces(limit, overlap), 1):
                            rows.append((name, i, k, x, y, n, shared, text[x:y]))
                            size += y - x
                            if size > BATCH_CHARACTERS:
                                yield batch(rows)
                                rows, size = [], 0
            if rows:
                yield batch(rows)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and text <> ''")
    return texts.mapInArrow(split, SCHEMA)
