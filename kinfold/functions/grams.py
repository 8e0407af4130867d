"""Character n-grams, MinHash and LSH arithmetic: column expressions and their vectorised twins."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.normalize import let

PRIME = 2**31 - 1
MAX_PERMUTATIONS = [16, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024]  # fixed values of the calibration's grid


def ngrams(form: Column | str, n: int = 3) -> Column:
    """Overlapping n-grams, repeats kept; none if the text is shorter."""
    s = F.col(form) if isinstance(form, str) else form
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(F.length(s) >= n, grams).otherwise(F.array().cast("array<string>"))


def distinct_ngrams(form: Column | str, n: int = 3) -> Column:
    return F.array_distinct(ngrams(form, n))


def gram_hash(gram: Column) -> Column:
    """60 bits of MD5 modulo PRIME; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(gram.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(PRIME)


@lru_cache(maxsize=300_000)
def gram_hash_of(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:15], 16) % PRIME


def coefficients(permutations: int, seed: int = 0) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(permutations)]


def minhash(grams: Column, permutations: int, seed: int = 0) -> Column:
    """Signature of a gram set as an expression; of an empty set all PRIME. For big tables take signature()."""
    ab = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in coefficients(permutations, seed)])
    least = lambda c, hashes: F.coalesce(F.array_min(F.transform(hashes, lambda h: (h * c["a"] + c["b"]) % F.lit(PRIME))), F.lit(PRIME).cast("long"))
    # the grams are hashed once, not once for each permutation
    return let(F.transform(grams, gram_hash), lambda hashes: F.transform(ab, lambda c: least(c, hashes)))


class Signer:
    """Signatures of texts in numpy, equal to minhash()."""

    def __init__(self, n: int, permutations: int, seed: int = 0):
        ab = np.array(coefficients(permutations, seed), np.int64).reshape(-1, 2)
        self.n, self.a, self.b = n, ab[:, :1], ab[:, 1:]

    def __call__(self, text: str) -> np.ndarray:
        n = self.n
        h = np.array([gram_hash_of(g) for g in {text[i : i + n] for i in range(len(text) - n + 1)}], np.int64)
        if not len(h):
            return np.full(len(self.a), PRIME, np.int64)
        return ((self.a * h + self.b) % PRIME).min(axis=1)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band: a multilinear hash of the band's values, by fixed odd numbers."""
    r = np.random.default_rng(20011)
    c = r.integers(1, 2**63, (bands, rows), np.uint64) | np.uint64(1)
    v = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        k = (v * c).sum(axis=2, dtype=np.uint64)
    return (k ^ (k >> np.uint64(29))).view(np.int64)


class Grams:
    """All grams of a batch of texts in numpy: the text and the code of each place a gram starts at.

    Codes tell grams apart: seven bits a character for ASCII texts and up to nine characters, in the order of the grams;
    else a hash of 64 bits."""

    def __init__(self, texts: list[str], n: int):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.joined, self.n = "".join(texts), n
        points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters up to the text's end
        self.at = np.flatnonzero(left >= n)
        self.text = np.repeat(np.arange(len(texts)), lengths)[self.at]
        short = n <= 9 and self.joined.isascii()
        code = np.zeros(len(self.at), np.int64)
        with np.errstate(over="ignore"):
            for i in range(n):
                c = points[self.at + i]
                code = (code << 7) | c if short else code * np.int64(6364136223846793005) + c * np.int64(1442695040888963407) + np.int64(1 << 62)
        self.codes, first, self.which = np.unique(code, return_index=True, return_inverse=True)
        self.first = self.at[first]

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in codes, times) of each distinct gram of each text, by text and code."""
        both, times = np.unique(self.text * max(1, len(self.codes)) + self.which, return_counts=True)
        return both // max(1, len(self.codes)), both % max(1, len(self.codes)), times

    def signatures(self, signer: Signer) -> tuple[np.ndarray, np.ndarray]:
        """(texts that have grams, their signatures)."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros((0, len(signer.a)), np.int64)
        h = np.fromiter((gram_hash_of(self.joined[p : p + self.n]) for p in self.first), np.int64, len(self.first))
        permuted = ((signer.a * h + signer.b) % PRIME).astype(np.int32).T.copy()
        start = np.flatnonzero(np.diff(self.text, prepend=-1))
        return self.text[start], np.minimum.reduceat(permuted[self.which], start, axis=0).astype(np.int64)


def estimate_jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def collision_probability(similarity: float, bands: int, rows: int) -> float:
    return 1 - (1 - similarity**rows) ** bands


def lsh_calibrate(target_jaccard: float, target_recall: float = 0.95, fp_jaccard: float | None = None) -> dict:
    """Fewest permutations whose bands and rows find pairs of target_jaccard with target_recall, and of those the split
    with the fewest pairs of fp_jaccard (half the target unless given)."""
    fp = target_jaccard / 2 if fp_jaccard is None else fp_jaccard
    if not (0 < target_jaccard < 1 and 0 < target_recall < 1 and 0 < fp < 1):
        raise ValueError("target_jaccard, target_recall and fp_jaccard must lie between 0 and 1")
    for permutations in MAX_PERMUTATIONS:
        fits = []
        for rows in range(1, permutations + 1):
            if permutations % rows == 0:
                bands = permutations // rows
                hit = collision_probability(target_jaccard, bands, rows)
                if hit >= target_recall:
                    fits.append((collision_probability(fp, bands, rows), rows, bands, hit))
        if fits:
            p_fp, rows, bands, hit = min(fits)
            return {"bands": bands, "rows": rows, "num_perm": permutations, "p_at_target": hit, "p_at_fp": p_fp}
    raise ValueError(f"no split of up to {MAX_PERMUTATIONS[-1]} permutations reaches the recall")
