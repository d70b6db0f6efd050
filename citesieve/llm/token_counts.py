"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

A text is normalised and cut into pre-tokens as the vocabulary file says; a file that asks for steps other than
those built here is refused, not miscounted. The pre-tokens not seen before are
laid out as one ragged array of symbol numbers; in each round every sequence applies its own lowest-rank pair,
at all its places at once, and the symbols that survive are counted. Counts are kept by pre-token, up to a
bound, for the following texts of the task.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .text import SLICE_BYTES, slices

#: Pre-tokens whose counts a task keeps; then it starts again.
KEPT = 400_000
#: A pre-token of more letters is counted by itself, and only the pairs beside merged places are ranked again.
LONG = 2048
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is one, else those from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def checked(spec: dict) -> str:
    """The pattern of pre-tokens in a vocabulary file; ValueError if the file is not of the kind counted here.

    That is BPE over bytes with nothing but word ends added, after NFC, single blanks and lower case, whose
    pre-tokens are the matches of one pattern, and whose added tokens are special and matched as they stand.
    """
    model, normalizer, cut = spec.get("model") or {}, spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, parts = normalizer.get("normalizers", []), cut.get("pretokenizers", [])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    fits = [
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")),
        normalizer.get("type") == "Sequence" and steps == [{"type": "NFC"}, blanks, {"type": "Lowercase"}],
        cut.get("type") == "Sequence" and [p["type"] for p in parts] == ["Split", "ByteLevel"],
        all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", [])),
        not spec.get("truncation") and not spec.get("padding"),
    ]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges") or []]
    used: dict[str, int] = {}
    for rank, pair in enumerate(merges):
        for symbol in pair:
            used.setdefault(symbol, rank)
    # Only then may all places of a rank merge at once: what they make forms no pair that should have come before.
    fits.append(all(used.get(a + b, rank) >= rank for rank, (a, b) in enumerate(merges)))
    if not all(fits) or parts[0]["behavior"] != "Removed" or not parts[0]["invert"] or parts[1]["add_prefix_space"] or parts[1]["use_regex"]:
        raise ValueError("this kind of vocabulary file is not supported")
    return parts[0]["pattern"]["Regex"]


class Merges:
    """The pair ranks of a vocabulary in an open hash table, looked up for whole arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = checked(spec)
        vocab, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[symbols[b] + end] for b in range(256)], np.int64)
        self.size = len(vocab)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & self.mask
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], _NONE)
        seek = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(seek):
            slot[seek] = (slot[seek] + 1) & self.mask
            found = self.keys[slot[seek]]
            hit = found == keys[seek]
            out[seek[hit]] = self.ranks[slot[seek[hit]]]
            seek = seek[~hit & (found != -1)]
        return out


def count_symbols(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """How many symbols are left of each (non-empty) pre-token when no pair has a rank."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces], np.int64)
    ids = merges.inner[data]
    last = np.cumsum(lengths) - 1
    ids[last] = merges.final[data[last]]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    counts = lengths.copy()
    while len(ids) > 1:
        inside = owner[1:] == owner[:-1]
        rank = np.where(inside, merges.rank(ids[:-1], ids[1:]), _NONE)
        begins = np.flatnonzero(np.concatenate([[True], ~inside]))
        lowest = np.minimum.reduceat(np.append(rank, _NONE), begins)
        alive = lowest < _NONE
        sizes = np.diff(np.append(begins, len(ids)))
        stay = np.repeat(alive, sizes)
        if not stay.any():
            break
        best = np.repeat(lowest, sizes)[:-1]
        at = (rank == best) & (rank < _NONE)
        places = np.flatnonzero(at)
        fresh = np.ones(len(places), bool)
        fresh[1:] = np.diff(places) > 1
        places = places[_every_other(fresh)]
        ids[places] = merges.made[rank[places]]
        stay[places + 1] = False
        counts -= np.bincount(owner[places], minlength=len(counts))
        ids, owner = ids[stay], owner[stay]
    return counts


def _every_other(fresh: np.ndarray) -> np.ndarray:
    """In a run such as "x x x" only every other place can merge, counted from the left; ``fresh`` marks where runs begin."""
    order = np.arange(len(fresh))
    return (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0


def count_long(piece: bytes, merges: Merges) -> int:
    """As ``count_symbols`` for one long pre-token.

    Places wait by the rank of the pair that begins there, the lowest rank is applied at all of its places, and
    only the pairs beside these are ranked again: the work grows with the merges, not with rounds times length.
    """
    data = np.frombuffer(piece, np.uint8)
    n = len(data)
    ids = merges.inner[data]
    ids[-1] = merges.final[data[-1]]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    # The rank of the pair that begins at each symbol; a merged symbol, like the last, begins none.
    rank = np.append(merges.rank(ids[:-1], ids[1:]), _NONE)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[rank[places] < _NONE]
        places = places[np.argsort(rank[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[places])) + 1
        for group in np.split(places, cuts) if len(places) else []:
            own = int(rank[group[0]])
            if own not in waiting:
                waiting[own] = []
                heapq.heappush(ranks, own)
            waiting[own].append(group)

    wait(np.arange(n))
    left = n
    while ranks:
        lowest = heapq.heappop(ranks)
        places = np.unique(np.concatenate(waiting.pop(lowest)))
        places = places[rank[places] == lowest]
        if not len(places):
            continue
        fresh = np.ones(len(places), bool)
        fresh[1:] = after[places[:-1]] != places[1:]
        places = places[_every_other(fresh)]
        gone = after[places]
        ids[places] = merges.made[lowest]
        rank[gone] = _NONE
        after[places] = after[gone]
        inner = places[after[places] < n]
        before[after[inner]] = inner
        rank[places] = _NONE
        rank[inner] = merges.rank(ids[inner], ids[after[inner]])
        outer = before[places]
        outer = outer[outer >= 0]
        rank[outer] = merges.rank(ids[outer], ids[after[outer]])
        left -= len(places)
        wait(np.union1d(inner, outer))
    return left


class Counter:
    """Counts the tokens of texts within one task."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        # In the file's patterns \s is Unicode white space; Python's also takes four control characters.
        self.cut = regex.compile(self.merges.pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.apart = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special tokens stand between them."""
        special = 0
        if self.apart and self.apart.search(text):
            parts = self.apart.split(text)
            special = len(parts) - 1
            found = [p for part in parts for p in self.pieces(part)[0]]
            return found, special
        if text.isascii():
            return self.cut(text.lower()), 0
        return self.cut(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()), 0

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        new = list(set().union(*(p for p, _ in cut)).difference(self.known))
        long = [p for p in new if len(p) > LONG]
        self.known.update((p, count_long(p.encode(), self.merges)) for p in long)
        new = [p for p in new if len(p) <= LONG]
        part, size = [], 0
        for piece in [*new, None]:
            if piece is None or size > SLICE_BYTES // 4:
                if part:
                    self.known.update(zip(part, count_symbols([p.encode() for p in part], self.merges).tolist(), strict=True))
                part, size = [], 0
            if piece is not None:
                part.append(piece)
                size += len(piece)
        return [sum(map(self.known.__getitem__, p)) + s for p, s in cut]


def token_counts(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the library that reads the vocabulary file at ``path`` (BPE with word ends), without
    begin or end tokens; special strings inside a text are one token each, as is that library's default. A file
    of another kind raises a ValueError before any job runs. A null text counts as empty: no bytes, no tokens. Other columns are ignored; repeated rows stay.
    """

    with open(path, encoding="utf-8") as f:
        checked(json.load(f))

    def run(batches):
        counter = Counter(path)
        for part in slices(batches, limit=SLICE_BYTES // 2):
            texts = pc.fill_null(part.column("text"), "")
            counts = np.array(counter.counts(texts.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
