"""Byte-level BPE encoding with a contiguous rank array, and decoding.

A word is held as its parts and, between them, the ranks of adjacent parts: one rank for each boundary that a merge could remove.
The array is scanned for its least rank, the leftmost of equals; that boundary is deleted, and the ranks of the two boundaries
beside it are looked up anew, until no adjacent parts merge. Words are short, so scanning a few adjacent numbers beats a heap; words
of more than SHORT bytes, where scans would add up to the square of the length, keep the same order in a heap over linked parts.

The vocabulary file is read as JSON; nothing of the encoding itself is left to the library that made it. Only the question which
characters are letters and numbers, which differs between Unicode versions, is put to the library, once per session on the driver.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table

#: Bytes of the longest word whose ranks are scanned.
SHORT = 192
#: Words of similar length: more than the first and at most the second number of bytes.
WIDTHS = [(0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 48), (48, SHORT)]
#: Rank of a pair that doesn't merge, and what stands where a word has no more parts.
NEVER, NO_PART = 1 << 30, (1 << 20) - 1
#: White space beside a space, and white space and separators beyond the six usual characters.
BESIDE_SPACE = ["  ", *(x + " " for x in "\t\n\r\v\f"), *(" " + x for x in "\t\n\r\v\f")]
ODD_CONTROL, ODD_SPACE = re.compile("[\x1c-\x1f]"), re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the file: itself where it is printable Latin-1, else the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache
def unknown_letters() -> str:
    """Characters that the regex module calls letters or numbers and the tokenizers library, of an older Unicode version, doesn't."""
    from tokenizers import pre_tokenizers

    split, out = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str, []
    for k in range(0, 0x110000, 0x4000):
        chars = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(max(k, 128), k + 0x4000) if not 0xD800 <= c < 0xE000))
        starts = {s for _, (s, _) in split("".join(f" a{c} 1{c}" for c in chars))}
        out += [c for j, c in enumerate(chars) if (6 * j + 2 in starts) and (6 * j + 5 in starts)]
    return "".join(out)


def pattern(unknown: str) -> regex.Pattern:
    """What splits a text into words, with some characters that count neither as letters nor as numbers."""
    no = f"--[{unknown}]" if unknown else ""
    letter, number, other = rf"[\p{{L}}{no}]", rf"[\p{{N}}{no}]", (r"[^\p{White_Space}\p{L}\p{N}]" if not unknown else rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{unknown}]]")
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+")


class Encoder:
    """Encodes and decodes whole texts; remembers up to `remember` stretches between spaces, and as many words, then starts anew.

    Most new stretches are known words put together anew, so merging and decoding are left to words that were never met. A stretch
    whose ids stand for just its own bytes, as in valid texts all do, needs no other copy of them.
    """

    def __init__(self, path: str, unknown: str = "", remember: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or file["normalizer"] or not plain:
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("added tokens must stand for their own text only")
        vocab, byte_of = model["vocab"], printable_bytes()
        self.bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.name = [str(i) for i in range(max(self.bytes) + 1)]
        self.single = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            self.single[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: k for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys = np.array([*sorted(self.rank), np.iinfo(np.int64).max])
        self.key_ranks = np.array([*(self.rank[k] for k in self.keys[:-1].tolist()), NEVER])
        self.words, self.rare = pattern(""), frozenset(unknown)
        self.words_rare = pattern(unknown) if unknown else self.words
        self.specials = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        # Ids, joined by commas, by stretch and by word; and the decoded bytes of those that differ from their own.
        self.ids: dict[str, str] = {}
        self.word_ids: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}
        self.remember = remember

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of adjacent parts, NEVER where they don't merge."""
        keys = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.key_ranks[at], NEVER)

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word: the rank arrays of words of similar length are the rows of a matrix, and a step takes one merge of each."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in WIDTHS:
            for at in np.array_split(np.flatnonzero((sizes > low) & (sizes <= high)), max(1, len(words) * high >> 21)):
                if not len(at):
                    continue
                taken = np.frombuffer(b"".join(words[k] for k in at), np.uint8)
                parts = np.full((len(at), high + 1), NO_PART, np.int32)
                parts[np.arange(high + 1) < sizes[at][:, None]] = self.single[taken]
                ranks = self.pair_ranks(parts[:, :-1], parts[:, 1:])
                names, place = at, np.arange(high)
                while len(names):
                    row, least = np.arange(len(names)), ranks.argmin(axis=1)
                    rank = ranks[row, least]
                    going = rank < NEVER
                    if not going.all():
                        held = parts[~going] != NO_PART
                        tokens, stops = parts[~going][held].tolist(), np.cumsum(held.sum(axis=1)).tolist()
                        for k, a, b in zip(names[~going].tolist(), [0, *stops], stops, strict=False):
                            out[k] = tokens[a:b]
                        names, parts, ranks, least, rank = names[going], parts[going], ranks[going], least[going], rank[going]
                        row = np.arange(len(names))
                        if not len(names):
                            break
                    parts[row, least] = self.merged[rank]
                    # The boundary goes: what stands behind it moves up.
                    parts[:, :-1] = np.where(place > least[:, None], parts[:, 1:], parts[:, :-1])
                    parts[:, -1] = NO_PART
                    ranks[:, :-1] = np.where(place[:-1] >= least[:, None], ranks[:, 1:], ranks[:, :-1])
                    ranks[:, -1] = NEVER
                    ranks[row, least] = self.pair_ranks(parts[row, least], parts[row, np.minimum(least + 1, high)])
                    inner = least > 0
                    ranks[row[inner], least[inner] - 1] = self.pair_ranks(parts[row[inner], least[inner] - 1], parts[row[inner], least[inner]])
        for k in np.flatnonzero(sizes > SHORT):
            out[k] = self.long_word(words[k])
        return out

    def long_word(self, word: bytes) -> list[int]:
        """The same for a word of any length: the boundaries wait in a heap, by rank and place."""
        parts, n = self.single[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := self.rank.get(parts[k] << 20 | parts[k + 1], NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue  # one of the two has changed since
            parts[k], parts[j], after[k] = int(self.merged[r]), -1, after[j]
            if after[k] < n:
                before[after[k]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j < n and (r := self.rank.get(parts[i] << 20 | parts[j], NEVER)) < NEVER:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))
        return [p for p in parts if p >= 0]

    def learn(self, stretches: list[str]) -> None:
        """Remember the ids of each stretch, and the bytes that they stand for where these are not its own."""
        plain, other = [], []
        for s in stretches:
            (plain if s[0] == " " and len(s) > 1 and not s[1].isspace() and not s[-1].isspace() else other).append(s)
        # Words of plain stretches end where these end, so that they can be split as one text.
        found = [self.split("".join(plain)), *map(self.split, other)]
        ends = np.cumsum([len(s) for s in plain])
        stops = np.searchsorted(np.cumsum([len(w) for w in found[0]]), ends, "left") + 1 if plain else np.zeros(0, np.int64)
        stops = [*stops.tolist(), *(len(found[0]) + np.cumsum([len(f) for f in found[1:]], dtype=np.int64)).tolist()]
        words = [w for f in found for w in f]
        long = self.learn_words(words)
        ids, start = list(map(self.word_ids.__getitem__, words)), 0
        for w in long:
            del self.word_ids[w]
        for s, stop in zip([*plain, *other], stops, strict=True):
            if stop - start == 1:
                self.ids[s] = ids[start]
            else:  # a word holds whole characters, so each can be decoded by itself
                self.ids[s] = ",".join(ids[start:stop])
            if self.odd and not self.odd.keys().isdisjoint(words[start:stop]):
                self.odd[s] = b"".join([self.odd[w] if w in self.odd else w.encode() for w in words[start:stop]])
            start = stop

    def learn_words(self, words: list[str]) -> list[str]:
        """Remember the ids of each word. Returns the words that are too long to be kept."""
        asked = set(words)
        new = asked.difference(self.word_ids)
        if len(self.word_ids) + len(new) > self.remember:
            self.word_ids, new = {}, asked
        unlike, name = list(new), self.name.__getitem__
        for w, ids in zip(unlike, self.merge_words([w.encode("utf-8", "replace") for w in unlike]), strict=True):
            self.word_ids[w] = ",".join(map(name, ids))
            if (raw := self.decode_bytes(ids)) != w.encode("utf-8", "surrogatepass"):
                self.odd[w] = raw
        return [w for w in unlike if len(w) > 64]

    def split(self, text: str) -> list[str]:
        return (self.words if text.isascii() or self.rare.isdisjoint(text) else self.words_rare).findall(text)

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The text cut before single spaces. No word crosses a space that has no white space on either side, and what is matched
        from there on depends on nothing before it."""
        if "\0" not in text and not any(x in text for x in BESIDE_SPACE) and not (ODD_SPACE.search(text) if not text.isascii() else ODD_CONTROL.search(text)):
            return [s for s in text.replace(" ", "\0 ").split("\0") if s]
        first, *rest = text.split(" ")
        out = [first] if first or not rest else []
        closed = bool(first) and not first[-1].isspace()  # the last stretch ends in a character, so that a new one may begin
        for w in rest:
            if out and not (closed and w and not w[0].isspace()):
                out[-1] += " " + w
            else:
                out.append(" " + w)
            closed = bool(w) and not w[-1].isspace()
        return [s for s in out if s]

    def coded(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Per text its ids, joined by commas, and their bytes; the texts of added tokens are these tokens."""
        cut = [[s for piece in self.specials.split(t) if piece for s in ([piece] if piece in self.special else self.stretches(piece))] if self.specials and self.specials.search(t) else self.stretches(t) for t in texts]
        asked = set().union(*cut)
        new = asked.difference(self.ids)
        if len(self.ids) + len(new) > self.remember:
            self.ids, self.word_ids, self.odd, new = {}, {}, {}, asked
        self.learn([s for s in new if s not in self.special])
        for s in new.intersection(self.special):
            self.ids[s] = str(self.special[s])
        out = [(",".join(map(self.ids.__getitem__, t)), b"".join([self.odd.get(s, s.encode("utf-8", "surrogatepass")) for s in t]) if self.odd else text.encode()) for text, t in zip(texts, cut, strict=True)]
        for s in [s for s in new if len(s) > 64]:
            del self.ids[s]
        return out

    def encoded(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """The same as lists, empty for a text without tokens."""
        return [[x] if x[0] else [] for x in self.coded(texts)]

    def encode(self, text: str) -> list[int]:
        ids = self.coded([text])[0][0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Bytes of the tokens; what is no UTF-8 becomes the replacement character."""
        raw = b"".join([self.bytes[i] for i in ids])
        return raw if raw.isascii() else raw.decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, unknown: str = "") -> Encoder:
    if (path, unknown) not in _ENCODERS:
        _ENCODERS[path, unknown] = Encoder(path, unknown)
    return _ENCODERS[path, unknown]


def encode_texts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, and its ids (array<int>) if keep_ids.

    Null texts are empty and have no tokens. Rows are independent: repeated rows have a row each, a null id stays null, an empty table
    gives an empty result, other columns are ignored; a text of any length is encoded whole, stretch by stretch. `vocabulary` is a
    path that every executor can read.
    """
    kind = dict(docs.dtypes)[doc_id]
    fields = f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    unknown = unknown_letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, unknown)
        for batch in batches:
            counts, shas, plain, kept = [], [], [], []
            for ids, raw in enc.coded([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(ids.count(",") + 1 if ids else 0)
                shas.append(hashlib.sha256(ids.encode()).hexdigest())
                plain.append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    kept.append(np.fromiter(map(int, ids.split(",") if ids else []), np.int32, counts[-1]))
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(plain, pa.string())]
            names = [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
                cols, names = [*cols, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept) if kept else [], pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    bounded_batches(docs.sparkSession)
    return docs.select(doc_id, text).mapInArrow(run, fields)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), default_vocabulary())
