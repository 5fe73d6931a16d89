"""SentencePiece BPE encoding by backtracking, and decoding.

Merging pieces greedily by score has one result per text, and a token sequence is that result exactly if every adjacent pair of
tokens is what merging their joined text would give. So the encoder takes the longest piece that starts at a position (found by
an Aho-Corasick automaton over the vocabulary), checks it against the token before by re-merging the pair, goes on to the
next-longest prefix piece if they don't fit, and steps back when none is left. A bitfield marks the positions from which no
valid rest exists, so that none is tried twice.

The vocabulary is read from the model file; nothing of the encoding itself is left to the library that made the file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table

SPACE = "▁"


def read_pieces(path: str) -> tuple[list[str], list[float], dict[int, int], int]:
    """Pieces and scores by id, {byte: id}, and the id of the end piece. Checks that the model is of the supported kind."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    pieces = [sp.id_to_piece(i) for i in ids]
    special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
    by_byte = {int(pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
    if any(sp.is_unused(i) for i in ids) or len(by_byte) != 256:
        raise ValueError("a model with byte pieces and without unused ones is needed")
    if sp.normalize(" ﬁ  x") != f"{SPACE}{SPACE}ﬁ{SPACE}{SPACE}x":
        raise ValueError("a model that leaves the text as it is, but for spaces, is needed")
    if any(SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if i not in special):
        raise ValueError("a model without spaces inside pieces is needed")
    return [p if i not in special else "" for i, p in enumerate(pieces)], [sp.get_score(i) for i in ids], by_byte, sp.eos_id()


class Encoder:
    """Encodes and decodes whole texts; remembers the tokens of up to `remember` words, then starts anew."""

    def __init__(self, path: str, remember: int = 300_000, remember_pairs: int = 500_000):
        import ahocorasick

        self.pieces, self.scores, self.by_byte, self.end = read_pieces(path)
        self.id = {p: i for i, p in enumerate(self.pieces) if p}
        self.byte_of = {i: b for b, i in self.by_byte.items()}
        self.known = {p: i for p, i in self.id.items() if len(p) == 1}
        self.sizes = list(map(len, self.pieces))
        self.fits_memo: dict[int, bool] = {}
        self.words: dict[str, tuple[str, str]] = {}
        self.remember, self.remember_pairs = remember, remember_pairs
        # Only pieces that merging their own text gives can stand in a result.
        self.whole = {p: i for p, i in self.id.items() if len(p) == 1 or self.merge(p) == [i]}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.whole.items():
            if len(p) > 1:
                self.automaton.add_word(p, (len(p) - 1, i))
        self.automaton.make_automaton()
        #: The next-longest piece that a piece begins with, -1 for none.
        self.shorter = {i: next((self.whole[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), -1) for p, i in self.whole.items()}

    def merge(self, text: str) -> list[int]:
        """Greedy merging of a short text: the pair of the highest score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return [self.id.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b gives a and b again."""
        if len(self.fits_memo) >= self.remember_pairs:
            self.fits_memo.clear()
        known = self.fits_memo[a << 20 | b] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return known

    def backtrack(self, text: str) -> list[int]:
        """Tokens of a text whose characters are all pieces."""
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]
        longest = [self.known[c] for c in text]
        for last, (back, i) in self.automaton.iter(text):  # of those with one start, the longest ends last
            longest[last - back] = i
        n, sizes, memo, shorter = len(text), self.sizes, self.fits_memo, self.shorter
        longest.append(-1)
        failed = bytearray(n + 1)  # 1: no valid rest begins here
        out: list[int] = []
        at, i = 0, longest[0]
        while at < n:
            stop = at + sizes[i]
            if not failed[stop] and (not out or (fit := memo.get(out[-1] << 20 | i)) or (fit is None and self.fits(out[-1], i))):
                out.append(i)
                at, i = stop, longest[stop]
                continue
            i = shorter[i]
            while i < 0:
                failed[at] = 1
                if not out:
                    raise ValueError("no valid tokens")
                last = out.pop()
                at -= sizes[last]
                i = shorter[last]
        return out

    def ids(self, word: str) -> list[int]:
        """Tokens of any text without a break; characters that aren't pieces become their bytes and part what is beside them."""
        ids: list[int] = []
        run = 0
        for k, c in enumerate(word):
            if c not in self.known:
                if run < k:
                    ids += self.backtrack(word[run:k])
                ids += [self.by_byte[b] for b in c.encode("utf-8", "replace")]
                run = k + 1
        if run < len(word):
            ids += self.backtrack(word[run:])
        return ids

    def word(self, word: str) -> tuple[str, str]:
        """The ids, joined by spaces, and the pieces, joined and with plain spaces, of a word as split() gives it."""
        got = self.words.get(word)
        if got is None:
            whole = word if word[:1] == SPACE else SPACE + word
            ids = self.ids(whole)
            got = (" ".join(map(str, ids)), self.joined(ids).replace(SPACE, " "))
            if len(word) <= 64:
                if len(self.words) >= self.remember:
                    self.words.clear()
                self.words[word] = got
        return got

    def split(self, text: str) -> list[str]:
        """Words with the spaces before them; a single one is left out. No piece holds a space after another character, so
        tokens never cross the start of a run of spaces."""
        if not text:
            return []
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return words
        out, spaces = [], 0
        for w in words:
            spaces += 1
            if w:
                out.append(w if spaces == 1 else SPACE * spaces + w)
                spaces = 0
        if spaces:
            out.append(SPACE * spaces)
        return out

    def encode(self, text: str) -> list[int]:
        return [*(int(i) for w in self.split(text) for i in self.word(w)[0].split()), self.end]

    def joined(self, ids: list[int]) -> str:
        """Pieces joined, runs of byte pieces read as UTF-8."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    @staticmethod
    def plain(joined: str) -> str:
        """Spaces put back, and the one before the text taken away."""
        text = joined.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        return self.plain(self.joined(ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, and its ids (array<int>) if keep_ids.

    Null texts are empty: they have the end id only. Rows are independent, so repeated rows, an empty table and other columns
    (ignored) need no care; a text of any length is encoded whole, word by word. model is a path that every executor can read.
    """
    kind = dict(docs.dtypes)[doc_id]
    fields = f"{doc_id} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        end, known = str(enc.end), enc.words
        for batch in batches:
            counts, shas, plain, kept = [], [], [], []
            for t in batch.column(1).to_pylist():
                words = [known.get(w) or enc.word(w) for w in enc.split(t or "")]
                ids = " ".join([*[w[0] for w in words], end])
                counts.append(ids.count(" ") + 1)
                shas.append(hashlib.sha256(ids.encode()).hexdigest())
                # A word begins with a space piece, so no run of byte pieces goes from one word into the next.
                plain.append(hashlib.sha256(enc.plain("".join([w[1] for w in words])).encode()).hexdigest())
                if keep_ids:
                    kept.append(np.fromiter(map(int, ids.split()), np.int32, counts[-1]))  # an object per id would take nine times as much
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(plain, pa.string())]
            names = [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
                cols, names = [*cols, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept) if kept else [], pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    bounded_batches(docs.sparkSession)
    return docs.select(doc_id, text).mapInArrow(run, fields)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), default_model())
