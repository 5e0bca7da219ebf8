"""BPE encoding and decoding with a given vocabulary, over a pair occurrence index.

A block's distinct words that have not been seen yet are laid out as one array of symbols. An index maps the rank of each
adjacent pair to all its positions in the block; the ranks wait in a heap. The lowest active rank is taken, its pair
is merged at all its positions from left to right, and the pairs that this makes or ends are put into the lists of their own
ranks. Where a merge makes a pair of a lower rank, the rest of the list waits until that rank is done, so every word
sees its merges in the order that it would see alone.

The text goes through what the vocabulary's file states: the strings of special tokens are cut out of the raw text, the
rest is composed (NFC), lower-cased, and split into contractions, runs of letters, single digits and runs of
other characters; white space only separates. A word's bytes are the first symbols, its last one carries the mark of a
word's end. Decoding joins the tokens' strings by spaces, as the file names no decoder.

Defined results: null and empty texts have no ids and decode to an empty text; equal rows get equal results; ids and other
columns are passed through by position, so clashing names are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blocks, col

BLOCK_BYTES = 1 << 20
#: From this code point on, versions of Unicode differ in what is a letter, so the library's own normaliser and splitter
#: cut texts that go so far into words; the merges are made here all the same.
UNSURE = "\u0370"
#: Words that a worker remembers between blocks; beyond, it forgets those that were not met since it last held so many.
REMEMBERED = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it is printable Latin-1, else the next free code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """The file's merges and tokens, and the words encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.library = Tokenizer.from_file(path)
        self.inner, self.last = [ids[c] for c in symbols], [ids[c + end] for c in symbols]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[a] << 20 | ids[b], (rank, ids[a + b]))
        names = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for name, i in [*ids.items(), *self.special.items()]:
            names[i] = name
        self.names = pa.array(names)
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            if max(text) >= UNSURE:
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in split]
            text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.lower())

    def pieces(self, text: str) -> list[str]:
        """Words, and special tokens as they stand (upper case or not, a word never holds a whole one)."""
        if self.cut is None or "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += ["\0" + part] if k % 2 else self.words(part)
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words and remembers them."""
        sym: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        heads: list[int] = []
        for w in words:
            heads.append(len(sym))
            raw = w.encode()
            first, n = len(sym), len(raw)
            sym += [self.inner[b] for b in raw[:-1]]
            sym.append(self.last[raw[-1]])
            nxt += range(first + 1, first + n)
            nxt.append(-1)
            prv.append(-1)
            prv += range(first, first + n - 1)
        merges, index = self.merges, {}
        for k, j in enumerate(nxt):
            if j >= 0 and (m := merges.get(sym[k] << 20 | sym[j])):
                index.setdefault(m[0], []).append(k)
        by_rank = self.by_rank()
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            a, b, new = by_rank[rank]
            for done, k in enumerate(places):
                j = nxt[k]
                if sym[k] != a or j < 0 or sym[j] != b:
                    continue
                sym[k], sym[j] = new, -1
                after, before = nxt[j], prv[k]
                nxt[k] = after
                lower = False
                if after >= 0:
                    prv[after] = k
                    if m := merges.get(new << 20 | sym[after]):
                        if m[0] not in index:
                            index[m[0]] = []
                            heapq.heappush(active, m[0])
                        index[m[0]].append(k)
                        lower = m[0] < rank
                if before >= 0 and (m := merges.get(sym[before] << 20 | new)):
                    if m[0] not in index:
                        index[m[0]] = []
                        heapq.heappush(active, m[0])
                    index[m[0]].append(before)
                    lower |= m[0] < rank
                if lower and done + 1 < len(places):
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(active, rank)
                    index[rank] += places[done + 1 :]
                    break
        flat = np.array(sym, np.int32)
        ends = [*heads[1:], len(sym)]
        alive = flat >= 0
        at = np.concatenate([[0], np.cumsum(alive)])
        packed = flat[alive].tobytes()
        for w, s, e in zip(words, at[heads].tolist(), at[ends].tolist(), strict=True):
            self.known[w] = packed[4 * s : 4 * e]

    def by_rank(self) -> dict[int, tuple[int, int, int]]:
        if not hasattr(self, "_by_rank"):
            self._by_rank = {rank: (key >> 20, key & 0xFFFFF, new) for key, (rank, new) in self.merges.items()}
        return self._by_rank

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        pieces = [self.pieces(t) if t else () for t in texts]
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {}
            new = set().union(*pieces)
        if self.older:
            met = new.intersection(self.older)
            self.known.update((w, self.older[w]) for w in met)
            new -= met
        words = []
        for w in new:
            if w[0] == "\0" and w[1:] in self.special:
                self.known[w] = np.int32(self.special[w[1:]]).tobytes()
            else:
                words.append(w)
        if words:
            self.learn(words)
        each = [b"".join(map(self.known.__getitem__, p)) for p in pieces]
        ends = np.cumsum([0, *(len(x) // 4 for x in each)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(each), np.int32)))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        names = pc.take(self.names, ids.values)
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, names), " ")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    path = path or default_path()
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _carried(df: DataFrame, names: list[str], also: str) -> tuple[list[str], str]:
    own = [f"_{k}" for k in range(len(names))]
    return own, ", ".join([*(f"{o} {df.schema[n].dataType.simpleString()}" for o, n in zip(own, names, strict=True)), also])


def encode(docs: DataFrame, carry: list[str], text: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """The columns in ``carry``, ids (array of int) and, if asked for, decoded: what ``decode`` makes of the ids."""
    own, schema = _carried(docs, carry, "ids array<int>" + ", decoded string" * decoded)
    rows = docs.select(*(col(c).alias(o) for c, o in zip(carry, own, strict=True)), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in blocks(batches, "_text", BLOCK_BYTES):
            ids = v.encode(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(o) for o in own), ids, *([v.decode(ids)] if decoded else [])], names=[*own, "ids", *(["decoded"] if decoded else [])])

    out = rows.mapInArrow(run, schema)
    return out.toDF(*carry, "ids", *(["decoded"] if decoded else []))


def decode(rows: DataFrame, carry: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """The columns in ``carry`` and decoded: the tokens' strings joined by spaces; null ids are no ids."""
    own, schema = _carried(rows, carry, "decoded string")
    some = rows.select(*(col(c).alias(o) for c, o in zip(carry, own, strict=True)), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column("_ids")
                flat = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), lists.flatten())
                yield pa.RecordBatch.from_arrays([*(part.column(o) for o in own), v.decode(flat)], names=[*own, "decoded"])

    return some.mapInArrow(run, schema).toDF(*carry, "decoded")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = encode(docs, ["doc_id"], path=path, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
