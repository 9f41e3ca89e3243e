"""BPE encoding and decoding by a traversal of a trie of the distinct words.

The encoding of a word by merges is fixed by the last token of each of its prefixes: a token
t ends the encoding of a prefix p if t is a suffix of p and follows the last token of the
rest of p without the two of them being merged differently when they stand side by side.
So the distinct words of a batch are put into a trie, and one depth-first walk hands each
node the last token of every prefix above it; a prefix that many words share is encoded
once. The trie is laid out as the sorted words: each one hangs below what it shares with the
one before it, and the walk keeps the states of the path it stands on. The words' ids are
then read back along the last tokens. Texts are looked up word by word in what the walk
found, which each task keeps up to a bound of bytes.
"""

from __future__ import annotations

import gc
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.llm.common import SLICE_BYTES, kept, slices

#: Bytes that a task keeps of pieces and their ids, in each of two generations; an entry's own cost is counted in.
CACHE_BYTES, ENTRY_BYTES = 112_000_000, 220
#: Longer pieces are encoded each time.
LONGEST_KEPT = 64
#: Texts' bytes that are cut into pieces at a time.
SLICE = 3 * SLICE_BYTES


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Follows(dict):
    """(left << 32 | right) to whether the two tokens stay side by side; kept up to a bound."""

    def __init__(self, encoder: TrieEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, pair: int) -> bool:
        found = self[pair] = self.encoder._follows(pair >> 32, pair & 0xFFFFFFFF)
        return found

    def trim(self) -> None:
        if len(self) > 1 << 18:
            self.clear()


class TrieEncoder:
    """Words (strings without white space) to token ids, as the vocabulary file defines it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Of a pair of tokens, as left << 32 | right: its place among the merges.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[left << 32 | right] = r
            if made not in self.parts:
                self.parts[made] = (left, right)
                self.born[made] = r
        # words are looked for in pieces without white space, so \s needs no mention there
        self.word_parts = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", ""))
        pattern = tokenizers.Regex(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_words = tokenizers.pre_tokenizers.Split(pattern, "removed", invert=True)
        self.normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        #: Symbols are bytes, and from 256 on bytes at the end of a word; the token of each alone.
        symbols = byte_symbols()
        code = {s: i for i, s in enumerate(symbols)}
        ending = {s + self.suffix: i + 256 for s, i in code.items()} if self.suffix else {s: i for s, i in code.items()}
        self.single = [vocab.get(s, -1) for s in symbols] + [vocab.get(s + self.suffix, -1) for s in symbols]

        def units(token: str) -> list[int] | None:
            """Symbols of a token; the last one carries the end-of-word mark. None: not from bytes."""
            try:
                if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
                    body = token[: -len(self.suffix)]
                    return [*(code[c] for c in body[:-1]), ending[body[-1] + self.suffix]]
                return [code[c] for c in token]
            except KeyError:
                return None

        whole: dict[int, bool] = {}
        for i in sorted(vocab.values(), key=lambda i: self.born.get(i, -1)):
            left, right = self.parts.get(i, (-1, -1))
            whole[i] = left < 0 or (whole[left] and whole[right] and self._follows(left, right, self.born[i]))
        #: Tokens by their symbols, last symbol first: (node << 9 | symbol) to node, and node to token.
        self.ends: dict[int, int] = {}
        self.end_token: dict[int, int] = {}
        #: (token << 9 | symbol) to the token that is one symbol longer.
        self.longer: dict[int, int] = {}
        for t, i in vocab.items():
            own = units(t)
            if own is None or not whole[i] or (i not in self.parts and len(own) > 1):
                continue  # merges never make it
            at = 0
            for u in reversed(own):
                at = self.ends.setdefault(at << 9 | u, len(self.ends) + 1)
            self.end_token[at] = i
            if i in self.parts and own[:-1]:
                before = vocab.get("".join(symbols[u] for u in own[:-1]))
                if before is not None:
                    self.longer[before << 9 | own[-1]] = i
        self.follows = Follows(self)

    def _follows(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether `left right` stays so when both are encoded side by side.

        The two are taken apart, latest merge first; a merge across the boundary that comes
        before the merge that made the neighbour would have broken it.
        """
        rank, born, parts = self.rank, self.born, self.parts
        while True:
            r = rank.get(left << 32 | right)
            if r is not None and r < limit:
                return False
            a, b = born.get(left, -1), born.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left one was made last: before, its right part stood at the boundary
                limit, left = a, parts[left][1]
            else:  # the same merge further left comes first
                limit, right = b + 1, parts[right][0]

    def words(self, words: Iterable[str]) -> list[tuple[bytes, list[int]]]:
        """The UTF-8 of non-empty words with their ids."""
        found: dict[str, bytes] = {}
        self.encode(words, found)
        return [(w.encode(), [i for (i,) in UNPACK(ids)]) for w, ids in found.items()]

    def encode(self, words: Iterable[str], into: dict[str, bytes]) -> None:
        """Puts the ids of non-empty words into a dictionary, by one depth-first walk over their trie."""
        longer, single, follows, state_of = self.longer.get, self.single, self.follows, self._state
        pack, most = PACK, len(PACK)
        follows.trim()
        # a state: last token, the state without it, the state without the last symbol, that symbol
        start = (-1, None, None, -1)
        path, before = [start], b""
        for word in sorted(words):  # in the order of their UTF-8, too
            code = word.encode()
            n = len(code) - 1
            # the path down to where this word leaves the last one; the last symbol is one of its own
            k = 0
            for x, y in zip(before, code):
                if x != y:
                    break
                k += 1
            k = min(k, n, len(path) - 1)
            del path[k + 1 :]
            up = path[k]
            for u in code[k:n]:
                t, rest = up[0], up[1]
                grown = longer(t << 9 | u)
                if grown is not None and (rest is start or follows[rest[0] << 32 | grown]):
                    up = (grown, rest, up, u)
                elif up is start or follows[t << 32 | single[u]]:
                    up = (single[u], up, up, u)
                else:
                    up = state_of(up, u, start)
                path.append(up)
            before = code
            # symbols inside other words carry no end mark: the last state isn't on the path
            u = code[n] | 256
            t, rest = up[0], up[1]
            grown = longer(t << 9 | u)
            if grown is not None and (rest is start or follows[rest[0] << 32 | grown]):
                ids = [grown]
            elif up is start or follows[t << 32 | single[u]]:
                ids, rest = [single[u]], up
            else:
                t, rest, *_ = state_of(up, u, start)
                ids = [t]
            while rest is not start:
                ids.append(rest[0])
                rest = rest[1]
            ids.reverse()
            into[word] = pack[len(ids)](*ids) if len(ids) < most else struct.pack(f"<{len(ids)}I", *ids)

    def _state(self, up: tuple, u: int, start: tuple) -> tuple:
        """The state after symbol u where neither the last token grows nor u stands alone."""
        ends, before = self.ends, up
        at = ends[u]
        while True:
            at, before = ends[at << 9 | before[3]], before[2]
            t = self.end_token.get(at)
            if t is not None and (before is start or self.follows[before[0] << 32 | t]):
                return (t, before, up, u)

    def pieces(self, text: str) -> list[str]:
        """The text cut at white space, otherwise unchanged; special tokens stand alone."""
        if "<|" in text:
            parts = self.split_special.split(text)
            return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._cut(part))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        # split() takes these four for white space, Unicode's property doesn't
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return NOT_SPACE.findall(text)
        return text.split()

    def parts_of(self, piece: str) -> list[str]:
        """The words of a piece, normalised as the vocabulary file says.

        Beyond Latin letters, versions of Unicode differ in what is a letter: there the library
        that defines the result says what the words are.
        """
        if piece.isascii():
            if (head := piece[:-1]).isalpha() and not piece[-1].isalnum():
                return [head.lower(), piece[-1]]
        else:
            if max(piece) > "\u024f":
                return [w for w, _ in self.split_words.pre_tokenize_str(self.normalizer.normalize_str(piece))]
            piece = unicodedata.normalize("NFC", piece)
        piece = piece.lower()
        return [piece] if piece.isalpha() else self.word_parts.findall(piece)


NOT_SPACE = regex.compile("[^\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Cache:
    """Pieces of text to their ids as bytes, and to their ids' names joined by a space.

    Holds two generations, each of CACHE_BYTES and one slice's new pieces at most: when the newer
    one is full, only what is used again lives on. Pieces beyond LONGEST_KEPT live for one slice, and
    so do words with one other character behind them, if only ids are asked for: both parts are kept.
    """

    def __init__(self, encoder: TrieEncoder):
        self.encoder = encoder
        self.ids: dict[str, bytes] = {}
        self.names: dict[str, str] = {}
        self.old: tuple[dict, dict] = {}, {}
        self.bytes = 0
        self.passing: list[str] = []

    def learn(self, texts: list[list[str]], named: bool = False) -> None:
        """Encodes the distinct new pieces of these texts together."""
        gc.disable()  # states and ids have no cycles, and there are many of them to visit
        try:
            self._learn(texts, named)
        finally:
            gc.enable()

    def _learn(self, texts: list[list[str]], named: bool) -> None:
        for p in self.passing:
            self.ids.pop(p, None)
            self.names.pop(p, None)
        self.passing = []
        if self.bytes > CACHE_BYTES:
            self.old, self.ids, self.names, self.bytes = (self.ids, self.names), {}, {}, 0
        have = self.names if named else self.ids
        new = set().union(*texts).difference(have)
        if self.old[named]:
            again = new & self.old[named].keys()
            for p in again:
                self.ids[p] = self.old[0][p]
                if named:
                    self.names[p] = self.old[1][p]
            new -= again
            self.bytes += ENTRY_BYTES * (1 + named) * len(again)
        # a word is a piece of its own, with the same ids
        ids, old, special, parts_of = self.ids, self.old[0], self.encoder.special, self.encoder.parts_of
        words, heads, parts = set(), [], {}
        for p in new:
            if p.isascii():
                if p.isalpha():
                    if p.islower():
                        words.add(p)
                        continue
                elif (head := p[:-1]).isalpha() and not p[-1].isdigit():
                    heads.append((p, head.lower(), p[-1]))
                    continue
            if p in special:
                ids[p] = struct.pack("<I", special[p])
            else:
                parts[p] = parts_of(p)
        words.update([w for _, w, _ in heads], [w for _, _, w in heads], *parts.values())
        words.difference_update(ids)
        if old:
            again = words & old.keys()
            for w in again:
                ids[w] = old[w]
            words -= again
            self.bytes += ENTRY_BYTES * len(again)
        self.encoder.encode(words, ids)
        for p, head, end in heads:
            ids[p] = ids[head] + ids[end]
        for p, ws in parts.items():
            ids[p] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])
        if named:
            names = self.encoder.names
            for p in new:
                self.names[p] = " ".join([names[i] for (i,) in UNPACK(ids[p])])
        self.bytes += ENTRY_BYTES * (len(words) + named * len(heads) + len(parts) + named * len(new))
        self.passing = [p for p in {*words, *new} if len(p) > LONGEST_KEPT]
        if not named:
            self.passing += [p for p, *_ in heads]


UNPACK = struct.Struct("<I").iter_unpack
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def cache_for(path: str) -> Cache:
    """One per worker process and vocabulary file."""
    return kept(path, lambda: Cache(TrieEncoder(path)))


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, named: bool = False) -> Iterator[tuple[pa.RecordBatch, Cache, list[list[str]]]]:
    """Slices of the batches, the cache that knows all their pieces, and each text's pieces."""
    cache = cache_for(path)
    for batch, texts in slices(batches, limit=SLICE, keep=path):
        cut = [cache.encoder.pieces(t.decode()) for t in texts]
        cache.learn(cut, named)
        yield batch, cache, cut


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each row: ids as little-endian unsigned 32-bit integers, and their decoding.

    A null text counts as empty; an empty text has no ids and decodes to ''. Repeated rows and
    null ids stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cache, texts in pieces_of(batches, path, named=True):
            ids, names = cache.ids.__getitem__, cache.names.__getitem__
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([b"".join(map(ids, t)) for t in texts], pa.binary()),
                    pa.array([" ".join(filter(None, map(names, t))) for t in texts], pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for ids in the form that encode() returns; null ids decode to ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = cache_for(path).encoder.names
        for batch in batches:
            texts = [" ".join([names[i] for (i,) in struct.iter_unpack("<I", ids or b"")]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(encoded[id_col].cast("long").alias("_id"), encoded[ids_col].alias("_ids")).mapInArrow(run, "doc_id long, decoded string")


def lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens); a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cache, texts in pieces_of(batches, path):
            counts = [len(b"".join(map(cache.ids.__getitem__, t))) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def token_pieces(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and then end_id, cut into pieces of `limit`."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cache, texts in pieces_of(batches, path):
            rows: list[tuple] = []
            for doc, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = b"".join(map(cache.ids.__getitem__, t)) + end
                for n, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
