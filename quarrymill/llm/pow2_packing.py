"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two: as many of the
sequence length as fit, then the binary digits of the rest, longest first. Pieces of one
length form one bucket and each piece is a sequence of its own, so that no sequence crosses
documents and none needs padding.

Defined cases: a null text counts as empty and becomes its end id alone, one piece of length
1; a repeated row is packed again under its own sequence ids; a null doc_id stays null;
very long texts are tokenized part by part, cut at white space, which changes no id; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept_by_worker, slices

SEQUENCE = 2048
END_ID = 1
#: Pre-tokens, and words that are no plain ones, whose ids a worker remembers in a generation; where packing runs alone; longest kept, in bytes.
CACHE, CACHE_ALONE, CACHED_BYTES = 120_000, 300_000, 48
#: New pre-tokens that the library's BPE is given at once.
AT_ONCE = 100
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
_PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: The pre-token pattern of the tokenizer's file, for plain characters in lower case (fixed value).
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Bounded(dict):
    """Ids of strings, in two generations of at most `most` entries each; what is asked for again outlives a change."""

    def __init__(self, most: int = CACHE):
        super().__init__()
        self.most, self.old = most, {}

    def of(self, keys: pa.Array, make) -> pa.Array:
        """The ids of different keys; `make` gets those that are new, all at once."""
        keys = keys.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, keys))
        unknown = [i for i, ids in enumerate(found) if ids is None]
        for i in unknown if self.old else ():
            found[i] = self.old.get(keys[i])
        new = [i for i in unknown if found[i] is None]
        for i, ids in zip(new, make([keys[i] for i in new]), strict=True):
            found[i] = ids
        for i in unknown:
            if len(keys[i]) <= CACHED_BYTES:
                if len(self) >= self.most:
                    self.old = dict(self)
                    self.clear()
                self[keys[i]] = found[i]
        return pa.array(found, pa.binary())


class WordIds:
    """Ids of texts, as little-endian 32-bit integers, from a `tokenizers` file.

    The tokenizer drops white space and never joins what it parts, so that a text's ids are those
    of its words in turn. Of the words of many texts each different one is looked at once; those of
    plain characters are parted into pre-tokens here, of which again each different one is looked
    up once and new ones go through the library's own BPE; other words go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = Tokenizer(self.tokenizer.model)
        self.bpe.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = byte_alphabet()
        self.parts, self.others = _Bounded(most), _Bounded(most)
        # The short way holds for files of this kind only: lower-cased, with that pattern.
        probe = "It's THE (Ünïté) of 42.5 a_b!?".split()
        self.plain = self._short(pa.array(probe)).to_pylist() == self._whole([w.encode() for w in probe])

    def _whole(self, words: list[bytes]) -> list[bytes]:
        return [np.array(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words]

    def _merged(self, tokens: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(tokens), AT_ONCE):
            some = [t if t.isascii() else "".join(map(self.alphabet.__getitem__, t.encode())) for t in tokens[at : at + AT_ONCE]]
            merged = self.bpe.encode(" ".join(some), add_special_tokens=False)
            ids, ends = np.array(merged.ids, dtype="<u4").tobytes(), 4 * np.searchsorted(np.array(merged.word_ids, dtype=np.int64), np.arange(len(some) + 1))
            out += [ids[i:j] for i, j in itertools.pairwise(ends.tolist())]
        return out

    def _short(self, words: pa.Array) -> pa.Array:
        """Ids of plain words."""
        tokens = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(pc.utf8_lower(words), _SPLIT, r"\0 ")))
        coded = tokens.values.dictionary_encode()
        return _regrouped(self.parts.of(coded.dictionary, self._merged).take(coded.indices), tokens.offsets.to_numpy())

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of different words."""
        if not self.plain:
            return self.others.of(words.cast(pa.binary()), self._whole)
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        other = pc.invert(plain)
        ids = pa.concat_arrays([self._short(words.filter(plain)), self.others.of(words.filter(other).cast(pa.binary()), self._whole)])
        return ids.take(pa.array(np.argsort(np.argsort(other.to_numpy(zero_copy_only=False), kind="stable"))))  # back to the order of `words`

    def texts(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, with those of `end` behind them."""
        words = pc.ascii_split_whitespace(texts)
        coded, ends = words.values.dictionary_encode(), words.offsets.to_numpy()
        ids = pa.concat_arrays([self._words(coded.dictionary), pa.array([end], pa.binary())])
        order = np.insert(coded.indices.to_numpy(), ends[1:], len(ids) - 1)
        return _regrouped(ids.take(pa.array(order)), ends + np.arange(len(ends), dtype=ends.dtype))

    def text(self, text: str) -> bytes:
        """The ids of one text, however long."""
        return b"".join(self.texts(pa.array([part.encode("utf-8", "replace")]).cast(pa.string()))[0].as_py() for part in cut(text))


def _regrouped(ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """Consecutive entries joined, those from ends[i] to ends[i + 1] into entry i."""
    _, offsets, data = ids.buffers()
    ends = np.frombuffer(offsets, dtype="<i4")[: len(ids) + 1][ends]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), data])


def piece_lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Binary lengths, longest first, that sum to n; none above `sequence`, itself a power of two."""
    rest = n % sequence
    return [sequence] * (n // sequence) + [1 << k for k in range(sequence.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, cache: int = CACHE) -> DataFrame:
    """One row per piece: doc_id, start, length (its bucket), ids (binary, 32-bit little-endian), doc_tokens, sequence_id, offset.

    A narrow pass: nothing is shuffled. Sequence ids are unique in one result.
    """
    if sequence & (sequence - 1) or sequence < 2:
        raise ValueError("the sequence length must be a power of two")

    def run(batches):
        ids_of, end = kept_by_worker(f"ids:{cache}:{tokenizer_path}", lambda: WordIds(tokenizer_path, cache)), np.array([end_id], dtype="<u4").tobytes()

        def pieces():
            for b in slices(batches, "text"):
                texts = b.column("text").cast(pa.string()).fill_null("")
                if len(texts) == 1:  # it may be longer than a slice
                    ids = pa.array([ids_of.text(texts.cast(pa.binary())[0].as_py().decode("utf-8", "replace")) + end], pa.binary())
                else:
                    ids = ids_of.texts(texts, end)
                yield _pieces(b.column("doc_id"), ids, sequence)

        yield from slices(pieces(), "ids")

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def _pieces(doc_ids: pa.Array, ids: pa.Array, sequence: int) -> pa.RecordBatch:
    """The pieces of documents, whose ids lie one behind the other: pieces are cuts of the same bytes."""
    counts = pc.binary_length(ids).to_numpy().astype(np.int64) // 4
    cuts = [piece_lengths(n, sequence) for n in counts.tolist()]
    doc, lengths = np.repeat(np.arange(len(cuts)), [len(x) for x in cuts]), np.fromiter(itertools.chain.from_iterable(cuts), np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    starts = ends[:-1] - (np.cumsum(counts) - counts)[doc]
    cut_ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((4 * ends).astype("<i4")), ids.buffers()[2]])
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), pa.array(starts), pa.array(lengths), cut_ids, pa.array(counts[doc])], names=["doc_id", "start", "length", "ids", "doc_tokens"])


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, for training with equal lengths in a batch."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def packing_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    pieces = pack(docs, tokenizer_path, cache=CACHE_ALONE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
