"""Token counts by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens go into a trie. A trie node's forward score, the best unigram score of any
segmentation of its prefix, and the number of pieces in that segmentation are computed once,
however many pre-tokens share the prefix; a pre-token's count is stored at its terminal node.
Texts then only look up their pre-tokens.

The lexicon comes from a public SentencePiece file: its pieces, and scores by Zipf's law over
their order, as such a file orders pieces by how often they were merged. A character outside
the lexicon costs one piece per UTF-8 byte at the score of the byte pieces.

Defined cases: null and empty texts, and texts of white space alone, have 0 tokens; among
segmentations of equal score the one with fewer tokens counts; each row gets a row, repeated ids
and null ids too; very long texts are counted part by part, cut at white space; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept_by_worker, slices

MARK = "▁"  # stands for the space before a word
#: Pre-tokens whose counts a generation holds; those of more characters are not kept.
CACHE, KEPT_CHARS = 300_000, 64
#: Bytes of text that are counted together; parts of texts that go into the trie at once.
SLICE, PARTS = 1 << 20, 1_000


def lexicon_from_pieces(path: str) -> tuple[dict[str, float], float]:
    """(piece -> log-probability, score of one byte piece) from a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(plain) + 256)))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(plain)}, -math.log(len(plain) + 256) - norm


class ScoringTrie:
    """Counts of pre-tokens; forward scores are computed once per shared prefix.

    Pre-tokens are inserted in sorted order, so that the trie's only live branch is the path to
    the last one: the next one keeps the scores of the prefix they share and adds nodes below it.
    Terminal counts are kept in two generations: what is asked for again outlives a change.
    """

    def __init__(self, lexicon: dict[str, float], byte_score: float):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece, score in lexicon.items():
            self.pieces.add_word(piece, (len(piece), score))
        if lexicon:
            self.pieces.make_automaton()
        self.longest = max(map(len, lexicon), default=0)
        self.byte_score = byte_score
        self.terminals: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def insert(self, tokens: list[str]) -> None:
        """Store the counts of pre-tokens that have none yet; they must be sorted."""
        last, path = "", [(0.0, 0)]
        for token in tokens:
            shared = 0
            for a, b in zip(last, token, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            self._extend(token, path)
            self.terminals[token] = -path[-1][1]
            last = token

    def know(self, tokens: set[str]) -> None:
        """Make sure that the current generation has all of these."""
        new = tokens - self.terminals.keys()
        if len(self.terminals) + len(new) > CACHE:
            self.older, self.terminals, new = self.terminals, {}, tokens
        again = new & self.older.keys()
        self.terminals.update((t, self.older[t]) for t in again)
        self.insert(sorted(new - again))

    def _extend(self, token: str, path: list[tuple[float, int]]) -> None:
        """Add the forward scores (score, minus tokens) of the prefixes that `path` lacks.

        A piece that ends in the new part begins at most its length before, so that only that
        much of the shared prefix is looked at again.
        """
        known, byte_score = len(path), self.byte_score
        fresh = token[known - 1 :]
        sizes = None if fresh.isascii() else [len(c.encode("utf-8", "replace")) for c in fresh]
        done, total, add = known, len(token) + 1, path.append
        score, count = path[-1]
        for end, (size, gain) in self.pieces.iter(token, max(0, known - self.longest)) if self.longest else ():
            end += 1
            if end < known:
                continue
            while done <= end:
                n = 1 if sizes is None else sizes[done - known]
                score, count = score + n * byte_score, count - n
                add((score, count))
                done += 1
            before = path[end - size]
            way = (before[0] + gain, before[1] - 1)
            if way > (score, count):
                score, count = path[end] = way
        while done < total:
            n = 1 if sizes is None else sizes[done - known]
            score, count = score + n * byte_score, count - n
            add((score, count))
            done += 1

    def count(self, words: list[str]) -> int:
        """Tokens of a text's words, all of which are known or too long to be kept."""
        try:
            return sum(map(self.terminals.__getitem__, words))
        except KeyError:
            return sum(self.one(w) for w in words)

    def one(self, token: str) -> int:
        if (n := self.terminals.get(token)) is None:
            path = [(0.0, 0)]
            self._extend(token, path)
            n = -path[-1][1]
        return n


def count_tokens(docs: DataFrame, pieces_path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every whole text, in one narrow pass."""

    def run(batches):
        trie = kept_by_worker(f"trie:{pieces_path}", lambda: ScoringTrie(*lexicon_from_pieces(pieces_path)))
        for b in slices(batches, "text", SLICE):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n, counts = [0] * len(texts), [0] * len(texts)
            parts = [(i, part) for i, t in enumerate(texts) for part in cut(t)]
            for at in range(0, len(parts), PARTS):
                words = [(i, pre_tokens(part)) for i, part in parts[at : at + PARTS]]
                trie.know({w for _, ws in words for w in set(ws) if len(w) <= KEPT_CHARS})
                for i, ws in words:
                    n[i] += len(ws)
                    counts[i] += trie.count(ws)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def pre_tokens(text: str) -> list[str]:
    """Words, each behind the mark of its space."""
    words = (MARK + f" {MARK}".join(text.split())).split(" ")
    return words if words != [MARK] else []
