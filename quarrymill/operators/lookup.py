"""Exact and close look-ups of many strings at once: trigram postings over texts, and a fuzzy join of dictionaries.

A trigram index makes a search a join: a needle's rarest trigrams name the few texts that can hold it,
and only these are compared. Texts end in a mark on either side, so that every character is in a trigram.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from .ranking import BROADCAST_ROWS, rank_by

EDGE = "\u0001"
#: Trigrams of a needle that are looked up: the rarest ones.
RAREST = 3


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case, with a mark on either side."""
    return F.array_distinct(_overlapping(F.concat(F.lit(EDGE), F.lower(text), F.lit(EDGE)), 3))


def _overlapping(text: Column, n: int) -> Column:
    """All runs of n characters, one beginning at each; one pass, where substrings by position would begin anew each time."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1))


def trigram_index(fragments: DataFrame, key: str = "node_id", scope: str | None = None) -> DataFrame:
    """(gram, key): postings of fragments (key, text); null texts have none. With `scope`, a column, only strings of the same scope meet."""
    return fragments.filter("text is not null").select(F.explode(_scoped(trigrams(F.col("text")), scope)).alias("gram"), key)


def _scoped(grams: Column, scope: str | None) -> Column:
    return grams if scope is None else F.transform(grams, lambda g: F.concat(F.coalesce(F.col(scope).cast("string"), F.lit("")), F.lit(EDGE), g))


def candidates(asked: DataFrame, index: DataFrame, key: str = "node_id", scope: str | None = None) -> DataFrame:
    """(needle[, scope], key): texts that hold the RAREST trigrams of a needle, or, for needles under three characters, any trigram with it.

    Postings are counted once for each trigram that occurs in a needle; a common trigram is never read
    where a needle has rarer ones. Empty and null needles are nowhere.
    """
    named = ["needle", *([scope] if scope else [])]
    needles = asked.select(F.lower("needle").alias("needle"), *named[1:]).filter(F.length("needle") > 0).distinct()
    grams = needles.filter(F.length("needle") >= 3).select(*named, F.explode(_scoped(F.array_distinct(_overlapping(F.col("needle"), 3)), scope)).alias("gram"))
    sizes = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarity = Window.partitionBy(*named).orderBy(F.coalesce("n", F.lit(0)), "gram")
    chosen = grams.join(sizes, "gram", "left").withColumn("_at", F.row_number().over(rarity)).filter(F.col("_at") <= RAREST).withColumn("_most", F.count("*").over(Window.partitionBy(*named)))
    found = index.join(chosen.select("gram", "_most", *named), "gram").groupBy(*named, key, "_most").agg(F.count("*").alias("_n"))
    long_ = found.filter(F.col("_n") == F.col("_most")).select(*named, key)
    short = needles.filter(F.length("needle") < 3)
    kinds = index.select("gram").distinct()  # as many rows as there are trigrams, whatever the texts
    held = F.contains(F.right("gram", F.lit(3)), F.col("needle"))
    if scope:
        held = held & F.startswith("gram", F.concat(F.coalesce(F.col(scope).cast("string"), F.lit("")), F.lit(EDGE)))
    kinds = kinds.join(short, held).select("gram", *named)
    return long_.unionByName(index.join(kinds, "gram").select(*named, key).distinct())


def exact_search(asked: DataFrame, fragments: DataFrame, index: DataFrame | None = None, key: str = "node_id", whole_words: bool = False, scope: str | None = None) -> DataFrame:
    """(needle[, scope], key) of each fragment (key, text) that holds a needle of `asked` (needle), whatever the case (RET-15).

    With `whole_words`, a needle that begins with a letter or digit is held only between characters that
    are none of a word; others are held anywhere. `index` is the fragments' trigram_index, built and
    written here if it is not given, unless a scan will do: up to BROADCAST_ROWS needles, counted first, are
    broadcast, and no text or trigram is shuffled or written. With `scope`, a column of both, a needle is sought in its own scope.
    """
    if index is None and scope is None and not whole_words:
        needles = asked.select(F.lower("needle").alias("needle")).filter(F.length("needle") > 0).distinct()
        if needles.count() <= BROADCAST_ROWS:
            return _scanned(needles, fragments, key).distinct()
    index = written(trigram_index(fragments, key, scope), "trigrams") if index is None else index
    pairs = candidates(asked, index, key, scope).join(fragments.filter("text is not null").select(key, F.lower("text").alias("_text")), key)
    return pairs.filter(_held(whole_words)).select("needle", *([scope] if scope else []), key).distinct()


def _held(whole_words: bool) -> Column:
    held = F.contains("_text", F.col("needle"))
    if whole_words:
        bounded = F.regexp_like("_text", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("needle"), F.lit(r"\E(?!\w)")))
        held = held & (~F.col("needle").rlike(r"^[\p{L}\p{N}]") | bounded)
    return held


def _scanned(needles: DataFrame, fragments: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """(needle, key) by one pass over the texts, some `most` characters at a time, with all needles in every task.

    A needle is sought where its trigram stands that is rarest in the task's first texts; which one that is
    changes the work, not what is found. Needles of one or two characters are sought in every text.
    """
    sent = fragments.sparkSession.sparkContext.broadcast([r["needle"] for r in needles.collect()])

    def letters(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)

    def codes(c: np.ndarray, at=slice(None)) -> np.ndarray:
        x, y, z = (part[at].astype(np.int64) for part in (c[:-2], c[1:-1], c[2:]))
        return (x << 42) | (y << 21) | z

    def slots(c: np.ndarray) -> np.ndarray:
        return ((c[:-2] * np.uint32(40_503) + c[1:-1]) * np.uint32(40_503) + c[2:]) & np.uint32((1 << 20) - 1)

    def run(batches):
        short, long_ = [n for n in sent.value if len(n) < 3], [n for n in sent.value if len(n) >= 3]
        table, of, maybe = None, {}, np.zeros(1 << 20, dtype=bool)
        for b in batches:
            texts, keys = b.column("_text").to_pylist(), b.column(key)
            ends = np.cumsum([len(t) + 1 for t in texts])
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
                some = texts[at:stop]
                here = letters("\0".join([*some, "\0\0"]))
                if table is None:
                    kinds, counts = np.unique(codes(here), return_counts=True)
                    for n in long_:
                        grams = codes(letters(n))
                        place = np.minimum(np.searchsorted(kinds, grams), len(kinds) - 1)
                        rare = int(np.argmin(np.where(kinds[place] == grams, counts[place], 0)))
                        of.setdefault(int(grams[rare]), []).append(n)
                        maybe[slots(letters(n))[rare]] = True
                    table = np.array(sorted(of), dtype=np.int64)
                found: tuple[list, list] = ([], [])
                if len(table):
                    where = np.flatnonzero(maybe[slots(here)])  # most places end here
                    grams = codes(here, where)
                    place = np.minimum(np.searchsorted(table, grams), len(table) - 1)
                    where, place = where[table[place] == grams], place[table[place] == grams]
                    begins = np.append(0, np.cumsum([len(t) + 1 for t in some])[:-1])
                    for pair in np.unique((np.searchsorted(begins, where, side="right") - 1) * len(table) + place).tolist():
                        text = some[pair // len(table)]
                        for n in of[int(table[pair % len(table)])]:
                            if n in text:
                                found[0].append(n)
                                found[1].append(at + pair // len(table))
                for i, text in enumerate(some):
                    held = [n for n in short if n in text]
                    found[0].extend(held)
                    found[1].extend([at + i] * len(held))
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), keys.take(pa.array(found[1], pa.int64()))], names=["needle", key])
                at = stop

    kind = fragments.schema[key].dataType.simpleString()
    return fragments.filter("text is not null").select(key, F.lower("text").alias("_text")).mapInArrow(run, f"needle string, {key} {kind}")


def exact_matches(fragments: DataFrame, keys: DataFrame, limit: int = 8, rare: float = 0.2) -> DataFrame:
    """(file, ord, n_keys, rank): fragments with a file's rare keys as whole words, most keys first, then in order (FLT-13, AGG-27).

    fragments (file, ord, text); keys (file, key). A key is rare in a file if it is in at most
    max(1, floor(rare * n)) of its n fragments. A key that is one word is looked up among the words of
    its file's texts; only others, if there are any, need trigrams.
    """
    asked = keys.select("file", F.lower("key").alias("needle")).filter(F.length("needle") > 0).distinct()
    word = F.col("needle").rlike(r"(?U)^[\p{L}\p{N}]\w*$")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("needle")
    single = asked.filter(word).select("file", "needle")
    single = F.broadcast(single) if single.count() <= BROADCAST_ROWS else single
    found = fragments.filter("text is not null").select("file", "ord", words).join(single, ["file", "needle"], "left_semi").select("needle", "file", "ord").distinct()
    others = asked.filter(~word).select("file", "needle")
    if not others.isEmpty():
        rows = fragments.select("file", "text", F.struct("file", "ord").alias("_id"))
        found = found.unionByName(exact_search(others, rows, key="_id", whole_words=True, scope="file").select("needle", "_id.*"))
    most = fragments.groupBy("file").agg(F.greatest(F.lit(1), F.floor(F.count("*") * rare)).alias("_most"))
    useful = found.groupBy("file", "needle").agg(F.count("*").alias("_df")).join(most, "file").filter("_df <= _most")
    hits = found.join(useful.select("file", "needle"), ["file", "needle"]).groupBy("file", "ord").agg(F.count("*").alias("n_keys"))
    return rank_by(hits, ["file"], [F.desc("n_keys"), F.asc("ord")]).filter(F.col("rank") <= limit)


#: Likeness from which two words are one, words and flat names that are long enough for it, hints for a question (fixed values).
CLOSE, WORD_LEAST, FLAT_LEAST, HINTS = 0.85, 4, 3, 25


def _bigrams(word: Column) -> Column:
    """Bigrams of a word, each numbered among its equals, so that counts of common ones are those of multisets."""
    grams = _overlapping(word, 2)
    numbered = lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string"))
    return F.transform(grams, numbered)


def least_common(a: Column, b: Column) -> Column:
    """Bigrams that words of lengths a and b have in common at least, if their ratio is CLOSE or more.

    The ratio is 2 m / (a + b) for m characters in common, in order. Of the a - 1 bigrams, each of the
    a - m characters that are left out takes two, each of the b - m that are put in between splits one.
    """
    m = F.ceil(F.lit(CLOSE) * (a + b) / 2 - 1e-9)
    return 3 * m - a - b - 1


def close_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of words of `left` (a) and `right` (b) whose ratio is CLOSE or more; those of `right` have WORD_LEAST characters or more.

    Words are compared only if they share enough bigrams. Of a word's bigrams, rarest first, only so
    many are looked up that a close word must hold one of them; then common ones are counted, and the
    pairs that are left get their exact ratio.
    """
    import difflib

    a, b = left.select("a").filter(F.length("a") >= WORD_LEAST - 1).distinct(), right.select("b").filter(F.length("b") >= WORD_LEAST).distinct()
    grams = lambda df, c: df.select(c, F.explode(_bigrams(F.col(c))).alias("gram"))
    ga, gb = grams(a, "a"), grams(b, "b")
    df = gb.groupBy("gram").agg(F.count("*").alias("n"))

    def rarest(g: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        # The shortest partner asks for the fewest common bigrams; least_common is never less than this line.
        both = n + F.ceil(n * (CLOSE / (2 - CLOSE)) - 1e-9)
        need = F.greatest(F.lit(1), F.ceil((1.5 * CLOSE - 1) * both - 1 - 1e-9))
        order = Window.partitionBy(c).orderBy(F.coalesce("n", F.lit(0)), "gram")
        return g.join(df, "gram", "left").withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= n - 1 - need + 1).select(c, "gram")

    pairs = rarest(ga, "a").join(rarest(gb, "b"), "gram").select("a", "b").distinct()
    size = lambda c: F.length(c)
    pairs = pairs.filter(2 * F.least(size("a"), size("b")) >= CLOSE * (size("a") + size("b")) - 1e-9)
    common = F.size(F.array_intersect(_bigrams(F.col("a")), _bigrams(F.col("b"))))
    pairs = pairs.filter(common >= least_common(size("a"), size("b")))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return pairs.filter(ratio("a", "b") >= CLOSE).select("a", "b")


def value_hints(questions: DataFrame, values: DataFrame, limit: int = HINTS) -> DataFrame:
    """(query_id, table, column, value): stored values that a question names, the first `limit` by table, column and value (JOIN-17, FLT-11, SQL-05).

    questions (query_id, text), values (table, column, value). A value is named if, without white space,
    hyphens and underscores, it stands in the question so flattened, or if one of its words is close to
    a word of the question. All questions and values meet through their trigrams and bigrams.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), r"(?U)[\s_\-]+", "")
    known = values.select("table", "column", "value").filter(F.length("value") >= 2).distinct()
    bare = known.select("value", flat("value").alias("needle")).filter(F.length("needle") >= FLAT_LEAST).distinct()
    asked = questions.select("query_id", flat("text").alias("text"))
    literal = exact_search(bare.select("needle"), asked, key="query_id").join(bare, "needle").select("query_id", "value")
    parts = known.select("value", F.explode(F.split(F.lower("value"), r"(?U)[\s_\-=]+")).alias("b")).filter(F.length("b") >= WORD_LEAST).distinct()
    tokens = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[\w\-]+"), F.lit(0)))).alias("a"))
    # Of all the values with a word, only the first `limit` can be among a question's first.
    first = rank_by(parts.join(known, "value"), ["b"], [F.asc("table"), F.asc("column"), F.asc("value")], "_n").filter(F.col("_n") <= limit).drop("_n")
    spelled = close_words(tokens.select("a"), parts.select("b")).join(tokens, "a").join(first, "b").select("query_id", "table", "column", "value")
    named = literal.join(known, "value").select("query_id", "table", "column", "value").unionByName(spelled).distinct()
    return rank_by(named, ["query_id"], [F.asc("table"), F.asc("column"), F.asc("value")]).filter(F.col("rank") <= limit).select("query_id", "table", "column", "value")


def read_file(asked: DataFrame, nodes: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, node_id, rank): the first fragments of a file, of one of its cells or pages if those are given (RET-15).

    asked (query_id, path, cell, page); nodes (node_id, file_path, node_type, ord, cell, page, page_end).
    """
    pairs = asked.select("query_id", F.col("path").alias("file_path"), F.col("cell").alias("_cell"), F.col("page").alias("_page")).join(nodes.filter("node_type <> 'file'"), "file_path")
    at_cell = F.col("_cell").isNull() | (F.col("cell") == F.col("_cell"))
    at_page = F.col("_page").isNull() | F.col("_page").between(F.col("page"), F.coalesce("page_end", "page"))
    return rank_by(pairs.filter(at_cell & at_page), ["query_id"], [F.asc("ord"), F.asc("node_id")]).filter(F.col("rank") <= most).select("query_id", "node_id", "rank")


def list_folder(asked: DataFrame, files: DataFrame, most: int = 60) -> DataFrame:
    """(query_id, path, rank): the first files below a folder by path, of all files for an empty one (RET-15).

    asked (query_id, path), files (path). Each file is joined by the folders above it, not by a prefix
    comparison with every question.
    """
    folder = F.regexp_replace(F.replace(F.trim(F.coalesce("path", F.lit(""))), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    placed = files.select("path", F.explode(above).alias("_folder"))
    pairs = asked.select("query_id", folder.alias("_folder")).join(placed, "_folder")
    return rank_by(pairs, ["query_id"], [F.asc("path")]).filter(F.col("rank") <= most).select("query_id", "path", "rank")
