"""Spelling variants: words one letter apart, and the far more frequent word that a rare one stands for.

Two words at distance one share their first or their last half, so words are dealt
by halves: a word of length m belongs to the length classes m and m - 1, and in
class c to one block by its first c // 2 letters and one by its last c - c // 2.
Inside a block the vocabulary is a bit-sliced position index: for each (position,
letter) a bit set over the block's words. All queries of a block run through
word-parallel recurrences that carry, letter by letter, the words equal so far
(zero errors) and those with one replacement, one insertion (the word's positions
shifted by one) or one deletion. Pairs whose first halves agree count in the first
kind of block and all others in the second, so that none counts twice and no pair is
written: a block sends, for each word, how many near words it has there and the most
frequent of them.

A block of more than ``MOST_INDEXED`` words is split: every part indexes its share of
the words, and all words of the block query each part, index rows first and queries
in batches, so memory follows the share and not the block.

Defined results: null or empty texts have no words; a null doc_id deletes nothing
from its runs; repeated rows count each time; among equally frequent near words the
smallest in code-point order is the form; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, TIMES, TYPO = 7, 2, 10, 31
MOST_INDEXED = 4096
#: Rows, and letters with padding, of one index inside a task; queries go in batches of at most as many pairs.
CHUNK_ROWS, CHUNK_LETTERS, CHUNK_PAIRS = 32_768, 1 << 20, 1 << 18
NEAR = "word string, n_near long, best struct<order: long, form: string>"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): what is counted, words of at least LEAST_LETTERS code points and LEAST_COUNT occurrences."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % LEAST_LETTERS), F.lit(0)))
    runs = docs.select(F.col(id_col).cast("string").alias("id"), run.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _blocks(words: DataFrame) -> DataFrame:
    """Each word once per block that it belongs to: kind = 2 * class + (0 for first halves, 1 for last ones)."""

    def block(c: Column, kind: int) -> Column:
        half = F.floor(c / 2).cast("int")
        own = F.substring("word", F.lit(1), half) if kind == 0 else F.substring("word", F.length("word") - (c - half) + 1, c - half)
        return F.struct((2 * c + kind).cast("int").alias("kind"), F.xxhash64(own).alias("key"))

    m = F.length("word")
    return words.select("word", "n", F.explode(F.array(*[block(c, kind) for c in (m, m - 1) for kind in (0, 1)])).alias("b")).select("word", "n", "b.*")


def _dealt(words: DataFrame, most: int) -> DataFrame:
    """Blocks with their parts: a word is indexed in one part of its block and queries all of them."""
    keyed = _blocks(words)
    large = keyed.groupBy("kind", "key").agg(F.count("*").alias("size")).filter(F.col("size") > most)
    keyed = keyed.join(large, ["kind", "key"], "left").withColumn("parts", F.ceil(F.coalesce("size", F.lit(1)) / most).cast("int"))
    parts = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return parts.select("kind", "key", "part", (F.pmod(F.xxhash64("word"), "parts") != F.col("part")).alias("guest"), "word", "n")


class _Chunk:
    """Rows sorted by group. Guests are not indexed; rows that have been answered ask no more."""

    FIELDS = ("words", "n", "kind", "group", "guest", "asks")

    def __init__(self, *columns: np.ndarray):
        self.words, self.n, self.kind, self.group, self.guest, self.asks = columns

    def take(self, at) -> _Chunk:
        return _Chunk(*(getattr(self, k)[at] for k in self.FIELDS))

    @staticmethod
    def join(chunks: list[_Chunk]) -> _Chunk:
        return _Chunk(*(np.concatenate([getattr(c, k) for c in chunks]) for k in _Chunk.FIELDS))


def _near(index: _Chunk, asked: _Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its number of near words in the index's group, and n and place of the best; place -1: none."""
    width = max(index.words.dtype.itemsize, asked.words.dtype.itemsize) + 2
    letters, queries = (c.words.astype(f"S{width}").view(np.uint8).reshape(len(c.words), width) for c in (index, asked))
    lengths, own = (np.char.str_len(c.words) for c in (index, asked))
    alphabet, code = np.unique(np.concatenate([np.zeros(1, np.uint8), letters.ravel(), queries.ravel()])), np.zeros(256, np.intp)
    code[alphabet] = np.arange(len(alphabet))
    slots = -(-len(letters) // 64)

    def bits(rows: np.ndarray) -> np.ndarray:
        """Bit sets over the index, 64 words in one integer."""
        out = np.zeros((len(rows), slots * 8), np.uint8)
        packed = np.packbits(rows, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    sizes = np.unique(lengths)
    by_length = np.concatenate([bits(lengths[None, :] == sizes[:, None]), np.zeros((1, slots), np.uint64)])
    of_length = lambda x: np.where((i := np.searchsorted(sizes, x)) < len(sizes), np.where(sizes[np.minimum(i, len(sizes) - 1)] == x, i, len(sizes)), len(sizes))

    # A pair is a query and 64 index words that hold some of its group.
    lo, hi = np.searchsorted(index.group, asked.group, "left"), np.searchsorted(index.group, asked.group, "right")
    first, spans = lo >> 6, np.where(hi > lo, ((hi - 1) >> 6) - (lo >> 6) + 1, 0)
    q = np.repeat(np.arange(len(queries)), spans)
    slot = first[q] + np.arange(len(q)) - np.repeat(np.cumsum(spans) - spans, spans)
    full = ~np.uint64(0)
    from_, to = np.maximum(lo[q] - 64 * slot, 0), np.minimum(hi[q] - 64 * slot, 64)
    equal = np.left_shift(full, from_.astype(np.uint64)) & np.right_shift(full, (64 - to).astype(np.uint64))
    none = np.zeros(len(q), np.uint64)
    replaced, longer, shorter, halves = none, none, none, none.copy()
    half = (asked.kind >> 2)[q]  # kind // 2 is the class, half of it the first half's length
    table = lambda i: bits(code[letters[:, i]][None, :] == np.arange(len(alphabet))[:, None])
    before, here, after = np.zeros((len(alphabet), slots), np.uint64), table(0), table(1)
    for i in range(width - 1):
        if (now := half == i).any():
            halves[now] = equal[now]
        a = code[queries[:, i]][q]
        same = here[a, slot]
        # equal: no error up to here; longer: the word has a letter more, its positions run one ahead; shorter: one behind
        longer = (longer | equal) & after[a, slot]
        shorter = (shorter & before[a, slot]) | equal
        replaced = (replaced & same) | (equal & ~same)
        equal = equal & same
        before, here, after = here, after, table(i + 2) if i + 2 < width else before
    c, m = asked.kind[q] >> 1, own[q]
    short = m == c
    found = np.where(short, (replaced & by_length[of_length(m), slot]) | (longer & by_length[of_length(m + 1), slot]), shorter & by_length[of_length(m - 1), slot])
    found &= np.where(asked.kind[q] & 1, ~halves, halves)

    count = np.zeros(len(queries), np.int64)
    best, place = np.zeros(len(queries), np.int64), np.full(len(queries), -1)
    hit = np.flatnonzero(found)
    at, bit = np.nonzero(np.unpackbits(found[hit].view(np.uint8).reshape(len(hit), 8), axis=1, bitorder="little"))
    who, word = q[hit[at]], 64 * slot[hit[at]] + bit
    np.add.at(count, who, 1)
    order = np.lexsort((index.words[word], -index.n[word], who))
    who, word = who[order], word[order]
    lead = np.flatnonzero(np.diff(who, prepend=-1))
    best[who[lead]], place[who[lead]] = index.n[word[lead]], word[lead]
    return count, best, place


def _answers(rows: _Chunk) -> Iterator[pa.RecordBatch]:
    index, asked = rows.take(~rows.guest), rows.take(rows.asks)
    if not len(index.words):
        return
    per_query = np.maximum(1, np.searchsorted(index.group, asked.group, "right") - np.searchsorted(index.group, asked.group, "left")) // 64 + 2
    ends = np.cumsum(per_query)
    lo = 0
    while lo < len(asked.words):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_PAIRS, side="right")))
        part = asked.take(slice(lo, hi))
        count, best, place = _near(index, part)
        some = np.flatnonzero(place >= 0)
        text = lambda x: pa.array([w.decode("latin-1") for w in x.tolist()], pa.string())
        form = pa.StructArray.from_arrays([pa.array(-best[some]), text(index.words[place[some]])], names=["order", "form"])
        yield pa.RecordBatch.from_arrays([text(part.words[some]), pa.array(count[some]), form], names=["word", "n_near", "best"])
        lo = hi


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, indexed ones first: indexes are built over whole groups, or over the open group's once its guests come."""
    open_: _Chunk | None = None
    key, number = None, 0

    def done(c: _Chunk) -> Iterator[pa.RecordBatch]:
        """Groups of one row have no pair; the others go in chunks of bounded letters."""
        sizes = np.diff(np.flatnonzero(np.diff(c.group, prepend=-1, append=-1)))
        c = c.take(np.repeat(sizes > 1, sizes))
        if not len(c.words):
            return
        starts = np.append(np.flatnonzero(np.diff(c.group, prepend=-1)), len(c.words))
        wide = np.maximum.reduceat(np.char.str_len(c.words), starts[:-1])
        lo = 0
        while lo < len(wide):
            hi, most = lo + 1, wide[lo]
            while hi < len(wide) and (most := max(most, wide[hi])) * (starts[hi + 1] - starts[lo]) <= CHUNK_LETTERS:
                hi += 1
            some = c.take(slice(starts[lo], starts[hi]))
            yield from _answers(some)
            lo = hi

    for b in batches:
        for part in (b.slice(i, CHUNK_ROWS) for i in range(0, b.num_rows, CHUNK_ROWS)):
            columns = {k: part.column(k).to_numpy(zero_copy_only=False) for k in ("kind", "key", "part", "guest", "n")}
            mark = np.stack([columns[k].astype(np.int64) for k in ("kind", "key", "part")], axis=1)
            new = np.ones(len(mark), bool)
            new[1:] = (mark[1:] != mark[:-1]).any(axis=1)
            new[0] = key is None or (mark[0] != key).any()
            group, key = number + np.cumsum(new), mark[-1]
            number = int(group[-1])
            words = np.array([w.encode("latin-1") for w in part.column("word").to_pylist()])
            chunk = _Chunk(words, columns["n"].astype(np.int64), columns["kind"].astype(np.int64), group, columns["guest"].astype(bool), np.ones(len(words), bool))
            c = chunk if open_ is None else _Chunk.join([open_, chunk])
            last = int(np.searchsorted(c.group, number))
            yield from done(c.take(slice(0, last)))
            open_ = c.take(slice(last, None))
            if open_.guest.any() and len(open_.words) > CHUNK_ROWS:
                # all index rows of the group are here: its queries so far are answered and the index stays
                yield from _answers(open_)
                open_ = open_.take(~open_.guest)
                open_.asks = np.zeros(len(open_.words), bool)
    if open_ is not None:
        yield from done(open_)


def near_words(words: DataFrame, most: int = MOST_INDEXED) -> DataFrame:
    """(word, n_near, best): for each word with near words, in parts that add up by word."""
    dealt = _dealt(words, most).repartition("kind", "key", "part").sortWithinPartitions("kind", "key", "part", "guest")
    return dealt.mapInArrow(_search, NEAR)


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_INDEXED) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    words = written(vocabulary(docs, id_col, text_col), "vocabulary")
    none = F.lit(None).cast("struct<order: long, form: string>")
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best")).unionByName(near_words(words, most).withColumn("n", F.lit(None).cast("long")))
    near = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    follows = -F.col("best.order") >= TIMES * F.col("n")
    near = written(near.select("word", "n", "n_near", F.when(follows, F.col("best.form")).alias("form"), F.when(follows, -F.col("best.order")).alias("form_n")), "near-words")
    # Each step multiplies n by TIMES at least, so doubling the links a few times reaches every last form.
    top = near.agg(F.max("form_n")).first()[0] or 0
    links = near.filter("form is not null").select("word", F.col("form").alias("to"))
    steps = 1
    while TIMES ** (steps + 1) * LEAST_COUNT <= top:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        links = written(links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to")), "forms")
        steps *= 2
    return near.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))
