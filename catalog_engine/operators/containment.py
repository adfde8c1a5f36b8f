"""Texts that contain words of a key anywhere, in any script: an index of character grams finds candidates, a look at the text confirms them.

Words are expanded by alias groups first. Every word is looked up by the rarest of its
grams (three characters, or the whole word if it is shorter), so a word that shares a
frequent gram with every text brings no candidates through it. What is hot is a gram,
and rows of one gram are joined row by row, so a skewed join can be split; nothing is
collected by gram or by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..sources.buckets import work_dir
from .windows import top_per_key

GRAM = 3
#: Grams of words that may be sent to every task (8 MB).
MOST_SENT = 1 << 20
#: Words that stand for each other: a keyword that holds one of a group, or is held by one, stands for all of it (fixed values).
ALIASES = (
    ("水杯", "保温杯", "杯子", "运动水壶", "water bottle", "tumbler", "bottle"),
    ("保温杯", "水杯", "杯子", "thermos", "insulated bottle", "vacuum bottle"),
    ("瑜伽垫", "运动垫", "健身垫", "yoga mat", "exercise mat", "fitness mat"),
    ("厨房垫", "沥水垫", "餐垫", "dish drying mat", "kitchen mat", "sink mat"),
    ("收纳盒", "收纳箱", "整理盒", "storage box", "organizer"),
    ("枕头", "靠枕", "睡枕", "pillow"),
    ("手机支架", "平板支架", "phone stand", "phone holder"),
    ("不锈钢", "304", "316", "stainless steel"),
    ("硅胶", "silicone"),
    ("铝合金", "铝", "aluminum", "aluminium"),
)


def expand_keywords(words: Column, aliases: tuple[tuple[str, ...], ...] = ALIASES) -> Column:
    """The words, trimmed, and all words of the groups that they touch, each once; Latin terms are compared without case."""
    none = F.array().cast("array<string>")

    def touches(term: str, word: Column) -> Column:
        a, b = (F.lit(term.lower()), F.lower(word)) if term.isascii() else (F.lit(term), word)
        return F.contains(a, b) | F.contains(b, a)

    def one(word: Column) -> Column:
        out = F.array(word)
        for group in aliases:
            hit = touches(group[0], word)
            for term in group[1:]:
                hit = hit | touches(term, word)
            out = F.concat(out, F.when(hit, F.array(*[F.lit(t) for t in group])).otherwise(none))
        return out

    kept = F.filter(F.transform(words, F.trim), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(kept, one)))


def _codes(text: str, size: int) -> np.ndarray:
    """Every run of so many characters as one number: 21 bits a character, and the run's length on top."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = max(0, len(signs) - size + 1)
    out = np.zeros(n, np.int64)
    for i in range(size):
        out = (out << 21) | signs[i : i + n]
    return out if size == GRAM else out | (size << 42)


def _marks(codes: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(codes).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


@F.pandas_udf(ArrayType(LongType()))
def _word_grams(words: pd.Series) -> pd.Series:
    return pd.Series([np.unique(_codes(w, min(GRAM, len(w)))) for w in words])


def _text_grams(sizes: list[int], wanted: np.ndarray | None):
    """(id, gram) of texts: their distinct grams, of those wanted where the list is given."""
    known = np.zeros(1 << 16, bool)
    if wanted is not None:
        wanted = np.sort(wanted)
        known[_marks(wanted)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, grams, held = b.column("id"), [], [], 0
            for i, text in enumerate(b.column("text")):
                for size in sizes if text.is_valid else ():
                    codes = _codes(text.as_py(), size)
                    if wanted is not None:
                        codes = codes[known[_marks(codes)]]
                        codes = codes[wanted[np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)] == codes]
                    codes = np.unique(codes)
                    rows.append(np.full(len(codes), i))
                    grams.append(codes)
                    held += len(codes)
                if held > 1 << 20 or i == b.num_rows - 1:
                    if held:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(grams))], names=["id", "gram"])
                    rows, grams, held = [], [], 0

    return run


def containing_texts(texts: DataFrame, words: DataFrame, id_col: str, text_col: str, word_col: str, most_sent: int = MOST_SENT) -> DataFrame:
    """(id, word) of every text that holds a word, both lower-cased; ids name one text each. Null texts and empty words hold nothing.

    Grams of the words go to every task only while there are at most ``most_sent`` (8
    bytes each), to spare the join what no word asks for; beyond, the join does it all.
    """
    spark = texts.sparkSession
    pages = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    wanted = words.select(F.lower(F.col(word_col)).alias("word")).filter("word <> ''").distinct()
    of_word = wanted.select("word", F.explode(_word_grams("word")).alias("gram"))
    sizes = sorted(r["size"] for r in wanted.select(F.least(F.lit(GRAM), F.length("word")).alias("size")).distinct().collect())  # of 1, 2 and 3
    if not sizes:
        return pages.select("id", F.col("text").alias("word")).limit(0)
    some = of_word.select("gram").distinct().limit(most_sent + 1).toPandas()["gram"].to_numpy()
    schema = f"id {pages.schema['id'].dataType.simpleString()}, gram long"
    found = pages.mapInArrow(_text_grams(sizes, some if len(some) <= most_sent else None), schema)
    if len(some) > most_sent:
        found = found.join(of_word.select("gram").distinct(), "gram").select("id", "gram")
    path = work_dir(spark, "gram-hits")
    found.write.parquet(path)
    hits = spark.read.schema(schema).parquet(path)
    often = hits.groupBy("gram").agg(F.count("*").alias("often"))
    # a word with a gram that no text has is in no text
    lookup = of_word.join(often, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("rarest")).filter("rarest.often > 0").select("word", "rarest.gram")
    maybe = hits.join(lookup, "gram").groupBy("id").agg(F.collect_set("word").alias("words"))
    sure = pages.join(maybe, "id").select("id", F.filter("words", lambda w: F.contains(F.col("text"), w)).alias("words"))
    return sure.select("id", F.explode("words").alias("word"))


def imported_offer_match(offers: DataFrame, keywords: DataFrame, id_col: str = "offer_id", text_cols: tuple[str, ...] = ("text",), time_col: str = "imported_at", key_col: str = "key", words_col: str = "words", top_k: int = 20, aliases: tuple[tuple[str, ...], ...] = ALIASES) -> DataFrame:
    """(key, id, score, rank): for each key the offers with the most of its expanded words in their texts, then the newest, then the least id.

    Keys are rows with an array of words; an expanded word counts once, words that
    differ in case only count each. Offers without a hit are left out.
    """
    named = offers.select(F.col(id_col).alias("id"), F.concat_ws(" ", *text_cols).alias("text"), F.col(time_col).alias("at"))
    asked = keywords.select(F.col(key_col).alias("key"), F.explode(expand_keywords(F.col(words_col), aliases)).alias("raw")).distinct().groupBy("key", F.lower("raw").alias("word")).agg(F.count("*").alias("n"))
    held = containing_texts(named, asked, "id", "text", "word")
    scores = held.join(asked, "word").groupBy("key", "id").agg(F.sum("n").alias("score")).join(named.select("id", "at"), "id")
    best = top_per_key(scores, ["key"], [F.desc("score"), F.desc_nulls_last("at"), F.asc("id")], top_k, "rank")
    return best.select(F.col("key").alias(key_col), F.col("id").alias(id_col), "score", "rank")
