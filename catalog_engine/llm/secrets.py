"""Secret scans: candidates by shape, false positives removed by a random forest.

Every run of 8 or more key-like characters is a candidate, wherever it stands in a
word, if it holds a digit or is assigned to a name (in the same word, or by words
like ``name :`` and ``name =`` before it). A forest trained on labelled findings
judges each by its length, character transitions, character kinds, dictionary
coverage, path and neighbouring words. Everything is DataFrame and Spark ML work inside the JVM:
one scan, no shuffle of the documents.

Defined results: null and empty texts have no findings; every word of a text of any
length is looked at, and a word may hold several candidates; repeated rows are reported once each; a null path counts as
an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import SPACE

THRESHOLD = 0.5
TREES, DEPTH, SEED = 30, 8, 3
FINDINGS = 6000
#: A run of key-like characters with the signs before it; base64 padding counts only where no value follows it.
PIECE = r"""\G([^A-Za-z0-9_+/.\-]*+)([A-Za-z0-9_+/.\-]++(?:={1,2}(?![A-Za-z0-9_+/.\-"'`=]))?)"""
VALUE = r"^[A-Za-z0-9_+/.\-]{8,}"
#: A name and the signs that assign to it, at the end of what stands before a value.
NAME = r"""(?<![A-Za-z0-9_.\-])([A-Za-z0-9_.\-]++)["'`\\\])]{0,3} ?[=:]+>? ?["'`(\[{<,\\]*$"""
SECRET_WORDS = "password passwd passphrase pwd pass secret token key apikey api_key access_key auth authorization bearer credential credentials private login"
OTHER_WORDS = "sha sha1 sha256 md5 commit checksum digest revision rev uuid guid id hash etag build version integrity isbn phone order invoice tracking file path url image"
ADDRESS_WORDS = "mailto email mail e-mail from to cc contact xmpp sip acct"
#: Words that show up inside names, placeholders and slugs.
DICTIONARY = "example sample test demo dummy placeholder your here change password secret token key user name admin release notes version update report image photo page index article news draft final copy file data module config default service client server request response error value number string result north south summer winter street house school market music video world people water light paper green black white"
FORMATS = r"^(?:AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)$"
PATH_WORDS = r"(?i)(?:^|[^a-z])(?:test|tests|example|examples|fixture|fixtures|docs?|sample|mock)(?:[^a-z]|$)"
FEATURES = ["length", "distinct", "digits", "uppers", "lowers", "signs", "hex", "kind_turns", "vowel_turns", "transitions", "repeats", "words", "named", "format", "secret_near", "other_near", "shape_uuid", "sample_path"]


def _transitions() -> tuple[dict[str, float], float]:
    """log2 probability of each letter after another in the dictionary's words, and that of pairs it lacks."""
    pairs = Counter(w[i : i + 2] for w in DICTIONARY.split() for i in range(len(w) - 1))
    first = Counter(p[0] for p in pairs.elements())
    return {p: math.log2((n + 0.5) / (first[p[0]] + 13)) for p, n in sorted(pairs.items())}, math.log2(1 / 52)


def _any(words: str) -> str:
    return "(?i)(?:^|[^a-z0-9])(?:" + "|".join(words.split()) + ")(?:[^a-z0-9]|$)"


def with_features(df: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of (candidate, name, before, after, path)."""
    n = F.greatest(F.length("candidate"), F.lit(1))
    share = lambda p: F.regexp_count("candidate", F.lit(p)) / n
    near = F.concat_ws(" ", "name", "before")
    low = F.lower("candidate")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    logs, rare = _transitions()
    table = F.create_map(*[F.lit(x) for pair in logs.items() for x in pair])
    steps = F.transform(F.regexp_extract_all(low, F.lit("(?=([a-z]{2}))"), F.lit(1)), lambda p: F.coalesce(F.try_element_at(table, p), F.lit(rare)))
    return df.withColumns(
        {
            "length": F.length("candidate").cast("double"),
            "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / n,
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "lowers": share("[a-z]"),
            "signs": share("[^A-Za-z0-9]"),
            "hex": flag(F.col("candidate").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "kind_turns": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
            "vowel_turns": F.regexp_count(low, F.lit("(?<=[aeiou])(?=[b-df-hj-np-tv-z])")) / n,
            "transitions": F.when(F.size(steps) > 0, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.size(steps)).otherwise(F.lit(rare)),
            "repeats": F.regexp_count("candidate", F.lit(r"(.)(?=\1)")) / n,
            "words": 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w))), "")) / n,
            "named": flag(F.col("name") != ""),
            "format": flag(F.col("candidate").rlike(FORMATS)),
            "secret_near": flag(near.rlike(_any(SECRET_WORDS))),
            "other_near": flag(near.rlike(_any(OTHER_WORDS)) | F.col("after").rlike(_any("commit checksum"))),
            "shape_uuid": flag(F.col("candidate").rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
            "sample_path": flag(F.col("path").rlike(PATH_WORDS)),
        }
    )


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, word_index, word, before, after, candidate, name): three words before and one after the word of each candidate."""
    words = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE).alias("words"),
    )

    def likely(i: Column) -> Column:
        w, last = F.get("words", i), F.coalesce(F.get("words", i - 1), F.lit(""))
        return (F.octet_length(w) >= 8) & w.rlike(r"[A-Za-z0-9_+/.\-]{8}") & (w.rlike("[0-9=:]") | last.rlike("[=:]>?$"))

    at = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    index = F.filter(F.sequence(F.lit(0), F.size("words") - 1), likely)
    hits = words.withColumn("index", index).withColumn(
        "hits",
        F.transform(
            "index",
            lambda i: F.struct(
                i.cast("long").alias("word_index"),
                at(i).alias("word"),
                F.concat_ws(" ", at(i - 3), at(i - 2), at(i - 1)).alias("before"),
                at(i + 1).alias("after"),
            ),
        ),
    )
    # an inner explode would put a filter on the array below the projections, and so compute them twice
    out = hits.select("doc_id", "path", F.explode_outer("hits").alias("hit")).filter(F.col("hit").isNotNull()).select("doc_id", "path", "hit.*")
    piece = lambda group: F.regexp_extract_all("word", F.lit(PIECE), F.lit(group))
    runs = out.withColumns({"signs": piece(1), "runs": piece(2)}).select("*", F.posexplode_outer("runs").alias("k", "candidate"))
    lead = F.when(F.col("k") == 0, F.concat("before", F.lit(" "))).otherwise(F.get("runs", F.col("k") - 1))
    runs = runs.withColumn("name", F.regexp_extract(F.concat(lead, F.get("signs", "k")), NAME, 1))
    # user:value@host is a login unless user says that an address follows
    login = (F.get("signs", "k") == ":") & F.get("signs", F.col("k") + 1).startswith("@") & ~F.lower("name").isin(ADDRESS_WORDS.split())
    runs = runs.withColumn("name", F.when(login, F.concat("name", F.lit(" login"))).otherwise(F.col("name")))
    runs = runs.filter(F.col("candidate").rlike(VALUE) & (F.col("candidate").rlike("[0-9]") | (F.col("name") != "") & F.col("candidate").rlike("[A-Za-z]")))
    return runs.drop("signs", "runs", "k")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(word, before, after, path, candidate, name, label): findings of known origin, made by rule from hashes of a row number."""
    digest = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), F.col("id").cast("string")), 256)
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(words))) + 1).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex(digest("b"))), "[=\n]", "")
    upper = F.upper(F.translate(F.regexp_replace(b64, "[+/]", "Q"), "018", "ABC"))
    filler = pick("the and in order mon der les para house it was then".split(), "f")
    word = lambda k: pick(DICTIONARY.split(), k)
    number = F.substring(F.conv(F.substring(digest("n"), 1, 14), 16, 10), 1, 16)
    secret = "password passwd secret token api_key auth_token access_key pwd client_secret".split()
    other = "commit sha1 checksum revision md5 digest build etag".split()
    quote, sign = pick(["", '"', "'"], "q"), pick(["=", ":", " = ", ": "], "s")
    assigned = lambda names, value: F.concat(pick(names, "k"), sign, quote, value, quote)
    hexes = lambda lo, hi: F.substring(digest("h"), F.lit(1), (F.lit(lo) + F.pmod(F.xxhash64(F.lit("l"), "id"), F.lit(hi - lo + 1))).cast("int"))
    joint = pick(["-", "_", "/", "."], "j")
    short = F.substring(F.regexp_replace(b64, "[+/]", "x"), F.lit(1), (F.lit(8) + F.pmod(F.xxhash64(F.lit("m"), "id"), F.lit(10))).cast("int"))
    letters = F.substring(F.regexp_replace(b64, "[0-9+/]", ""), 1, 16)
    cases = [
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16))),
        (1, assigned(secret, hexes(16, 48)), hexes(16, 48)),
        (1, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "x"), 1, 36))),
        (1, assigned(secret, b64), b64),
        (1, assigned(secret, hexes(12, 24)), hexes(12, 24)),
        (1, F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(b64, "[+/]", "7"), 1, 24))),
        (1, assigned(secret, short), short),
        (1, assigned(secret, letters), letters),
        (1, F.concat(F.lit("postgres://"), word("1"), F.lit(":"), short, F.lit("@"), word("2"), F.lit(".example.com/db")), short),
        (1, F.concat(word("1"), F.lit(":"), hexes(16, 48), F.lit("@"), word("2"), F.lit(".example.com")), hexes(16, 48)),
        (0, F.concat(pick(["mailto", "email", "from"], "o"), F.lit(":"), word("1"), F.lit("."), F.substring(number, 1, 4), F.lit("@mail."), word("2"), F.lit(".example.com"))),
        (0, F.concat(pick(other, "o"), F.lit(" "), hexes(32, 40))),
        (0, F.concat(pick(other, "o"), F.lit(":"), hexes(32, 64))),
        (0, F.concat_ws("-", F.substring(digest("u"), 1, 8), F.substring(digest("u"), 9, 4), F.substring(digest("u"), 13, 4), F.substring(digest("u"), 17, 4), F.substring(digest("u"), 21, 12))),
        (0, F.concat(word("1"), joint, word("2"), joint, word("3"), joint, F.substring(number, 1, 4))),
        (0, number),
        (0, assigned(secret, F.concat_ws("_", F.lit("your"), word("1"), word("2"), F.lit("1234")))),
        (0, F.concat(F.lit("AKIAIOSFODNN7"), F.lit("EXAMPLE"))),
        (0, F.concat(F.lit("https://www."), word("1"), F.lit(".example.com/"), word("2"), F.lit("/"), F.substring(number, 1, 8))),
        (0, F.concat(word("1"), F.initcap(word("2")), F.initcap(word("3")), F.substring(number, 1, 2))),
        (0, assigned("date time updated size width".split(), F.concat(F.lit("2024-11-"), F.substring(number, 1, 2), F.lit("T10.20.30")))),
        (0, F.concat(word("1"), F.lit("."), F.substring(number, 1, 2), F.lit("@mail."), word("2"), F.lit(".example.com"))),
        (0, F.concat_ws("-", F.lit("555"), F.substring(number, 1, 4), F.substring(number, 5, 4))),
        (0, F.concat(F.lit("2024"), pick(["-", "/", "."], "d"), F.substring(number, 1, 2), pick(["-", "/", "."], "d"), F.substring(number, 3, 2))),
        (0, F.concat_ws(".", F.substring(number, 1, 3), F.substring(number, 4, 3), F.substring(number, 7, 2), F.substring(number, 9, 2))),
        (0, assigned(["note", "title", "see", "password", "key", "from"], F.concat(word("1"), pick(["", "-", "_"], "j"), word("2")))),
        (0, F.concat(word("1"), pick(["", "-", "_", "."], "j"), word("2"), F.substring(number, 1, 2))),
        (0, F.concat(pick(["order", "invoice", "ticket", "page", "id"], "o"), pick([" ", ": ", "=", ":"], "s"), F.substring(number, F.lit(1), (F.lit(8) + F.pmod(F.col("id"), F.lit(8))).cast("int")))),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(cases)))
    # of a finding's candidates only the secret itself is one
    text, secret_value = F.lit(""), F.lit("")
    for i, (y, whole, *value) in enumerate(cases):
        text = F.when(kind == i, whole).otherwise(text)
        secret_value = F.when(kind == i, (value or [whole])[0] if y else F.lit("")).otherwise(secret_value)
    rows = spark.range(n).select(F.concat_ws(" ", filler, filler, text, filler).alias("text"), secret_value.alias("secret"), pick(["", "src0", "app/main", "docs/guide", "tests/unit", "web"], "p").alias("source"), F.col("id").alias("doc_id"))
    found = candidates(rows)
    found = found.join(rows.select("doc_id", "secret"), "doc_id").withColumn("label", (F.col("candidate") == F.col("secret")).cast("int"))
    return found.drop("doc_id", "word_index", "secret")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest on labelled findings (candidate, name, before, after, path, label); their number is the caller's bound."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(rows.select("features", F.col("label").cast("double").alias("label")).repartition(4))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", model: RandomForestClassificationModel | None = None) -> DataFrame:
    """doc_id, word_index, candidate, probability and is_secret of every candidate."""
    model = model or train(labelled_findings(df.sparkSession))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(df, id_col, text_col, path_col)))
    judged = model.transform(rows).withColumn("probability", F.element_at(vector_to_array("probability"), 2))
    return judged.select("doc_id", "word_index", "candidate", "probability", (F.col("probability") >= THRESHOLD).alias("is_secret"))
