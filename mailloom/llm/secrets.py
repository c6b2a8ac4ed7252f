"""Secret scans with a random forest against false positives, in DataFrame operations only.

Candidates are long runs of key characters, values of any length after an assigned key word
or `bearer`, and the password in the user info of a URL. Each has whole-number features:
length, character classes and their changes, coverage by dictionary words and by common
letter pairs, path marks, and words beside it. A random forest trained on labelled findings
says which are secrets.

The dictionary is the DICTIONARY most frequent words of all texts, with some words of
configuration files. Where no labelled findings are given, the training rows are all seeds
made by rule and at most LABELLED_ROWS different candidates of each label whose neighbourhood
decides, so neither copies nor the size of the input change the balance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailloom.llm.common import kept

KEY_WORD = "token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|bearer|credential|private.?key"
LONG_RUN = r"[A-Za-z0-9_+/\-]{20,}={0,2}"
VALUE = r"[^\s\"'`]*[^\s\"'`.,;:!?()\[\]{}<>]"
# The short look back comes first, so that the long one is tried behind an assignment only.
ASSIGNED = (r"(?<=[:=>][ \t]{0,4}[\"'`]?)(?<=(?i:" + KEY_WORD + r")[\w.\-]{0,24}[\"'`]?[ \t]{0,4}(?:=>|:=|[:=])"
            r"[ \t]{0,4}[\"'`]?)" + VALUE)
BEARER = r"(?<=[ \t])(?<=(?i:bearer)[ \t])" + VALUE
USER_INFO = r"(?<=:)(?<=://[^\s/@:]{1,64}:)[^\s/@]+(?=@)"
CANDIDATE = "|".join([USER_INFO, ASSIGNED, BEARER, LONG_RUN])
BESIDE = 80  # characters beside a candidate that its features see
LABELLED_ROWS = 5_000
DICTIONARY = 5_000
TREES = 30
MASK = "[SECRET]"

# Frequent letter pairs of running text.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro"
    " ic ne ea ra ce li ch ll be ma si om ur ie ei nn ss un ge ic us el la os ue qu ui eu pa tr so ad do ci"
).split()

# Words that stand for a secret, or beside one, in configuration files.
CONFIGURED = (
    "required optional none null true false undefined empty unset missing default enabled disabled expired invalid"
    " valid basic digest bearer token secret password key user name your here value string env config environ get set"
    " the and for not with from this that must see change example sample dummy placeholder redacted hidden file path"
).split()

FEATURES = ["n", "digits", "uppers", "lowers", "signs", "changes", "distinct", "slashes", "pairs", "words", "hex",
            "key_word", "assigned", "quoted", "path_before", "user_info", "stand_in", "example"]


def _letters(text: Column) -> Column:
    """Runs of letters in lower case; a change from lower to upper case ends a run."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]+"), F.lit(0))


def dictionary(docs: DataFrame, words: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters and more, over all texts; of equals the first by name."""
    every = docs.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word"))
    counts = every.filter(F.char_length("word").between(3, 20)).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return sorted({r.word for r in top.collect()} | set(CONFIGURED))


def features(known: list[str]) -> dict[str, Column]:
    """Of columns candidate, before, after; shares are in hundredths."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.char_length(c)
    left = lambda pattern: n - F.char_length(F.regexp_replace(c, pattern, ""))
    share = lambda k: F.floor(F.lit(100) * k / n)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[a-z]+", "\x01"), "[A-Z]+", "\x02"), "[0-9]+", "\x03")
    two = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                                    lambda i: F.substr(F.lower(c), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    covered = F.aggregate(F.filter(_letters(c), lambda w: w.isin(known)), F.lit(0), lambda a, w: a + F.char_length(w))
    return {
        "n": n, "digits": share(left("[0-9]+")), "uppers": share(left("[A-Z]+")),
        "lowers": share(left("[a-z]+")), "signs": share(left("[^A-Za-z0-9]+")),
        "changes": share(F.char_length(classes) - 1),
        "distinct": share(F.size(F.array_distinct(F.split(c, "")))), "slashes": left("/+"),
        "pairs": share(F.size(F.filter(two, lambda x: x.isin(PAIRS)))), "words": share(covered),
        "hex": c.rlike("^[0-9a-f]+$").cast("int"),
        "key_word": F.lower(before).rlike("(" + KEY_WORD + ")").cast("int"),
        "assigned": before.rlike("([=:]\\s*|=>\\s*)[\"'`]?$").cast("int"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("int"),
        "path_before": before.rlike("(://|\\.|/)\\S*$").cast("int"),
        "user_info": (before.rlike("://[^\\s/@:]+:$") & after.rlike("^@")).cast("int"),
        "stand_in": c.rlike("^([$%<{*]|x{3,}|X{3,}|-{2,})|[(\\[]").cast("int"),
        "example": F.lower(F.concat(before, after)).rlike("(example|sample|dummy|placeholder|commit|sha1|md5|checksum)").cast("int"),
    }


def _row_key() -> Column:
    """128 bits of a row's text and id; equal rows have equal findings."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.col("doc_id").cast("string"), "text")))


def candidates(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, nth, start, candidate, before, after) of each candidate, by place.

    Only texts with a candidate are split. Null and empty texts have none.
    """
    held = docs.select("doc_id", _row_key().alias("row_key"), "text").filter(
        F.col("text").rlike(CANDIDATE))
    parts = held.select("row_key", "doc_id", F.split("text", CANDIDATE).alias("parts"),
                        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    # Places: the lengths of all parts and candidates before.
    ends = F.aggregate(
        F.arrays_zip(F.col("parts").alias("p"), F.col("found").alias("f")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["p"]) + F.coalesce(F.char_length(x["f"]), F.lit(0))).alias("at"),
            F.concat(a["starts"], F.array(a["at"] + F.char_length(x["p"]))).alias("starts")),
        lambda a: a["starts"])
    placed = parts.withColumn("starts", ends)
    return placed.select("row_key", "doc_id", "parts", "starts", F.posexplode("found").alias("nth", "candidate")).select(
        "row_key", "doc_id", "nth", F.get("starts", F.col("nth")).alias("start"), "candidate",
        F.right(F.get("parts", F.col("nth")), F.lit(BESIDE)).alias("before"),
        F.left(F.get("parts", F.col("nth") + 1), F.lit(BESIDE)).alias("after"))


def seed_findings(spark: SparkSession, rows: int = 200) -> DataFrame:
    """Labelled findings (candidate, before, after, label) by rule: keys and passwords of several kinds
    that are assigned or in a URL; and long words, paths, sums of commits, stand-ins and plain words."""
    i = F.col("id").cast("string")
    word = F.translate(F.substr(F.md5(i), F.lit(1), F.lit(4) + F.pmod(F.col("id"), F.lit(5)).cast("int")),
                       "0123456789abcdef", "thernandostilemo")
    digits = F.pmod(F.hash("id"), F.lit(9973)).cast("string")
    mark = F.substr(F.lit("!@#$%&*+?_"), F.pmod(F.col("id"), F.lit(10)).cast("int") + 1, F.lit(1))
    of = lambda texts: F.get(F.lit(texts), F.pmod(F.col("id"), F.lit(len(texts))).cast("int"))
    key = of(['password = "', "password: ", 'token = "', "secret=", "api_key: ", "pwd=", "auth_token => '", "DB_PASSWORD="])
    after = F.regexp_extract(key, "[\"']$", 0)
    kinds = F.array(
        *[F.struct(c.alias("candidate"), (b if isinstance(b, Column) else F.lit(b)).alias("before"),
                   (a if isinstance(a, Column) else F.lit(a)).alias("after"), F.lit(y).alias("label")) for c, b, a, y in (
            (F.sha1(i), 'the token = "', '" and', 1.0),
            (F.substr(F.base64(F.unhex(F.sha2(i, 256))), F.lit(1), F.lit(40)), "secret: ", " then", 1.0),
            (F.concat(F.lit("AKIA"), F.upper(F.substr(F.md5(i), F.lit(1), F.lit(16)))), "api_key=", "", 1.0),
            (F.concat(F.lit("ghp_"), F.substr(F.base64(F.unhex(F.sha1(i))), F.lit(1), F.lit(24))), "password '", "'", 1.0),
            (F.concat(F.initcap(word), mark, digits), key, after, 1.0),
            (F.concat(F.translate(word, "aeos", "4305"), mark, F.substr(F.sha1(i), F.lit(1), F.lit(3))), key, after, 1.0),
            (F.substr(F.sha1(i), F.lit(1), F.lit(8) + F.pmod(F.col("id"), F.lit(9)).cast("int")), key, after, 1.0),
            (F.substr(F.base64(F.unhex(F.md5(i))), F.lit(1), F.lit(10) + F.pmod(F.col("id"), F.lit(9)).cast("int")), key, after, 1.0),
            (F.concat(word, digits, F.reverse(word)), F.concat(F.lit("postgres://"), F.reverse(word), F.lit(":")), "@host/db", 1.0),
            (F.concat(F.initcap(word), mark, digits), "see https://admin:", "@example.org/x", 1.0),
            (F.base64(F.unhex(F.sha1(i))), "Authorization: Bearer ", "", 1.0),
            (of(CONFIGURED), key, after, 0.0),
            (F.concat(of(CONFIGURED), of([".", "_", "-", " "]), F.reverse(F.lit("yek"))), key, after, 0.0),
            (F.concat(F.lit("${"), F.upper(word), F.lit("}")), key, after, 0.0),
            (F.concat(F.lit("<"), word), key, after, 0.0),
            (F.repeat(of(["*", "x", "X", "-", "."]), F.lit(8)), key, after, 0.0),
            (F.concat(F.lit("os.environ["), word), key, after, 0.0),
            (F.concat(F.lit("get_"), word, F.lit("()")), key, after, 0.0),
            (word, key, after, 0.0),
            (F.pmod(F.col("id"), F.lit(50)).cast("string"), key, after, 0.0),
            (F.sha1(i), "see commit ", " in the log", 0.0),
            (F.md5(i), "md5 of the file ", "", 0.0),
            (F.translate(F.sha1(i), "0123456789abcdef", "thernandostilemo"), "and then ", " was", 0.0),
            (F.concat(F.lit("/usr/share/"), F.translate(F.md5(i), "0123456789", "aeioustrnl")), "in ", ".", 0.0),
            (F.repeat(F.substr(F.lit("-_=+"), F.pmod(F.col("id"), F.lit(4)).cast("int") + 1, F.lit(1)), F.lit(30)), "", "", 0.0),
        )])
    return spark.range(rows).select(F.inline(kinds))


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings (with features) whose neighbourhood decides: long, assigned to a key word and with
    digits; or letters only without one, or plain words of the dictionary."""
    label = F.when((F.col("key_word") + F.col("assigned") == 2) & (F.col("digits") >= 10) & (F.col("example") == 0)
                   & (F.col("n") >= 16), 1.0).when(
        (F.col("lowers") >= 95) & (F.col("key_word") == 0) | (F.col("words") >= 95), 0.0)
    return found.withColumn("label", label).filter("label IS NOT NULL").select("candidate", "before", "after", "label")


def labelled_rows(seeds: DataFrame, weak: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """All seeds, and for each label at most `rows` different weak ones of the smallest hash."""
    different = kept(weak.distinct(), "weak")
    order = F.xxhash64("candidate", "before", "after")
    few = [different.filter(F.col("label") == y).orderBy(order, "candidate", "before", "after").limit(rows)
           for y in (0.0, 1.0)]
    return reduce(DataFrame.unionByName, few, seeds.distinct())


def train(labelled: DataFrame, known: list[str]) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, before, after, label), whose number is bounded."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        labelled.filter("candidate <> ''").withColumns(features(known)))
    return RandomForestClassifier(numTrees=TREES, maxDepth=8, seed=11, maxMemoryInMB=64).fit(
        kept(vectors.select("features", "label"), "vectors"))


def findings(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(row_key, doc_id, nth, start, length, candidate, probability, secret) of each candidate.

    `start` counts characters from 0. Without `labelled` the seeds and the candidates that
    `weak_labels` decides are the training rows. Repeated rows of `docs` give equal findings,
    a null doc_id stays null. An empty table gives none. Other columns are not read.
    """
    known = dictionary(docs)
    found = kept(candidates(docs).withColumns(features(known)), "candidates")
    if labelled is None:
        labelled = labelled_rows(seed_findings(docs.sparkSession), weak_labels(found))
    model = train(labelled, known)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    p = F.round(vector_to_array("probability")[1], 6)
    return scored.select("row_key", "doc_id", "nth", "start", F.char_length("candidate").alias("length"),
                         "candidate", p.alias("probability"), (p >= 0.5).alias("secret"))


def mask_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All rows and columns of `docs`, with MASK in place of each secret of a text."""
    flagged = kept(findings(docs, labelled).filter("secret").groupBy(F.col("row_key").alias("__row_key")).agg(
        F.collect_set("nth").alias("__nth")), "flagged")
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    shown = F.transform(found, lambda c, i: F.when(F.array_contains("__nth", i), F.lit(MASK)).otherwise(c))
    text = F.array_join(F.flatten(F.transform(
        F.arrays_zip(F.split("text", CANDIDATE).alias("p"), shown.alias("f")),
        lambda x: F.array(x["p"], F.coalesce(x["f"], F.lit(""))))), "")
    joined = docs.withColumn("__row_key", _row_key()).join(flagged, "__row_key", "left")
    return joined.withColumn("text", F.when(F.col("__nth").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)
