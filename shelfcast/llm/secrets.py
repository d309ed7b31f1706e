"""Secret scan: values cut out of the text as candidates, and a random forest that removes false
positives.

All of it is DataFrame work: candidates and features are built-in expressions, the forest is
Spark's own and is fitted and applied by its DataFrame API.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.storage import staged

#: Characters of the shortest value that is a candidate without a secret's name.
SHORTEST = 16
#: Labelled findings of each label that the forest is fitted on, about.
SAMPLE = 20_000
#: Planted findings of each form, and words of the documents they are planted among.
PLANTED, NEIGHBOURS = 400, 400
TREES, DEPTH, SEED = 30, 8, 7
THRESHOLD = 0.5

# Parts of the names of secrets, and words beside look-alikes.
SECRET_PARTS = [
    "token", "secret", "password", "passwd", "passphrase", "pass", "pwd", "key", "apikey", "accesskey", "secretkey",
    "auth", "authorization", "bearer", "credential", "credentials",
]
HARMLESS_PARTS = [
    "example", "sample", "test", "dummy", "placeholder", "commit", "sha", "sha1", "sha256", "md5", "checksum",
    "digest", "etag", "uuid", "guid", "revision", "isbn", "doi", "public", "id", "version", "path", "file",
]
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
FEATURES = [
    "length", "digits", "upper", "lower", "runs", "distinct", "hexadecimal", "likelihood", "coverage", "path",
    "separators", "secret_word", "harmless_word", "assigned", "quoted", "prefix", "grouped", "secret_near",
    "harmless_near", "repeats", "is_name",
]

#: A parameter of an address begins a new piece.
_PARAMETER = "[&?](?=[A-Za-z0-9_.\\-]{1,64}=)"
#: A piece is a sign of assignment, or a run without white space, quotes, commas and signs.
_PIECE = "[=:]+>?|[\"'`]?[^\\x20\\x09-\\x0D\"'`,;=:]+[\"'`]?"
_OUTSIDE = "^[\"'`(\\[{<*#|]+|[\"'`)\\]}>*#|.]+$"


def _one_of(parts: Sequence[str]) -> str:
    """Pattern of normalised names that have one of the parts."""
    return f"(?:^|_)(?:{'|'.join(parts)})[0-9]*(?:_|$)"


def normalised(name: Column) -> Column:
    """A name's parts in lower case with one ``_`` between them; capitals begin a part."""
    parts = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(F.regexp_replace(parts, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _sign(piece: Column) -> Column:
    return piece.startswith("=") | piece.startswith(":")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, raw, value, key, assigned, before, after): values that may be secrets.

    Texts are cut into pieces at white space, quotes, commas, semicolons, ``=``, ``:`` and the ``&``
    or ``?`` before a parameter of an address; position counts pieces from 0. Candidates are all
    values whose key is a secret's name, whatever their length, the password of an address, and
    all others from ``SHORTEST`` characters on. key is the name, normalised, that the value is
    assigned to, or the word before it. An unquoted value ends where one of the signs above does, so
    ``=`` at the end of a coded value isn't part of it.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    pieces = F.regexp_extract_all(F.regexp_replace(text, _PARAMETER, " "), F.lit(_PIECE), F.lit(0))
    secret = _one_of(SECRET_PARTS)

    def at(i: Column) -> Column:
        return F.coalesce(F.get("w", i), F.lit(""))

    def address(i: Column) -> Column:
        return (at(i - 1) == ":") & at(i - 2).startswith("//") & at(i).contains("@")

    def scheme(i: Column) -> Column:
        return _sign(at(i - 2)) & F.lower(at(i - 1)).isin("bearer", "basic")

    def wanted(i: Column) -> Column:
        named = _sign(at(i - 1)) & (address(i) | normalised(at(i - 2)).rlike(secret))
        return ~_sign(at(i)) & ((F.length(at(i)) >= SHORTEST) | named | scheme(i))

    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), wanted)
    near = F.transform(
        places, lambda i: F.struct(
            i.alias("position"), at(i).alias("raw"),
            F.when(address(i), "password").when(scheme(i) | _sign(at(i - 1)), at(i - F.when(scheme(i), 1).otherwise(2)))
            .otherwise(at(i - 1)).alias("key"),
            (scheme(i) | _sign(at(i - 1))).alias("assigned"), address(i).alias("address"),
            F.concat_ws(" ", at(i - 4), at(i - 3), at(i - 2), at(i - 1)).alias("before"), at(i + 1).alias("after"),
        )
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), pieces.alias("w")).select("id", F.inline(near))
    bare = F.regexp_replace("raw", _OUTSIDE, "")
    rows = rows.withColumn("value", F.when(F.col("address"), F.regexp_extract("raw", "^([^@/]*)@", 1)).otherwise(bare))
    rows = rows.withColumn("key", normalised(F.col("key")))
    long_enough = (F.length("value") >= SHORTEST) | (F.col("assigned") & F.col("key").rlike(secret))
    return rows.where((F.col("value") != "") & long_enough).drop("address")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): all words of all documents; runs that hold digits or ``_`` are no words."""
    runs = F.explode(F.split(F.lower(F.col(f"`{text_col}`")), "[^a-zà-öø-ÿ0-9_]+"))
    words = docs.select(runs.alias("word")).where((F.length("word") >= 2) & ~F.col("word").rlike("[0-9_]"))
    return staged(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")


def transitions(words: DataFrame) -> list[float]:
    """Log-probability of each character given the one before, over all words by their counts.

    What comes to the driver are the sums of the alphabet's pairs."""
    pairs = F.explode(
        F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    )
    sums = words.select(pairs.alias("pair"), "n").where(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").agg(F.sum("n").alias("n"))
    size = len(_ALPHABET)
    counts = [[1.0] * size for _ in range(size)]
    for r in sums.collect():
        counts[_ALPHABET.index(r["pair"][0])][_ALPHABET.index(r["pair"][1])] += r["n"]
    return [math.log(c / sum(row)) for row in counts for c in row]


def with_coverage(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Adds coverage: the share of a value's characters in words of the documents, each word
    weighing by the logarithm of its count against that of the most frequent one.

    Every distinct value is looked up once, whatever the number of its rows."""
    most = words.agg(F.max("n")).first()[0] or 1
    values = rows.select("value").distinct()
    pieces = F.explode(F.filter(F.split(F.lower("value"), "[^a-zà-öø-ÿ]+"), lambda x: F.length(x) >= 3))
    weight = F.length("word") * F.log("n") / F.lit(math.log(max(most, 2)))
    known = values.select("value", pieces.alias("word")).join(words, "word").groupBy("value").agg(F.sum(weight).alias("__c"))
    coverage = F.coalesce("__c", F.lit(0.0)) / F.length("value")
    return rows.join(known, "value", "left").withColumn("coverage", coverage).drop("__c")


def _share(pattern: str) -> Column:
    """Share of a value's characters that are left when those of the pattern are taken out."""
    return F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


def with_features(rows: DataFrame, words: DataFrame, likelihoods: list[float]) -> DataFrame:
    size = len(_ALPHABET)
    places = F.filter(F.transform(F.split(F.lower("value"), ""), lambda c: F.instr(F.lit(_ALPHABET), c)), lambda p: p > 0)
    rows = with_coverage(rows, words).withColumn("places", places)
    rows = rows.withColumn("table", F.array(*[F.lit(x) for x in likelihoods]))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("places") - 1, F.lit(1))),
        lambda i: F.coalesce(
            F.get("table", (F.get("places", i - 1) - 1) * size + F.get("places", i) - 1), F.lit(math.log(1 / size))
        ),
    )
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    flag = lambda condition: condition.cast("double")
    near = normalised(F.concat_ws(" ", "before", "after"))
    return rows.withColumns({
        "length": F.length("value").cast("double"), "digits": _share("[^0-9]"), "upper": _share("[^A-Z]"),
        "lower": _share("[^a-z]"), "runs": F.length(kinds) / F.length("value"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "hexadecimal": flag(F.col("value").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "likelihood": F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("places"), F.lit(1)),
        "path": flag(F.col("value").rlike("[/\\\\].*[/\\\\]|\\.[A-Za-z]{2,5}$|@|//")),
        "separators": _share("[A-Za-z0-9]"),
        "secret_word": flag(F.col("key").rlike(_one_of(SECRET_PARTS))),
        "harmless_word": flag(F.col("key").rlike(_one_of(HARMLESS_PARTS))),
        "assigned": flag(F.col("assigned")), "quoted": flag(F.col("raw").rlike("[\"'`]")),
        "prefix": flag(F.col("value").rlike("^[A-Za-z]{2,5}[_\\-]?[A-Za-z0-9]{12,}$")),
        "grouped": flag(F.col("value").rlike("^[0-9A-Za-z]{8}-[0-9A-Za-z]{4}-|^[0-9]{1,4}[-.][0-9]{1,3}[-.]")),
        "secret_near": flag(near.rlike(_one_of(SECRET_PARTS))), "harmless_near": flag(near.rlike(_one_of(HARMLESS_PARTS))),
        "is_name": flag(F.col("after").rlike("^[=:]") & ~F.col("raw").contains("@")),
        "repeats": flag(F.col("value").rlike("(.)\\1{3}|^[$%<{]")),
    }).drop("places", "table")


# Names that planted findings are assigned to, and the values that stand in for secrets.
_NAMES = [
    "password", "db_password", "PASSWORD", "passwd", "pwd", "userPassword", "token", "access_token", "authToken", "API_TOKEN",
    "api_key", "apiKey", "API_KEY", "AWS_SECRET_ACCESS_KEY", "secret", "client_secret", "clientSecret", "private_key",
    "auth", "credentials",
]
_OTHER_NAMES = [
    "commit", "sha256", "checksum", "md5", "digest", "etag", "id", "request_id", "user", "file", "path", "title", "version",
    "color", "name", "revision", "build", "url",
]
_STAND_INS = [
    "changeme", "your_token_here", "xxxxxxxxxxxxxxxx", "${TOKEN}", "$PASSWORD", "<password>", "required", "null", "none", "true",
    "********", "os.environ", "settings.api_key", "YOUR_API_KEY", "example", "****************", "REPLACE_ME", "getPassword()",
]
#: How a name and its value are written: what stands between them, and what ends the value.
_WRITTEN = [("=", ""), (" = \"", "\""), (": ", ""), ("\":\"", "\""), ("='", "'"), (" = ", ""), (": \"", "\"")]


def planted(spark: SparkSession, words: DataFrame, seed: int = SEED) -> DataFrame:
    """(text, value, label): labelled findings, ``PLANTED`` of each form, among the documents' words.

    The label tells how the value was made and isn't derived from its look: 1 for values drawn at
    random as secrets are (hex, mixed letters and digits, coded bytes, edited words, keys with a
    prefix, signed tokens, passwords of addresses), 0 for words, names, paths, addresses, numbers,
    digests and stand-ins. Values drawn at random are assigned to a secret's name or stand alone;
    so do look-alikes.
    """
    neighbours = [r["word"] for r in words.orderBy(F.xxhash64("word", F.lit(seed)), "word").limit(NEIGHBOURS).collect()]
    neighbours = neighbours or HARMLESS_PARTS

    def draw(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed * 1000 + salt)), F.lit(n)).cast("int")

    def choice(values: Sequence[str], salt: int) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), draw(len(values), salt))

    def word(number: int) -> Column:
        return F.get("words", F.lit(number))

    noise, coded, mixed, digits = (F.col(c) for c in ("noise", "coded", "mixed", "digits"))

    def cut(text: Column, low: int, high: int, salt: int, start: int = 1) -> Column:
        return F.substring(text, F.lit(start), F.lit(low) + draw(high - low + 1, salt))

    hexadecimal = F.substring(noise, F.lit(1), F.get(F.array(F.lit(32), F.lit(40), F.lit(64)), draw(3, 1)))
    short_hex = cut(noise, 16, 24, 2)
    edited = F.concat(
        F.translate(F.initcap(word(3)), "aeio", "4310"), cut(digits, 1, 4, 4), F.concat(choice("!&#%+*-_", 5), cut(mixed, 0, 3, 6))
    )
    uuid = F.concat_ws("-", *[F.substring(noise, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    joined = lambda sign, n: F.concat_ws(sign, *[word(i) for i in range(n)])
    path = F.concat(choice(["/", "./", "C:\\", "src/"], 7), joined("/", 3), choice([".txt", ".py", ".json", ""], 8))
    camel = F.concat(word(0), F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)))
    jwt = F.concat(F.lit("eyJ"), cut(mixed, 20, 40, 13), F.lit("."), cut(mixed, 30, 60, 14, 40), F.lit("."), cut(mixed, 20, 43, 15, 90))
    named, other, free = "named", "other", "free"
    forms = [
        (1, named, hexadecimal), (1, named, short_hex), (1, named, cut(mixed, 16, 40, 30)), (1, named, cut(mixed, 8, 15, 31)),
        (1, named, cut(F.regexp_replace(coded, "=", ""), 24, 64, 32)), (1, named, edited), (1, named, uuid), (1, named, jwt),
        (1, free, F.concat(F.lit("AKIA"), F.upper(cut(mixed, 16, 16, 33)))), (1, free, cut(mixed, 30, 44, 34)), (1, free, jwt),
        (1, free, F.concat(choice(["ghp_", "sk_", "xoxb-", "pk-", "glpat-", "npm_"], 35), cut(mixed, 24, 36, 36))),
        (1, "bearer", F.when(draw(2, 37) == 0, jwt).otherwise(cut(mixed, 20, 44, 38))), (1, "address", cut(mixed, 10, 20, 39)),
        (1, "address", edited), (0, named, word(0)), (0, named, choice(_STAND_INS, 41)), (0, named, joined("_", 3)),
        (0, named, joined(".", 3)), (0, named, path), (0, named, cut(digits, 1, 3, 42)), (0, named, camel), (0, other, hexadecimal),
        (0, other, uuid), (0, other, word(1)), (0, other, path), (0, other, short_hex), (0, free, hexadecimal), (0, free, uuid),
        (0, free, path), (0, free, F.concat(joined(".", 2), cut(digits, 0, 4, 44), F.lit("@"), joined("-", 2), F.lit(".com"))),
        (0, free, F.concat(F.lit("www."), joined("-", 2), F.lit(".com/"), joined("/", 2), cut(digits, 0, 8, 45))),
        (0, free, cut(digits, 16, 24, 46)), (0, free, joined("-", 4)), (0, free, joined("_", 4)), (0, free, camel),
        (0, free, F.upper(joined("_", 3))), (0, free, F.concat(F.upper(joined("_", 2)), choice(["_KEY", "_TOKEN", "_SECRET", "_ID"], 51))),
        (0, free, F.concat(joined("", 3), choice(["%%%", "&&&", "###", "$$$", "***", ")...", "!!!"], 47))),
        (0, free, F.concat_ws("-", cut(digits, 4, 4, 48), F.lit("11"), F.lit("23T10"), cut(digits, 8, 12, 49))),
        (0, "sample", cut(mixed, 16, 40, 50)), (0, "name", F.upper(joined("_", 3))), (0, "name", joined("_", 3)),
        (0, "name", F.concat(F.upper(word(0)), choice(["_SECRET_KEY", "_ACCESS_TOKEN", "_PASSWORD", "_CREDENTIALS"], 52))), (0, "name", camel),
    ]
    written = draw(len(_WRITTEN), 60)
    between, end = (F.get(F.array(*[F.lit(w[side]) for w in _WRITTEN]), written) for side in (0, 1))
    context = (
        F.when(F.col("context") == named, F.concat(choice(_NAMES, 61), between, F.col("value"), end))
        .when(F.col("context") == other, F.concat(choice(_OTHER_NAMES, 62), between, F.col("value"), end))
        .when(F.col("context") == "sample", F.concat(choice(["example", "sample", "dummy", "placeholder"], 63), between, F.col("value"), end))
        .when(F.col("context") == "bearer", F.concat(F.lit("Authorization: Bearer "), F.col("value")))
        .when(F.col("context") == "address", F.concat(choice(["postgres", "https", "amqp"], 64), F.lit("://"), word(4), F.lit(":"), F.col("value"), F.lit("@db."), word(5), F.lit(".com/x")))
        .when(F.col("context") == "name", F.concat(F.col("value"), between, word(5), end))
        .otherwise(F.col("value"))
    )
    text = F.concat_ws(" ", word(6), word(7), word(8), context, word(9))
    # names and noise are written first, which keeps the expressions of the forms small
    table = F.array(*[F.lit(w) for w in neighbours])
    rows = spark.range(0, len(forms) * PLANTED, numPartitions=8).withColumn("table", table).select(
        "id", (F.col("id") % len(forms)).alias("form"),
        F.sha2(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary"), 512).alias("noise"),
        F.transform(
            F.sequence(F.lit(0), F.lit(9)),
            lambda i: F.get("table", F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(len(neighbours))).cast("int")),
        ).alias("words"),
    )
    rows = rows.withColumn("coded", F.base64(F.unhex(F.concat("noise", F.sha2(F.col("noise").cast("binary"), 512)))))
    rows = rows.withColumns({"mixed": F.regexp_replace("coded", "[^A-Za-z0-9]", ""), "digits": F.regexp_replace("noise", "[a-f]", "")})
    values = staged(rows, "secret-noise")
    value = F.coalesce(*[F.when(F.col("form") == i, v) for i, (_, _, v) in enumerate(forms)])
    kind, label = (F.get(F.array(*[F.lit(f[side]) for f in forms]), F.col("form").cast("int")) for side in (1, 0))
    values = staged(values.withColumns({"value": value, "context": kind, "label": label.cast("double")}), "secret-values")
    return staged(values.select(text.alias("text"), "value", "label"), "secret-planted")


def labelled(findings: DataFrame, words: DataFrame, likelihoods: list[float]) -> DataFrame:
    """Features and label of (text, value, label): the candidates of each text that are its value."""
    lines = findings.select(F.struct("text", "value", "label").alias("line"), "text")
    rows = candidates(lines, "line").where("value = id.value")
    return with_features(rows.withColumn("label", F.col("id.label").cast("double")), words, likelihoods)


def fit(findings: DataFrame) -> RandomForestClassificationModel | None:
    """A forest from findings with features and ``label``. Of each label about ``SAMPLE`` rows are
    used, drawn by the hash of their value. Without one of the labels there is no forest."""
    counts = {int(r["label"]): r["count"] for r in findings.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1, F.lit(SAMPLE / counts[1])).otherwise(F.lit(SAMPLE / counts[0]))
    chance = F.pmod(F.xxhash64("value", "key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = findings.where(chance < share).select("label", *FEATURES)
    # both labels weigh the same
    sample = sample.withColumn("weight", F.when(F.col("label") == 1, 1.0 / min(counts[1], SAMPLE)).otherwise(1.0 / min(counts[0], SAMPLE)) * SAMPLE)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(sample)
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED
    ).fit(staged(assembled.select("features", "label", "weight"), "secret-sample"))


def scored(rows: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """Rows with features: probability and is_secret added. Without a forest nothing is removed."""
    if forest is None:
        return rows.withColumn("probability", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows)
    out = forest.transform(assembled).withColumn("probability", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "prediction").withColumn("is_secret", F.col("probability") >= THRESHOLD)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate: id, position, key, value, probability, is_secret.

    Every piece of every text is looked at. The forest is fitted on ``findings`` (text, value,
    label), or on ``planted`` ones. Word counts and character transitions are over all documents.

    Null and empty texts have no candidate; ids may be null or repeat, each row is scanned by
    itself; other columns are not looked at; an empty table gives none.
    """
    words = word_counts(docs, text_col)
    likelihoods = transitions(words)
    if findings is None:
        findings = planted(docs.sparkSession, words)
    forest = fit(staged(labelled(findings, words, likelihoods), "secret-findings"))
    rows = staged(candidates(docs, id_col, text_col), "secret-candidates")
    return scored(with_features(rows, words, likelihoods), forest).select(
        F.col("id").alias(id_col), "position", "key", "value", "probability", "is_secret"
    )
