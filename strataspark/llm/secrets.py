"""Secret scan: candidates by pattern, false positives removed by a random forest. JVM expressions only.

A candidate is a run of 16 or more key characters that holds a digit, inside a word of the text (`candidates`), or
whatever is assigned to a secret word, stands as the password of a URL or fills a private-key block, of any length and
characters (`assigned`).
Its features are its length, its character classes and how often they change, how much of it dictionary words cover, whether it looks like
(or the text's path says) something other than a secret, and which words stand around it. The forest is trained from
labelled findings, which a rule makes from hashes (`labelled_findings`), through the same candidate and feature
expressions, and scored by Spark's own model transform.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm.common import columns_of, fresh, written

VALUE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: A text that holds no candidate has no match of this; tried once a run, so a very long run costs no more.
SUSPECT = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16}"
TREES, TREE_DEPTH, FINDINGS, SEED, THRESHOLD = 30, 6, 3000, 17, 0.5
MASK = "[SECRET]"

# Words whose presence in a value or beside it tells secrets from other strings.
DICTIONARY = (
    "account admin alpha android apple array backup base batch beta block board branch build button cache chain change "
    "channel check class client cloud code color column command commit common config content control core count data "
    "database debug default delete demo device document domain dummy element email engine entry error event example "
    "export field file filter final folder format frame function general global group handler header height hello home "
    "host image import index info input item job label layer layout level library line link list local login main "
    "manager market master member memory menu message method mobile model module monitor name network node note number "
    "object online option order output package page panel parent part path payload phone photo pipeline placeholder "
    "plugin point policy port prod product profile project property public query queue random record region release "
    "remote report request resource response result role root route row sample schema screen search section server "
    "service session setting shared size source staging start state static status step storage store stream string "
    "style system table target task team template test text theme thread time title topic total track tree type unit "
    "update upload user value version video view web widget width window word worker world your"
).split()
SECRET_WORDS = "token secret password passwd pwd credential apikey api_key access_key private auth bearer key"
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid guid revision order invoice tracking serial build phone card isbn session_id request_id trace example etag"
PATH_WORDS = "test tests spec example examples fixture fixtures sample docs mock"
FEATURES = (
    "length digits uppers lowers marks symbols changes distinct hexlike uuidlike dictionary slashes assigned "
    "secret_near other_near path_other prefix_known sequence"
).split()


def _one_of(words: str) -> str:
    return "|".join(sorted(words.split(), key=len, reverse=True))


#: What follows an assignment to a secret word, up to the quote or blank, the password of a URL, and the body of a
#: private-key block. Groups: 1, 6 and 8 what leads to the value, the others the value. Texts are matched with a line
#: end added.
ASSIGNED = (
    rf"((?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:{_one_of(SECRET_WORDS)})[A-Za-z0-9_\-]{{0,40}}+[\"'`\]]{{0,2}}+[ \t]*+"
    r"(?::=|=>|=|:)[ \t]*+(?:(?i:bearer|basic)[ \t]++)?)"
    r"(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|[\"'`]?([^\s\"'`]\S*?)[,;.)\]}\"'`]*\s)"
    r"|(://[^\s/:@]*:)([^\s/]+)@"
    r"|(-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)([^-]++(?:-(?!----)[^-]*+)*+)-----END"
)


#: In lower case each of SECRET_WORDS holds one of these.
_STEMS = "token secret passw pwd credential key private auth bearer".split()


def may_assign(text: Column) -> Column:
    """False only for texts without a match of ASSIGNED; plain searches, so that few texts are matched at all."""
    low = F.lower(text)
    stem = F.lit(False)
    for word in _STEMS:
        stem = stem | F.contains(low, F.lit(word))
    return F.coalesce((stem & (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))) | F.contains(text, F.lit("://")) | F.contains(text, F.lit("-----BEGIN ")), F.lit(False))


def has_assigned(text: Column) -> Column:
    return may_assign(text) & F.concat(text, F.lit("\n")).rlike(ASSIGNED)


def candidates(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, word, value, before, after, path): one row for each candidate of docs(doc_id, text). `word` is the
    index of the white-space separated word that holds it. Null and empty texts have none."""
    t = F.col(text).cast("string")
    where = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))
    # lines of a very long text are words like any other; only words that can hold a value are looked at again
    words = docs.where(t.rlike(SUSPECT)).select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), F.split(t, r"\s+").alias("w"))
    hits = F.filter(F.transform("w", lambda x, i: F.when((F.length(x) >= 16) & x.rlike(VALUE) & x.rlike("[0-9]"), i)), lambda i: i.isNotNull())
    at = words.withColumn("word", F.explode(hits))
    around = at.select(
        "doc_id",
        "path",
        "word",
        F.element_at("w", F.col("word") + 1).alias("whole"),
        F.concat_ws(" ", F.slice("w", F.greatest(F.col("word") - 1, F.lit(1)), F.least(F.col("word"), F.lit(2)))).alias("left"),
        F.concat_ws(" ", F.slice("w", F.col("word") + 2, 1)).alias("after"),
    )
    values = around.withColumn("value", F.explode(F.regexp_extract_all("whole", F.lit(f"({VALUE})"), F.lit(1)))).where(F.col("value").rlike("[0-9]"))
    head = F.expr("substring_index(whole, value, 1)")
    return values.select("doc_id", "word", "value", F.concat_ws(" ", "left", head).alias("before"), "after", "path")


def assigned(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Like candidates, for what is assigned to secret words, passwords of URLs and private-key blocks, less the values
    that `candidates` gives. `piece` is the match that holds the value and `masked` the same with the value masked."""
    t = F.concat(F.col(text).cast("string"), F.lit("\n"))
    where = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))
    rows = docs.where(has_assigned(F.col(text).cast("string"))).select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), t.alias("t"))
    rows = rows.withColumn("pieces", F.regexp_extract_all("t", F.lit(ASSIGNED), F.lit(0)))
    rows = rows.select("doc_id", "path", "t", "pieces", F.posexplode("pieces").alias("at", "piece"))

    def group(k: int) -> Column:
        return F.regexp_extract("piece", ASSIGNED, k)

    rows = rows.select("*", F.concat(*[group(k) for k in (2, 3, 4, 5, 7, 9)]).alias("value"), F.length(F.concat(group(1), group(6), group(8))).alias("lead"))
    rows = rows.withColumn("start", F.expr("locate(value, piece, lead + 1)"))
    rows = rows.withColumn("nth", F.expr("cast(size(filter(slice(pieces, 1, at + 1), x -> x = piece)) as int)"))
    rows = rows.withColumn("left", F.split(F.concat(F.expr("substring_index(t, piece, nth)"), F.expr("substring(piece, 1, start - 1)")), r"\s+"))
    rows = rows.withColumn("rest", F.expr("substring(piece, start + length(value))"))
    run = F.col("value").rlike(f"^{VALUE}$") & F.col("value").rlike("[0-9]")
    return rows.where(~run).select(
        "doc_id",
        (F.size("left") - 1).alias("word"),
        "value",
        F.concat_ws(" ", F.slice("left", F.greatest(F.size("left") - 3, F.lit(1)), 4)).alias("before"),
        F.col("rest").alias("after"),
        "path",
        "piece",
        F.concat(F.expr("substring(piece, 1, start - 1)"), F.lit(MASK), F.col("rest")).alias("masked"),
    )


def all_candidates(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return candidates(docs, text, path).select("*", none.alias("piece"), none.alias("masked")).unionByName(assigned(docs, text, path))


def features(found: DataFrame) -> DataFrame:
    """found (candidates) with the FEATURES columns, all double and never null."""
    v, low = F.col("value"), F.lower("value")
    n = F.length(v)

    def share(kept: str) -> Column:
        return F.length(F.regexp_replace(v, f"[^{kept}]", "")) / n

    def has(c: Column, words: str) -> Column:
        return F.lower(c).rlike(rf"(^|[^a-z0-9])({_one_of(words)})([^a-z0-9]|$)")

    around = F.concat_ws(" ", "before", "after")
    changes = F.regexp_count(v, F.lit("(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[+/_-])(?=[^+/_-])"))
    steps = F.regexp_count(low, F.lit("0123|1234|2345|3456|4567|5678|6789|7890|abcd|bcde|cdef|xxxx|0000|1111"))
    cols = {
        "length": n,
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "lowers": share("a-z"),
        "marks": share("+/_=-"),
        "symbols": 1 - share("A-Za-z0-9+/_=-"),
        "changes": changes / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hexlike": low.rlike("^[0-9a-f]+$"),
        "uuidlike": low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
        "dictionary": 1 - F.length(F.regexp_replace(low, f"({_one_of(' '.join(DICTIONARY))})", "")) / n,
        "slashes": F.regexp_count(v, F.lit("/")) + F.regexp_count("before", F.lit("/")),
        "assigned": F.col("before").rlike("[=:]\\s*[\"'`]?$"),
        "secret_near": has(around, SECRET_WORDS),
        "other_near": has(around, OTHER_WORDS),
        "path_other": has(F.col("path"), PATH_WORDS),
        "prefix_known": v.rlike("^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|AIza|eyJ|glpat-)"),
        "sequence": steps,
    }
    return found.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{k}") for k, c in cols.items()])


#: Shapes of findings, secrets first; {name} and {name:first:length} stand for what `labelled_findings` makes.
SECRET_SHAPES = [
    "{a} token = \"{hx:1:40}\" {b}",
    "{a} password={hx:1:18} {b}",
    "{a} AKIA{up:1:16} {b}",
    "{a} api_key: {b64:1:32} {b}",
    "secret {hx:1:32} {b}",
    "{a} ghp_{b64:1:36} {b}",
    "authorization: bearer eyJ{b64} {b}",
    "{a} sk_live_{b64:1:24} {b}",
    "export AWS_SECRET_ACCESS_KEY={b64:1:40} {a}",
    "{a} {b} AKIA{up:5:16} {c}",
    "pwd='{b64:1:20}' {b}",
    "{a} password={b}{num:1:2} {c}",
    "{a} password=\"{b64:1:8}&{num:1:1}\" {b}",
    "{a} pwd: {b64:1:3}!{b64:4:3}@{b64:7:3}#{b64:10:3}$ {b}",
    "{a} token = \"{letters}\" {b}",
    "postgres://{a}:{b64:1:10}@{b} {c}",
    "{a} passwd='{b64:1:7}' {b}",
    "-----BEGIN RSA PRIVATE KEY-----\n{b64}\n{up}\n-----END RSA PRIVATE KEY-----\n{a}",
    "-----BEGIN PRIVATE KEY-----\n{b64}\n-----END PRIVATE KEY-----\n{a}",
    "Authorization: Basic {b64:1:24}== {a}",
    "Server={a};Password={b64:1:12};Database={b} {c}",
    "{a} xoxb-{num:1:11}-{num:12:11}-{b64:1:24} {b}",
    "client_secret: '{b64:1:30}' {a}",
    "AIza{b64:1:35} {a}",
]
OTHER_SHAPES = [
    "commit {hx:1:40} {b}",
    "sha256: {hx} {b}",
    "md5 checksum {hx:1:32} {b}",
    "uuid {hx:1:8}-{hx:9:4}-{hx:13:4}-{hx:17:4}-{hx:21:12} {b}",
    "{a} {num:1:16} {b}",
    "card {num:3:16} {b}",
    "{a} {b}_{c}_{d}_2{num:1:3} {c}",
    "token = \"your_{a}_token_{b}_1234\" {c}",
    "password=xxxxxxxxxxxxxxxx1 {b}",
    "api_key = example_{a}_{b}_0000000 {c}",
    "https://{a}.example/{b}/{c}/{d}-{num:1:4}-{a} {b}",
    "order number {num:1:20} {b}",
    "key: 1234567890abcdef{num:1:2} {b}",
    "{a} {b}-{c}-{d}-v{num:1:2} key {a}",
    "password: {a} {b}",
    "author: {a} {b}",
    "tokens: {num:1:3} {b}",
    "password=${{a}_password} {b}",
    "keywords: {a}, {b} {c}",
    "password = \"********\" {b}",
    "secret: <{a}> {b}",
    "https://{a}:password@{b}.example {c}",
    "-----BEGIN CERTIFICATE-----\n{b64}\n-----END CERTIFICATE-----\n{a}",
    "-----BEGIN PUBLIC KEY-----\n{b64}\n-----END PUBLIC KEY-----\n{a}",
    "\"integrity\": \"sha512-{b64}==\", {a}",
    "data:image/png;base64,{b64}{up} {a}",
    "etag: \"{hx:1:32}\" {a}",
    "trace_id={hx:1:32} {a}",
    "at 2024-0{num:1:1}-1{num:2:1}T10:{num:3:2}:00.{num:5:6}Z {a}",
    "class {cap_a}{cap_b}{cap_c}{cap_d}{num:1:1} {a}",
    "IBAN DE{num:1:20} {a}",
]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(doc_id, text, path, label): n findings, each one candidate in a few words, label 1 for secrets. Values come
    from hashes of the row number, put into SECRET_SHAPES and OTHER_SHAPES in turn."""
    hx = F.sha2(F.concat(F.lit("finding:"), F.col("doc_id").cast("string")), 256)
    b64 = F.translate(F.base64(F.unhex(hx)), "+/=", "xyz")
    up = F.upper(F.translate(b64, "01", "23"))
    word = [F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int")) for k in range(4)]
    num = F.translate(hx, "abcdef", "123456")
    made = {"hx": hx, "b64": b64, "up": up, "num": num, "letters": F.translate(F.substring(hx, 1, 24), "0123456789", "klqwrtyuio")}
    made |= dict(zip("abcd", word, strict=True)) | {f"cap_{k}": F.initcap(w) for k, w in zip("abcd", word, strict=True)}
    shapes = SECRET_SHAPES + OTHER_SHAPES
    kind = F.pmod(F.col("doc_id"), F.lit(len(shapes)))
    text = F.element_at(F.array(*[F.lit(t) for t in shapes]), (kind + 1).cast("int"))
    for hole in sorted({h for t in shapes for h in re.findall(r"\{(?:%s)(?::\d+:\d+)?\}" % "|".join(made), t)}):
        name, *cut = hole[1:-1].split(":")
        text = F.replace(text, F.lit(hole), F.substring(made[name], int(cut[0]), int(cut[1])) if cut else made[name])
    label = (kind < len(SECRET_SHAPES)).cast("int")
    in_tests = (F.col("label") == 0) & (F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(5)) == 0)
    rows = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"))
    return rows.withColumn("label", label).withColumn("text", text).withColumn("path", F.when(in_tests, "tests/data.txt").otherwise("src/main.txt"))


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(features(found))


def fit(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings (doc_id, text, path, label). Rows whose text has no candidate teach nothing."""
    findings = written(findings, "findings")  # bounded; the rule that makes them is a large expression
    found = all_candidates(findings, path="path").join(findings.select("doc_id", "label"), "doc_id")
    rows = _vectors(found).select("features", F.col("label").cast("double").alias("label"), "doc_id").coalesce(1).sortWithinPartitions("doc_id")
    rows = written(rows, "findings")
    return RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, minInstancesPerNode=2).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, word, value, score, is_secret) of every candidate in docs; repeated rows are scanned each."""
    return _scored(docs, model, text, path).drop("piece", "masked")


def _scored(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", path: str | None = None) -> DataFrame:
    scored = model.transform(_vectors(all_candidates(docs, text, path)))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "word", "value", "piece", "masked", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel, path: str | None = None) -> DataFrame:
    """docs with every secret in text replaced by MASK; other columns and the rows without secrets stay as they are.
    Only rows with candidates are shuffled. Each is matched with its own findings by a hash of its text and path, so
    repeated ids do no harm and copies share their findings, which meet as partial sets before the shuffle."""
    columns, text_key, other_key, secrets = columns_of(docs), fresh(docs, "text_key"), fresh(docs, "key"), fresh(docs, "secrets")
    ended = F.concat(F.col("text"), F.lit("\n"))
    suspect = F.coalesce(F.col("text").rlike(SUSPECT) | has_assigned(F.col("text")), F.lit(False))
    where = F.lit(None).cast("string") if path is None else F.col(path).cast("string")
    suspects = docs.where(suspect).withColumn(text_key, F.xxhash64("text", where))
    keyed = suspects.select(F.col(text_key).alias("doc_id"), "text", where.alias("path"))
    # an assigned value may be short or a common word, so it is masked where it is assigned only
    part = F.struct(F.col("piece").isNull().alias("run"), F.coalesce("piece", "value").alias("old"), F.coalesce("masked", F.lit(MASK)).alias("new"))
    found = _scored(keyed, model, path="path").where("is_secret").groupBy(F.col("doc_id").alias(other_key)).agg(F.collect_set(part).alias(secrets))
    joined = suspects.join(found, F.col(text_key) == F.col(other_key), "left")
    ordered = F.array_sort(F.transform(secrets, lambda s: F.struct(s["run"].alias("run"), (-F.length(s["old"])).alias("n"), s["old"].alias("old"), s["new"].alias("new"))))
    clean = F.aggregate(ordered, ended, lambda acc, s: F.replace(acc, s["old"], s["new"]))
    clean = F.substring(clean, F.lit(1), F.length(clean) - 1)
    masked = joined.withColumn("text", F.when(F.col(secrets).isNull(), F.col("text")).otherwise(clean)).select(*columns)
    return docs.where(~suspect).select(*columns).unionAll(masked)
