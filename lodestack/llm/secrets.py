"""Secret scan: candidates by pattern, false positives out by a random forest.

DataFrame functions and Spark ML's forest only; no Python runs on executors.
Candidates are long runs of key characters with a digit, and whatever is
assigned to a name that asks for a secret. The forest judges length, character
transitions, dictionary coverage, path and neighbouring words, and is trained
from labelled findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.rows import ROW, packed, spread, unpacked
from lodestack.plans.storage import Scratch

_KEY = "A-Za-z0-9_+/-"
_ASKING = r"passw(?:or)?d|passphrase|pwd|secret|token|(?:api|access|private|secret|account)[_-]?key(?:[_-]?id)?|credentials?"
#: Four or more characters that stand behind such a name, a sign of assignment and perhaps a quote.
ASSIGNED = rf"""(?<=[=:>"'`]|[=:>][ \t]{{1,2}})(?<=(?i:{_ASKING})["'`]?[ \t]{{0,2}}[:=]{{1,2}}>?[ \t]{{0,2}}["'`]?)[^\s"'`,;<>()\[\]]{{4,200}}+"""
#: A maximal run of 16 or more key characters with a digit among them, and padding behind it.
RUN = rf"(?<![{_KEY}])(?=[A-Za-z_+/-]*[0-9])[{_KEY}]{{16,}}+={{0,2}}"
CANDIDATE = f"{ASSIGNED}|{RUN}"
#: Characters of context on either side that features look at.
CONTEXT = 48
#: Labelled findings to train from, trees, and their depth.
FIT_ROWS, TREES, DEPTH = 4000, 20, 7
THRESHOLD = 0.5
MASK = "[SECRET]"

_ASKS = r"(?i)(token|secret|passw(or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|bearer)"
_NAMES = r"(?i)(sha-?1|sha-?256|sha-?512|md5|commit|checksum|digest|uuid|guid|etag|revision|integrity|version|build|order|card|invoice|phone|isbn)"
_FORMAT = r"^(AKIA|ASIA|ghp_|gho_|xox[bpars]-|sk_live_|AIza|glpat-|eyJ)"
_WORDS = "about|above|access|account|after|again|all|and|api|app|are|array|based|be|build|but|by|can|change|class|client|code|com|config|content|count|data|date|default|demo|document|done|dummy|edit|error|example|false|field|file|first|for|from|function|get|group|handle|have|help|here|home|http|image|in|index|info|input|insert|is|item|java|key|last|length|line|list|load|local|login|main|make|me|message|model|module|name|new|next|not|null|number|object|of|on|open|option|order|org|other|output|page|param|part|password|path|place|point|post|project|python|query|read|request|result|return|role|sample|script|search|secret|section|select|server|service|set|size|some|source|src|start|state|string|style|system|table|template|test|text|that|the|this|time|title|to|token|total|true|type|update|url|user|utils|value|version|view|web|width|with|word|world|write|you|your"

_EMPTY = r"(?i)(your|example|change_?me|placeholder|dummy|insert|x{4,}|\*{3,}|0{6,}|\$|\{|%|environ|getenv|config|^(null|none|nil|true|false|undefined|required|optional|string|str|redacted|hidden|empty)\b)"

FEATURES = ["f_length", "f_symbols", "f_empty", "f_transitions", "f_digits", "f_upper", "f_distinct", "f_hex", "f_digits_only", "f_dictionary", "f_format", "f_slashes", "f_in_path", "f_test_path", "f_asks", "f_asks_near", "f_names", "f_assigned", "f_quoted"]


def with_features(rows: DataFrame) -> DataFrame:
    """Rows (candidate, before, after, path) with the columns of FEATURES."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(c)
    share = lambda pattern: (n - F.length(F.regexp_replace(c, pattern, ""))) / n
    runs = reduce(lambda x, k: F.regexp_replace(x, *k), [("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")], c)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    near = F.substring(before, -20, 20)
    features = {
        "f_length": n.cast("double"),
        "f_transitions": (F.length(runs) - 1) / F.greatest(n - 1, F.lit(1)),
        "f_digits": share("[0-9]+"),
        "f_upper": share("[A-Z]+"),
        "f_symbols": share("[^A-Za-z0-9]+"),
        "f_empty": flag(c.rlike(_EMPTY)),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "f_digits_only": flag(c.rlike("^[0-9]+$")),
        "f_dictionary": (n - F.length(F.regexp_replace(F.lower(c), f"({_WORDS})", ""))) / n,
        "f_format": flag(c.rlike(_FORMAT)),
        "f_slashes": (F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))).cast("double"),
        "f_in_path": flag(before.rlike(r"(://\S*|[\w.]/|\\)$") | after.rlike(r"^\.[a-z]{1,5}\b")),
        "f_test_path": flag(F.col("path").rlike(r"(?i)(test|example|sample|fixture|vendor|docs?/)")),
        "f_asks": flag(before.rlike(_ASKS)),
        "f_asks_near": flag(near.rlike(_ASKS)),
        "f_names": flag(near.rlike(_NAMES)),
        "f_assigned": flag(before.rlike("""[=:][ \t]*["']?$""") | before.rlike(r"(?i)bearer $")),
        "f_quoted": flag(before.rlike("""["'`]$""") & after.rlike("""^["'`]""")),
    }
    return rows.withColumns(features)


def labelled_findings(spark: SparkSession, rows: int = FIT_ROWS, seed: int = 11) -> DataFrame:
    """(candidate, before, after, path, label): findings made by rule, half of
    them secrets, from hashes of their number.

    Secrets are random keys of common shapes and short passwords that something
    assigns; the rest are what scanners wrongly report: digests, ids, numbers,
    paths, identifiers, placeholders and plain words. Each is written as a text
    and found by ``candidates``, so that features see what a scan would.
    """
    r = lambda k: F.md5(F.concat_ws("-", F.lit(seed), F.col("id"), F.lit(k)))
    pick = lambda k, options: F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    hex40, hex64 = F.substring(F.concat(r(1), r(2)), 1, 40), F.concat(r(1), r(2))
    letters = F.regexp_replace(F.concat(F.base64(F.unhex(r(3))), F.base64(F.unhex(r(4)))), "[+/=\r\n]", "")
    prose = pick(5, ["the result was stored and ", "and then it is said that ", "Read this before ", "of the other ones ", "it was not in ", "", "wh the entre, ", "der und ist "])
    key = pick(6, ["token", "secret", "api_key", "password", "apiKey", "client_secret", "auth_token", "access_key", "TOKEN", "private_key", "passwd", "credentials"])
    form = pick(7, [' = "', '="', ": ", "=", "=", ": '", "='", ' => "', ' := "', " = "])
    quote = F.substring(form, -1, 1)
    close = F.when(quote.isin('"', "'"), F.concat(quote, pick(8, [" and", "\n", ";", ",", ""]))).otherwise(pick(8, [" and", "\n", " ", "", " the"]))
    assigned = F.concat(prose, key, form)
    names = pick(9, ["commit ", "sha256: ", "md5 = ", "checksum: ", "digest=", "etag: \"", "revision ", "integrity sha256-", "order ", "build ", "uuid: ", "version "])
    words = pick(10, ["get_user_account_by_id_2", "src/main/java/org/example/Utils2", "your_api_key_goes_here_1", "test_default_config_value_42", "this-is-an-example-page-2024", "select_group_by_order_total_3", "example_password_string_123", "data/2024/01/file_list_part", "xxxxxxxxxxxxxxxxxxxx1234", "0000000000000000000000", "1234567890123456", "-----------------2024-----", "changeme_changeme_changeme1", "ABCDEFGHIJKLMNOP0123456789"])
    number = F.concat(pick(11, ["4", "5", "3", "6"]), F.substring(F.regexp_replace(hex64, "[a-f]", "7"), 1, 15))
    uuid = F.concat_ws("-", F.substring(r(1), 1, 8), F.substring(r(1), 9, 4), F.substring(r(1), 13, 4), F.substring(r(1), 17, 4), F.substring(r(1), 21, 12))
    after = pick(12, [" and the", ".", ", it", "\n", " in", "", " | "])
    path = pick(13, ["src3", "config/app.yaml", "src/main.py", "deploy/.env", "web/page", ""])
    calm = pick(14, ["tests/fixtures/data", "docs/readme", "src7", "examples/demo", "web/page", "src/lock.json"])
    kinds = [
        (1, hex40, assigned, close, path),
        (1, F.concat(F.substring(letters, 1, 5), pick(19, ["!", "@", "#7", ".", "$9", "&", "-", "_", ""]), F.substring(letters, 6, 5)), F.concat(prose, key, form), close, path),
        (1, F.concat(pick(20, ["hunter", "Dragon", "letme", "summer", "S3cr", "Winter", "p@ss", "qwe"]), F.substring(hex64, 1, 4), pick(21, ["", "!", "#", "$$", "?"])), F.concat(prose, pick(22, ["password", "passwd", "DB_PASSWORD", "pwd", "secret", "admin_password"]), form), close, path),
        (1, F.substring(letters, 1, 32), F.concat(prose, pick(23, ["AWS_SECRET_ACCESS_KEY", "SLACK_TOKEN", "SENTRY_AUTH_TOKEN", "db.password", "STRIPE_SECRET"]), F.lit("=")), after, pick(24, ["deploy/.env", "docker-compose.yml", ".bashrc"])),
        (1, F.substring(letters, 1, 32), assigned, close, path),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))), F.concat(prose, F.lit("aws_access_key_id = ")), after, path),
        (1, F.concat(F.lit("ghp_"), F.substring(letters, 1, 36)), F.concat(prose, pick(15, ["use ", "GITHUB=", ""])), after, path),
        (1, F.substring(letters, 1, 20), assigned, close, path),
        (1, hex64, assigned, close, path),
        (1, F.concat(F.lit("eyJ"), letters), F.lit("Authorization: Bearer "), after, path),
        (0, hex40, F.concat(prose, names), after, calm),
        (0, hex64, F.concat(prose, names), after, calm),
        (0, uuid, F.concat(prose, pick(16, ["id: ", "uuid ", "", "request "])), after, path),
        (0, number, prose, after, path),
        (0, pick(25, ["required", "null", "None", "changeme", "your_password", "example", "${DB_PASSWORD}", "os.environ", "getenv", "True", "string", "undefined", "********", "{{secret}}", "config.password", "process.env.TOKEN", "xxxxxxxx", "your-token-here", "%s", "self.token"]), F.concat(prose, key, form), close, path),
        (0, pick(26, ["the", "that", "with", "this", "from", "there", "thing", "must", "should", "which", "stored", "encrypted", "missing", "expired", "invalid", "wrong"]), F.concat(prose, pick(27, ["password", "The secret", "a token", "credentials"]), F.lit(": ")), pick(28, [" be kept", " is", " of", ". The", " was"]), path),
        (0, F.concat(pick(29, ["onthtion", "reandthe", "eaunment", "inghesth", "lichkeit", "ciónmente"]), pick(30, ["", ".", "er", "an"])), F.concat(prose, pick(31, ["password", "secret", "token"]), F.lit(": ")), F.lit(" and"), path),
        (0, words, F.when(F.pmod("id", F.lit(3)) == 0, assigned).otherwise(prose), after, path),
        (0, hex40, F.concat(prose, F.lit("https://example.org/static/"), pick(17, ["", "img/", "js/app."])), pick(18, [".js", ".png", "/view", ".css"]), calm),
        (0, F.substring(letters, 1, 24), F.concat(prose, F.lit("https://example.org/watch?v=")), after, path),
    ]
    made = spark.range(0, rows, 1, 4).withColumn("_k", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(kinds))))
    choose = lambda n: reduce(lambda x, k: x.when(F.col("_k") == k, kinds[k][n] if n else F.lit(kinds[k][0])), range(1, len(kinds)), F.when(F.col("_k") == 0, kinds[0][n] if n else F.lit(kinds[0][0])))
    written = made.select("id", choose(1).alias("planted"), choose(2).alias("lead"), choose(3).alias("rest"), choose(4).alias("source"), choose(0).cast("double").alias("label"))
    written = Scratch(spark, "findings").table(written, "written")
    texts = written.select(F.col("id").alias("doc_id"), F.concat("lead", "planted", "rest").alias("text"), "source")
    found = candidates(texts).withColumnRenamed("doc_id", "id").join(written.select("id", "planted", "label"), "id")
    # A mark behind an unquoted value belongs to what a scan finds.
    return found.filter(F.startswith("candidate", "planted")).select("candidate", "before", "after", "path", "label")


_models: dict[str, RandomForestClassificationModel] = {}


def default_model(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest of ``labelled_findings``, trained once a session."""
    app = spark.sparkContext.applicationId
    if app not in _models:
        _models[app] = train(labelled_findings(spark))
    return _models[app]


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, before, after, path, label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2, subsamplingRate=0.8).fit(rows.select("features", "label"))


def _row_hash(path: str) -> Column:
    return F.xxhash64("text", F.coalesce(F.col(path).cast("string"), F.lit("")))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, text_hash, ordinal, start, candidate, before, after, path) of
    every candidate; ``start`` counts characters from 0.

    Between candidates lie the pieces that splitting by the pattern leaves, so
    context and place follow from them. Null texts have none; rows equal in id,
    text and path give their candidates once; a null path is an empty one.
    ``text_hash`` is of text and path. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id"), _row_hash(path).alias("text_hash"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("_c")).filter(F.size("_c") > 0)
    rows = rows.withColumn("_s", F.split("text", CANDIDATE, -1)).drop("text")
    piece = lambda i: F.get(F.col("_s"), i)
    each = F.transform("_c", lambda x, i: F.struct(i.alias("ordinal"), x.alias("candidate"), F.substring(piece(i), -CONTEXT, CONTEXT).alias("before"), F.substring(piece(i + 1), 1, CONTEXT).alias("after"), (F.length(piece(i)) + F.when(i > 0, F.length(F.get(F.col("_c"), i - 1))).otherwise(0)).cast("long").alias("step")))
    each = rows.select("doc_id", "text_hash", "path", F.explode(each).alias("x")).select("doc_id", "text_hash", "path", "x.*").dropDuplicates(["doc_id", "text_hash", "ordinal"])
    place = Window.partitionBy("doc_id", "text_hash").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("start", F.sum("step").over(place)).drop("step")


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Findings (doc_id, text_hash, ordinal, start, length, candidate, score,
    secret) of ``docs`` (doc_id, text and the path column).

    Every candidate comes back with its score, judged by ``threshold``; an
    empty table gives an empty result; other columns are not read.
    """
    model = model or default_model(docs.sparkSession)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs, path)))
    found = model.transform(rows).withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return found.select("doc_id", "text_hash", "ordinal", "start", F.length("candidate").alias("length"), "candidate", "score", (F.col("score") >= threshold).alias("secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each secret replaced by MASK; ``n_chars`` follows the text
    where it exists. Documents without a secret keep their text, and no row
    goes."""
    found = scan(docs, model, path, threshold).filter("secret").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_tx")).agg(F.collect_set("candidate").alias("_secrets"))
    keyed = packed(docs, F.col("text"), F.col("doc_id").alias("_did"), _row_hash(path).alias("_dtx"))
    out = keyed.join(found, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dtx") == F.col("_tx")), "left")
    pieces, own = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    shown = F.concat(F.transform(own, lambda x: F.when(F.array_contains("_secrets", x), F.lit(MASK)).otherwise(x)), F.array(F.lit("")))
    clean = F.array_join(F.zip_with(pieces, shown, lambda a, b: F.concat(a, b)), "")
    changed = {"text": F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(clean)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_secrets").isNull(), F.col(f"{ROW}.n_chars")).otherwise(F.length(clean).cast("long"))
    return unpacked(out, docs.columns, **changed)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    found = scan(docs)
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")
