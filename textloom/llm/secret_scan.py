"""Secret scans: patterns find candidates, a random forest trained from labelled findings removes false positives.

Everything is DataFrame operations: candidates come from regular expressions on array functions, features are columns,
and the forest is MLlib's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut

CONTEXT = 48
THRESHOLD = 0.5
TREES, DEPTH = 32, 10
#: Labelled findings that the default forest is trained on.
FINDINGS, FINDING_PARTS = 6000, 4
#: Hits of one text whose places are summed in one fold.
FOLD = 512
#: The default dictionary: words that names, placeholders and examples are made of. A parameter of the scan.
WORDS = (
    "access account address admin alpha apple application archive auth author backup base beta bird black blue board book branch build button cache camera castle cat center change changeme check city class "
    "client cloud code color commit company config connection contact copy correct country credential customer dark data date default delta demo desk device digest dog domain dragon driver dummy earth email "
    "enter env error event example export factory fake family field file fire flower folder foo forest format friend game garden gate group guest harbor hash head header hello here horse host house hunter image "
    "index input insert internal island item key king lake lamp language level library light limit line list local login long main manager market master member memory message mobile model monkey moon mountain "
    "music name network night none null number object office ocean open order output owner page paper pass passwd password path phone picture place placeholder plain planet player port power printer private "
    "process product profile project public queen question queue random record redacted remote report request rest river road rock root sample school secret secure server service session settings shadow silver "
    "sky staging star state station staple stone storage store string summer system table test time token tree true user value version water welcome white window winter word world your"
).split()
_NAMED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)"
_RUN = r"[A-Za-z0-9_-]{8,}+"
_JWT = rf"eyJ{_RUN}\.{_RUN}\.{_RUN}"
_PREFIXED = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|gh[pousr]_[A-Za-z0-9]{36,}+"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}+"
    r"|sk_(?:live|test)_[A-Za-z0-9]{16,}+"
    r"|AIza[0-9A-Za-z_-]{35,}+"
    r"|-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,\\]*+-----END [A-Z ]{0,24}PRIVATE KEY-----)?"
)
_ASSIGNED = rf"{_NAMED}[\"']?\x20{{0,2}}[:=]\x20{{0,2}}[\"']?"
#: What ends a named value of more than 128 characters besides a delimiter: the start of another credential.
_NEXT = rf"{_PREFIXED}|(?<![A-Za-z0-9_.-]){_JWT}|{_ASSIGNED}[^\s\"',;]{{8}}"
#: Formats of credentials; fixed values. No length has an upper bound, so a candidate is the whole value; possessive
#: quantifiers keep that linear, and of the eyJ in one run only the first of 256 characters is tried: what fails there
#: fails at the next ones too, as the run ends where it ends.
PATTERN = (
    rf"{_PREFIXED}"
    rf"|(?<!eyJ[A-Za-z0-9_-]{{0,255}}){_JWT}"
    rf"|{_ASSIGNED}[^\s\"',;]{{8,128}}+(?:(?!{_NEXT})[^\s\"',;])*+[\"']?"
    r"|(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])"
)
#: What must be in a text for PATTERN to match at all.
_HINT = r"AKIA|ASIA|gh[pousr]_|xox|sk_|AIza|eyJ|-----BEGIN|(?i:passw|pwd|secret|token|key|auth)|[0-9a-f]{32}"
FEATURES = [
    "size", "distinct", "transitions", "digits", "upper", "symbols", "longest_run", "steps", "coverage", "named", "prefixed", "quoted", "is_hex", "example_near", "digest_near", "secret_near", "example_path",
    "document_path",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, path, found, start, finish, before, after): every match of PATTERN in the whole text, with its neighbourhood."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    base = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text")).filter(F.col("text").rlike(_HINT))
    split = base.select("id", "path", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("hits"), F.split("text", PATTERN, -1).alias("gaps")).filter(F.size("hits") > 0)
    n = F.size("hits")
    sizes = F.zip_with(F.slice(F.col("gaps"), 1, n), F.col("hits"), lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    split = split.withColumn("sizes", sizes)
    # A place is the sum of the lengths of what stands before. Sums run over blocks of FOLD hits first, as a fold over all
    # of them would copy a growing array with each step.
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int"))
    own = lambda b: F.slice(F.col("sizes"), b * FOLD + 1, FOLD)
    empty = F.array().cast("array<int>")
    running = lambda values, at: F.aggregate(values, F.struct(at.alias("at"), empty.alias("all")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    totals = F.transform(blocks, lambda b: F.aggregate(own(b), F.lit(0), lambda a, x: a + x["g"] + x["h"]))
    split = split.withColumn("begins", running(totals, F.lit(0)))
    ends_of_hits = F.transform(blocks, lambda b: running(F.transform(own(b), lambda x: x["g"] + x["h"]), F.get("begins", b)))
    # Only what is needed of a text goes into a hit's row: the hit, its place and the ends of its two gaps.
    hits = F.arrays_zip(
        F.col("hits").alias("found"), F.flatten(ends_of_hits).alias("passed"), F.transform("sizes", lambda x: x["g"]).alias("gap"),
        F.transform(F.slice(F.col("gaps"), 1, n), lambda g: F.right(g, F.lit(CONTEXT))).alias("before"), F.transform(F.slice(F.col("gaps"), 2, n), lambda g: F.left(g, F.lit(CONTEXT))).alias("after"),
    )
    each = split.select("id", "path", F.inline(hits).alias("found", "passed", "gap", "before", "after"))
    start = F.col("passed") + F.col("gap")
    return each.select("id", "path", "found", start.alias("start"), (start + F.length("found")).alias("finish"), "before", "after")


def _share(n: Column, of: Column) -> Column:
    return n.cast("double") / F.greatest(of, F.lit(1)).cast("double")


def with_features(found: DataFrame, words: Sequence[str] = WORDS) -> DataFrame:
    """Adds secret (the candidate without its name and quotes) and FEATURES, from found, path, before and after."""
    secret = F.regexp_replace("found", rf"^{_NAMED}[\"']?\x20*[:=]\x20*[\"']?|[\"']$", "")
    out = found.withColumn("secret", secret)
    size = F.length("secret")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("secret", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    near = F.lower(F.concat_ws(" ", "before", "after"))
    low = F.lower("secret")
    runs = F.transform(F.regexp_extract_all("secret", F.lit(r"(.)\1*"), F.lit(0)), F.length)
    count = lambda pattern: size - F.length(F.regexp_replace("secret", pattern, ""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    word, end = r"(?<![\w.@-])", r"(?![\w-]|\.\w)"  # a word of its own, no part of a host name
    # Steps of one from a character to the next, as in 12345 and abcde.
    codes = F.transform(F.split(F.left(low, F.lit(256)), ""), F.ascii)
    steps = F.aggregate(codes, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")), lambda s, x: F.struct(x.alias("last"), (s["n"] + F.when(x == s["last"] + 1, 1).otherwise(0)).alias("n")), lambda s: s["n"])
    return out.select(
        "*",
        F.least(size, F.lit(256)).cast("double").alias("size"),
        _share(F.size(F.array_distinct(F.split("secret", ""))), F.least(size, F.lit(64))).alias("distinct"),
        _share(F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1, size).alias("transitions"),
        _share(count("[0-9]"), size).alias("digits"),
        _share(count("[A-Z]"), size).alias("upper"),
        _share(count("[^0-9A-Za-z]"), size).alias("symbols"),
        _share(F.coalesce(F.array_max(runs), F.lit(0)), size).alias("longest_run"),
        _share(steps, F.least(size, F.lit(256))).alias("steps"),
        _share(size - F.length(F.regexp_replace(low, "|".join(sorted(set(words), key=lambda w: (-len(w), w))), "")), size).alias("coverage"),
        flag(F.col("found").rlike(rf"^{_NAMED}")).alias("named"),
        flag(F.col("found").rlike(r"^(?:AKIA|ASIA|gh[pousr]_|xox|sk_|AIza|eyJ|-----)")).alias("prefixed"),
        flag(F.col("found").rlike(r"[\"']$")).alias("quoted"),
        flag(F.col("secret").rlike(r"^[0-9a-f]+$")).alias("is_hex"),
        flag(near.rlike(word + r"(?:example|sample|dummy|fake|placeholder|test|your|replace|e\.g)" + end)).alias("example_near"),
        flag(near.rlike(word + r"(?:commit|sha1|sha256|md5|checksum|hash|digest|etag|revision|uuid|fingerprint|build)" + end)).alias("digest_near"),
        flag(near.rlike(word + r"(?:secret|credential|key|password|login|private|bearer|authorization)" + end)).alias("secret_near"),
        flag(F.lower("path").rlike(r"test|example|sample|fixture|mock")).alias("example_path"),
        flag(F.lower("path").rlike(r"doc|readme|\.md$")).alias("document_path"),
    )


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, start: int = 0) -> DataFrame:
    """Labelled findings (found, path, before, after, label) made from hashes of the numbers from start on.

    Credentials and what only looks like them share paths, surroundings and shapes: random values that are named like
    secrets but are digests, passwords made of words, keys of the right format that are placeholders, values that the
    path alone or the words next to them tell apart. One label in fifty is wrong, as in findings that people review.
    """
    n = (F.col("id") + F.lit(start)).cast("string")
    key = lambda k: F.concat(F.lit(k), n)
    drawn = ("a", "b", "c", "d", "e", "k", "kind", "name", "p", "r", "s", "v", "wrong", "x", "y")
    # The numbers and strings that findings are made of are written first; an expression over all of it is too large to compile.
    base = cut(
        spark.range(0, rows, 1, FINDING_PARTS).select(
            *[F.crc32(key(k).cast("binary")).alias(k) for k in drawn], F.sha2(key("h"), 256).alias("hexes"), F.upper(F.translate(F.sha2(key("c"), 256), "0123456789", "GKPQRS4567")).alias("caps"),
            F.translate(F.base64(F.unhex(F.sha2(key("m"), 512))), "+/=\r\n", "xYz").alias("mixed"), F.translate(F.sha2(key("l"), 256), "0123456789", "ghijklmnop").alias("letters"),
            F.conv(F.substring(F.sha2(key("h"), 256), 1, 12), 16, 10).alias("number"),
        )
    )
    hexes, caps, mixed, letters, number = (F.col(x) for x in ("hexes", "caps", "mixed", "letters", "number"))
    pick = lambda k, options: F.get(F.split(F.lit("\x01".join(options)), "\x01"), F.pmod(F.col(k), F.lit(len(options))).cast("int"))
    word = lambda k: pick(k, WORDS)
    title = lambda k: F.initcap(word(k))
    name = pick("name", ["password=", 'token = "', "secret: ", 'api_key="', "passwd=", "access_key=", "auth: "])
    named = lambda value: F.concat(name, value, F.when(name.endswith('"'), '"').otherwise(""))
    short = lambda value, least, most: F.left(value, F.lit(least) + F.pmod(F.col("s"), F.lit(most - least + 1)).cast("int"))
    plain = F.concat(F.left(letters, F.lit(5)), F.lit(" "), F.substring(letters, 7, 4), F.lit(" "))
    about = lambda k, *words: F.concat(F.substring(letters, 9, 4), F.lit(" "), pick(k, words), F.lit(" "))
    example = about("a", "example", "sample", "dummy", "your", "e.g", "replace")
    digest = about("d", "commit", "sha256", "md5", "checksum", "hash", "digest", "etag", "revision", "build")
    secret = about("k", "secret", "credential", "private", "bearer", "login")
    any_path = pick("p", ["src/app.py", "src/main.go", "config/prod.yml", "deploy/env", "src3", "src12", "web", "docs/setup.md", "tests/fixture.py"])
    shipped = pick("p", ["src/app.py", "src/main.go", "config/prod.yml", "deploy/env", "src3", "src12", "web"])
    trial = pick("p", ["tests/test_login.py", "examples/demo.py", "fixtures/users.yml", "mock/server.js", "spec/sample.rb"])
    close = pick("x", ["xoxb-", "xoxp-"])
    made = [
        # credentials
        (F.concat(pick("v", ["AKIA", "ASIA"]), F.substring(caps, 1, 16)), plain, any_path, 1),
        (F.concat(pick("v", ["ghp_", "gho_", "ghs_"]), F.substring(mixed, 1, 36)), plain, any_path, 1),
        (F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), plain, any_path, 1),
        (F.concat(close, F.left(number, F.lit(12)), F.lit("-"), F.substring(mixed, 1, 24)), plain, any_path, 1),
        (F.concat(F.lit("AIza"), F.substring(mixed, 3, 35)), plain, any_path, 1),
        (F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit(".eyJ"), F.substring(mixed, 20, 40), F.lit("."), F.substring(mixed, 30, 43)), plain, any_path, 1),
        (named(short(hexes, 16, 64)), plain, any_path, 1),
        (named(short(mixed, 12, 48)), plain, any_path, 1),
        (named(F.concat(title("a"), pick("y", ["!", "#", "_", ""]), title("b"), F.substring(number, 1, 4))), plain, shipped, 1),
        (named(F.concat(word("a"), F.lit("-"), word("b"), F.lit("-"), F.substring(number, 1, 3))), secret, shipped, 1),
        (short(hexes, 32, 64), secret, shipped, 1),
        (named(short(hexes, 32, 40)), secret, any_path, 1),
        (F.concat(F.lit("-----BEGIN "), pick("v", ["RSA ", "EC ", ""]), F.lit("PRIVATE KEY-----")), plain, shipped, 1),
        # what only looks like them
        (F.concat(F.lit("AKIA"), F.left(F.upper(F.concat(word("a"), word("b"), word("c"), F.lit("XXXXXXXXXXXXXXXX"))), F.lit(16))), pick("e", ["set ", "for example ", "id "]), any_path, 0),
        (F.concat(pick("v", ["ghp_", "gho_"]), F.left(F.repeat(pick("r", ["x", "0", "a", "abc", "1234567890"]), F.lit(36)), F.lit(36))), plain, any_path, 0),
        (F.concat(F.lit("sk_test_"), F.substring(mixed, 1, 24)), example, trial, 0),
        (F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit(".eyJ"), F.substring(mixed, 20, 40), F.lit("."), F.substring(mixed, 30, 43)), example, trial, 0),
        (named(F.concat(word("a"), pick("y", ["_", "-", "."]), word("b"), pick("y", ["_", "-", "."]), word("c"))), plain, any_path, 0),
        (named(F.concat(F.lit("${"), F.upper(word("a")), F.lit("_"), F.upper(word("b")), F.lit("}"))), plain, any_path, 0),
        (named(F.concat(word("a"), F.lit("."), word("b"), F.lit("("), word("c"), F.lit(")"))), plain, any_path, 0),
        (named(F.concat(F.lit("<"), word("a"), F.lit("-"), word("b"), F.lit(">"))), plain, any_path, 0),
        (named(F.left(F.repeat(pick("r", ["x", "*", "0", "12345678", "abcdefgh"]), F.lit(24)), F.lit(20))), plain, any_path, 0),
        (named(F.concat(title("a"), pick("y", ["!", "#", "_", ""]), title("b"), F.substring(number, 1, 4))), plain, trial, 0),
        (named(F.concat(word("a"), F.lit("-"), word("b"), F.lit("-"), F.substring(number, 1, 3))), example, any_path, 0),
        (named(F.concat(F.lit("your-"), word("a"), F.lit("-here-"), F.substring(number, 1, 3))), plain, any_path, 0),
        (named(short(hexes, 32, 64)), digest, any_path, 0),
        (short(hexes, 32, 64), digest, any_path, 0),
        (short(hexes, 32, 40), plain, any_path, 0),
    ]
    kind, wrong = F.pmod(F.col("kind"), F.lit(len(made))), F.pmod(F.col("wrong"), F.lit(50)) == 0
    found, path, before, label = (F.lit(None) for _ in range(4))
    for k, (f, b, p, y) in enumerate(made):
        here = kind == k
        found, before, path, label = F.when(here, f).otherwise(found), F.when(here, b).otherwise(before), F.when(here, p).otherwise(path), F.when(here, float(y)).otherwise(label)
    return base.select(found.alias("found"), path.alias("path"), before.alias("before"), plain.alias("after"), F.when(wrong, 1.0 - label).otherwise(label).alias("label"))


def train_forest(findings: DataFrame, seed: int = 5, words: Sequence[str] = WORDS) -> RandomForestClassificationModel:
    """A forest over FEATURES of labelled findings (found, path, before, after, label 1 for a true secret)."""
    # Written once: features of a union would be compiled anew for each of its parts, and a forest reads its rows several times.
    findings = cut(findings.select("found", "path", "before", "after", "label").coalesce(FINDING_PARTS))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings, words).fillna(0.0, FEATURES))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="0.6").fit(rows.select("features", "label"))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", words: Sequence[str] = WORDS) -> DataFrame:
    """One row per candidate: id_col, kind, start, finish, secret_sha256, score, is_secret.

    start and finish are code points of the whole match, finish exclusive. The forest is trained on findings, by default
    on FINDINGS generated ones; is_secret is a score of THRESHOLD or more. Candidates are returned whatever their score,
    so that nothing is lost; null and empty texts have none, and an empty table gives no rows; rows that repeat give
    theirs each; path_col None or null paths count as an empty path; null ids are kept; other columns, whatever their
    names, are not read. Candidates have no longest length, and a very long text takes time in proportion.
    """
    model = train_forest(labelled_findings(docs.sparkSession) if findings is None else findings, words=words)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs, id_col, text_col, path_col), words))
    kind = F.lit("hex")
    for name, start in (("aws", "AKIA|ASIA"), ("github", "gh[pousr]_"), ("slack", "xox"), ("stripe", "sk_"), ("google", "AIza"), ("jwt", "eyJ"), ("private_key", "-----"), ("named", _NAMED)):
        kind = F.when(F.col("found").rlike(f"^(?:{start})"), name).otherwise(kind)
    score = vector_to_array(F.col("probability"))
    scored = model.transform(rows).withColumn("score", F.get(score, F.lit(1)))
    return scored.select(
        F.col("id").alias(id_col), kind.alias("kind"), "start", "finish", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), "score", (F.col("score") >= THRESHOLD).alias("is_secret")
    )
