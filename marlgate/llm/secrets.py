"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame expressions only.

A candidate is a run of at least 16 letters, digits and ``_+/-`` with a digit in it, a key with a known prefix, with or without
a digit, a password in a URL, or what is assigned (``=`` or ``:``) to a name with a keyword in it: six or more characters other than
white space and quotes.  Its features are length, character shares, changes of character class, the likelihood of its transitions
between letters in common words, coverage by dictionary words, the words around it (patterns, and the last ones by hash), and the path.  The forest
is trained on the driver from labelled findings (``labelled_findings``, or a caller's table of the same columns, of which at
most ``MAX_LABELLED`` rows are used), and becomes one expression of nested conditions.  A text's candidates stay in its row as an
array: nothing is shuffled.

Edge cases: a null or empty text has no findings; redaction leaves it as it is.  A null path says nothing.  Candidates may be of
any length and any number.  Repeated rows and null ids are scanned like others.  Redaction changes the text column only and
hands on all columns.  An empty table gives an empty table.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.functions.patterns import running_sums
from marlgate.llm.forest import Node, as_column, train_forest
from marlgate.llm.quality import COMMON_WORDS
from marlgate.llm.scratch import shielded

# A name with a keyword, and a sign of assignment; at most CONTEXT characters, as it is looked for behind.
_KEY = "(?:api|private|access|signing|encrypt(?:ion)?|account|shared|storage|master|secret|session|hmac|aes|ssh|license)[_ -]?key"
NAMED = f"(?i:passw(?:or)?d|pass(?![a-z])|pwd|passphrase|secret|token|{_KEY}|auth|credential)[A-Za-z0-9_.-]{{0,20}}[\"'`]?[ \\t]{{0,2}}(?:=>|:=|[=:])[ \\t]{{0,2}}[\"'`]?"
VALUE = f"(?<=[=:>][ \\t\"'`]{{0,3}})(?=[^\\s\"'`]{{6}})(?<={NAMED})[^\\s\"'`]{{5,}}[^\\s\"'`.,;:)\\]}}]"
KNOWN = "(?<![A-Za-z0-9_+/-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[pousr]_|github_pat_|sk-|[sr]k_(?:live|test)_|xox[abprs]-|glpat-|AIza|npm_|hf_)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}(?:\\.[A-Za-z0-9_-]+){1,2})"
RUN = "(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![\"'`]?[A-Za-z0-9]))?"
# The password of a user in a URL; the colon is looked for first, as the look behind it is dear.
IN_URL = "(?<=:)(?<=://[^\\s/@:]{1,64}:)[^\\s/@]{6,}(?=@)"
CANDIDATE = f"{VALUE}|{IN_URL}|{KNOWN}|{RUN}"
#: Shortest candidate; so many before one are enough to fill its context.
SHORTEST = 6
CONTEXT = 48
MAX_LABELLED = 20_000
THRESHOLD = 0.5
MASK = "[SECRET]"
# Words that make up names and placeholders rather than secrets.
DICTIONARY = "access account alpha beta build chapter client config data default demo docs download dummy example file final image index info intro item large library list local main model module name number overview package page part path photo project public python readme release report review sample script section server service session small source staging stable static system table target temp test thumb tutorial update upload user value version video view".split()
# Patterns over what stands before a candidate, the candidate, and the path.
KEYWORD = f"(?i)(token|secret|passw|pass(?![a-z])|pwd|apikey|{_KEY}|auth|bearer|credential|private|signing)[^\\n]{{0,12}}$"
ASSIGNED = "[=:]\\s*[\"'`]?$"
HARMLESS = "(?i)(commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|guid|build|revision|etag|card|iban|phone|isbn|doi|order|invoice|serial|request|trace|span|node|version|playlist|list|type|id)[^\\n]{0,8}$"
PREFIX = "^(AKIA|ASIA|gh[pousr]_|github_pat_|sk-|[sr]k_(live|test)_|hf_|xox[abprs]-|glpat-|eyJ|AIza|npm_)"
PLACEHOLDER = "(?i)(x{4,}|0{6,}|1234567|abcdef|your|example|changeme|dummy|sample|placeholder)"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
CODE = "[(){}<>\\[\\]]|^\\$|://|^[A-Za-z_]+(\\.[A-Za-z_]+)+$"
TEST_PATH = "(?i)(test|example|fixture|mock|sample|docs?/)"
CONFIG_PATH = "(?i)\\.(env|pem|key|cfg|conf|ini|ya?ml|properties|tfvars)$"


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Buckets of the words before a candidate.
WORD_BUCKETS = 12


def transitions() -> list[float]:
    """Log2 probabilities of a letter (1 to 26; 0 is anything else) after another, smoothed, from common words; row by row."""
    counts = np.ones((27, 27))
    for word in [*DICTIONARY, *(w for words in COMMON_WORDS.values() for w in words)]:
        codes = [0, *(_LETTERS.find(c) + 1 for c in word), 0]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return [round(float(x), 4) for x in np.log2(counts / counts.sum(axis=1, keepdims=True)).ravel()]


def _likelihood(candidate: Column) -> Column:
    """Mean log2 probability of a candidate's transitions."""
    table = F.array(*map(F.lit, transitions()))
    codes = F.transform(F.split(F.lower(candidate), ""), lambda c: F.instr(F.lit(_LETTERS), c))
    pairs = F.zip_with(codes, F.slice(codes, 2, F.length(candidate)), lambda a, b: a * 27 + b)
    return F.aggregate(pairs, F.lit(0.0), lambda total, k: total + F.coalesce(F.get(table, k), F.lit(0.0))) / F.greatest(F.lit(1), F.length(candidate) - 1)


def features(candidate: Column, before: Column, after: Column, path: Column) -> Column:
    """Array of doubles; the order is that of the lines below."""
    n = F.length(candidate).cast("double")
    share = lambda keep: F.length(F.regexp_replace(candidate, f"[^{keep}]+", "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    last = F.slice(F.reverse(F.filter(F.split(F.lower(before), "[^a-z]+"), lambda w: w != "")), 1, 3)
    buckets = F.transform(last, lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)).cast("int"))
    return F.array(
        n,
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        share("0-9"),
        share("A-Z"),
        share("a-z"),
        (F.length(kinds) - 1) / (n - 1),
        F.array_max(F.transform(F.split(candidate, "[^A-Za-z]+"), lambda x: F.length(x))) / n,
        flag(candidate.rlike("^[0-9a-fA-F]+$")),
        flag(candidate.rlike("^[0-9-]+$")),
        1 - F.length(F.regexp_replace(F.lower(candidate), words, "")) / n,
        flag(before.rlike(KEYWORD)),
        flag(before.rlike(ASSIGNED)),
        flag(before.rlike(HARMLESS)),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        flag(candidate.rlike(PREFIX)),
        flag(candidate.rlike(PLACEHOLDER)),
        flag(candidate.rlike(UUID)),
        flag(path.rlike(TEST_PATH)),
        flag(path.rlike(CONFIG_PATH)),
        flag(before.rlike(NAMED + "$")),
        flag(candidate.rlike(CODE)),
        flag(after.rlike("^[\"'`]?[ \\t]{0,2}(=>|:=|[=:])")),
        1 - share("A-Za-z0-9"),
        flag(candidate.rlike("[0-9]")),
        _likelihood(candidate),
        flag(before.rlike("://[^\\s/@:]+:$") & after.startswith("@")),
        *(flag(F.array_contains(buckets, k)) for k in range(WORD_BUCKETS)),
    )


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(before, candidate, after, path, label): findings of known kinds, secrets and look-alikes, drawn from a seed."""
    rng, out = random.Random(seed), []
    hexa, digits, lower, upper = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = lower + upper + digits
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    prose = lambda: " ".join(draw(lower, rng.randint(2, 8)) for _ in range(rng.randint(1, 5)))
    uuid = lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12))
    name = lambda: rng.choice("_-/").join([*rng.sample(DICTIONARY, rng.randint(2, 4)), draw(digits, rng.randint(1, 8))])
    for i in range(n):
        quote = rng.choice(['"', "'", ""])
        path = rng.choice(["", "", f"src{rng.randint(0, 99)}", "app/settings.yml", "deploy/.env", "src/main.py", "tests/test_auth.py", "docs/guide.md"])
        if i % 2 == 0:
            key = rng.choice(["token", "api_key", "API key", "secret", "password", "auth_token", "access_key", "client_secret", "credential", "pass", "DB_PASS", "encryption_key", "master key", "AccountKey", "storage_key", "session_key"])
            body = rng.choice([lambda: draw(hexa, rng.choice([32, 40, 64])), lambda: draw(mixed, rng.randint(20, 48)), lambda: draw(mixed + "+/", 40), lambda: draw(mixed + "+/", 86) + "==", lambda: draw(hexa, 64), lambda: uuid()])()
            body = rng.choice([body, body, rng.choice(["ghp_", "sk-", "sk_live_", "AKIA", "glpat-", "xoxb-", "github_pat_", "sk_test_"]) + draw(mixed, rng.choice([32, 60]))])
            if not any(c.isdigit() for c in body):
                body += draw(digits, 2)
            before = rng.choice([f"{prose()} {key} = {quote}", f"{prose()} {key}: {quote}", f"{key}={quote}", f"{prose()} bearer "])
            out.append((before, body, quote + rng.choice([" ", "\n", ", "]) + prose(), path, 1))
        else:
            what, body = rng.choice([
                ("commit ", draw(hexa, 40)), ("sha256: ", draw(hexa, 64)), ("md5 = ", draw(hexa, 32)), ("checksum ", draw(hexa, 40)),
                ("id: ", uuid()), ("uuid = ", uuid()), (rng.choice(["request ", "trace=", "span ", "node ", "session started by ", ""]), uuid()), (f"https://{draw(lower, 7)}.com/{rng.choice(['watch?v=', 'playlist?list=', 'p/', '?ref=', 'a?b='])}", rng.choice(["PL", "", "UU"]) + draw(mixed + "_-", rng.randint(16, 34))),
                (f"https://{draw(lower, 7)}.org/", "-".join(draw(lower, rng.randint(3, 8)) for _ in range(rng.randint(3, 6))) + "-" + draw(digits, 4)), (prose() + " ", draw(lower, 5) + "_".join([draw(upper[:6] + lower, 7), draw(lower, 6), draw(digits, 2)])), ("", draw(digits, 16)), ("card ", draw(digits, 16)), ("", draw(digits, rng.randint(16, 30))),
                ("see ", name() + "-" + rng.choice(DICTIONARY) + "-" + rng.choice(DICTIONARY)), ("", name() + "_" + name()), ("", "/usr/" + name() + "/" + name()),
                ("token = " + quote, "YOUR_TOKEN_" + draw(digits, 6)), ("password: ", "x" * rng.randint(12, 30) + draw(digits, 2)), ("api_key = " + quote, "example-key-" + draw("01", 8)),
                (f"data:image/{rng.choice(['png', 'gif', 'jpeg'])};base64,", draw(mixed + "+/", rng.randint(60, 400))), (rng.choice(["", "begin 644 "]), draw(mixed + "+/", rng.randint(200, 600))),
                ("", draw(lower, rng.randint(14, 24)) + draw(digits, 2)), ("order ", draw(digits, 4) + "-" + draw(digits, 6) + "-" + draw(digits, 6)), ("revision ", draw(hexa, 40)),
            ])
            while len(body) < 16 or not any(c.isdigit() for c in body):
                body += draw(digits, 2)
            out.append((f"{prose()} {what}", body, rng.choice([" ", "\n", ". "]) + prose(), path, 0))
    # values of names with a keyword: short ones, ones with other signs, and ones without a digit; keys with a prefix and no digit
    signs = "!@$&%#*?.:^~"
    for i in range(n):
        quote = rng.choice(['"', "'", ""])
        path = rng.choice(["", "", "app/settings.yml", "deploy/.env", "src/main.py", f"src{rng.randint(0, 99)}"])
        name_of = rng.choice(["password", "db_password", "passwd", "pwd", "secret", "CLIENT_SECRET", "token", "api_key", "pass", "DB_PASS", "smtp_pass", "encryption_key", "DB_PASSWORD_2024_PROD", "CLIENT_SECRET_2024_PROD", "auth_token", "passphrase"])
        before = rng.choice(["", f"{prose()} ", f"{prose()}\n", "{" + quote]) + name_of + rng.choice([f"={quote}", f" = {quote}", f": {quote}", f'": {quote}'])
        after = quote + rng.choice([" ", "\n", ", "]) + prose()
        if i % 2 == 0:
            body = rng.choice([
                lambda: draw(mixed, rng.randint(2, 8)) + rng.choice(signs) + draw(mixed, rng.randint(3, 8)), lambda: draw(mixed + signs, rng.randint(8, 30)), lambda: draw(mixed, rng.randint(8, 15)),
                lambda: draw(lower, rng.randint(4, 9)).title() + draw(digits, rng.randint(1, 4)) + draw("!@$&%#*?", rng.randint(0, 2)), lambda: draw(lower + upper, rng.randint(16, 40)),
            ])()
            body = "A" + body[1:-1] + rng.choice(digits + "z!&") if body[-1] in ".:" or len(body) < 6 else body
            if i % 14 == 2:  # in a URL
                before, after = f"{rng.choice(['', prose() + ' ', 'DATABASE_URL=', 'url: '])}{rng.choice(['postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb'])}://{rng.choice(['', draw(lower, 5)])}:", f"@{draw(lower, 6)}.{rng.choice(['org', 'net', 'local'])}/{draw(lower, 4)}"
                body = rng.choice([draw(mixed, rng.randint(8, 20)), draw(lower, rng.randint(4, 8)).title() + draw(digits, 3)])
            elif i % 10 == 0:
                before, body = rng.choice([before, f"{prose()} ", f"{prose()} key "]), rng.choice([
                    lambda: "AKIA" + draw(upper, 16), lambda: rng.choice(["ghp_", "sk-", "glpat-", "npm_"]) + draw(lower + upper, 32), lambda: "AKIA" + draw(upper + digits, 16),
                    lambda: rng.choice(["ghp_", "gho_", "AIza", "glpat-"]) + draw(mixed, 36), lambda: f"xoxb-{draw(digits, 12)}-{draw(digits, 12)}-{draw(mixed, 24)}",
                ])()
            out.append((before, body + draw(mixed, max(0, SHORTEST - len(body))), after, path, 1))
        else:
            if i % 6 == 3:  # words about a secret, not a secret
                before = rng.choice(["", f"{prose()} "]) + rng.choice(["token_type", "tokenizer", "auth_method", "password_policy", "secret_name", "token_count", "auth_provider", "key_type", "passing", "token_class"]) + rng.choice([": ", " = ", '": "'])
            body = rng.choice([
                lambda: draw(upper, 1) + draw(lower, rng.randint(3, 6)) + draw(upper, 1) + draw(lower, rng.randint(3, 6)), lambda: draw(lower, rng.randint(6, 12)), lambda: draw(lower, rng.randint(5, 9)).title() + "x", lambda: rng.choice(["string", "required", "please", "Optional", "undefined", "changeme", "your-password", "********", "xxxxxxxx", "Bearer", "boolean"]),
                lambda: f"get_{draw(lower, 6)}()", lambda: "${" + draw(upper, 8) + "}", lambda: f"os.environ[{draw(upper, 5)}]", lambda: f"config.{draw(lower, 6)}.{draw(lower, 5)}", lambda: f"https://{draw(lower, 8)}.org/{draw(lower, 4)}", lambda: f"<{draw(lower, 8)}>", lambda: f"{draw(lower, 5)}-{draw(lower, 6)}", lambda: f"{draw(lower, 5)}_{draw(lower, 6)}",
            ])()
            if i % 14 == 1:
                before, after, body = f"{prose()} {rng.choice(['postgres', 'https', 'redis'])}://{draw(lower, 4)}:", f"@{draw(lower, 6)}.org/", rng.choice(["password", "changeme", "<password>", "${DB_PASS}", "xxxxxxxx", "secret", "your-password"])
            out.append((before, body, after, path, 0))
        if i % 5 == 0:
            # a name that a value is assigned to is a candidate by itself
            label = "_".join([rng.choice(["CLIENT", "SERVICE", "DEPLOY", draw(upper, 5)]), rng.choice(["SECRET", "TOKEN", "PASSWORD", "API_KEY"]), draw(digits, 4), rng.choice(["PROD", "STAGING", draw(upper, 4)])])
            out.append((rng.choice(["", f"{prose()} ", f"{prose()}\n", 'token = "x"\n']), rng.choice([label, label.lower()]), rng.choice(["=", " = ", ": ", '": ']) + quote + draw(lower, 8), path, 0))
    return out


_default: list[list[Node]] = []


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> list[Node]:
    """The forest for labelled findings (before, candidate, after, path, label); for none, the default one, once a process."""
    if labelled is None and _default:
        return _default[0]
    rows = spark.createDataFrame(labelled_findings(), "before string, candidate string, after string, path string, label int") if labelled is None else labelled
    found = rows.where("candidate <> '' and label is not null").select(features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit(""))).alias("x"), "label")
    sample = found.orderBy(F.xxhash64("x", "label")).limit(MAX_LABELLED).collect()  # the same rows in each run
    forest = train_forest(np.array([r["x"] for r in sample], float), np.array([r["label"] for r in sample], float))
    if labelled is None:
        _default.append(forest)
    return forest


def _judged(docs: DataFrame, forest: list[Node], text: str, path: str | None) -> DataFrame:
    """Adds _pieces (the text between candidates) and _found (array of struct of text, score) to all columns."""
    t, p = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")
    any_found = t.rlike(CANDIDATE)
    one = docs.select("*", F.when(any_found, F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).alias("_texts"), F.when(any_found, F.split(t, CANDIDATE, -1)).alias("_pieces"))

    def before(i: Column) -> Column:
        """What stands before a candidate, other candidates too."""
        near = F.sequence(F.greatest(i - CONTEXT // SHORTEST, F.lit(0)), i)
        parts = F.transform(near, lambda k: F.concat(F.when(k > 0, F.right(F.get("_texts", k - 1), F.lit(CONTEXT))).otherwise(F.lit("")), F.right(F.get("_pieces", k), F.lit(CONTEXT))))
        return F.right(F.array_join(parts, ""), F.lit(CONTEXT))

    vectors = F.transform("_texts", lambda c, i: features(c, before(i), F.left(F.get("_pieces", i + 1), F.lit(CONTEXT)), p))
    two = one.withColumn("_vectors", vectors)
    scores = F.transform("_vectors", lambda v: as_column(forest, lambda i: F.get(v, F.lit(i))))
    return two.withColumn("_scores", scores).drop("_vectors")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", labelled: DataFrame | None = None) -> DataFrame:
    """A row for each candidate: ``key``, start (code points from 0), length, candidate, score, is_secret."""
    own = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_t"), *([F.col(f"`{path}`").alias("_path")] if path else []))
    found = _judged(own, fit(docs.sparkSession, labelled), "_t", "_path" if path else None).where("_texts is not null")
    sizes = F.zip_with("_pieces", "_texts", lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
    starts = F.zip_with(F.slice(running_sums(sizes), 1, F.size("_texts")), F.col("_texts"), lambda end, c: end - F.length(c))
    rows = found.select("_key", F.explode(F.arrays_zip(starts.alias("start"), F.col("_texts").alias("candidate"), F.col("_scores").alias("score"))).alias("z"))
    c = F.col("z.candidate")
    return rows.select(F.col("_key").alias(key), F.col("z.start").alias("start"), F.length(c).alias("length"), c.alias("candidate"), F.round("z.score", 6).alias("score"), (F.col("z.score") >= THRESHOLD).alias("is_secret"))


def redact_secrets(docs: DataFrame, text: str = "text", path: str | None = "source", labelled: DataFrame | None = None, length: str | None = None) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by a mask; texts without one are not changed.

    A column named by ``length`` gets the code points of a text that is changed.
    """
    own, names = shielded(docs)
    held = f"_in{names.index(text)}"
    found = _judged(own, fit(docs.sparkSession, labelled), held, f"_in{names.index(path)}" if path in names else None)
    parts = F.transform("_pieces", lambda p, i: F.concat(p, F.coalesce(F.when(F.get("_scores", i) >= THRESHOLD, F.lit(MASK)), F.get("_texts", i), F.lit(""))))
    some = F.exists("_scores", lambda s: s >= THRESHOLD)
    out = {c: F.col(c) for c in own.columns}
    out[held] = F.when(some, F.array_join(parts, "")).otherwise(F.col(held))
    if length in names:
        size = f"_in{names.index(length)}"
        out[size] = F.when(some, F.length(out[held]).cast(own.schema[size].dataType)).otherwise(F.col(size))
    return found.select(*(v.alias(c) for c, v in out.items())).toDF(*names)
