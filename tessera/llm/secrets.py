"""Secret scans with a random forest against false positives (operator 4), DataFrame expressions only.

Candidates are found by one pattern. Each gets features: length, shares of
character classes, transitions between classes and common letter pairs, the share that
dictionary words cover, whether it is part of a path or address, and the words before and after it. A
random forest is trained from labelled findings, and a candidate that most trees take
for something else is dropped. The trained trees become one SQL expression, so a text's findings are
scored in its own row: nothing is exploded, joined or shuffled.

The labelled findings are ``labelled_findings``: formats of credentials and of what
resembles them (digests, identifiers, numbers, paths, placeholders), filled from hashes of a
counter; their number is bounded by ``FINDINGS``. A table of one's own with the same columns
(secret, before, is_secret, and after if known) can be given instead.

Defined results: a null or empty text has no findings; texts are scanned whole;
repeated rows each have theirs; a null doc_id is kept; an empty table gives no rows;
offsets and lengths count characters; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled findings to train on, trees, their depth, and the share of trees that makes a secret.
FINDINGS, TREES, DEPTH, THRESHOLD = 6_000, 24, 8, 0.5
#: Characters before and after a candidate that are looked at.
BEFORE = AFTER = 48
#: What is put in a secret's place.
MASK = "[SECRET]"

# Fixed word lists of the features.
COMMON_PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur")
DICTIONARY = ("example", "sample", "dummy", "changeme", "placeholder", "password", "secret", "token", "default", "admin", "user", "test", "demo", "your", "here", "name", "file", "path", "image", "data", "http", "https", "www", "html", "index", "home", "page", "config", "version", "release", "build", "library", "local", "share", "module", "python", "java", "node", "docs", "api", "key", "null", "none", "true", "false", "value", "string", "number", "item", "list", "report", "summary", "draft", "final", "news", "article", "post", "photo", "video")
TELLING = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api key", "access_key", "auth", "bearer", "credential", "private", "client_secret", "login")
HARMLESS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "isbn", "phone", "tel", "order", "invoice", "version", "example", "sample", "id", "ref", "revision", "etag")

#: Candidates may be of any length: the runs are possessive, so they don't backtrack. A candidate is a private key block; a value of at
#: least eight characters assigned to a telling name, with blanks and a quote allowed between; or a run of at least fourteen token
#: characters with a digit in it. Blanks between are as many as the features look back (lookbehinds need a bound).
_NAMES = "|".join(sorted((name.replace(" ", "[ _-]") for name in TELLING), key=len, reverse=True))
PATTERN = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,24}PRIVATE KEY-----"
    r"|(?<=[=:\s\"'`])(?=[^\s\"'`<>,;=:])(?<=[=:]\s{0,48}[\"'`]?)"
    r"(?<=(?i:" + _NAMES + r")[\"'`]?\s{0,48}[=:]\s{0,48}[\"'`]?)[^\s\"'`<>,;]{8,}+"
    r"|(?<![A-Za-z0-9+/_.%-])(?=[A-Za-z+/_.%-]*+[0-9])[A-Za-z0-9+/_.%-]{14,}+={0,2}"
)

#: Every candidate has a digit or follows this.
ASSIGNED = r"(?i)(" + _NAMES + r")[\"'`]?\s*[=:]|PRIVATE KEY"


#: A candidate has at least eight characters, so that so many before it, and what lies between, make up the characters looked at.
_NEAR = -(-BEFORE // 8)
#: Candidates whose lengths are added up together.
_RUN = 64


def find(text: Column) -> Column:
    """The findings of a text: an array of (start, value, before)."""
    return F.transform(_placed(_found(text)["hits"]), lambda f: F.struct(f["start"].alias("start"), f["value"].alias("value"), f["before"].alias("before")))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(text: Column) -> Column:
    """(hits, rest): the findings of a text, each with the gap before it and the characters before and after; what follows the last.

    All of it comes from the pattern's hits and the gaps between, so the time is linear in the text and in the findings.
    """
    split = F.struct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("hits"), F.split(text, PATTERN, -1).alias("gaps"))

    def build(s: Column) -> Column:
        hits, gaps = s["hits"], s["gaps"]

        def one(h: Column, i: Column) -> Column:
            back = F.transform(F.sequence(F.greatest(F.lit(0), i - _NEAR), i), lambda j: F.concat(F.right(F.get(gaps, j), F.lit(BEFORE)), F.when(j < i, F.right(F.get(hits, j), F.lit(BEFORE))).otherwise("")))
            ahead = F.transform(F.sequence(i + 1, F.least(F.size(hits), i + 1 + _NEAR)), lambda j: F.concat(F.left(F.get(gaps, j), F.lit(AFTER)), F.coalesce(F.left(F.get(hits, j), F.lit(AFTER)), F.lit(""))))
            return F.struct(h.alias("value"), F.get(gaps, i).alias("gap"), F.right(F.array_join(back, ""), F.lit(BEFORE)).alias("before"), F.left(F.array_join(ahead, ""), F.lit(AFTER)).alias("after"))

        return F.struct(F.transform(hits, one).alias("hits"), F.element_at(gaps, -1).alias("rest"))

    likely = text.rlike("[0-9]") | text.rlike(ASSIGNED)
    return F.when(likely, _once(split, build))


def _placed(hits: Column) -> Column:
    """``hits`` (with value and gap) with their ``start``: sums of the lengths so far, by runs of ``_RUN``."""

    def place(s: Column) -> Column:
        add = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["sizes"]) - 1) / _RUN).cast("int")), lambda r: add(F.slice(s["sizes"], r * _RUN + 1, F.lit(_RUN))))

        def one(t: Column) -> Column:
            def start(h: Column, i: Column) -> Column:
                r = F.floor(i / _RUN).cast("int")
                here = add(F.slice(s["sizes"], r * _RUN + 1, i - r * _RUN)) + F.get(t["before"], r) + F.char_length(h["gap"])
                return h.withField("start", here)

            return F.transform(s["hits"], start)

        before = _once(runs, lambda r: F.transform(r, lambda x, i: add(F.slice(r, F.lit(1), i))))
        return _once(F.struct(before.alias("before")), one)

    sized = F.struct(hits.alias("hits"), F.transform(hits, lambda h: F.char_length(h["gap"]) + F.char_length(h["value"])).alias("sizes"))
    return F.when(F.size(hits) > 0, _once(sized, place))


def features(value: Column, before: Column, after: Column | None = None) -> list[tuple[str, Column]]:
    after = F.lit("") if after is None else after
    n = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    without = lambda pattern: (n - F.char_length(F.regexp_replace(value, pattern, ""))) / n
    runs = F.char_length(F.regexp_replace(value, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x")) - 1
    has = lambda c, words: F.when(F.lower(c).rlike(r"(?<![a-z])(" + "|".join(words) + r")(?![a-z])"), 1.0).otherwise(0.0)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        ("length", n),
        ("lower", without("[a-z]")),
        ("upper", without("[A-Z]")),
        ("digits", without("[0-9]")),
        ("other", without("[A-Za-z0-9]")),
        ("transitions", runs / n),
        ("distinct", F.size(F.array_distinct(F.split(value, ""))) / n),
        ("pairs", without("(?i)" + "|".join(COMMON_PAIRS))),
        ("covered", without("(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True)))),
        ("repeats", without(r"(.)\1{2,}")),
        ("hex", flag(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$"))),
        ("uuid", flag(value.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))),
        ("known", flag(value.rlike("^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|sk-|xox[abpr]-|AIza|eyJ|-----BEGIN)"))),
        ("path", flag(value.rlike("[/.].*[/.]") | value.rlike(r"\.[a-z]{2,5}$") | before.rlike(r"(://|/|\.|@)\S*$"))),
        ("assigned", flag(before.rlike(r"[=:]\s*[\"'`]?$"))),
        ("quoted", flag(before.rlike(r"[\"'`]$"))),
        ("telling", has(before, TELLING)),
        ("harmless", has(before, HARMLESS)),
        ("telling_after", has(after, TELLING)),
        ("harmless_after", has(after, HARMLESS)),
    ]


#: The number of features.
WIDTH = 20


def _hex(n: int, salt: int) -> str:
    return f"substring(concat({', '.join(f'''sha2(concat(id, '/{salt}/{i}'), 256)''' for i in range(-(-n // 64)))}), 1, {n})"


def _letters(n: int, salt: int, alphabet: str) -> str:
    """``n`` characters of ``alphabet``, picked by hashes of the row's id."""
    return f"array_join(transform(sequence(1, {n}), i -> substring('{alphabet}', 1 + cast(pmod(xxhash64(id, {salt}, i), {len(alphabet)}) as int), 1)), '')"


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """(secret, before, is_secret, after): the formats below, filled from hashes of a counter."""
    mixed = UPPER + LOWER + DIGITS
    words = "array('time', 'nation', 'ender', 'hertion', 'sting', 'report', 'image', 'lateron', 'theread', 'notes')"
    word = lambda i: f"element_at({words}, 1 + cast(pmod(xxhash64(id, {i}), 10) as int))"
    plain = f"concat({word(91)}, ' ', {word(92)}, ' ', {word(93)}, ' ')"
    follows = f"concat(' ', {word(94)}, ' ', {word(95)})"
    # Fixed formats: what a finding looks like, what stands before it, whether it is a secret, and what follows it if that tells.
    forms = [
        (f"concat('AKIA', {_letters(16, 1, UPPER + DIGITS)})", plain, 1),
        (f"concat('AKIA', {_letters(16, 2, UPPER + '234567')})", f"concat({plain}, 'aws_access_key_id = ')", 1),
        (_hex(18, 3), f"concat({plain}, 'password=')", 1),
        (_letters(14, 4, mixed + "%._-"), f"concat({plain}, 'password: ')", 1),
        (_hex(40, 5), f"concat({plain}, 'token = \"')", 1),
        (_hex(32, 6), f"concat({plain}, 'api_key: \"')", 1),
        (f"concat('ghp_', {_letters(36, 7, mixed)})", plain, 1),
        (f"concat('sk_live_', {_letters(24, 8, mixed)})", plain, 1),
        (f"concat('eyJ', {_letters(20, 9, mixed)}, '.', {_letters(40, 10, mixed)}, '.', {_letters(40, 11, mixed + '_-')})", f"concat({plain}, 'Bearer ')", 1),
        (_letters(40, 12, mixed + "+/"), f"concat({plain}, 'secret=')", 1),
        (f"concat('xoxb-', {_letters(12, 13, DIGITS)}, '-', {_letters(24, 14, mixed)})", plain, 1),
        (f"concat('-----BEGIN RSA PRIVATE KEY-----', {_letters(120, 15, mixed + '+/')}, '-----END RSA PRIVATE KEY-----')", plain, 1),
        (_hex(40, 21), f"concat({plain}, 'commit ')", 0),
        (_hex(64, 22), f"concat({plain}, 'sha256: ')", 0),
        (_hex(32, 23), f"concat({plain}, 'md5=')", 0),
        (_hex(40, 24), plain, 0),
        (f"concat({_hex(8, 25)}, '-', {_hex(4, 26)}, '-', {_hex(4, 27)}, '-', {_hex(4, 28)}, '-', {_hex(12, 29)})", f"concat({plain}, 'id: ')", 0),
        (_letters(16, 30, DIGITS), plain, 0),
        (f"concat('555-', {_letters(4, 31, DIGITS)}, '-', {_letters(6, 32, DIGITS)})", f"concat({plain}, 'phone ')", 0),
        (f"concat({_letters(3, 33, DIGITS)}, '.', {_letters(3, 34, DIGITS)}, '.', {_letters(3, 35, DIGITS)}, '.', {_letters(3, 36, DIGITS)})", plain, 0),
        (f"concat('usr/lib/', {word(37)}, '/', {word(38)}, '-', {_letters(3, 39, DIGITS)}, '/index.html')", f"concat({plain}, '/')", 0),
        (f"concat({word(40)}, {_letters(2, 41, DIGITS)}, {word(42)}, {word(43)})", plain, 0),
        (f"concat('2024-0', {_letters(1, 44, '123456789')}, '-', {_letters(2, 45, DIGITS)}, '-', {word(46)}, '-', {word(47)})", f"concat({plain}, 'https://example.com/')", 0),
        (f"concat({word(48)}, '.', {_letters(2, 49, DIGITS)}, 'mail', {_letters(1, 50, DIGITS)}, '.example.com')", f"concat({plain}, {word(51)}, '@')", 0),
        (f"concat('your-', {word(52)}, '-key-here-', {_letters(2, 53, DIGITS)})", f"concat({plain}, 'api_key: ')", 0),
        ("repeat('x', 16)", f"concat({plain}, 'password=')", 0),
        (f"concat('changeme', {_letters(6, 54, '1234')})", f"concat({plain}, 'password=')", 0),
        (f"concat({word(55)}, {word(56)}, {word(57)})", f"concat({plain}, 'token: ')", 0),
        (_letters(10, 58, mixed + "!@#$"), f"concat({plain}, 'password = \"')", 1),
        (_letters(12, 59, mixed), f"concat({plain}, 'access_key: ')", 1),
        (f"concat({word(60)}, {_letters(1, 61, DIGITS)}, {_letters(3, 62, LOWER)})", f"concat({plain}, 'pwd=\"')", 1),
        (f"concat({_letters(4, 63, LOWER)}, {_letters(4, 64, DIGITS)})", f"concat({plain}, 'api_key = \"')", 1),
        (_letters(11, 65, "bcdfghjkmnpqrstvwxzQWXZ"), f"concat({plain}, 'secret: ')", 1),
        (f"concat('eyJ', {_letters(200, 66, mixed)}, '.', {_letters(1500, 67, mixed)}, '.', {_letters(340, 68, mixed + '_-')})", f"concat({plain}, 'Bearer ')", 1),
        (_letters(900, 69, mixed + "+/"), f"concat({plain}, 'token=')", 1),
        (f"concat('-----BEGIN PRIVATE KEY-----', {_letters(1600, 70, mixed + '+/')}, '-----END PRIVATE KEY-----')", plain, 1),
        (_letters(24, 71, mixed), plain, 1, "' is the api key'"),
        (_hex(40, 72), plain, 0, "' is the commit'"),
        (f"concat({word(73)}, {word(74)})", f"concat({plain}, 'password: ')", 0),
        (f"element_at(array('required', 'undefined', 'username', 'optional', 'whatever'), 1 + cast(pmod(xxhash64(id, 75), 5) as int))", f"concat({plain}, 'auth: ')", 0),
        (f"repeat({_letters(2, 76, mixed)}, 200 + cast(pmod(xxhash64(id, 77), 9000) as int))", plain, 0),
    ]
    pick = lambda k: "case " + " ".join(f"when kind = {i} then {f[k]}" for i, f in enumerate(forms)) + " end"
    after = "case " + " ".join(f"when kind = {i} then {f[3]}" for i, f in enumerate(forms) if len(f) > 3) + f" else {follows} end"
    base = spark.range(0, rows, 1, 1).selectExpr("id", f"cast(id % {len(forms)} as int) as kind")
    return base.selectExpr(f"{pick(0)} as secret", f"{pick(1)} as before", f"{pick(2)} as is_secret", f"{after} as after")


class Forest:
    """The trained trees, as nested (feature, threshold, left, right) or a leaf's class."""

    def __init__(self, trees: list):
        self.trees = trees

    def score(self, values: list[Column]) -> Column:
        """The share of trees that take the finding for a secret."""

        def grow(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(values[feature] <= threshold, grow(left)).otherwise(grow(right))

        return reduce(lambda a, b: a + b, map(grow, self.trees)) / F.lit(float(len(self.trees)))


def _parsed(printed: str) -> list:
    """Trees from the trained model's printed form."""
    lines = [x.strip() for x in printed.splitlines() if re.match(r"\s*(If|Else|Predict|Tree)", x)]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        left = node()
        at += 1  # its Else
        return int(feature), float(threshold), left, node()

    trees = []
    while at < len(lines):
        at += 1  # the tree's heading
        trees.append(node())
    return trees


def train(findings: DataFrame) -> Forest:
    """A forest from labelled findings (secret, before, is_secret, and after if it is there)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    values = features(F.col("secret"), F.col("before"), F.col("after"))
    rows = findings if "after" in findings.columns else findings.withColumn("after", F.lit(""))
    rows = rows.where("secret is not null and is_secret is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")})
    rows = rows.select(F.col("is_secret").cast("double").alias("label"), *(c.cast("double").alias(name) for name, c in values))
    rows = VectorAssembler(inputCols=[name for name, _ in values], outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=42, featureSubsetStrategy="sqrt").fit(rows)
    return Forest(_parsed(model.toDebugString))


def scored(text: Column, forest: Forest) -> Column:
    """(hits, rest): all candidates of a text with their score, and what follows the last."""

    def one(f: Column) -> Column:
        known = F.array(*(c.cast("double") for _, c in features(f["value"], f["before"], f["after"])))
        vote = _once(known, lambda v: forest.score([F.get(v, F.lit(i)) for i in range(WIDTH)]))
        return F.struct(f["value"].alias("value"), f["gap"].alias("gap"), vote.alias("score"))

    return _once(_found(text), lambda s: F.struct(F.transform(s["hits"], one).alias("hits"), s["rest"].alias("rest")))


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The secrets of all documents: doc_id, start, length, value, score."""
    hits = _placed(scored(F.col("text"), forest)["hits"])
    found = docs.select("doc_id", F.explode(F.filter(hits, lambda f: f["score"] >= threshold)).alias("f"))
    return found.select("doc_id", F.col("f.start").alias("start"), F.char_length("f.value").alias("length"), F.col("f.value").alias("value"), F.col("f.score").alias("score"))


def redact(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """``docs`` with each secret replaced by ``mask``; texts without secrets are unchanged."""
    text = F.col("text")

    def put(s: Column) -> Column:
        parts = F.transform(s["hits"], lambda f: F.concat(f["gap"], F.when(f["score"] >= threshold, F.lit(mask)).otherwise(f["value"])))
        return F.when(F.exists(s["hits"], lambda f: f["score"] >= threshold), F.concat(F.array_join(parts, ""), s["rest"]))

    return docs.withColumn("text", F.coalesce(_once(scored(text, forest), put), text))
