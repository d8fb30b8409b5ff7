"""Secret scans: candidates by pattern, false positives removed by a random forest, with DataFrame and SQL functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.llm.base import documents, free

#: Words that name what follows as secret, and words that name it as something else.
SECRET_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "auth", "bearer", "credential", "private_key", "access_key", "client_secret")
OTHER_WORDS = ("commit", "sha1", "sha256", "md5", "checksum", "hash", "digest", "revision", "uuid", "guid", "id", "order", "invoice", "isbn", "phone", "version", "build", "example", "sample", "serial", "ticket")
#: Prefixes that issuers give their keys, and the beginning of a private key.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "eyJ")
PEM = "-----BEGIN"
#: Words whose letters count as covered by the dictionary.
DICTIONARY = (
    "the", "and", "ing", "tion", "er", "test", "user", "name", "data", "file", "home", "main", "page", "image", "index", "value", "key", "your", "here", "example", "sample", "dummy", "change",
    "default", "config", "server", "client", "local", "release", "version", "build", "report", "chapter", "section", "table", "order", "item", "number", "date", "time", "year", "month", "error", "message", "system", "public",
    "static", "assets", "style", "script", "model", "base", "list", "view", "node", "edge", "word", "text", "line", "part", "src", "lib", "usr", "bin", "tmp", "var", "log", "org", "com", "net", "http", "https", "www",
    "about", "access", "account", "action", "address", "admin", "after", "again", "array", "before", "block", "book", "branch", "button", "cache", "call", "case", "check", "class", "code", "color", "column", "content", "context",
    "control", "count", "country", "create", "current", "day", "debug", "delete", "design", "detail", "device", "direct", "document", "download", "drive", "editor", "email", "enable", "engine", "entry", "event", "export", "field",
    "final", "first", "folder", "format", "front", "function", "general", "global", "group", "guide", "header", "help", "history", "image", "import", "info", "input", "install", "language", "layer", "level", "library", "license",
    "link", "load", "login", "manager", "master", "media", "member", "menu", "method", "module", "network", "none", "null", "object", "option", "output", "package", "parent", "patch", "path", "payment", "people", "phone", "photo",
    "please", "point", "policy", "post", "print", "process", "product", "profile", "project", "query", "random", "read", "record", "request", "required", "reset", "result", "sales", "schema", "search", "service", "session",
)

_RUN = r"[A-Za-z0-9+/_\-]{12,}={0,2}"
_EDGE = r"(?<![A-Za-z0-9+/_\-])"
#: What may be secret: a private key; a value that a name ascribes to itself; three parts with dots that begin as a web token does; at least
#: 12 letters, digits and + / _ - in a row, from the start of such a run, with two digits among them.
_KEY = r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----)?"
_NAMED = r"(?i:{names})(?:[\"']?[=:]>?[\"']?)[^\s\"'<>,;&]{{6,}}"
_TOKEN = _EDGE + r"eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]+){1,2}"
_DIGITS = _EDGE + r"(?=[A-Za-z+/_\-]*[0-9][A-Za-z+/_\-]*[0-9])" + _RUN
#: The name directly before a candidate, at the end of what its word has before it.
_NAME = r"(?:^|[^A-Za-z0-9_.\-])[_.\-]*([A-Za-z][A-Za-z0-9_.\-]{1,40}[\"']?[=:]+>?)[\"'(\[{<]*$"
#: Code points before and after a candidate in which its neighbouring words are looked for.
_BEFORE, _AFTER = 80, 40
#: Inputs of the forest, in order.
FEATURES = (
    "length", "digits", "upper", "lower", "hexadecimal", "class_changes", "letter_pairs", "distinct", "dictionary", "slashes", "marks", "issuer", "secret_name", "secret_near", "other_near", "other_after", "placeholder", "date_like",
    "all_digits", "all_letters", "dots",
)
#: Labelled findings in the training set; trees, their depth, and the share of votes that makes a finding a secret.
FINDINGS, TREES, LEVELS, VOTES = 8_000, 20, 7, 0.5


def _any(words: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True)) + ")"


_NAMED = _NAMED.format(names=_any(SECRET_WORDS))
_MAY_HOLD = "|".join((_KEY, _NAMED, _TOKEN, _DIGITS))
_PARTS = f"^({_any(SECRET_WORDS)}[\"']?[=:]>?)[\"']?(.*)$"


def _with(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def candidates(text: Column) -> Column:
    """array<struct<name, value, near, after, lead>>: each candidate of the text, with the name directly before it, the three words before
    its word, the word after it, and how many code points of the pattern's match come before the value.

    A text without a candidate gives null; it is told by one pattern match. Every other text is cut at its matches.
    """
    return F.when(F.coalesce(text, F.lit("")).rlike(_MAY_HOLD), _with(_cut(text), lambda p: _of(p)))


def _cut(text: Column) -> Column:
    return F.struct(F.regexp_extract_all(text, F.lit(_MAY_HOLD), F.lit(0)).alias("runs"), F.split(text, _MAY_HOLD, -1).alias("gaps"))


def _of(p: Column) -> Column:
    def one(run: Column, k: Column) -> Column:
        last = F.greatest(k - 1, F.lit(0))
        earlier = F.when(k > 0, F.concat(F.get(p["gaps"], last), F.get(p["runs"], last))).otherwise(F.lit(""))
        lead = F.substring(F.concat(F.substring(earlier, -_BEFORE, _BEFORE), F.get(p["gaps"], k)), -_BEFORE, _BEFORE)
        behind = F.substring(F.concat(F.get(p["gaps"], k + 1), F.coalesce(F.get(p["runs"], k + 1), F.lit(""))), 1, _AFTER)
        own = F.regexp_extract(run, "(?is)" + _PARTS, 1)
        value = F.when(own != "", F.regexp_extract(run, "(?is)" + _PARTS, 2)).otherwise(run)
        name = F.when(own != "", own).otherwise(F.regexp_extract(lead, _NAME, 1))
        near = F.rtrim(F.regexp_extract(lead, r"((?:\S+\s+){0,3})\S*$", 1))
        return F.struct(F.lower(name).alias("name"), value.alias("value"), F.lower(near).alias("near"), F.lower(F.regexp_extract(behind, r"^\S*\s+(\S+)", 1)).alias("after"), (F.length(run) - F.length(value)).alias("lead"))

    return F.transform(p["runs"], one)


def features(c: Column) -> Column:
    """array<double> of FEATURES of a candidate (struct<name, value, near, after>)."""
    v = c["value"]
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    around = F.concat_ws(" ", c["near"], c["name"])
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    parts = (
        F.least(n, F.lit(200.0)),
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        flag(v.rlike("^[0-9a-f]+$") | v.rlike("^[0-9A-F]+$")),
        share(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        share(r"(?i)(?<=[bcdfghjklmnpqrstvwxz])(?=[aeiouy])|(?<=[aeiouy])(?=[bcdfghjklmnpqrstvwxz])"),
        F.size(F.array_distinct(F.split(v, ""))) / n,
        1 - F.length(F.regexp_replace(F.lower(v), _any(DICTIONARY), "")) / n,
        share("/"),
        share(r"[_.\-+!?#$%^*@]"),
        flag(v.rlike("^(?:" + _any(PREFIXES) + "|" + PEM + ")")),
        flag(c["name"].rlike(_any(SECRET_WORDS))),
        flag(around.rlike(_any(SECRET_WORDS))),
        flag(around.rlike(r"(?:^|[^a-z])" + _any(OTHER_WORDS) + r"(?:$|[^a-z])")),
        flag(c["after"].rlike(r"(?:^|[^a-z])" + _any(OTHER_WORDS) + r"(?:$|[^a-z])")),
        flag(v.rlike(r"(?i)x{4,}|(.)\1{5,}|12345|your|example|changeme|placeholder|dummy|\*{4,}")),
        flag(v.rlike(r"^[0-9]{4}-[0-9]{2}|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|^[0-9]{1,4}[-/][0-9]{1,4}[-/]")),
        flag(v.rlike(r"^[0-9/+_\-]+$")),
        flag(v.rlike(r"^[A-Za-z_.()\[\]{}$-]+$")),
        share(r"\."),
    )
    return F.array(*(x.cast("double") for x in parts))


def findings(spark: SparkSession, n: int = FINDINGS, seed: int = 0) -> DataFrame:
    """(name, value, near, after, label) of n labelled findings, half of them secrets, of the kinds that scanners find; the same each time
    for a seed."""
    row = spark.range(seed * 1_000_003, seed * 1_000_003 + n)
    pick = lambda seed, words: F.element_at(F.array(*(F.lit(w) for w in words)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(words))) + 1).cast("int"))
    hexes = F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256))
    packed = F.base64(F.unhex(hexes))
    loose = F.regexp_replace(packed, "[+/=]", "")
    capitals = F.translate(F.upper(hexes), "018", "GQZ")
    size = lambda seed, lo, hi: (F.lit(lo) + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(hi - lo + 1))).cast("int")
    cut = lambda x, long: F.substring(x, F.lit(1), long)
    some = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("string")
    prose = ("the of and", "in der und", "de la que", "that was with", "", "un les dans", "as on it", "von mit zu")
    said = lambda seed, extra: F.concat_ws(" ", pick(seed, prose), extra)
    wordy = lambda sep: F.concat_ws(sep, pick(21, DICTIONARY[5:]), pick(22, DICTIONARY[5:]), pick(23, DICTIONARY[5:]), some(24, 9000))
    none, named = F.lit(""), F.concat(pick(3, SECRET_WORDS), pick(4, ("=", ":", "':")))
    word = pick(25, ("hunter", "dragon", "Sommer", "letmein", "Winter", "monkey", "tiger", "Passw0rd", "qwerty", "blue", "Kaffee", "sunny"))
    chosen = F.concat(word, some(26, 99), pick(27, ("!", "#", "$x", "", "_", "?7")), cut(hexes, size(28, 0, 4)))
    kinds = [  # name, value, near, label
        (named, cut(hexes, size(5, 12, 40)), said(6, none), 1),
        (none, cut(hexes, size(5, 20, 64)), said(6, F.concat(pick(3, SECRET_WORDS), pick(4, (" =", " :", " is")))), 1),
        (none, F.concat(pick(7, PREFIXES[:2]), cut(capitals, F.lit(16))), said(6, none), 1),
        (none, F.concat(pick(7, PREFIXES[2:-1]), cut(loose, size(5, 20, 40))), said(6, none), 1),
        (named, cut(loose, size(5, 14, 44)), said(6, none), 1),
        (none, cut(packed, size(5, 24, 64)), said(6, F.concat(pick(3, SECRET_WORDS), pick(4, (" =", " :", " is")))), 1),
        (named, chosen, said(6, none), 1),
        (pick(29, ("", "token=", "bearer:", "auth=")), F.concat(F.lit("eyJ"), cut(loose, size(5, 16, 40)), F.lit("."), F.substring(loose, F.lit(9), size(30, 16, 70)), F.lit("."), F.substring(loose, F.lit(20), size(31, 16, 43))), said(6, none), 1),
        (none, F.concat(F.lit("-----BEGIN "), pick(32, ("RSA ", "EC ", "", "OPENSSH ")), F.lit("PRIVATE KEY-----\n"), packed, F.lit("\n"), F.reverse(packed)), said(6, none), 1),
        (none, cut(hexes, F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), (F.pmod("id", F.lit(3)) + 1).cast("int"))), said(6, pick(8, OTHER_WORDS[:8])), 0),
        (pick(9, ("id=", "uuid:", "", "order=", "ref:")), F.regexp_replace(cut(hexes, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), said(6, pick(8, OTHER_WORDS)), 0),
        (none, cut(F.regexp_replace(hexes, "[a-f]", "7"), size(5, 12, 20)), said(6, pick(10, ("card", "number", "phone", "", "the", "order"))), 0),
        (none, wordy("/"), said(6, none), 0),
        (pick(11, ("", "name=", "file:", "class:")), wordy("_"), said(6, none), 0),
        (none, F.concat(wordy("-"), F.lit("-2021")), said(6, pick(12, ("see", "version", "file", "chapter"))), 0),
        (named, F.concat(pick(13, ("your_token_here_", "xxxxxxxxxxxx", "example-key-", "changeme", "placeholder_", "1234567890", "********")), F.lit("12345")), said(6, none), 0),
        (none, F.concat_ws("-", F.pmod(F.xxhash64("id", F.lit(14)), F.lit(80)) + 1950, F.lit("10"), F.lit("12T"), F.pmod(F.xxhash64("id", F.lit(15)), F.lit(9000)) + 1000), said(6, none), 0),
        (named, F.concat(pick(21, DICTIONARY[5:]), pick(33, ("_", ".", "", "-")), pick(22, DICTIONARY[5:]), pick(34, ("", "()", "name", "value"))), said(6, none), 0),
        (pick(35, ("", "page=", "url:")), F.concat(wordy("/"), F.lit("/"), cut(hexes, F.lit(8))), said(6, pick(36, ("see", "at", "from", ""))), 0),
    ]
    yes = [k for k, x in enumerate(kinds) if x[3]]
    no = [k for k, x in enumerate(kinds) if not x[3]]
    which = F.when(F.pmod("id", F.lit(2)) == 0, F.element_at(F.array(*map(F.lit, yes)), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(len(yes))) + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, no)), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(len(no))) + 1).cast("int")))
    made = F.element_at(F.array(*(F.struct(a.alias("name"), v.alias("value"), w.alias("near"), F.lit(y).cast("double").alias("label")) for a, v, w, y in kinds)), which + 1)
    after = F.when((which == no[0]) & (F.pmod(F.xxhash64("id", F.lit(37)), F.lit(2)) == 0), pick(38, OTHER_WORDS[:8])).otherwise(pick(39, ("the", "in", "and", "", "que", "mit", "of", "for")))
    return row.select(made.alias("x"), after.alias("after")).select("x.name", "x.value", "x.near", "after", "x.label")


def parsed(forest: str) -> list[tuple]:
    """The trees of a forest's description: ("leaf", vote) or (feature, threshold, at most it, over it)."""
    trees, lines = [], []
    for line in [*forest.splitlines()[1:], "  Tree"]:
        if line.strip().startswith("Tree"):
            if lines:
                trees.append(_node(lines))
            lines = []
        else:
            lines.append(line.strip())
    return trees


def _node(lines: list[str]) -> tuple:
    line = lines.pop(0)
    if line.startswith("Predict:"):
        return "leaf", float(line.split(":")[1])
    feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _node(lines)
    lines.pop(0)  # Else
    return int(feature), float(threshold), low, _node(lines)


def train(spark: SparkSession, labelled: DataFrame | None = None) -> list[tuple]:
    """The trees of a random forest on labelled findings (name, value, near, after, label); None: findings()."""
    rows = findings(spark) if labelled is None else labelled
    x = rows.select("label", array_to_vector(features(F.struct("name", "value", "near", "after"))).alias("features"))
    return parsed(RandomForestClassifier(numTrees=TREES, maxDepth=LEVELS, seed=5, featureSubsetStrategy="sqrt").fit(x.coalesce(1)).toDebugString)


def votes(c: Column, trees: Sequence[tuple]) -> Column:
    """Share of the trees that take a candidate for a secret: the trees as nested conditions."""

    def vote(node: tuple, x: Column) -> Column:
        if node[0] == "leaf":
            return F.lit(node[1])
        feature, threshold, low, high = node
        return F.when(F.get(x, F.lit(feature)) <= threshold, vote(low, x)).otherwise(vote(high, x))

    return _with(features(c), lambda x: reduce(lambda a, b: a + b, [vote(t, x) for t in trees]) / len(trees))


def _ends(sizes: Column) -> Column:
    """Running sums of an array, by doubling steps."""
    rounds = F.ceil(F.log2(F.size(sizes) + F.lit(1.0))).cast("int")
    power = lambda j: F.pow(F.lit(2.0), j).cast("int")
    return F.aggregate(F.sequence(F.lit(0), rounds), sizes, lambda acc, j: F.transform(acc, lambda x, i: x + F.when(i >= power(j), F.get(acc, F.greatest(i - power(j), F.lit(0)))).otherwise(0)))


def scan(docs: DataFrame, trees: Sequence[tuple], text: str = "text", least: float = VOTES, into: str = "findings") -> DataFrame:
    """docs with into: array<struct<value, start, votes, secret>> of each whole text, null where it has no candidate.

    start: code points before the value in the text, for each of its occurrences. Null and empty texts have none; repeated rows are
    scanned each. A column of that name is an error. All of it is one projection: no row is shuffled.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {into}")

    def placed(p: Column) -> Column:
        sizes = F.transform(p["runs"], lambda r, k: F.length(F.get(p["gaps"], k)) + F.length(r))
        return _with(
            F.struct(F.transform(_of(p), lambda c: F.struct(c["value"].alias("value"), c["lead"].alias("lead"), votes(c, trees).alias("votes"))).alias("found"), _ends(sizes).alias("ends")),
            lambda x: F.transform(x["found"], lambda s, k: F.struct(s["value"].alias("value"), (F.get(x["ends"], k) - F.length(s["value"])).alias("start"), s["votes"].alias("votes"), (s["votes"] >= least).alias("secret"))),
        )

    return docs.withColumn(into, F.when(F.coalesce(text, F.lit("")).rlike(_MAY_HOLD), _with(_cut(F.col(text)), placed)))


def redacted(docs: DataFrame, trees: Sequence[tuple], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by mark at its place in the text, and n_chars, if there is one, of the new text; all rows stay.

    A candidate is replaced if it, or an equal one in the same text, is judged a secret.
    """
    new = free("redacted", docs)

    def rebuilt(p: Column) -> Column:
        def joined(x: Column) -> Column:
            secret = F.transform(F.filter(x, lambda s: s["secret"]), lambda s: s["value"])
            piece = lambda s, k: F.concat(F.get(p["gaps"], k), F.when(F.array_contains(secret, s["value"]), F.concat(F.substring(F.get(p["runs"], k), F.lit(1), s["lead"]), F.lit(mark))).otherwise(F.get(p["runs"], k)))
            return F.when(F.size(secret) > 0, F.concat(F.array_join(F.transform(x, piece), ""), F.get(p["gaps"], F.size(p["runs"]))))

        return _with(F.transform(_of(p), lambda c: F.struct(c["value"].alias("value"), c["lead"].alias("lead"), (votes(c, trees) >= VOTES).alias("secret"))), joined)

    out = docs.withColumn(new, F.when(F.coalesce(text, F.lit("")).rlike(_MAY_HOLD), _with(_cut(F.col(text)), rebuilt)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn(text, F.coalesce(new, text)).select(*docs.columns)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per candidate: doc_id, nth (in its text), start, length, value_sha256, votes, secret. Null and empty texts and texts without a
    candidate give no rows; repeated rows give their candidates each."""
    found = scan(documents(spark, sf_dir), train(spark)).where("findings is not null")
    each = found.select("doc_id", F.posexplode("findings").alias("nth", "f"))
    return each.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("f.start").cast("long").alias("start"), F.length("f.value").cast("long").alias("length"), F.sha2(F.col("f.value").cast("binary"), 256).alias("value_sha256"), "f.votes", "f.secret")


QUERIES = {"op8_secrets": op8_secrets}
ORACLES: dict[str, str] = {}
