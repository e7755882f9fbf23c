"""Secret scans: candidates by shape, false positives removed by a random forest, all in column expressions.

A candidate is a long run of key characters, a private key block, or a value of eight characters
and more, whatever its signs, that is assigned to a name like password. Its features are its length, its characters and
the changes between them, how much of it dictionary words cover, whether it stands in a path,
and the words beside it. The forest is fitted on labelled findings by Spark's own learner: findings composed
around values whose kind is known (keys and passwords; digests, paths, ids, pictures), and plain words
of the corpus. It is then written out as one CASE expression for each tree, so scoring joins nothing and moves no text.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored

SAMPLE_DOCS = 20_000  # documents whose findings the forest is fitted on, about
COMPOSED = 200  # values composed for each of the contexts below
DICTIONARY = 1_000  # frequent words of the corpus that the dictionary holds
TREES, DEPTH = 25, 7
MASK = "[secret]"
BEFORE, AFTER = 48, 16  # characters beside a candidate that are looked at

# Shapes, names that announce a secret, and words that real secrets seldom hold.
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----))*+-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
# a sign of equality belongs to a run only as padding at its end, not between a name and its value
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]|[\"'`][^\s\"'`,;)\]}]))?"
ISSUED = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|-----BEGIN .*)"
NAMES = r"(?i)(?:token|secret|passwd|password|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential)"
ASSIGNED = NAMES + r"[A-Za-z0-9_]{0,20}[\"']?\s{0,3}(?:=|:|=>|:=)\s{0,3}[\"']?$"
# Values of at least eight characters, signs too: between quotes behind a name from NAMES, or bare behind a name and '=' or ':'.
# References like ${NAME} are no values. A sign that often follows a value belongs to it only if the value goes on.
QUOTED = "|".join(
    f"(?<={q})(?<={NAMES}[A-Za-z0-9_]{{0,20}}[\"']?\\s{{0,3}}(?:=|:|=>|:=)\\s{{0,3}}{q})(?!\\$[{{(]|\\{{\\{{)(?:[^{q}\\s\\\\]|\\\\\\S){{8,}}+(?={q})" for q in "\"'"
)
BARE = (
    r"(?:(?<=[=:>])|(?<=[=:>][ \t])|(?<=[=:>][ \t]{2})|(?<=[=:>][ \t]{3}))(?<=" + NAMES + r"[A-Za-z0-9_]{0,20}[\"']?[ \t]{0,3}(?:=|:|=>|:=)[ \t]{0,3})(?![=:>]|//|\$[{(]|\{\{)"
    r"(?:[^\s\"'`<>&;,.)\]}]|[&;,.)\]}](?![\s\"'`<>&;,.)\]}]|$|[A-Za-z0-9_.-]{1,64}=)){8,}+"
)
CANDIDATE = f"(?:{BLOCK})|(?<=[\"'=:> \\t])(?:{QUOTED}|{BARE})|(?:{RUN})"  # one cheap look back before the long ones
WORDS = r"(?i)(?:the|and|ing|tion|ment|ation|that|with|for|this|have|from|test|example|sample|name|user|data|file|http|www|index|value|string|number|lich|ung|ent|que|eau|ado|ión|ver|er|an|on|en|re|st|es|or|ou|de|le|la)"
DIGEST = r"(?i)(?:sha-?\d*|md5|hash|checksum|digest|commit|revision|etag|integrity|uuid|guid|fingerprint|base64|version|blob|id)[\"']?[\s:=,-]{0,4}[\"']?$"
SAID = r"(?i)(?:bearer|basic|" + NAMES[4:] + r"\s+(?:is|was|to|set to|of))[\"']?\s{1,3}[\"']?$"
PATH_WORDS = ["usr", "local", "lib", "var", "run", "home", "etc", "opt", "src", "main", "python", "site", "packages", "config", "settings", "secrets", "service", "handler"]

# Contexts of composed findings: what stands before the value, the kind of value, what stands behind it, and whether it is a secret.
CONTEXTS = [
    ('token = "', "hex40", '" ', 1), ("token: ", "hex40", "\n", 1), ("api_key=", "hex32", "\n", 1), ("?access_token=", "hex40", "&page=2", 1),
    ("Authorization: Bearer ", "mixed", "\n", 1), ("authorization: Basic ", "base64", "\n", 1), ("export SECRET_KEY=", "base64", "\n", 1),
    ("client_secret: '", "mixed", "',", 1), ("the password is ", "mixed", " for now", 1), ("password: ", "phrase", ", next", 1),
    ('"password": "', "phrase", '"', 1), ("DB_PASSWORD=", "phrase", "\n", 1), ("aws_secret_access_key = ", "base64", "\n", 1),
    ("private_key = ", "hex64", "\n", 1), ("the token was ", "hex40", ".", 1), ("x-api-key: ", "mixed", "\n", 1),
    ("sha1: ", "hex40", "\n", 0), ("commit ", "hex40", "\n", 0), ("sha256 = ", "hex64", "\n", 0), ("md5: ", "hex32", " ok", 0), ("checksum ", "hex64", " of ", 0),
    ('"integrity": "sha512-', "base64", '"', 0), ("etag: \"", "hex32", '"', 0), ("id = ", "uuid", "\n", 0), ("uuid: ", "uuid", " and", 0),
    ("see build ", "hex40", " for more", 0), ("data:image/png;base64,", "base64", '"', 0), ("image ", "base64", " end", 0), ("token: ", "path", "\n", 0),
    ("auth_module = ", "path", "\n", 0), ("password_file=", "path", "\n", 0), ("open ", "path", " first", 0), ("https://x.org", "path", " ", 0), ("secret = ", "name", "\n", 0),
    ("credentials: ", "name", "\n", 0), ("call ", "name", " then", 0), ("number ", "digits", " and", 0), ("call ", "digits", ".", 0), ("of ", "uuid", ",", 0),
    ("token_id: ", "uuid", "\n", 0), ("auth commit ", "hex40", "\n", 0), ("password hash: ", "hex64", "\n", 0),
]

FEATURES = [
    "length", "digits", "upper", "lower", "signs", "hex", "distinct", "changes", "vowels", "dictionary", "path", "named", "assigned", "quoted",
    "known", "segments", "digest", "said", "uuid",
]


class Forest(list):
    """Trees as SQL text, and the dictionary their features were made with."""

    def __init__(self, trees: list[str] = (), words: tuple[str, ...] = ()) -> None:
        super().__init__(trees)
        self.words = tuple(words)


def _share(c: Column, pattern: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.length(c)


def _known(value: Column, words: tuple[str, ...]) -> Column:
    """Share of ``value`` in whole words of the dictionary."""
    if not words:
        return F.lit(0.0)
    parts = F.split(F.lower(F.regexp_replace(value, "(?<=[a-z])(?=[A-Z])", " ")), r"[^\p{L}]+")
    return F.aggregate(F.filter(parts, lambda w: w.isin(*words)), F.lit(0), lambda n, w: n + F.length(w)) / F.length(value)


def features(value: Column, before: Column, after: Column, words: tuple[str, ...] = ()) -> Column:
    """An array in the order of ``FEATURES``; ``words`` is the dictionary."""
    flag = lambda c: c.cast("double")
    steps = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    return F.array(
        F.length(value).cast("double"),
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        _share(value, "[a-z]"),
        _share(value, "[^A-Za-z0-9]"),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        F.length(F.regexp_replace(F.regexp_replace(value, steps, " "), "[^ ]", "")) / F.length(value),
        _share(value, "(?i)[aeiou]"),
        _share(value, WORDS),
        flag(value.contains("/") | before.rlike(r"(?:/|\\|\.|www|https?:)$")),
        flag(before.rlike(NAMES)),
        flag(before.rlike(ASSIGNED)),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        _known(value, words),
        (F.length(value) - F.length(F.regexp_replace(value, "[/._-](?=[A-Za-z])", ""))).cast("double"),
        flag(before.rlike(DIGEST)),
        flag(before.rlike(SAID)),
        flag(value.rlike("^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")),
    )


def with_candidates(docs: DataFrame, text: str, gaps: str, found: str, words: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``gaps`` (what stands around the candidates) and ``found`` (struct of value, x, issued, assigned)."""
    hits = fresh([*docs.columns, gaps, found], "hits")
    cut = F.struct(F.coalesce(F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)), F.array()).alias(hits), F.split(F.col(text), CANDIDATE, -1).alias(gaps))
    # behind a generator the matches are made once, however often they are used
    parts = docs.select("*", F.inline(F.array(cut)))

    def one(value: Column, i: Column) -> Column:
        near = lambda k: F.concat(F.col(gaps)[k], F.coalesce(F.get(hits, k), F.lit("")))
        # a long name is a candidate itself, and still stands before its value
        before = F.right(F.concat(F.when(i > 0, near(F.greatest(i - 1, F.lit(0)))).otherwise(F.lit("")), F.col(gaps)[i]), F.lit(BEFORE))
        after = F.left(F.concat(near(i + 1), F.coalesce(F.get(gaps, i + 2), F.lit(""))), F.lit(AFTER))
        return F.struct(
            value.alias("value"), features(value, before, after, words).alias("x"), value.rlike(ISSUED).alias("issued"), before.rlike(ASSIGNED).alias("assigned")
        )

    listed = F.struct(F.transform(F.col(hits), one).alias(found))
    return parts.select(*docs.columns, gaps, F.inline(F.array(listed)))


def frequent_words(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> tuple[str, ...]:
    """The dictionary: the ``size`` most frequent words of 3 to 24 letters in all documents, and ``PATH_WORDS``.

    Ties go by the word. What reaches the driver is bounded by ``size``, not by the corpus.
    """
    words = docs.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).filter(F.length("w").between(3, 24))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()
    return tuple(sorted({r.w for r in top} | set(PATH_WORDS)))


def composed_findings(spark: SparkSession, words: tuple[str, ...] = (), each: int = COMPOSED, contexts: list[tuple] = CONTEXTS) -> DataFrame:
    """Labelled findings (``n``, ``context``, ``x``, ``label``): values of known kinds in known contexts.

    Value ``n`` is made from hashes of its number, so the findings are the same in every run.
    """
    some = F.split(F.lit(" ".join(words or PATH_WORDS)), " ")  # one literal, however many words
    word = lambda salt: F.get(some, F.pmod(F.hash("n", F.lit(salt)), F.size(some)))
    seed = lambda salt: F.concat(F.lit(salt), F.col("n").cast("string"))
    wide = F.sha2(seed("base64"), 256)
    packed = F.regexp_replace(F.base64(F.unhex(wide)), "=", "")
    kinds = {
        "hex32": F.md5(seed("hex32").cast("binary")),
        "hex40": F.sha1(seed("hex40").cast("binary")),
        "hex64": F.sha2(seed("hex64"), 256),
        "base64": F.substring(packed, 1, 40),
        "mixed": F.left(F.regexp_replace(packed, "[+/]", "x"), F.pmod(F.col("n"), F.lit(17)) + 20),
        "phrase": F.concat(F.initcap(word("p")), F.lit("#"), F.left(wide, F.lit(5)), F.lit("!"), F.upper(F.right(wide, F.lit(2)))),
        "uuid": F.regexp_replace(F.md5(seed("uuid").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        "path": F.concat(F.lit("/"), F.array_join(F.array(F.lit("usr"), word("a"), word("b"), F.lit("site-packages"), word("c")), "/"), F.pmod(F.col("n"), F.lit(10)).cast("string")),
        "name": F.array_join(F.array(word("d"), F.lit("service"), word("e"), word("f")), "_"),
        "digits": F.rpad(F.pmod(F.xxhash64("n"), F.lit(10**16)).cast("string"), 16, "7"),
    }
    made = [
        F.struct(F.lit(i).alias("context"), F.col(kind).alias("value"), F.concat("g", F.lit(" " + left), kind, F.lit(right), "h").alias("text"), F.lit(float(label)).alias("label"))
        for i, (left, kind, right, label) in enumerate(contexts)
    ]
    values = spark.range(each).withColumnRenamed("id", "n").select("n", *[c.alias(k) for k, c in kinds.items()], word("g").alias("g"), word("h").alias("h"))
    texts = values.select("n", F.inline(F.array(*made)))
    found = with_candidates(texts, "text", "gaps", "found", words).select("n", "context", "value", "label", F.explode("found").alias("f"))
    # a long name before the value can be a finding too, and nobody said what that is
    return found.filter(F.col("f.value").contains(F.col("value"))).select("n", "context", "f.x", "label")


def label_findings(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text", words: tuple[str, ...] = ()) -> DataFrame:
    """Findings ``x`` with ``label`` 0: plain words and plain numbers of a bounded sample of documents, picked by a hash of their text.

    Only findings that can be nothing else are taken: letters alone or digits alone, of no
    issued shape and not assigned to a name. The others are not labelled.
    """
    total = docs.count()
    share = F.lit(int(min(1.0, sample_docs / max(1, total)) * (1 << 30)))
    sample = docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < share)
    found = with_candidates(sample, text, "gaps", "found", words).select(F.explode("found").alias("f"))
    plain = ~F.col("f.issued") & ~F.col("f.assigned") & F.col("f.value").rlike("^(?:[A-Za-z]+|[0-9]+)$")
    return found.filter(plain).select("f.x", F.lit(0.0).alias("label"))


def fit(findings: DataFrame) -> list[str]:
    """A forest on findings with ``x`` and ``label``: one SQL expression over ``f`` for each tree; none without both labels."""
    kinds = {r["label"] for r in findings.select("label").distinct().collect()}
    if not {0.0, 1.0} <= kinds:
        return []
    rows = findings.select(array_to_vector("x").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows)
    return trees_of(forest.toDebugString)


def trees_of(described: str) -> list[str]:
    """The printed trees as CASE expressions."""
    out: list[list[str]] = []
    for line in described.splitlines():
        line = line.strip()
        if line.startswith("Tree "):
            out.append([])
        elif m := re.match(r"If \(feature (\d+) (<=|>) (\S+)\)", line):
            out[-1].append(f"CASE WHEN f[{m[1]}] {m[2]} {float(m[3])!r}D THEN ")
        elif line.startswith("Else"):
            out[-1].append(" ELSE ")
        elif m := re.match(r"Predict: (\S+)", line):
            out[-1].append(f"{float(m[1])!r}D")
    return [_closed("".join(t)) for t in out]


def _closed(tree: str) -> str:
    """Put an END behind the second branch of each CASE."""
    done, waiting = [], []
    for part in re.split(r"(CASE WHEN [^T]* THEN | ELSE )", tree):
        if part.startswith("CASE"):
            waiting.append(2)
        done.append(part)
        if part and not part.startswith(("CASE", " ELSE")):
            while waiting:
                waiting[-1] -= 1
                if waiting[-1]:
                    break
                waiting.pop()
                done.append(" END")
    return "".join(done)


def scan(docs: DataFrame, trees: list[str], text: str = "text", secrets: str = "secrets", threshold: float = 0.5, columns_only: bool = False) -> DataFrame:
    """All columns of ``docs``, the secrets in ``text`` masked, and ``secrets``: array of (value length, score).

    ``n_candidates`` counts what was looked at. Issued shapes are secrets whatever the trees say;
    without trees a rule decides: a value with digits that is assigned to a name from ``NAMES``. A null text stays null. ``columns_only`` returns
    just the columns of ``docs``. Repeated rows stay; no shuffle, no Python.
    """
    own = [c for c in docs.columns if c not in (secrets, "n_candidates")]
    gaps, found, judged = (fresh([*docs.columns, secrets, "n_candidates"], n) for n in ("gaps", "found", "judged"))
    parts = with_candidates(docs.select(*own), text, gaps, found, getattr(trees, "words", ()))
    vote = " + ".join(f"({t})" for t in trees)
    score = F.expr(f"transform(`{found}`.x, f -> ({vote}) / {len(trees)}D)") if trees else F.transform(F.col(found), lambda f: (f["issued"] | (f["assigned"] & (f["x"][1] > 0))).cast("double"))
    each = F.zip_with(
        F.col(found), score, lambda f, s: F.struct(f["value"].alias("value"), F.when(f["issued"], F.lit(1.0)).otherwise(s).alias("score"))
    )
    parts = parts.select(*own, gaps, F.inline(F.array(F.struct(each.alias(judged)))))
    shown = F.transform(F.col(judged), lambda j: F.when(j["score"] >= threshold, F.lit(MASK)).otherwise(j["value"]))
    whole = F.array_join(F.zip_with(F.col(gaps), shown, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    masked = F.when(F.exists(judged, lambda j: j["score"] >= threshold), whole).otherwise(F.col(text)).alias(text)
    out = [masked if c == text else F.col(c) for c in own]
    if columns_only:
        return parts.select(*out)
    kept = F.transform(F.filter(judged, lambda j: j["score"] >= threshold), lambda j: F.struct(F.length(j["value"]).alias("length"), j["score"].alias("score")))
    return parts.select(*out, F.size(judged).cast("long").alias("n_candidates"), kept.alias(secrets))


def learn(docs: DataFrame, text: str = "text") -> Forest:
    """The dictionary of all documents, and a forest fitted on composed findings and a bounded sample's plain ones."""
    words = frequent_words(docs, text)
    findings = composed_findings(docs.sparkSession, words).select("x", "label").unionByName(label_findings(docs, text=text, words=words))
    return Forest(fit(stored(findings, "secret-findings")), words)
