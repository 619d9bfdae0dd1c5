"""Secret scans with a random forest that removes false positives (operator 1), in DataFrame and SQL functions only.

Candidates are what is assigned to a keyword such as `password`, from LEAST characters on and with any characters but quotes,
and elsewhere long runs of key characters in words. A forest over their length, character transitions, dictionary coverage,
path and neighbouring words, trained from labelled findings, says which of them are secrets. The trained forest becomes one SQL
expression over a candidate's features, so that a text is scanned, judged and redacted within its row, without a shuffle or a
join.

Null and empty texts have no candidates. Repeated texts and repeated candidates in a text are reported each. A null path is an
empty one; a table without paths may name another column, which then says nothing. Long texts are scanned whole. A score of
`least` or more, so also a tie at it, is a secret. An empty table gives no rows. A carried column named like a new one gives way
to it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, carried
from .quality import sql_string

TREES, DEPTH, SEED = 15, 8, 11
#: Labelled findings that the forest is trained on.
FINDINGS = 8000
#: Characters of an assigned value, and of a run of key characters that is assigned to nothing, at least.
LEAST, RUN = 4, 12
REDACTED = "[SECRET]"

# What candidates, keywords and placeholders look like (Java regular expressions) and common words.
CANDIDATE = rf"[A-Za-z0-9_+/.~\-]{{{RUN},}}={{0,2}}"
ASSIGNED = r"(?i)(secret|token|passw(or)?d|pwd|api_?-?key|access_?-?key|auth|credential|private.?key)"
SIGN = r"[\w.\-]*[\"']?\s?(:=|=>|=|:)[\"'`(]*"
HARMLESS = r"(?i)(example|sample|dummy|placeholder|changeme|your_|commit|sha1|sha256|md5|checksum|digest|version|uuid|isbn|card|phone|mail|xxxx)"
TEST_PATH = r"(?i)(test|example|sample|docs?/|fixture|mock|spec)"
PREFIXED = r"^(AKIA|ASIA|gh[pousr]_|xox[abp]-|sk_live_|AIza|eyJ)"
_OPEN, _START, _VALUE, _END = r"[=:][\"'`(]*$", r"^[\"'`(]*", r"([^\s\"'`]+)", r"[),;.#\]}]+$"
DICTIONARY = (
    "the and for that with this from have are was not you all can your key api token secret password user name host data file test example sample "
    "config value default change here insert service client server access private public value index page image content version update request response "
    "max min count retry timeout buffer cache path home local mail http https www com org net html json tion ment ing able ent ated ers ity ness"
).split()
SYLLABLES = "tion ent er in on at re he th an ou es ed ing or st ti le la de en au ment que ver sch ung ich ein ado ción mente os".split()


def _features(c: str) -> dict[str, str]:
    """SQL of each feature of a candidate struct c (value, word, left, right, path)."""
    v, near = f"{c}.value", f"concat_ws(' ', {c}.left, {c}.word)"
    before = f"concat_ws(' ', {c}.left, substring_index({c}.word, {v}, 1))"
    n = f"double(length({v}))"
    kinds = f"regexp_replace(regexp_replace(regexp_replace({v}, '[a-z]+', 'a'), '[A-Z]+', 'A'), '[0-9]+', '9')"
    covered = f"length(regexp_replace(lower({v}), {sql_string('(' + '|'.join(sorted(DICTIONARY + SYLLABLES, key=lambda w: (-len(w), w))) + ')')}, ''))"
    return {
        "length": n,
        "digits": f"length(regexp_replace({v}, '[^0-9]', '')) / {n}",
        "upper": f"length(regexp_replace({v}, '[^A-Z]', '')) / {n}",
        "lower": f"length(regexp_replace({v}, '[^a-z]', '')) / {n}",
        "vowels": f"length(regexp_replace({v}, '[^aeiouAEIOU]', '')) / {n}",
        "transitions": f"length({kinds}) / {n}",
        "longest_kind": f"double(array_max(transform(regexp_extract_all({v}, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+', 0), x -> length(x)))) / {n}",
        "different": f"size(array_distinct(split({v}, ''))) / {n}",
        "hex": f"double(int({v} RLIKE '^[0-9a-f]+$|^[0-9A-F]+$'))",
        "separators": f"double(length(regexp_replace({v}, '[^_./~\\\\-]', '')))",
        "dictionary": f"1 - {covered} / {n}",
        "prefixed": f"double(int({v} RLIKE {sql_string(PREFIXED)}))",
        "assigned": f"double(int({before} RLIKE '[=:]\\\\W*$'))",
        "keyword": f"double(int({before} RLIKE {sql_string(ASSIGNED)}))",
        "harmless": f"double(int({near} RLIKE {sql_string(HARMLESS)}))",
        "harmless_right": f"double(int({c}.right RLIKE {sql_string(HARMLESS)}))",
        "at_sign": f"double(int(instr({c}.word, '@') > 0))",
        "url": f"double(int(instr({c}.word, '://') > 0))",
        "symbols": f"double(length(regexp_replace({v}, '[A-Za-z0-9_./~\\\\-]', '')))",
        "test_path": f"double(int({c}.path RLIKE {sql_string(TEST_PATH)}))",
    }


def _candidates(text: str, path: str) -> str:
    """SQL of the array of candidate structs of a text. Runs without a digit are candidates only after a keyword."""
    near = "concat_ws(' ', get(w, i - 2), get(w, i - 1), w[i])"
    run = f"length(w[i]) >= {RUN} AND w[i] RLIKE {sql_string(CANDIDATE)} AND (w[i] RLIKE '[0-9]' OR {near} RLIKE {sql_string(ASSIGNED)})"
    # in the word itself, or in the words before it
    here = f"w[i] RLIKE '[=:].' AND w[i] RLIKE {sql_string(ASSIGNED + SIGN)}"
    there = f"i > 0 AND w[i - 1] RLIKE {sql_string(_OPEN)} AND concat_ws(' ', get(w, i - 2), w[i - 1]) RLIKE {sql_string(ASSIGNED + SIGN + '$')}"
    inner = f"IF({here}, regexp_extract_all(w[i], {sql_string(ASSIGNED + SIGN + _VALUE)}, 4), array())"
    outer = f"IF({there}, array(regexp_extract(w[i], {sql_string(_START + _VALUE)}, 1)), array())"
    assigned = f"filter(transform(array_distinct(concat({inner}, {outer})), v -> regexp_replace(v, {sql_string(_END)}, '')), v -> length(v) >= {LEAST})"
    runs = f"IF({run}, regexp_extract_all(w[i], {sql_string(CANDIDATE)}, 0), array())"
    left = "concat_ws(' ', get(w, i - 3), get(w, i - 2), get(w, i - 1))"
    right = "concat_ws(' ', get(w, i + 1), get(w, i + 2))"
    one = f"named_struct('word_at', i, 'value', v, 'word', w[i], 'left', {left}, 'right', {right}, 'path', coalesce({path}, ''))"
    values = f"element_at(transform(array({assigned}), a -> IF(size(a) > 0, a, {runs})), 1)"
    found = f"flatten(transform(filter(sequence(0, greatest(size(w) - 1, 0)), i -> i < size(w) AND (({run}) OR ({here}) OR ({there}))), i -> transform({values}, v -> {one})))"
    return f"element_at(transform(array(regexp_extract_all(coalesce({text}, ''), {sql_string(WORD)}, 0)), w -> {found}), 1)"


def _tree(node) -> str:
    """SQL of a tree's probability that features f are those of a secret."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return repr(float(stats[1] / max(1e-9, sum(stats)))) + "D"
    s = node.split()
    return f"IF(f[{s.featureIndex()}] <= {float(s.threshold())!r}D, {_tree(node.leftChild())}, {_tree(node.rightChild())})"


def features(findings: DataFrame, text: str = "text", path: str = "path", value: str = "value", label: str = "is_secret") -> DataFrame:
    """(a column for each feature, label) of the candidates that are the labelled value."""
    rows = findings.select(F.expr(_candidates(text, path)).alias("found"), F.col(value).alias("v"), F.col(label).cast("double").alias("label"))
    rows = rows.select(F.explode("found").alias("c"), "v", "label").filter("c.value = v")
    return rows.select(*(F.expr(sql).alias(n) for n, sql in _features("c").items()), "label")


def fit(rows: DataFrame):
    """Spark's forest of features(), over the vector column x."""
    table = VectorAssembler(inputCols=list(_features("c")), outputCol="x").transform(rows).select("x", "label")
    # square roots and thirds of so few features leave too little to choose from
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="0.5", maxBins=32).fit(table)


def as_sql(model) -> str:
    """SQL of a fitted forest's score of an array f of features."""
    return "(" + " + ".join(_tree(t._java_obj.rootNode()) for t in model.trees) + f") / {len(model.trees)}D"


def train(findings: DataFrame, text: str = "text", path: str = "path", value: str = "value", label: str = "is_secret") -> str:
    """SQL of the forest's score of an array f of features. findings: texts with the value found in each and its label."""
    return as_sql(fit(features(findings, text, path, value, label)))


def scan(df: DataFrame, forest: str, text: str = "text", path: str = "source", found: str = "found") -> DataFrame:
    """df with an array of (word_at, value, score) of each candidate."""
    scored = f"transform({_candidates(text, path)}, c -> element_at(transform(array(array({', '.join(_features('c').values())})), f -> named_struct('word_at', c.word_at, 'value', c.value, 'score', {forest})), 1))"
    return df.withColumn(found, F.expr(scored))


def findings(df: DataFrame, forest: str, text: str = "text", path: str = "source", carry: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The columns in carry, word_at, value, score and is_secret of each candidate."""
    carry = carried(carry, ["word_at", "value", "score", "is_secret"])
    rows = scan(df, forest, text, path, "__found").select(*carry, F.explode("__found").alias("__c"))
    return rows.select(*carry, "__c.word_at", "__c.value", "__c.score", (F.col("__c.score") >= least).alias("is_secret"))


def redact(df: DataFrame, forest: str, text: str = "text", path: str = "source", least: float = 0.5) -> DataFrame:
    """df with each secret of its texts replaced by REDACTED."""
    cols = df.columns
    out = scan(df, forest, text, path, "__found")
    # the longest first, so that no secret is left in part
    secrets = f"array_sort(array_distinct(transform(filter(__found, c -> c.score >= {least}D), c -> c.value)), (a, b) -> length(b) - length(a))"
    quoted = r"concat('(?<![A-Za-z0-9])\\Q', replace(s, '\\E', '\\E\\\\E\\Q'), '\\E(?![A-Za-z0-9])')"
    return out.withColumn(text, F.expr(f"IF(exists(__found, c -> c.score >= {least}D), aggregate({secrets}, {text}, (t, s) -> regexp_replace(t, {quoted}, '{REDACTED}')), {text})")).select(*cols)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(text, path, value, is_secret): n findings of known kinds, made by rule from their number.

    What is assigned to a keyword is no secret in a test's path, or where the words behind it call it an example.
    """
    rows = spark.range(n).withColumns({"h": F.sha2(F.concat(F.lit("finding"), "id"), 256), "k": F.pmod(F.xxhash64("id"), F.lit(35)).cast("int")})

    def pick(words: list[str], salt: int) -> str:
        return f"element_at(array({', '.join(sql_string(w) for w in words)}), int(pmod(xxhash64(id, {salt}), {len(words)})) + 1)"

    def prose(salt: int) -> str:
        return "concat_ws(' ', " + ", ".join(f"concat({pick(SYLLABLES, salt + j)}, {pick(SYLLABLES, salt + 10 + j)})" for j in range(3)) + ")"

    word = "concat(" + ", ".join(pick(SYLLABLES, 40 + j) for j in range(6)) + ")"
    short = f"concat({pick(SYLLABLES, 46)}, {pick(SYLLABLES, 47)}, {pick(SYLLABLES, 48)})"
    ident = f"concat({pick(DICTIONARY, 50)}, '_', {pick(DICTIONARY, 51)}, '_', {pick(DICTIONARY, 52)}, '_', id)"
    mixed = "regexp_replace(base64(unhex(h)), '[+/=]', 'Q')"
    lines = "regexp_replace(base64(unhex(concat(h, h))), '[^A-Za-z0-9+/]', '')"
    capitals = "substring(upper(translate(h, '0189', 'WXYZ')), 1, 16)"
    key = pick(["password", "api_key", "token", "secret", "auth_token", "db_password", "SECRET_KEY", "access-key", "pwd"], 60)
    sep = pick(["=", " = ", ": ", ' = "', "=", " = '"], 61)
    keyed = f"concat({key}, {sep})"
    # (value, what stands before it, what stands behind it, whether it is a secret: True, False, or "told" by path and neighbours)
    kinds = [
        ("substring(h, 1, 18)", f"concat({key}, '=')", "''", "told"),
        ("substring(h, 1, 40)", keyed, "''", "told"),
        ("substring(h, 1, 32)", keyed, "''", "told"),
        (f"concat('AKIA', {capitals})", "''", "''", True),
        (f"concat('AKIA', {capitals})", keyed, "''", True),
        ("base64(unhex(h))", keyed, "''", "told"),
        (f"concat('ghp_', substring({mixed}, 1, 36))", "''", "''", True),
        (f"substring({mixed}, 1, 32)", keyed, "''", "told"),
        (f"concat('sk_live_', substring({mixed}, 1, 24))", "''", "''", True),
        (f"concat('eyJ', {mixed}, '.', substring({mixed}, 3, 30))", "'bearer '", "''", True),
        (f"substring({lines}, 1, 64)", "'-----BEGIN RSA PRIVATE KEY-----\\n'", "''", True),
        (f"substring({lines}, 5, 64)", f"concat(substring({lines}, 1, 64), '\\n')", "''", True),
        (f"concat({short}, pmod(id, 97))", keyed, "''", "told"),
        (f"concat(initcap({pick(SYLLABLES, 62)}), {pick(['!', '#', '@', '&', '$', '%'], 63)}, pmod(id, 9973), substring({mixed}, 1, 3), {pick(['!', '*', '?x', '^', '+'], 64)}, 'z')", keyed, "''", "told"),
        (f"substring({mixed}, 1, 8)", keyed, "''", "told"),
        (f"substring({mixed}, 1, 20)", f"concat({pick(['postgres', 'amqp', 'https'], 65)}, '://admin:')", "'@db.internal/main'", True),
        (f"concat({word}, id)", "''", "''", False),
        (word, f"concat({key}, ' ')", "''", False),
        (short, f"concat({key}, ': ')", "''", False),
        (pick(["required", "string", "optional", "None", "null", "true", "<password>", "********", "${PASSWORD}", "os.environ", "prompt", "redacted"], 66), keyed, "''", False),
        ("lpad(string(abs(xxhash64(id, 70))), 16, '4')", "''", "''", False),
        ("lpad(string(abs(xxhash64(id, 71))), 16, '5')", "'card '", "''", False),
        (f"concat({pick(SYLLABLES, 72)}, '.', id, '')", "''", "''", False),
        ("concat('mail', pmod(id, 9), '.example.com')", f"concat({pick(SYLLABLES, 73)}, '.', pmod(id, 99), '@')", "''", False),
        (f"concat('mail', substring({mixed}, 1, 14), '.', {pick(SYLLABLES, 67)}, '.net')", f"concat({pick(SYLLABLES, 73)}, '.', pmod(id, 99), '@')", "''", False),
        (f"concat('//host', pmod(id, 9), '.net/', {pick(DICTIONARY, 68)}, '/', substring({mixed}, 1, 22))", "'https:'", "''", False),
        ("concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), substring(h, 13, 4), substring(h, 17, 4), substring(h, 21, 12))", "'uuid '", "''", False),
        (ident, "''", "''", False),
        (ident, keyed, "''", False),
        (f"concat({pick(['your_api_key_here', 'changeme1234', 'xxxxxxxxxxxxxxxx', 'placeholder_0000', 'example_token_123', 'insert-your-key-1'], 74)}, '')", keyed, "''", False),
        ("substring(h, 1, 40)", pick(["commit ", "sha1: ", "checksum ", "digest=", "md5 "], 75), "''", False),
        ("substring(h, 1, 40)", "''", "' checksum'", False),
        ("h", pick(["sha256:", "sha256 = ", "checksum: "], 76), "''", False),
        ("concat(date_add(date'2020-01-01', int(pmod(id, 1500))), 'T00-00-00')", "''", "''", False),
        (f"concat('AKIA', substring({capitals}, 1, 9), 'EXAMPLE')", f"concat({pick(['example ', 'sample '], 77)}, {key}, {sep})", "''", False),
    ]

    def case(of: int) -> str:
        return "CASE k " + " ".join(f"WHEN {i} THEN {x[of]}" for i, x in enumerate(kinds)) + " END"

    path = pick(["src/app.py", "config/prod.env", "src3", "crawl", "tests/test_app.py", "docs/example.md", "web", "deploy/main.tf"], 78)
    after = pick(["", '"', '"###', "'", ".", ",", " "], 79)
    words = pick(["", "", "", "", "# example", "(dummy value)", "<- placeholder"], 80)
    told, plain = (", ".join(str(i) for i, x in enumerate(kinds) if x[3] == kind) for kind in ("told", True))
    label = f"k IN ({plain}) OR (k IN ({told}) AND words = '' AND NOT path RLIKE {sql_string(TEST_PATH)})"
    rows = rows.select("id", "k", F.expr(case(0)).alias("value"), F.expr(case(1)).alias("before"), F.expr(case(2)).alias("behind"), F.expr(path).alias("path"), F.expr(words).alias("words"))
    text = f"concat({prose(0)}, ' ', before, value, behind, IF(behind = '', {after}, ''), ' ', IF(words = '', '', concat(words, ' ')), {prose(20)})"
    return rows.select(F.expr(text).alias("text"), "path", "value", F.expr(label).alias("is_secret"))
