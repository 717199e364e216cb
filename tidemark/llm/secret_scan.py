"""Secret scans in DataFrame and SQL functions only.

A regular expression finds candidates: runs of token characters, values that a name of a secret is set to, and
private-key headers. Splitting the text
at them gives their places and the words beside them. Features (length, kinds of characters and transitions between
them, distinct pairs, coverage by dictionary words, shape of a path, neighbouring words) go through a random forest that
tells findings from look-alikes. The forest is trained on the driver from labelled findings, a bounded set that is
generated by the rules below, whose features Spark computes by the same expressions; it runs as SQL CASE expressions.
"""

from __future__ import annotations

import base64
import json
import random
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read_table

CHARS = "A-Za-z0-9_+/=\\-"
ASSIGNED_TO = "(?i:passwords?|passwd|passphrase|passcode|pwd|secret|token|credentials?|bearer|auth|authorization|api[_-]?key|(?:access|private|secret|signing|auth|account|client|encryption)[_ -]?key)"
SEPARATOR = r"[\"']?[ \t]{0,3}[=:]{1,2}>?[ \t]{0,3}"
BARE = r"[^\s\"'`<>]*[^\s\"'`<>.,;:)\]}]"
#: A candidate: the header of a private key; the password of a url; what a name of a secret is set to, of any characters
#: and length, bare (with the name, if no space is between) or in quotes; or at least 12 token characters.
#: Each alternative looks at one character first, so that most places of a text cost no more than that.
CANDIDATE = "|".join([
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    r"(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/@\"'<>]+(?=@)",
    rf"(?<![{CHARS}])(?=[A-Za-z_\-]{{1,60}}+(?i: key)?=)[A-Za-z_\-]{{0,30}}{ASSIGNED_TO}=+{BARE}",
    rf"(?<=\")(?<=[=:>][ \t]{{0,3}}\")(?<={ASSIGNED_TO}{SEPARATOR}\")[^\"\r\n]+(?=\")",
    rf"(?<=')(?<=[=:>][ \t]{{0,3}}')(?<={ASSIGNED_TO}{SEPARATOR}')[^'\r\n]+(?=')",
    rf"(?<=[=:> \t])(?<=[=:>][ \t]{{0,3}})(?<={ASSIGNED_TO}{SEPARATOR})(?![=:> \t]){BARE}",
    rf"(?<![{CHARS}])[{CHARS}]{{12,}}+",
])

# Words that speak for a secret beside it, for another kind of value, and words of ordinary identifiers.
SECRET_WORDS = "password passwd passphrase passcode pwd secret token apikey api_key api-key access_key auth bearer credential private key signing aws client_secret"
OTHER_WORDS = "sha1 sha256 md5 checksum digest commit hash uuid guid etag revision version id order invoice isbn card phone example sample dummy placeholder test serial build"
DICTIONARY = "password secret token access client server service config default example sample test user admin data file image index page module version release build source package model order number report record session request response status value"


def word_pattern(words: str) -> str:
    return "(?i)(?<![A-Za-z])(" + "|".join(sorted(words.split(), key=lambda w: (-len(w), w))) + ")(?![A-Za-z])"


def features(cand: Column, before: Column, after: Column) -> dict[str, Column]:
    """By name, as doubles. cand: the candidate; before, after: the text beside it."""
    value = F.regexp_replace(cand, r"^[A-Za-z_\-]{2,40}=+", "")
    value = F.when(F.length(value) >= 6, value).otherwise(cand)
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(value, pattern, ""))) / n
    flag = lambda c: c.cast("int").cast("double")
    lead = F.concat(before, F.regexp_extract(cand, r"^([A-Za-z_\-]{2,40})=+", 1))
    pairs = F.regexp_count(value, F.lit(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "signs": share("[A-Za-z0-9]"),
        "hex_only": flag(value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "kind_changes": pairs / n,
        "case_changes": F.regexp_count(value, F.lit(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / n,
        "consonant_runs": F.regexp_count(value, F.lit(r"(?i)[bcdfghjklmnpqrstvwxz]{4}")) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "dictionary": (F.length(value) - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w))), ""))) / n,
        "path": flag(value.rlike(r"/[A-Za-z]{2,}[^/]*/|^/|[\w-]+/[\w-]+/[\w-]+")),
        "parts": F.regexp_count(value, F.lit(r"[-_/]")).cast("double"),
        "uuid": flag(value.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "prefix": flag(value.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk[-_]|rk_|xox[abprs]-|AIza|eyJ|SG\.|npm_|-----BEGIN)")),
        "assigned": flag(F.concat(before, F.regexp_extract(cand, r"^[A-Za-z_\-]{2,40}(=+)", 1)).rlike(r"[=:]\s*[\"']?$")),
        "in_url": flag(before.rlike(r"://[^\s/:@]*:$") & after.rlike("^@")),
        "quoted": flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "secret_words": flag(lead.rlike(word_pattern(SECRET_WORDS))),
        "other_words": flag(F.concat(lead, F.lit(" "), F.substring(after, 1, 24)).rlike(word_pattern(OTHER_WORDS))),
        "others": share(rf"[^{CHARS}]"),
        "vowels": share("(?i)[aeiouy]"),
        "words": flag(value.rlike(r"^[A-Z]?[a-z]+(?:[-_/][A-Z]?[a-z]+)*$")),
        "placeholder": flag(F.lower(value).rlike("example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000000|1234567|abcdef")),
    }


NAMES = [
    "length", "digits", "upper", "lower", "signs", "hex_only", "kind_changes", "case_changes", "consonant_runs", "distinct",
    "dictionary", "path", "parts", "uuid", "prefix", "assigned", "in_url", "quoted", "secret_words", "other_words", "others", "vowels", "words", "placeholder",
]


def labelled_findings(n: int = 1600, seed: int = 7) -> list[dict]:
    """Candidates with their neighbours and a label, by rule: kinds of secrets, and of values that look like them."""
    r = random.Random(seed)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: r.choice([pick(low, r.randint(2, 9)), *"the and for with from value entry".split()])
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    b64 = lambda k: base64.b64encode(r.randbytes(k)).decode().rstrip("=")
    said = lambda k: "".join(r.choice("bcdfghklmnprstvw") * (r.random() < 0.85) + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "t", "l", "th", "nd"]) for _ in range(k))
    mixed = lambda k: "".join(r.sample(pick(low + up, k - 3) + pick(num, 2) + r.choice("&!#%*@^?"), k))
    keys = "password passwd pwd secret token api_key apikey access_key client_secret auth_token".split()
    others = "sha256 md5 checksum commit digest etag revision build serial order invoice".split()
    out: list[dict] = []

    def add(label: int, before: str, cand: str, after: str) -> None:
        out.append({"cand": cand, "before": before[-60:], "after": after[:60], "label": label})

    while len(out) < n:
        p, q = prose() + " ", " " + prose()
        name, quote = r.choice(keys), r.choice(['"', "'"])
        eq = r.choice([" = ", "=", ": ", " : "])
        kind = r.randrange(30)
        if kind == 0:
            add(1, p, r.choice(["AKIA", "ASIA"]) + pick(up + "234567", 16), q)
        elif kind == 1:
            add(1, f"{p}{name}{eq}{quote}", pick("0123456789abcdef", r.choice([32, 40, 40, 64])), quote + q)
        elif kind == 2:
            add(1, p, f"{name}={pick('0123456789abcdef', r.choice([16, 18, 20, 24, 32]))}", q)
        elif kind == 3:
            add(1, f"{p}{name}{eq}{quote}", pick(low + up + num, r.randint(14, 40)) + "7", quote + q)
        elif kind == 4:
            add(1, p, r.choice(["ghp_", "gho_", "ghs_"]) + pick(low + up + num, 36), q)
        elif kind == 5:
            add(1, p, r.choice(["sk-", "sk_live_", "rk_live_", "xoxb-", "npm_", "glpat-", "AIza"]) + pick(low + up + num, r.randint(20, 40)) + "3", q)
        elif kind == 6:
            add(1, p + r.choice(["Authorization: Bearer ", "bearer ", ""]), "eyJhbGciOiJIUzI1NiJ9" + b64(20), "." + b64(30) + q)
        elif kind == 7:
            add(1, p, r.choice(["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"]), "\n" + b64(40))
        elif kind == 8:
            add(1, p, f"{name}={b64(r.randint(12, 30))}9", q)
        elif kind == 9:
            add(1, f"{p}{name} ", pick(low + up + num, r.randint(16, 40)) + "1", q)
        elif kind == 10:
            add(0, f"{p}{r.choice(others)}{r.choice([' ', ': ', '=', ' = '])}", pick("0123456789abcdef", r.choice([32, 40, 64])), q)
        elif kind == 11:
            add(0, p, str(uuid.UUID(int=r.getrandbits(128))), q)
        elif kind == 12:
            add(0, p + r.choice(["", "card ", "id ", "number "]), pick(num, r.choice([12, 13, 16, 16, 16, 19])), q)
        elif kind == 13:
            add(0, p + r.choice(["", "https://host.example.org", "see "]), r.choice(["/", "docs/", "src/"]) + "/".join(pick(low, r.randint(3, 9)) for _ in range(r.randint(2, 4))) + pick(num, r.randint(1, 4)), q)
        elif kind == 14:
            add(0, p, "-".join(word() for _ in range(r.randint(2, 4))) + "-" + pick(num, r.randint(2, 6)) + pick(low, 6), q)
        elif kind == 15:
            add(0, p, f"20{pick(num, 2)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{pick(num, 2)}" if r.random() < 0.5 else f"20{pick(num, 2)}-{r.randint(10, 12)}-{r.randint(10, 28)}_{pick(num, 6)}", ":" + q)
        elif kind == 16:
            add(0, p, "".join(word().capitalize() for _ in range(r.randint(2, 4))) + pick(num, r.randint(1, 3)) + word().capitalize() + "Handler", q)
        elif kind == 17:
            add(0, f"{p}{name}{eq}{quote}", r.choice(["your-token-here-123", "example1234567", "changeme-12345", "xxxxxxxxxxxx1234", "dummy-secret-000001", "sample_key_123456"]), quote + q)
        elif kind == 18:
            add(0, p, "_".join([r.choice(DICTIONARY.split()) for _ in range(r.randint(2, 4))]) + "_" + pick(num, r.randint(1, 4)), q)
        elif kind == 19:
            add(0, p, pick(low, r.randint(10, 24)) + pick(num, r.randint(1, 2)), q)
        elif kind == 20:
            add(1, f"{p}{name}{eq}{quote}", mixed(r.randint(6, 20)), quote + q)
        elif kind == 21:
            add(1, *((f"{p}", f"{name}={mixed(r.randint(6, 20))}") if eq == "=" else (f"{p}{name}{eq}", mixed(r.randint(6, 20)))), q)
        elif kind == 22:
            add(1, f"{p}{name}{eq}{quote}", " ".join(said(r.randint(1, 3)) for _ in range(r.randint(3, 6))), quote + q)
        elif kind == 23:
            add(1, f"{p}{name}{eq}{quote}", r.choice([pick(low + up, r.randint(8, 40)), said(r.randint(2, 4)) + pick(num, r.randint(1, 4)), pick(low, r.randint(8, 20)), said(r.randint(3, 5))]), quote + q)
        elif kind == 24:
            add(1, p + r.choice(["", name + " "]), pick(low + up, r.randint(20, 48)), q)
        elif kind in (25, 26):
            add(0, p, r.choice([said(r.randint(5, 9)), said(r.randint(5, 9)).capitalize(), said(6).upper()]), r.choice([q, "." + q, ":" + q]))
        elif kind == 27:
            add(0, p + r.choice(["", "see ", "/"]), r.choice(["-", "_", "/", ""]).join(r.choice([str.capitalize, str])(said(r.randint(2, 4))) for _ in range(r.randint(3, 5))), r.choice([q, ": " + word()]))
        elif kind == 28:
            add(1, f"{p}{r.choice(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{pick(low, r.randint(0, 8))}:", r.choice([mixed(r.randint(6, 16)), pick(low + up, r.randint(8, 20)), said(r.randint(2, 4)) + pick(num, 2), pick(low, r.randint(6, 14))]), f"@{pick(low, 6)}.example.org/{pick(low, 4)}{q}")
        else:
            add(0, f"{p}{name}: ", r.choice([*"the this is your must are for and that it a what see not required optional".split(), said(r.randint(1, 3))]), q)
    return out


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 8, seed: int = 11) -> list:
    """Bagged trees by Gini gain, a sample of the features at each node. A node is (feature, cut, low, high); a leaf, P(1)."""
    rng = np.random.default_rng(seed)
    some = max(1, int(np.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray, left: int):
        p = float((y[rows].sum() + 0.25) / (len(rows) + 0.5))
        if left == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return round(p, 4)
        best = (0.0, None)
        total, ones = len(rows), y[rows].sum()
        base = ones * (total - ones) / total
        for f in rng.choice(x.shape[1], some, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, c = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= least) & (k <= total - least)]
            if len(k):
                a = c[k - 1]
                gini = a * (k - a) / k + (ones - a) * (total - k - ones + a) / (total - k)
                j = int(np.argmin(gini))
                if base - gini[j] > best[0] + 1e-9:
                    best = (base - gini[j], (int(f), float(v[k[j] - 1] + v[k[j]]) / 2))
        if best[1] is None:
            return round(p, 4)
        f, cut = best[1]
        return f, round(cut, 6), grow(rows[x[rows, f] <= cut], left - 1), grow(rows[x[rows, f] > cut], left - 1)

    return [grow(np.sort(rng.integers(0, len(y), len(y))), depth) for _ in range(trees)]


def tree_sql(node, names: list[str], of: str = "") -> str:
    if isinstance(node, float):
        return f"{node}D"
    f, cut, low, high = node
    return f"CASE WHEN {of}{names[f]} <= {cut}D THEN {tree_sql(low, names, of)} ELSE {tree_sql(high, names, of)} END"


def forest_sql(trees: list, names: list[str], of: str = "") -> str:
    return "(" + " + ".join(tree_sql(t, names, of) for t in trees) + f") / {len(trees)}D"


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    def one(node, row):
        while not isinstance(node, float):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    return np.array([np.mean([one(t, row) for t in trees]) for row in x])


_forests: dict = {}


def train(spark: SparkSession, findings: list[dict] | None = None) -> list:
    """The forest; for the standard findings it is grown once a session."""
    if findings is None and "standard" in _forests:
        return _forests["standard"]
    rows = findings or labelled_findings()
    told = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<cand:string,before:string,after:string,label:int>>")))
    got = told.select("label", *(c.alias(k) for k, c in features(F.col("cand"), F.col("before"), F.col("after")).items())).collect()
    x, y = np.array([[r[k] for k in NAMES] for r in got], float), np.array([r["label"] for r in got])
    trees = grow_forest(x, y)
    if findings is None:
        _forests["standard"] = trees
    return trees


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, trees: list | None = None) -> DataFrame:
    """Per row: id, n_candidates, n_findings, findings: array of (start, length, score), by start; in code points.

    Null and empty texts have none. Rows that repeat an id, or have none, are scanned each by itself. Other columns are ignored.
    """
    trees = trees or train(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out, of = with_scores(rows, "text", trees)
    hits = F.filter(of["scored"], lambda c: c["score"] >= threshold)
    return out.select(F.col("id").alias(id_col), F.size(of["scored"]).alias("n_candidates"), F.size(hits).alias("n_findings"), F.transform(hits, lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), c["score"].alias("score"))).alias("findings"))


MARK = "\x01"
EMPTY = "cast(array() AS array<struct<start:bigint,length:int,score:double>>)"


def with_scores(rows: DataFrame, text_col: str, trees: list, chunk: int = 256) -> tuple[DataFrame, dict[str, str]]:
    """rows with gaps, cands and scored: array of (start, length, score), one for each candidate. Nothing is shuffled.

    Also what these columns are called, since rows may have columns of such names. The features of all candidates of a text
    are computed inside its row, so hot texts and sources move nowhere. Places are sums over chunks of candidates, so that
    the work grows with their number.
    """
    of = {k: free_name(rows.columns, f"__{k}") for k in ("pieces", "gaps", "cands", "judged", "chunks", "sums", "begins", "scored")}
    pieces, gaps, cands, judged, chunks, sums, begins, scored = of.values()
    # One pass of the pattern puts marks around candidates; a text that has the mark itself takes two passes.
    text, none = F.col(text_col), F.array().cast("array<string>")
    marked = rows.withColumn(pieces, F.when(~text.contains(MARK), F.split(F.regexp_replace(text, f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK, -1)))
    every = lambda of_kind: F.filter(pieces, lambda x, k: k % 2 == of_kind)
    marked = marked.withColumn(gaps, F.when(F.col(pieces).isNull(), F.split(text_col, CANDIDATE, -1)).otherwise(every(0)))
    marked = marked.withColumn(cands, F.when(F.col(pieces).isNotNull(), every(1)).when(F.size(gaps) > 1, F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    n = F.size(cands)
    steps = F.zip_with(F.slice(gaps, F.lit(1), n), cands, lambda g, c: F.struct(g.alias("gap"), c.alias("cand")))
    # A name of over 12 characters is a candidate itself; the value after it has it in the words before.
    steps = F.zip_with(steps, F.slice(F.concat(F.array(F.lit("")), cands), F.lit(1), n), lambda s, c: F.struct(s["gap"].alias("gap"), s["cand"].alias("cand"), F.concat(F.right(c, F.lit(60)), F.right(s["gap"], F.lit(60))).alias("lead")))
    steps = F.zip_with(steps, F.slice(gaps, F.lit(2), F.greatest(n, F.lit(1))), lambda s, g: F.struct(s["gap"].alias("gap"), s["cand"].alias("cand"), s["lead"].alias("lead"), g.alias("next")))
    valued = F.transform(steps, lambda s: F.struct(F.length(s["gap"]).alias("skip"), F.length(s["cand"]).alias("length"), F.struct(*(v.alias(k) for k, v in features(s["cand"], F.right(s["lead"], F.lit(60)), F.left(s["next"], F.lit(60))).items())).alias("f")))
    marked = marked.withColumn(judged, F.when(n > 0, valued))
    marked = marked.withColumn(judged, F.expr(f"transform(`{judged}`, v -> named_struct('skip', v.skip, 'length', v.length, 'score', {forest_sql(trees, NAMES, 'v.f.')}))"))
    marked = marked.withColumn(chunks, F.expr(f"if(size(`{judged}`) > 0, transform(sequence(0, (size(`{judged}`) - 1) div {chunk}), k -> slice(`{judged}`, cast(k * {chunk} + 1 AS int), {chunk})), NULL)"))
    marked = marked.withColumn(sums, F.expr(f"transform(`{chunks}`, c -> aggregate(c, 0L, (a, v) -> a + v.skip + v.length))"))
    marked = marked.withColumn(begins, F.expr(f"transform(sequence(0, size(`{sums}`) - 1), k -> aggregate(slice(`{sums}`, 1, cast(k AS int)), 0L, (a, x) -> a + x))"))
    step = "named_struct('at', a.at + v.skip + v.length, 'all', concat(a.all, array(named_struct('start', a.at + v.skip, 'length', v.length, 'score', v.score))))"
    placed = f"flatten(zip_with(`{chunks}`, `{begins}`, (c, b) -> aggregate(c, named_struct('at', b, 'all', {EMPTY}), (a, v) -> {step}, a -> a.all)))"
    marked = marked.withColumn(scored, F.expr(f"if(`{chunks}` IS NULL, {EMPTY}, {placed})"))
    return marked.drop(pieces, judged, chunks, sums, begins), of


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, mark: str = "[SECRET]", trees: list | None = None) -> DataFrame:
    """docs with each finding replaced by mark; all rows and columns stay, and texts without a finding are unchanged."""
    trees = trees or train(docs.sparkSession)
    own = free_name(docs.columns, "__text")
    rows, of = with_scores(docs.withColumn(own, F.coalesce(F.col(text_col), F.lit(""))), own, trees)
    shown = F.zip_with(of["cands"], of["scored"], lambda c, s: F.when(s["score"] >= threshold, F.lit(mark)).otherwise(c))
    whole = F.concat_ws("", F.flatten(F.zip_with(of["gaps"], F.concat(shown, F.array(F.lit(""))), lambda g, c: F.array(g, c))))
    hit = F.exists(of["scored"], lambda s: s["score"] >= threshold)
    return rows.withColumn(text_col, F.when(hit, whole).otherwise(F.col(text_col))).select(*docs.columns)

def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))

