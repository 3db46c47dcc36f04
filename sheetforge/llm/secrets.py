"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

A candidate is a token-like string of at least 16 characters, or a value of any length and alphabet that follows a
secret name or stands as the password of user:password@host (user: up to 256 name characters). Its features are length, character transitions,
coverage by dictionary words, the path it stands under and the words around it. The forest is trained
from labelled findings. ``label_findings`` makes them from evidence that the features don't hold: vendors' formats, the name that a
value is assigned to, a word that says what a value is. These are cut out of the words around it before features are taken, so the
forest learns from values, paths and other neighbours, and judges candidates without such evidence. A labelled candidate is judged by a
forest that saw neither it nor any candidate of equal value, so that a forest may overrule a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetforge.llm.common import dropped, stored

_NAME = r"(?:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
_TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\.[A-Za-z0-9_-]{16,}){0,2}={0,2}"
# The short lookbehinds come first; they end the attempt at nearly all places of a text. Lookbehinds need a bound: 8 blanks on each side.
_NAMED = (
    r"(?<=[:=>\s\"'])(?<=[:=>]\s{0,8}[\"']?)(?<=(?i:" + _NAME + r")[\"']?\s{0,8}[:=]{1,2}>?\s{0,8}[\"']?)"
    r"(?:(?<=\")(?:[^\"\\\r\n]|\\.)++(?=\")|(?<=')(?:[^'\\\r\n]|\\.)++(?=')|(?!" + _TOKEN + r"[&,;)\]}<>])(?<![\"'])[^\s\"':=>][^\s\"']*(?<![,;.)\]}])|(?<=[\"'])[^\s\"']+(?<![,;.)\]}]))"
)
# Only the first colon after a user name starts an attempt, so a run of colons is searched once.
_LOGIN = r"(?<=:)(?<=(?<![A-Za-z0-9._%+:-])[A-Za-z0-9._%+-]{1,256}:)(?!/)[^\s\"'<>]+(?=@[A-Za-z0-9\[])"
CANDIDATE = f"{_NAMED}|{_LOGIN}|{_TOKEN}"

# Formats that vendors document for their keys, and key names that announce a secret.
KNOWN_FORMATS = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}|^sk_live_[A-Za-z0-9]{16,}|^xox[abprs]-[A-Za-z0-9-]{10,}|^AIza[A-Za-z0-9_-]{35}$|^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"
SECRET_NAMES = r"(?i)(pass(word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)['\"]?\s*[:=]{1,2}>?\s*['\"]?$"
#: Before the password of user:password@host.
LOGIN = r"[A-Za-z0-9._%+-]:$"
SECRET_WORDS = r"(?i)(pass(word|wd|phrase)?|secret|token|key|auth|credential|bearer|login)"
HARMLESS_WORDS = r"(?i)\b(commit|sha\d*|md5|checksum|digest|hash|uuid|guid|etag|isbn|card|phone|tel|invoice|order|version|revision)\b"
TEST_PATHS = r"(?i)(test|mock|fixture|example|sample|demo|doc)"
# Common words of code and prose whose share of a candidate speaks against a secret.
DICTIONARY = [
    "about", "access", "account", "action", "address", "admin", "after", "again", "agent", "align", "alpha", "and", "array", "asset", "auto", "back", "base", "before", "begin",
    "block", "book", "build", "button", "cache", "call", "center", "change", "check", "class", "clear", "client", "close", "cloud", "code", "color", "column", "common", "config",
    "content", "control", "copy", "count", "create", "data", "date", "debug", "default", "delete", "design", "detail", "device", "dialog", "document", "down", "edit", "element",
    "empty", "error", "event", "example", "export", "field", "file", "filter", "find", "first", "font", "form", "format", "from", "function", "get", "group", "handler", "header",
    "height", "home", "host", "html", "image", "import", "index", "info", "input", "item", "label", "last", "layout", "left", "level", "library", "line", "link", "list", "load",
    "local", "login", "main", "manager", "media", "menu", "message", "method", "model", "module", "name", "network", "new", "node", "number", "object", "option", "order", "output",
    "page", "panel", "parent", "path", "plugin", "position", "post", "product", "project", "property", "query", "read", "remote", "report", "request", "reset", "response", "result",
    "right", "root", "row", "screen", "script", "search", "section", "select", "server", "service", "session", "set", "setting", "size", "source", "start", "state", "status", "string",
    "style", "system", "table", "target", "template", "test", "text", "theme", "this", "time", "title", "type", "update", "user", "value", "version", "view", "web", "width", "window",
]

FEATURES = ["length", "transitions", "distinct_share", "digit_share", "upper_share", "covered_share", "vowel_share", "slashes", "secret_word", "harmless_word", "signs_near", "digits_near", "capitals_near", "test_path", "path_depth"]
#: What ``label_findings`` reads at the end of before: a name and an assignment, or a word that says what the value is.
_ASSIGNMENT = r"[A-Za-z0-9_.-]*['\"]?\s*[:=]{1,2}>?\s*['\"]?$"
_SAID = r"(?i)\b(commit|sha\d*|md5|checksum|digest|hash|uuid|guid|etag|isbn|card|phone|tel|invoice|order|version|revision)\W{0,4}$"


def _share(text: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(text, pattern, "")) / F.length(text)


def find_candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc, path, place, candidate, before, after): one row per candidate of every whole text.

    before and after are up to 80 characters around it, cut at other candidates, but a name that is one itself and
    is assigned to this one belongs to before. place counts from 0 in
    text order. Null and empty texts have none; repeated rows have theirs each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(path_col).alias("path"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), text.alias("text")).where(F.size("found") > 0)
    around = rows.select("doc", "path", "found", F.transform(F.split("text", CANDIDATE), lambda x: F.struct(F.right(x, F.lit(80)).alias("end"), F.left(x, F.lit(80)).alias("start"))).alias("gaps"))
    gap = F.coalesce(F.get("gaps", F.col("place"))["end"], F.lit(""))
    last = F.get("found", F.col("place") - 1)
    name = F.when(gap.rlike(r"^['\"]?\s*[:=]{0,2}>?\s*['\"]?$") & F.concat(last, gap).rlike(r"[:=]>?\s*['\"]?$"), last)
    return around.select("doc", "path", "gaps", "found", F.posexplode("found").alias("place", "candidate")).select(
        "doc", "path", "place", "candidate", F.right(F.concat(F.coalesce(name, F.lit("")), gap), F.lit(80)).alias("before"), F.coalesce(F.get("gaps", F.col("place") + 1)["start"], F.lit("")).alias("after")
    )


def with_features(candidates: DataFrame) -> DataFrame:
    """``candidates`` plus FEATURES, all doubles; a null path has depth 0. Columns of these names are replaced.

    The name that a value is assigned to, and a word just before it that says what it is, belong to the labels and are cut off first.
    """
    c, low = F.col("candidate"), F.lower("candidate")
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = F.translate(c, upper + lower + digits, "A" * 26 + "a" * 26 + "9" * 10)
    rest = F.regexp_replace(F.regexp_replace("before", _ASSIGNMENT, ""), _SAID, "")
    near = F.concat_ws(" ", F.right(rest, F.lit(48)), F.left(F.regexp_replace("after", "^['\"]", ""), F.lit(24)))
    around = F.length(near).cast("double")
    values = {
        "length": F.length(c),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / F.length(c),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "digit_share": _share(c, "[0-9]"),
        "upper_share": _share(c, "[A-Z]"),
        "covered_share": _share(low, "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"),
        "vowel_share": _share(low, "[aeiou]"),
        "slashes": F.length(c) - F.length(F.replace(c, F.lit("/"))),
        "secret_word": near.rlike(SECRET_WORDS),
        "harmless_word": near.rlike(HARMLESS_WORDS),
        "signs_near": (around - F.length(F.regexp_replace(near, "[=:;{}()<>\\[\\]\"'`#$&*/|]", ""))) / around,
        "digits_near": (around - F.length(F.regexp_replace(near, "[0-9]", ""))) / around,
        "capitals_near": (around - F.length(F.regexp_replace(near, "[A-Z]", ""))) / around,
        "test_path": F.coalesce(F.col("path").rlike(TEST_PATHS), F.lit(False)),
        "path_depth": F.coalesce(F.size(F.split("path", "/")), F.lit(0)),
    }
    return candidates.withColumns({k: v.cast("double") for k, v in values.items()})


def _evidence() -> tuple[Column, Column]:
    """Whether evidence calls a candidate a secret, and whether it calls it none."""
    c = F.col("candidate")
    named = F.col("before").rlike(SECRET_NAMES) | (F.col("before").rlike(LOGIN) & F.col("after").startswith("@"))
    yes = c.rlike(KNOWN_FORMATS) | (named & c.rlike("[0-9]"))
    no = (F.col("before").rlike(_SAID) | c.rlike(r"^[A-Za-z]+$|^[0-9]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[A-Za-z_/.-]+$|(.)\1{7}")) & ~yes & ~named
    return yes, no


def label_findings(candidates: DataFrame) -> DataFrame:
    """Candidates that evidence outside the features decides, with label 1.0 (secret) or 0.0.

    Secret: a vendor's format, or a value with a digit after a secret name or as the password of user:password@host. No secret: a value after a
    word that says what it is, a plain number, word or UUID, one sign many times; if nothing says the contrary.
    """
    yes, no = _evidence()
    return candidates.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).where("label is not null")


def train(findings: DataFrame, *, fit_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel | None:
    """Forest from labelled findings with features; at most ``fit_rows`` of them, those of least hash.

    None when the findings have one label only, or there are none.
    """
    sample = findings.orderBy(F.xxhash64("candidate", "before", "doc"), "doc", "place").limit(fit_rows)
    rows = stored(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label"), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32, minInstancesPerNode=2, featureSubsetStrategy="sqrt").fit(rows)
    dropped(rows)
    return model


def _word(model: RandomForestClassificationModel, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` plus the probability that ``model`` gives, as column ``name``."""
    silent = model.copy().setRawPredictionCol("").setPredictionCol("").setProbabilityCol(name)
    return silent.transform(rows).withColumn(name, F.get(vector_to_array(name), F.lit(1)))


def scan(docs: DataFrame, findings: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5, folds: int = 3) -> DataFrame:
    """(doc, path, place, candidate, FEATURES, label, probability, is_secret) of all candidates.

    ``findings`` are labelled candidates as of ``label_findings``, and train one forest. By default those of ``docs`` themselves do: label is
    what evidence says of a candidate, null where it is silent. They are dealt to ``folds`` by a hash of the value, and a forest is trained
    without each fold. A labelled candidate is judged by the forest that left its fold out, any other by the mean of all forests. Where one
    of the label kinds is missing in what a forest should learn from, the evidence's word stands for all: probability 1 for a known format or a named secret, else 0.
    is_secret is the forest's word at ``threshold``, but true for a known format and false where evidence says none: the forest removes what rules
    call secrets wrongly and judges where they are silent; probability stays its own word, so label and probability measure it. Rows that
    repeat an id, an empty table and texts without candidates need no care: candidates are rows of their own, none gives none. Other columns
    of ``docs`` are ignored, whatever their names. Very long texts are searched in whole.
    """
    found = with_features(stored(find_candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col), "candidates"))
    yes, no = _evidence()
    fold = F.pmod(F.xxhash64("candidate"), F.lit(folds))
    marked = found.withColumns({"label": F.when(yes, 1.0).when(no, 0.0), "fold": fold})
    if findings is None:
        known = label_findings(found).withColumn("fold", fold)
        models = [train(known.where(F.col("fold") != i)) for i in range(folds)]
    else:
        models = [train(findings)]
    sure = F.col("candidate").rlike(KNOWN_FORMATS)
    if any(m is None for m in models):
        named = (F.col("before").rlike(SECRET_NAMES) & F.col("candidate").rlike("[0-9]")) | (F.col("before").rlike(LOGIN) & F.col("after").startswith("@"))
        scored = marked.withColumn("probability", (sure | named).cast("double"))
    else:
        scored = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(marked)
        names = [f"word_{i}" for i in range(len(models))]
        for model, name in zip(models, names, strict=True):
            scored = _word(model, scored, name)
        mean = reduce(Column.__add__, [F.col(n) for n in names]) / len(names)
        own = F.get(F.array(*names), F.col("fold").cast("int")) if findings is None else mean
        scored = scored.withColumn("probability", F.when(F.col("label").isNull(), mean).otherwise(own))
    return scored.select("doc", "path", "place", "candidate", *FEATURES, "label", "probability", (sure | ((F.col("probability") >= threshold) & ~F.col("label").eqNullSafe(0.0))).alias("is_secret"))
