"""Secret scanning with a random forest that removes false positives. Native: SQL and JVM ML only.

Candidates are all runs of ``least`` or more key characters in a word, with a digit or mixed
case, and all values of ``SHORT`` or more characters that a credential word is assigned to,
in the word or in the words before; a word may hold any number of them. Features of a
finding: length, shares of character classes, transitions between classes and letters,
distinct characters, coverage by dictionary words, a known prefix, the path it was found
under and the words on both sides. The forest is trained on labelled findings; by default
on a generated set of bounded size (``labelled_findings``) whose rows are made by rule from
a row number. Its contexts and paths overlap between the classes, and nothing in it is
taken from the tables that the tests or queries read.

Scale: texts are tested by patterns that cost a constant a character, cut into words, and
only candidate words go on; nothing shuffles but the training rows.

Defined results: null and blank texts have no findings; a long text or word costs in
proportion to its length; a finding that occurs twice in a text comes out twice, with its
own place; rows that repeat an id are scanned each; a null id comes out null; a null path
has neutral path features; a probability at the threshold is a secret; an empty table gives
an empty result; other columns are ignored; secrets are returned as SHA-256 and a mask.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 16
SHORT = 6
TRAIN_ROWS = 8000
# Characters of keys and values, words that announce a credential, words that announce something
# harmless, prefixes of well-known keys, common English words and common pairs of letters.
KEY = "[A-Za-z0-9_+/.-]"
QUOTE, VALUE = "[\"'`]", "[^\\s\"'`,;&<>(){}\\[\\]\u0001]"
CREDENTIAL = r"(?i)(token|secret|passw|passphrase|pwd|api_?key|apikey|auth|bearer|credential|private|access_?key)"
NAME = r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|api_?key|auth|bearer|credentials?|private_?key|access_?key|secret_?key)"
HARMLESS = r"(?i)\b(sha[0-9]*|md5|commit|hash|checksum|digest|uuid|guid|example|sample|version|build|id|ref|license|see|path|file|url|required|expired|invalid)\b"
PREFIX = "^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xoxb-|xoxp-|xoxa-|sk-|sk_live_|rk_live_|AIza|ya29|npm_|pypi-|dop_v1_|SG[.]|eyJ)"
HOLDER = r"(?i)(example|sample|changeme|change_me|placeholder|dummy|your|here|xxxx|0000|1234|test|todo|none|null|redacted)"
WORDS = (
    "about after again also another answer area back base because become been before best between board book both build business call case change check city class close code come common company "
    "control could country course data date day different does door down draw each early earth email end enough error even event every example expect face fact family file find first follow food "
    "form found free from full general get give good great group grow hand hard have head help here high hold home hour house idea image important index info inside item just keep key kind know land "
    "large last late learn leave left letter level life light line link list little live local long look main make many market mean member message might mind model money month more morning most move "
    "much must name near need never next night north note nothing number off often old only open order other over own page paper part people place plan play point power present problem program public "
    "question quick read real right river road room run same school second server service set short should show side simple since small sound south special stand start state still stop story street "
    "study such system table take team tell test than that their them then there these they thing think this through time today together token town tree true turn type under unit until user value very"
).split()
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"

_RUN = f"{KEY}{{%d,}}[A-Za-z0-9_+/-]={{0,2}}"
_MIXED = "^[^A-Z]*+[A-Z][^a-z]*+[a-z][^A-Z]*+[A-Z]"  # anchored and possessive: one pass
FEATURES = [
    "length", "digits", "uppers", "lowers", "hexes", "others", "transitions", "pairs", "distinct", "vowels", "dictionary", "longest_letters", "known_prefix", "placeholder",
    "credential_before", "harmless_before", "harmless_after", "assigned", "by_word", "quoted", "path_test", "path_config",
]


def _share(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)) / F.greatest(F.length(s), F.lit(1))


def feature_columns() -> dict[str, Column]:
    """From candidate, before, after, assigned, quoted, path."""
    s, before, path = F.col("candidate"), F.col("before"), F.coalesce("path", F.lit(""))
    n = F.greatest(F.length(s), F.lit(1))
    letters = F.transform(F.regexp_extract_all(F.concat(s, F.lit("a")), F.lit("([A-Za-z]+)"), F.lit(1)), F.length)
    words = "|".join(sorted((w for w in WORDS if len(w) > 2), key=lambda w: (-len(w), w)))
    out = {
        "length": F.least(F.length(s), F.lit(200)), "digits": _share(s, "[0-9]"), "uppers": _share(s, "[A-Z]"), "lowers": _share(s, "[a-z]"), "hexes": _share(s, "[0-9a-fA-F]"),
        "others": _share(s, "[^A-Za-z0-9]"), "transitions": _share(s, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"), "pairs": _share(F.lower(s), f"(?={PAIRS})"),
        "distinct": F.size(F.array_distinct(F.split(s, ""))) / n, "vowels": _share(s, "[aeiouAEIOU]"), "dictionary": 1 - F.length(F.regexp_replace(F.lower(s), words, "")) / n,
        "longest_letters": F.array_max(letters) / n, "known_prefix": s.rlike(PREFIX), "placeholder": s.rlike(HOLDER), "credential_before": before.rlike(CREDENTIAL), "harmless_before": before.rlike(HARMLESS),
        "harmless_after": F.col("after").rlike(HARMLESS), "assigned": F.col("assigned"), "by_word": before.rlike("(?i) (is|was) ?$"), "quoted": F.col("quoted"), "path_test": path.rlike("(?i)test|example|doc|mock|fixture|sample"),
        "path_config": path.rlike(r"(?i)\.env|config|settings|\.ya?ml|secret|\.pem|\.ini|\.tf"),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def candidates(docs: DataFrame, path_col: str | None = "source", least: int = LEAST) -> DataFrame:
    """doc_id, path, word_index, candidate, before, after, assigned, quoted: one row per candidate."""
    path = F.col(path_col) if path_col and path_col in docs.columns else F.lit(None).cast("string")
    run = _RUN % (least - 1)
    value = f"{VALUE}{{{SHORT},}}"
    inner = f"(?<={NAME}{QUOTE}?[=:]{{1,2}}>?{QUOTE}?){value}"
    varied = lambda s: s.rlike("[0-9]") | s.rlike(_MIXED)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), F.col("text"))
    d = d.where((F.col("text").rlike(f"{KEY}{{{least - 1}}}") & varied(F.col("text"))) | F.col("text").rlike(rf"{NAME}{QUOTE}?\s*(?:[=:]|(?:is|was)\s)"))
    # the word before ends in an assigned credential word, or is the sign of assignment after one
    sign = lambda ws, i: F.coalesce(
        F.get(ws, i - 1).rlike(f"{NAME}{QUOTE}?[=:]{{1,2}}>?$") | F.get(ws, i - 1).rlike("^(?:[=:]{1,2}>?|is|was)$") & F.get(ws, i - 2).rlike(f"{NAME}{QUOTE}?$"), F.lit(False)
    )
    # only the places of candidate words are expanded, with the words around each; the words are bound
    # once, as an expression named inside a lambda is computed at each of its steps
    may = lambda ws, i: (F.get(ws, i).rlike(run) & varied(F.get(ws, i))) | F.get(ws, i).rlike(inner) | (sign(ws, i) & F.get(ws, i).rlike(f"^{QUOTE}{{0,2}}{value}"))
    at = lambda ws: F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: may(ws, i))
    around = lambda ws: F.transform(at(ws), lambda i: F.struct(
        i.cast("long").alias("i"), F.get(ws, i).alias("word"), F.array_join(F.slice(ws, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ").alias("before"),
        F.array_join(F.slice(ws, i + 2, F.lit(2)), " ").alias("after"), sign(ws, i).alias("sign"),
    ))
    found = F.get(F.transform(F.array(F.split("text", r"\s+")), around), F.lit(0))
    out = d.select("doc_id", "path", F.explode(found).alias("c")).select("doc_id", "path", F.col("c.i").alias("word_index"), "c.word", F.col("c.before").alias("words_before"), F.col("c.after").alias("words_after"), "c.sign")
    # every match with the text since the match before it; a mark stands for the assignment in the words before.
    # \G holds each search to the end of the last match, so a word is passed once
    marked = F.when(F.col("sign"), F.concat(F.lit("\u0001"), "word")).otherwise(F.col("word"))
    every = F.lit(rf"(?s)\G(.*?)(?:({inner}|(?<=^{chr(1)}{QUOTE}{{0,2}}){value})|({run}))")
    parts = F.arrays_zip(*(F.regexp_extract_all(marked, every, F.lit(g)).alias(name) for g, name in ((1, "lead"), (2, "value"), (3, "run"))))
    out = out.select("*", F.posexplode(parts).alias("nth", "m"))
    assigned = F.col("m.value") != ""
    lead = F.translate("m.lead", "\u0001", "")
    out = out.where(assigned | varied(F.col("m.run"))).select(
        "doc_id", "path", "word_index", F.when(assigned, F.rtrim(F.col("m.value"), F.lit(".:"))).otherwise(F.col("m.run")).alias("candidate"),
        F.when(F.col("nth") == 0, F.concat_ws(" ", "words_before", lead)).otherwise(lead).alias("before"), F.col("words_after").alias("after"),
        (assigned | lead.rlike(f"{QUOTE}?[=:]{{1,2}}>?{QUOTE}?$")).alias("assigned"), F.col("word").rlike(QUOTE).alias("quoted"),
    )
    return out.where(F.length("candidate") >= SHORT)


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """candidate, before, after, assigned, quoted, path, label: findings made by rule from a row number."""
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n))
    among = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    pick = lambda salt, values: among(draw(salt, len(values)), values)
    size = lambda salt, lo, hi: (draw(salt, hi - lo + 1) + lo).cast("int")
    cut = lambda s, n: F.substr(s, F.lit(1), n)
    hexes = F.concat(F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 256), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256))
    b64 = F.translate(F.base64(F.unhex(hexes)), "=", "")
    alnum = F.regexp_replace(b64, "[+/]", "q")
    uuid = F.concat_ws("-", *(F.substr(hexes, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    word = lambda salt: pick(salt, WORDS)
    number = lambda salt: draw(salt, 10**9).cast("string")
    kind = draw(1, 20)
    of = lambda *pairs: F.coalesce(*(F.when(kind == k, v) for k, v in pairs))
    secret = of(
        (0, cut(hexes, size(2, 32, 64))), (1, cut(hexes, F.lit(40))), (2, cut(b64, size(3, 22, 60))), (3, cut(alnum, size(4, 18, 44))), (4, F.upper(cut(alnum, size(5, 16, 40)))),
        (5, F.concat(pick(6, ["AKIA", "ghp_", "sk-", "xoxb-", "glpat-", "AIza", "sk_live_"]), F.when(draw(7, 2) == 0, F.upper(cut(alnum, F.lit(16)))).otherwise(cut(alnum, size(8, 20, 40))))),
        (6, cut(alnum, size(9, 7, 15))), (7, F.concat(F.initcap(word(10)), pick(11, ["!", "#", "_", "-", "."]), word(12), draw(13, 1000).cast("string"))), (8, F.concat(word(14), word(15))), (9, uuid),
    )
    junk = of(
        (10, cut(hexes, among(draw(16, 4), [32, 40, 64, 20]))), (11, uuid), (12, F.concat(word(17), F.initcap(word(18)), F.initcap(word(19)), draw(20, 100).cast("string"))),
        (13, F.concat_ws("_", word(17), word(18), word(19), draw(20, 10000).cast("string"))), (14, F.concat(F.lit("/"), F.concat_ws("/", word(17), word(18), F.concat(word(19), draw(20, 100).cast("string"), pick(21, [".yml", ".py", ".html", ".txt"]))))),
        (15, F.concat(number(22), number(23))), (16, F.concat(number(22), pick(24, [".", "-"]), number(23), pick(24, [".", "-"]), draw(25, 100).cast("string"))),
        (17, pick(26, ["your-token-here", "changeme123", "xxxxxxxxxxxxxxxx", "example-key-0000", "placeholder", "dummy_secret_1", "TEST_TOKEN_1234", "redacted", "insert-your-key-here"])),
        (18, word(27)), (19, F.concat_ws(".", word(17), F.concat(word(19), draw(20, 1000).cast("string")), word(18), pick(28, ["com", "org", "net"]))),
    )
    label = (kind < 10).cast("int")
    credential = pick(30, ["token", "secret", "password", "api_key", "apikey", "pwd", "passphrase", "private_key", "access_key", "auth"])
    # a bare key with a well-known prefix is a secret in any context; other secrets are assigned
    bare = F.when(kind == 5, draw(31, 2) == 0).otherwise(F.lit(False))
    odd = draw(32, 100)
    assigned = F.when(label == 1, ~bare).when(kind.isin(17, 18), F.lit(True)).otherwise(odd < 12)
    loose = F.concat_ws(" ", word(33), F.when(odd < 20, credential).otherwise(word(34)), pick(35, ["commit", "id", "file", "of", "sha256", "version", "ref", "the", "see", "and"]))
    named = F.concat_ws(" ", word(33), F.concat(credential, F.when(kind == 18, pick(36, [" is", " was"])).otherwise(pick(37, ["=", ":", " =", " :", " is", "=>"]))))
    other = F.concat_ws(" ", word(33), F.concat(pick(38, ["id", "commit", "path", "name", "version", "url", "checksum", "user"]), pick(39, ["=", ":", " ="])))
    before = F.when(assigned & ((label == 1) | kind.isin(17, 18)), named).when(assigned, other).otherwise(loose)
    after = F.when(kind == 18, pick(40, ["required for this", "expired and was", "invalid or missing", "not the same"])).otherwise(F.concat_ws(" ", word(41), word(42)))
    quoted = F.when(kind == 18, F.lit(False)).otherwise(draw(43, 2) == 0)
    chance = draw(44, 100)
    path = F.when(chance < F.when(label == 1, 35).otherwise(10), pick(45, ["app/config.yml", ".env", "settings.py", "deploy/main.tf"]))
    path = path.when(chance < F.when(label == 1, 45).otherwise(45), pick(46, ["docs/intro.md", "tests/a.py", "fixtures/b.json"])).when(chance < 80, pick(47, ["notes.txt", "web", "mail", "src/main.c"]))
    r = spark.range(rows).select(F.coalesce(secret, junk).alias("candidate"), before.alias("before"), after.alias("after"), assigned.alias("assigned"), quoted.alias("quoted"), path.alias("path"), label.alias("label"))
    return r.where(F.length("candidate") >= SHORT)


def _with_features(df: DataFrame) -> DataFrame:
    return df.withColumns({f"f_{k}": v for k, v in feature_columns().items()})


def train_forest(findings: DataFrame, trees: int = 40, depth: int = 8) -> PipelineModel:
    """From candidate, before, after, assigned, quoted, path, label."""
    from pyspark.ml import Pipeline

    steps = [
        VectorAssembler(inputCols=[f"f_{x}" for x in FEATURES], outputCol="f_all"),
        RandomForestClassifier(featuresCol="f_all", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, probabilityCol="f_prob", rawPredictionCol="f_raw", predictionCol="f_pred"),
    ]
    return Pipeline(stages=steps).fit(_with_features(findings))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, decide: float = 0.5, path_col: str | None = "source") -> DataFrame:
    """doc_id, word_index, secret_sha256, masked, length, probability, is_secret: one row per candidate."""
    model = train_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    judged = model.transform(_with_features(candidates(docs, path_col)))
    return judged.select(
        "doc_id", "word_index", F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"),
        F.concat(F.substring("candidate", 1, 4), F.lit("***")).alias("masked"), F.length("candidate").cast("long").alias("length"),
        F.round(vector_to_array("f_prob")[1], 6).alias("probability"), (vector_to_array("f_prob")[1] >= decide).alias("is_secret"),
    )
