"""Secret scans: a random forest judges candidates found by wide patterns, with DataFrame operations only.

Candidates are runs of at least ten token characters that hold a digit or begin with a known prefix, and values of any
length and any characters but white space, quotes and brackets that follow an assignment to a telling name. The forest sees their length, mix and transitions of character classes, how much of them a
dictionary of common syllables covers, whether they look like a path, and neighbouring words. It is fitted on
labelled findings that rules write out below (formats and contexts of real secrets, and of what is
mistaken for them: hashes of commits, identifiers, file names, numbers, words), since the tables hold no such labels.
Its trees become SQL, so that whole texts are scanned inside their rows without any shuffle.

Null and empty texts have no findings. Repeated rows are scanned each; extra columns pass through; empty tables give
empty ones.
"""

from __future__ import annotations

import json
import random
import string
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, table
from tidemark.llm.spans import context, redacted, sql_string, with_spans
from tidemark.llm.trees import forest_probability

PREFIXES = r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|eyJ[A-Za-z0-9_-]{10,}\.|ya29\.|npm_|SG\.|hf_)"
PASS_NAMES = r"(?:pass(?:word|wd|phrase|code)|passwort|kennwort|contrase[nñ]a|mot de passe|(?<![a-z])(?:pass|pwd))s?"
NAMES = rf"(?:{PASS_NAMES}|secret|token|credentials?|geheim|(?:api|access|private|auth|account|encryption|signing|secret)[_ -]?key|(?<![a-z])(?:key|auth|bearer|clave))"
SIGN = r"""(?:_?(?:key|token|id|value|hash|secret)|_[a-z0-9_]{1,20})?["')\]]?(?:\s{0,8}(?::=|=>|==|[:=])\s{0,8}["'(`]?|\s{1,8}["'`]|\s{1,4}(?:is|ist|es|est)\s{1,4}["'`]?)"""
VALUE = r"""(?![:=>])(?:[^\s"'`<>()\[\]{},;|\\&]|&(?![A-Za-z_]+=))++"""
CANDIDATE = (
    r"(?:\G|(?<![A-Za-z0-9_+/=.~-]))(?=[A-Za-z_+/=.~-]*[0-9])[A-Za-z0-9_+/=.~-]{10,}"
    rf"|(?<![A-Za-z0-9_+.~-])(?={PREFIXES})[A-Za-z0-9_+/=.~-]{{10,}}"
    # Two short looks at what is before leave few places for the long one.
    r"|(?<=[\s:=>\"'(`])(?=\S)(?<=[:=>\"'(`]\s{0,8}|(?<![A-Za-z])(?i:is|ist|es|est|bearer)\s{1,4})"
    rf"(?<=(?i:{NAMES}{SIGN}|(?<![a-z])bearer\s{{1,4}})){VALUE}"
)
THRESHOLD = 0.5
FINDINGS = 6_000
"""Labelled findings that the forest is fitted on."""
SECRET_WORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private|geheim|kennwort|passwort|contrase|clave|mot de passe|key)[a-z_]*[\"')]?\s*(is|[:=]+>?)?\s*[\"'(]*$"
PLAIN_WORDS = r"(?i)(sha-?(1|256|512)?|md5|commit|checksum|digest|uuid|guid|etag|isbn|issn|doi|version|build|revision|order|invoice|ticket|file|image|page|id|ref|phone|tel|card|account)[a-z_ ]*[#:=]?\s*[\"'(]*$"
PREFIX = rf"^(?:password=|passwd=|pwd=|secret=|token=|key=)?{PREFIXES}"
PASS_TOLD = rf"(?i){PASS_NAMES}{SIGN}$"
TOLD = rf"(?i){NAMES}{SIGN}$"
PLACEHOLDER = r"(?i)^(?:required|optional|none|null|nil|true|false|yes|no|string|str|text|value|field|reset|policy|manager|hash|hashed|changed?|your[-_a-z]*|x+|\*+|\.+|-+|n/a|empty|missing|invalid|valid|expired|incorrect|correct|wrong|undefined|type|varchar|char|int|input|the|an?|is|was|are|not|and|or|to|for|in|of|must|should|can|will|that|this|it|\$.*|%.*)[.:!?*]*$"
ASSIGNED = r"(?i)^(pass(word|wd)?|pwd|secret|token|api_?key|key|auth)="
SYLLABLES = "tion|ing|the|and|ver|ent|ich|ein|ung|der|sch|est|ment|que|les|pre|con|com|pro|ter|ere|ion|ado|aci|res|ers|ist|able|ation|port|serv|data|test|user|file|name|page|index|home|img|mail|example"
FEATURES = {
    "size": "length(t)",
    "digits": "length(regexp_replace(t, '[^0-9]', '')) / length(t)",
    "uppers": "length(regexp_replace(t, '[^A-Z]', '')) / length(t)",
    "lowers": "length(regexp_replace(t, '[^a-z]', '')) / length(t)",
    "marks": "length(regexp_replace(t, '[A-Za-z0-9]', '')) / length(t)",
    "turns": "(regexp_count(t, '[A-Za-z](?=[0-9])') + regexp_count(t, '[0-9](?=[A-Za-z])')) / length(t)",
    "case_turns": "(regexp_count(t, '[a-z](?=[A-Z])') + regexp_count(t, '[A-Z](?=[a-z])')) / length(t)",
    "hex": "cast(t rlike '^[0-9a-f]+$' as double)",
    "distinct": "size(array_distinct(split(t, ''))) / sqrt(length(t))",
    "covered": f"1 - length(regexp_replace(lower(t), '{SYLLABLES}', '')) / length(t)",
    "vowels": "length(regexp_replace(lower(t), '[^aeiou]', '')) / length(t)",
    "runs": "length(t) / (1 + regexp_count(t, '[A-Za-z]+|[0-9]+'))",
    "path": "regexp_count(t, '[/.]') / length(t)",
    "dashed": "cast(t rlike '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-' as double)",
    "prefix": f"cast(t rlike {sql_string(PREFIX)} as double)",
    "assigned": f"cast(t rlike {sql_string(ASSIGNED)} as double)",
    "told": f"cast(l rlike {sql_string(TOLD)} as double)",
    "pass_told": f"cast(l rlike {sql_string(PASS_TOLD)} as double)",
    "placeholder": f"cast(t rlike {sql_string(PLACEHOLDER)} as double)",
    "secret_word": f"cast(l rlike {sql_string(SECRET_WORDS)} as double)",
    "plain_word": f"cast(l rlike {sql_string(PLAIN_WORDS)} as double)",
    "at_sign": "cast(l like '%@' or r like '@%' as double)",
    "quoted": "cast(l rlike '[\"\\']$' as double)",
    "equals": "cast(l rlike '[=:]\\\\s*[\"\\']?$' as double)",
    "after_url": "cast(l rlike '[a-z]+:$|www$' as double)",
}


def findings(rows: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """Labelled findings (candidate, text before, text after, 1 for a secret), half of them secrets, by rule."""
    rng = random.Random(seed)

    def some(alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high or low)))

    hexes, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    syllables = SYLLABLES.split("|") + ["an", "er", "on", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "ti"]

    def word(low: int = 1, high: int = 4) -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(low, high)))

    def words() -> str:
        return " ".join(word() for _ in range(rng.randint(1, 4)))

    def lead() -> str:
        return words() + rng.choice([" ", ", ", ". ", "\n"])

    def tail() -> str:
        return rng.choice([" ", ". ", ", ", "\n"]) + words()

    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "access_key", "client_secret", "key", "Bearer", "passphrase"]
    plain = ["commit", "sha256:", "sha1", "md5", "checksum", "uuid", "id", "etag", "revision", "build", "digest:", "order", "invoice", "ref", "file", "version"]

    def secret() -> tuple[str, str, str]:
        value = rng.choice([lambda: some(hexes, 16, 64), lambda: some(alnum, 12, 48), lambda: some(alnum + "+/", 24, 60) + "==", lambda: word(1, 2) + some(string.digits, 2, 5) + some(alnum, 4, 8)])()
        kind = rng.randrange(11)
        if kind == 0:
            return rng.choice(["AKIA", "ASIA"]) + some(upper, 16), lead(), tail()
        if kind == 1:
            prefix, low, high = rng.choice([("ghp_", 36, 36), ("gho_", 36, 36), ("sk-", 32, 48), ("sk_live_", 24, 32), ("xoxb-", 24, 50), ("AIza", 35, 35), ("glpat-", 20, 20), ("npm_", 36, 36), ("hf_", 34, 34), ("SG.", 40, 60)])
            return prefix + some(alnum, low, high), lead(), tail()
        if kind == 2:
            return "eyJ" + some(alnum, 17, 40) + "." + some(alnum + "_-", 30, 90) + "." + some(alnum + "_-", 30, 44), lead() + rng.choice(["", "Bearer ", "token: "]), tail()
        if kind in (3, 4):
            return rng.choice(["password=", "passwd=", "pwd=", "secret=", "token=", "key="]) + value, lead(), tail()
        if kind >= 8:
            # Without a digit, short or made of words: the name of what is assigned tells.
            name = rng.choice(["password", "passwd", "pwd", "passphrase", "db_password", "Password", "Passwort", "PASSWORD"])
            chosen = rng.randrange(4)
            if chosen == 0:
                value = some(string.ascii_letters, 4, 24)
                name = rng.choice([name, "secret", "token", "api_key", "access_key", "client_secret"])
            elif chosen == 1:
                value = some(alnum + "!@#$%*?", 3, 9)
            else:
                value = "".join(rng.choice([str.capitalize, str.lower])(word(1, 3)) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "!", "."])
            quote = rng.choice(['"', "'", "", ""])
            return value, lead() + name + rng.choice(["=", "=", ": ", " = ", ":", '": ']) + quote, quote + tail()
        quote = rng.choice(['"', "'", ""])
        return value, lead() + rng.choice(names) + rng.choice([" = ", "=", ": ", ":", " "] if quote else [" = ", ": ", ":"]) + quote, quote + tail()

    def other() -> tuple[str, str, str]:
        kind = rng.randrange(15)
        if kind == 0:
            return some(hexes, rng.choice([10, 12, 32, 40, 64])), lead() + rng.choice(plain) + " ", tail()
        if kind == 1:
            return "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)), lead() + rng.choice(["", "uuid ", "id=", "id: "]), tail()
        if kind == 2:
            return rng.choice(["/", ""]) + "/".join(word(1, 2) for _ in range(rng.randint(1, 4))) + some(string.digits, 1, 4) + rng.choice([".png", ".html", "/", ".txt", ".py"]), lead() + rng.choice(["", "file ", "www", "https:"]), tail()
        if kind == 3:
            return some(string.digits, 10, 19), lead() + rng.choice(["", "card ", "order ", "+1 ", "account "]), tail()
        if kind == 4:
            return ".".join(some(string.digits, 1, 3) for _ in range(4)), lead(), tail()
        if kind == 5:
            return word(2, 5) + rng.choice(["", "-", "_", "."]) + some(string.digits, 1, 4) + rng.choice(["", word()]), lead(), tail()
        if kind == 6:
            return word() + "." + some(string.digits, 2), lead(), "@" + word() + ".example.com" + tail()
        if kind == 7:
            return "mail" + some(string.digits, 1) + ".example.com", lead() + word() + "@", tail()
        if kind == 8:
            return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(["", "T10", "T08"]), lead(), tail()
        if kind == 9:
            return word(2, 4).capitalize() + word(2, 3).capitalize() + some(string.digits, 1, 2), lead(), tail()
        if kind == 10:
            return word(1, 3) + "." + some(string.digits, 1, 3) + "." + word(1, 3), lead(), tail()
        if kind >= 12:
            name = rng.choice(["password", "passwd", "secret", "token", "api_key", "key", "auth", "access_key", "Password"])
            if rng.random() < 0.5:
                value = rng.choice("required optional none null true false string text value field reset policy hash changed your_password your-token xxxx ******** n/a missing invalid expired wrong the a must not".split())
                return value + rng.choice(["", "", ".", "!"]), lead() + name + rng.choice([": ", "=", " = ", " is "]), tail()
            name, value = rng.choice([("key", word(1, 3).capitalize()), ("auth", word(1, 2) + "@" + word() + ".example.com"), ("key", "https://" + word() + ".example.com/" + word()), ("token", word(1, 2)), ("secret", word(1, 2)), ("key", word(1, 3)), ("key", some(string.digits, 1, 3)), ("private key", word(1, 3))])
            return value, lead() + name + rng.choice([": ", " is ", ": "]), tail()
        return rng.choice(["978-", "v", "ISBN-", "doi.", "10."]) + some(string.digits + ".-", 8, 13) + some(string.digits, 2), lead() + rng.choice(["isbn ", "version ", "doi ", ""]), tail()

    out = []
    for i in range(rows):
        (value, before, after), label = (secret(), 1) if i % 2 else (other(), 0)
        out.append((value, before[-24:], after[:12], label))
    return out


def _features(t: str, left: str, right: str) -> list[str]:
    """SQL for the features, with the candidate and its surroundings put in."""
    import re

    put = {"t": t, "l": left, "r": right}
    # Only bare names outside of quoted patterns are put in.
    return [re.sub(r"'(?:\\.|[^'\\])*'|\b[tlr]\b(?!\w|\()", lambda m: m[0] if m[0][0] == "'" else put[m[0]], sql) for sql in FEATURES.values()]


@dataclass
class Scanner:
    probability: str  # SQL over fields of a struct named f

    def scan(self, df: DataFrame, text: str = "text", to: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
        """Add `to`: an array of (start, end, text, score) of the secrets found in every whole text."""
        (to,) = fresh(df, to)
        named = [f"c{i}" for i in range(len(df.columns))]
        at = named[df.columns.index(text)]
        found = with_spans(df.toDF(*named), at, {"candidates": (CANDIDATE, "true")})
        left, right = context(at, "c")
        seen = f"transform(candidates, c -> named_struct('c', c, 'l', {left}, 'r', {right}))"
        sized = ", ".join(f"'{n}', cast({sql} as double)" for n, sql in zip(FEATURES, _features("s.c.text", "s.l", "s.r")))
        found = found.withColumn("seen", F.expr(f"CASE WHEN size(candidates) > 0 THEN transform({seen}, s -> named_struct('c', s.c, 'f', named_struct({sized}))) END"))
        scored = f"transform(seen, x -> named_struct('start', x.c.start, 'end', x.c.end, 'text', x.c.text, 'score', {self.probability}))"
        found = found.withColumn("out", F.expr(f"coalesce(filter({scored}, y -> y.score >= {threshold!r}D), cast(array() as array<struct<start:int,end:int,text:string,score:double>>))"))
        return found.select(*named, "out").toDF(*df.columns, to)


def fit(spark: SparkSession, rows: int = FINDINGS, seed: int = 5) -> Scanner:
    """Fit the forest on labelled findings."""
    written = json.dumps([dict(zip("tlry", x)) for x in findings(rows, seed)])
    labelled = spark.sql("SELECT inline(from_json(:findings, 'array<struct<t:string,l:string,r:string,y:int>>'))", args={"findings": written})
    names = list(FEATURES)
    made = labelled.select(*(F.expr(f"cast({sql} as double)").alias(n) for n, sql in zip(names, _features("t", "l", "r"))), F.col("y").cast("double").alias("label"))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(made)
    forest = RandomForestRegressor(numTrees=20, maxDepth=7, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=seed).fit(data)
    return Scanner(forest_probability(forest, [f"x.f.{n}" for n in names]))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", scanner: Scanner | None = None) -> DataFrame:
    """df with the secrets in its texts replaced by a mark."""
    (found,) = fresh(df, "secrets")
    scanned = (scanner or fit(df.sparkSession)).scan(df, text, found)
    return scanned.withColumn(text, F.expr(redacted(f"`{text}`", f"`{found}`", mark))).drop(found)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: their number, and start:end of each in code points."""
    scanned = fit(spark).scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", F.size("secrets").cast("long").alias("n_secrets"), F.expr("array_join(transform(secrets, s -> concat(s.start, ':', s.end)), ',')").alias("spans"))
