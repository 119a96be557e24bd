"""Personal data: base patterns, and further spans that gradient-boosted trees judge, with DataFrame operations only.

The base patterns (e-mail, IP, card, phone) stand as they are, checked by their rules. Generators of high recall
propose further, overlapping spans: spelt-out addresses, numbers without a country code, defanged hosts, cards
with odd separators. Boosted trees use a candidate's format and its neighbourhood; a threshold that keeps
precision on calibration rows selects, and of overlapping ones the likeliest stays. The trees are fitted
on spans written out by rules below, as the tables hold no such labels, and become SQL inside the row.

Null and empty texts have no spans. Repeated rows are searched each; extra columns pass through; empty tables give
empty ones.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, table
from tidemark.llm.spans import LUHN, context, with_spans
from tidemark.llm.trees import boosted_probability

# In the patterns below a match may only start where the one before ended or where no character of its first
# run stands before: starts inside a run fail or succeed as the run's own start does, and cost quadratic time.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "{0} like '%@%'"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "{0} rlike '[0-9][.][0-9]'"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+", "{0} rlike '[0-9]'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "{0} like '%+%'"),
}
VALID = {
    "email": "true",
    "ip": "forall(split(s.text, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 AND cast(concat('0', regexp_replace(p, '^0+', '')) as int) <= 255)",
    "card": "length(regexp_replace(s.text, '[^0-9]', '')) BETWEEN 13 AND 19 AND " + LUHN.format("regexp_replace(s.text, '[^0-9]', '')"),
    "phone": "length(regexp_replace(s.text, '[^0-9]', '')) BETWEEN 9 AND 15",
}
KINDS = list(BASE)
WIDER = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)+", "{0} rlike '@|[(\\\\[]at[)\\\\]]| dot '"),
    "phone": (r"(?<![0-9])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", "{0} rlike '[0-9]{3}'"),
    "ip": (r"(?<![0-9])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9])", "{0} rlike '[0-9][\\\\[.]'"),
    "card": (r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,2}[0-9]{4}){3}(?![0-9])", "{0} rlike '[0-9]{4}'"),
}
CUES = {
    "email": r"(?i)(e-?mail|mailto|contact|write|address|kontakt|correo|courriel)[^a-z]{0,12}(me|us|to|at)?[^a-z]{0,6}$",
    "phone": r"(?i)(tel|phone|call|mobile|cell|fax|ring|whatsapp|telefon|telefono|handy)[a-z]{0,6}[^a-z0-9]{0,12}$",
    "ip": r"(?i)(ip|host|server|addr|address|from|login|client)[a-z]{0,4}[^a-z0-9]{0,6}$",
    "card": r"(?i)(card|visa|mastercard|credit|debit|amex|pan|karte|tarjeta|carte)[a-z]{0,4}[^a-z0-9]{0,12}$",
}
OTHER_CUES = r"(?i)(isbn|issn|order|invoice|serial|version|build|part|sku|id|ref|page|pages|section|date|score|ratio|lot|figure|table)[a-z ]{0,4}[^a-z0-9]{0,6}$"
DIGITS = "regexp_replace(t, '[^0-9]', '')"
FEATURES = {
    **{f"is_{k}": f"cast(k = '{k}' as double)" for k in KINDS},
    "size": "length(t)",
    "digits": f"length({DIGITS})",
    "letters": "length(regexp_replace(t, '[^A-Za-z]', ''))",
    "groups": "regexp_count(t, '[0-9]+')",
    "brackets": "cast(t rlike '[(\\\\[]' as double)",
    "spelt": "cast(t rlike '(?i)at[)\\\\]]|[(\\\\[]dot| at .* dot |\\\\[[.]\\\\]' as double)",
    "spaced": "regexp_count(t, ' ')",
    "luhn": f"cast(length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN.format(DIGITS)} as double)",
    "octets": "cast(forall(regexp_extract_all(t, '[0-9]+', 0), p -> length(p) <= 3 AND cast(p as int) <= 255) as double)",
    "ten": "cast(t rlike '^[(]?[2-9][0-9]{2}[)]?[ .-]?[0-9]{3}[ .-][0-9]{4}$' as double)",
    "years": "cast(t rlike '^(19|20)[0-9]{2}([^0-9]+(19|20)[0-9]{2})*$' as double)",
    "ending": "cast(t rlike '(?i)(com|org|net|edu|gov|io|de|fr|es|info)$' as double)",
    **{f"cue_{k}": f"cast(l rlike '{v}' as double)" for k, v in CUES.items()},
    "other_cue": f"cast(l rlike '{OTHER_CUES}' as double)",
    "joined_left": "cast(l rlike '[A-Za-z0-9.@$#/-]$' as double)",
    "joined_right": "cast(r rlike '^[A-Za-z0-9@/%-]|^[.][0-9]' as double)",
}
EXAMPLES = 6_000
PRECISION = 0.98


def examples(rows: int = EXAMPLES, seed: int = 4) -> list[tuple[str, str, str, str, int]]:
    """Labelled candidates (kind, candidate, text before, text after, 1 for personal data), by rule."""
    rng = random.Random(seed)

    def digits(n: int) -> str:
        return "".join(str(rng.randrange(10)) for _ in range(n))

    def word() -> str:
        return "".join(rng.choice(["an", "er", "on", "the", "re", "ti", "mar", "lo", "ka", "sen", "vi"]) for _ in range(rng.randint(1, 4)))

    def luhn(n: int) -> str:
        body = [rng.randint(1, 9), *(rng.randrange(10) for _ in range(n - 2))]
        total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(body)))
        return "".join(map(str, [*body, -total % 10]))

    def cut(value: str, mark: str) -> str:
        return mark.join(value[k : k + 4] for k in range(0, len(value), 4))

    def lead(*cues: str) -> str:
        return word() + " " + word() + rng.choice([" ", ", ", ". "]) + (rng.choice(cues) + rng.choice([" ", ": "]) if cues else "")

    def positive() -> tuple[str, str, str]:
        kind = rng.randrange(4)
        if kind == 0:
            at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", "."), (" @ ", ".")])
            return "email", word() + rng.choice(["", ".", "_"]) + word() + at + word() + dot + rng.choice(["com", "org", "net", "de", "io"]), lead(*rng.choice([(), ("email", "contact", "mail")]))
        if kind == 1:
            area, end = str(rng.randint(201, 989)), digits(4)
            value = rng.choice([f"({area}) {digits(3)}-{end}", f"{area}-{digits(3)}-{end}", f"{area}.{digits(3)}.{end}", f"({area}) {digits(3)} {end}"])
            return "phone", value, lead(*rng.choice([("call", "phone", "tel", "fax"), ("mobile", "phone")] if "(" not in value else [(), ("call", "tel")]))
        if kind == 2:
            return "ip", "[.]".join(str(rng.randint(0, 255)) for _ in range(4)), lead(*rng.choice([(), ("ip", "host")]))
        return "card", cut(luhn(16), rng.choice([".", "/", "_", "--"])), lead(*rng.choice([(), ("card", "visa")]))

    def negative() -> tuple[str, str, str]:
        kind = rng.randrange(7)
        if kind == 0:
            return "email", f"{word()} at {word()}" + rng.choice([". ", " dot ", "."]) + word(), lead()
        if kind == 1:
            value = rng.choice([f"{digits(2)} {digits(3)} {digits(3)}", f"{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(3)} {digits(4)} {digits(3)}", f"{rng.randint(1900, 2030)}-{digits(4)}.{digits(3)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
            return "phone", value, lead(*rng.choice([("order", "isbn", "ref", "serial", "pages"), ("id", "invoice")]))
        if kind == 2:
            return "phone", f"{digits(rng.choice([2, 3, 4]))}{rng.choice(' ./-')}{digits(rng.choice([3, 4]))}{rng.choice(' .-')}{digits(rng.choice([3, 4]))}", lead()
        if kind == 3:
            return "ip", ".".join(str(rng.randint(256, 999) if i == 2 else rng.randint(0, 999)) for i in range(4)), lead(*rng.choice([(), ("version", "section")]))
        if kind == 4:
            return "card", cut(digits(15) + "0", rng.choice([" ", "-", ".", "/"])), lead(*rng.choice([(), ("order", "serial", "ref")]))
        if kind == 5:
            return "email", f"{word()}@{word()}", lead()
        return "card", cut("".join(str(rng.randint(1900, 2030)) for _ in range(4)), rng.choice([" ", "-", "/"])), lead(*rng.choice([(), ("date", "table")]))

    out = []
    for i in range(rows):
        (kind, value, before), label = (positive(), 1) if i % 2 else (negative(), 0)
        out.append((kind, value, before[-24:], (rng.choice([" ", ". ", ", "]) + word())[:12], label))
    return out


def _features(k: str, t: str, left: str, right: str) -> list[str]:
    import re

    put = {"k": k, "t": t, "l": left, "r": right}
    return [re.sub(r"'(?:\\.|[^'\\])*'|\b[ktlr]\b(?!\w|\()", lambda m: m[0] if m[0][0] == "'" else put[m[0]], sql) for sql in FEATURES.values()]


@dataclass
class Finder:
    probability: str  # SQL over fields of a struct x.f
    threshold: float

    def find(self, df: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
        """Add `to`: an array of (kind, start, end, base) of every whole text, by kind as listed, then start."""
        (to,) = fresh(df, to)
        named = [f"c{i}" for i in range(len(df.columns))]
        at = named[df.columns.index(text)]
        patterns = {f"base_{k}": (p, c.replace("{0}", at)) for k, (p, c) in BASE.items()} | {f"wide_{k}": (p, c.replace("{0}", at)) for k, (p, c) in WIDER.items()}
        found = with_spans(df.toDF(*named), at, patterns)
        found = found.withColumns({f"base_{k}": F.expr(f"filter(base_{k}, s -> {VALID[k]})") for k in KINDS})
        # Proposals that meet a base span of any kind are settled already.
        base = "concat(" + ", ".join(f"base_{k}" for k in KINDS) + ")"
        found = found.withColumn("base", F.expr(base))
        proposed = "concat(" + ", ".join(f"transform(filter(wide_{k}, s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end)), s -> named_struct('kind', '{k}', 's', s))" for k in WIDER) + ")"
        found = found.withColumn("proposed", F.expr(f"CASE WHEN size(wide_email) + size(wide_phone) + size(wide_ip) + size(wide_card) > 0 THEN {proposed} END"))
        left, right = context(at, "p.s")
        sized = ", ".join(f"'{n}', cast({sql} as double)" for n, sql in zip(FEATURES, _features("q.p.kind", "q.p.s.text", "q.l", "q.r")))
        seen = f"transform(transform(proposed, p -> named_struct('p', p, 'l', {left}, 'r', {right})), q -> named_struct('p', q.p, 'f', named_struct({sized})))"
        found = found.withColumn("seen", F.expr(f"CASE WHEN size(proposed) > 0 THEN {seen} END"))
        scored = f"filter(transform(seen, x -> named_struct('kind', x.p.kind, 'start', x.p.s.start, 'end', x.p.s.end, 'score', {self.probability})), y -> y.score >= {self.threshold!r}D)"
        found = found.withColumn("scored", F.expr(f"CASE WHEN size(seen) > 0 THEN {scored} END"))
        better = "exists(scored, o -> o.start < z.end AND z.start < o.end AND (o.score > z.score OR (o.score = z.score AND (o.start < z.start OR (o.start = z.start AND (o.end > z.end OR (o.end = z.end AND o.kind < z.kind)))))))"
        found = found.withColumn("added", F.expr(f"CASE WHEN size(scored) > 0 THEN filter(scored, z -> NOT {better}) ELSE array() END"))
        parts = ", ".join(f"transform(base_{k}, s -> named_struct('order', {i}, 'start', s.start, 'end', s.end, 'kind', '{k}', 'base', true))" for i, k in enumerate(KINDS))
        order = "CASE a.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
        every = f"concat({parts}, transform(added, a -> named_struct('order', {order}, 'start', a.start, 'end', a.end, 'kind', a.kind, 'base', false)))"
        found = found.withColumn("every", F.expr(f"array_sort({every})"))
        return found.select(*named, F.expr("transform(every, e -> named_struct('kind', e.kind, 'start', e.start, 'end', e.end, 'base', e.base))").alias("out")).toDF(*df.columns, to)


def fit(spark: SparkSession, rows: int = EXAMPLES, seed: int = 4) -> Finder:
    """Fit the trees on three quarters of the examples, and choose the threshold on the others."""
    written = json.dumps([dict(zip(("k", "t", "l", "r", "y"), x)) for x in examples(rows, seed)])
    labelled = spark.sql("SELECT posexplode(from_json(:examples, 'array<struct<k:string,t:string,l:string,r:string,y:int>>')) AS (i, e)", args={"examples": written}).select("i", "e.*")
    names = list(FEATURES)
    made = labelled.select("i", *(F.expr(f"cast({sql} as double)").alias(n) for n, sql in zip(names, _features("k", "t", "l", "r"))), F.col("y").cast("double").alias("label"))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(made)
    trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, minInstancesPerNode=10, seed=seed).fit(data.filter("i % 8 < 6"))
    # The lowest threshold from which on the calibration rows keep the precision.
    tried = sorted(((r.p, r.label) for r in trees.transform(data.filter("i % 8 >= 6")).select(vector_to_array("probability")[1].alias("p"), "label").collect()), reverse=True)
    threshold, right = 0.9, 0.0
    for n, (p, label) in enumerate(tried, 1):
        right += label
        if right / n >= PRECISION:
            threshold = p
    return Finder(boosted_probability(trees, [f"x.f.{n}" for n in names]), max(0.5, round(threshold, 6)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of base spans, their digest, and all spans."""
    found = fit(spark).find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    found = found.withColumn("base", F.expr("filter(spans, s -> s.base)"))
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )
