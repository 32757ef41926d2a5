"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers vote on each (1 for, -1 against, 0 abstaining): checks of what matched, such
as check digits (regex), lists of known parts (gazetteer), words on both sides (context) and the span's shape.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability for each kind and each
pattern's probability, on which a logistic span classifier over votes and kind is trained. Candidates are found, placed
and aggregated by DataFrame functions; what the driver fits is a table with one row for each kind and vote pattern, at
most 10 * 3^4 rows at any size of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.quality import bound
from tessera.llm.shared import cut, read

# A run of the class is entered at its start or right after a match, so long runs cost no more than one reading;
# the possessive parts cannot give back what the next part needs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?i)(?:token|secret|password|passwd|api[_-]?key)[\x20_\"']{0,3}[:=]\s?[\"']?[A-Za-z0-9+/=_-]{12,}+"
LOCAL = r"(?<!\+[0-9]{1,3}[\x20.-])(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
_AT, _DOT = (rf"\x20?[\[(]\x20?{word}\x20?[\])]\x20?" for word in ("at", "dot"))
# A local part is entered at its first letter or digit, or after a match, so that it may be of any length.
SPELLED = (
    r"(?i)(?:(?<![a-z0-9._-])|(?<=(?:\G|(?<![a-z0-9._-]))[._-]{1,64}))[a-z0-9][a-z0-9._-]*+"
    rf"{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++){{0,30}}{_DOT}[a-z]{{2,8}}\b"
)
KEY = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|-----BEGIN\x20(?:[A-Z]{2,9}\x20)?PRIVATE\x20KEY-----)"
IBAN = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Kind, pattern, and a cheap test that a text with a match passes. The first four are the contract's, in its order.
KINDS = (
    ("email", EMAIL, "@"),
    ("ip", IP, "[0-9]"),
    ("card", CARD, "[0-9]"),
    ("phone", PHONE, r"\+"),
    ("email_spelled", SPELLED, r"(?i)[\[(]\x20?at"),
    ("phone_local", LOCAL, "[0-9]"),
    ("secret", SECRET, "(?i)token|secret|passw|api"),
    ("access_key", KEY, "AKIA|gh[pousr]_|sk-|xox|BEGIN"),
    ("iban", IBAN, "[A-Z]{2}[0-9]{2}"),
    ("national_id", NATIONAL, "[0-9]-[0-9]{2}-"),
)
BASE = 4
LABELERS = ("regex", "gazetteer", "context", "shape")
NEAR, ACCEPT, ROUNDS, SMOOTH = 32, 0.5, 50, 10.0
_CUES = {
    "email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|pay|credit", "phone": r"tel|phone|call|fax|mobile",
    "email_spelled": "mail|contact|write", "phone_local": "tel|phone|call|fax|mobile", "secret": r"export|config|env|auth|login|header|\bset\b|\bkey\b",
    "access_key": "key|auth|token|secret|config|aws|git", "iban": "iban|bank|account|konto|transfer|cuenta|compte", "national_id": r"\bssn\b|social|security|\bid\b|insurance",
}
#: Words near by that speak against.
_AGAINST = {
    "ip": r"version|release|\bv$", "phone_local": "order|invoice|isbn|part", "secret": "example|sample|dummy|placeholder", "access_key": "example|sample|dummy",
    "iban": "example|order|part", "national_id": "order|invoice|isbn|part",
}
_KNOWN = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", "ip": r"^(?!0|127\.|255\.)", "card": r"^[3-6]", "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "email_spelled": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", "phone_local": r"^\(?[2-9]", "secret": r"(?i)^(?!.*(?:change_?me|example|placeholder|your|xxxx|\*\*|dummy|test))",
    "access_key": r"^(?:AKIA|gh|sk-|xox|-)", "iban": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE)", "national_id": r"^(?!000|666|9)",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod97(text: Column) -> Column:
    """Whether an IBAN, without spaces, has the right check digits; letters count from 10."""
    turned = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    value = lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda s, i: (s * F.when(value(i) < 10, 10).otherwise(100) + value(i)) % 97) == 1


def _valid() -> Column:
    """The contract's checks for its kinds; the whole pattern for others."""
    m, n = F.col("m"), F.length(_digits(F.col("m")))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return (
        F.when(F.col("kind") == 1, m.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(F.col("kind") == 2, n.between(16, 19) & F.coalesce(F.when(n.between(16, 19), luhn(_digits(m))), F.lit(False)))
        .when(F.col("kind") == 3, n.between(8, 15))
        .otherwise(True)
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id_col, kind, start, end, valid, regex, gazetteer, context, shape): every match of every pattern, placed.

    A row without matches comes once with kind null. A match starts where the pieces and matches before it end; the
    running sum is taken over the few rows that matches make, by text and kind.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(k: int, pattern: str, gate: str) -> Column:
        found, parts = F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), F.split("t", pattern, -1)

        def zipped(pair: Column) -> Column:
            return F.transform(
                pair["f"],
                lambda m, i: F.struct(
                    F.lit(k).alias("kind"), i.alias("i"), F.length(F.get(pair["p"], i)).alias("gap"), m.alias("m"),
                    F.right(F.get(pair["p"], i), F.lit(NEAR)).alias("before"), F.left(F.get(pair["p"], i + 1), F.lit(NEAR)).alias("after"),
                ),
            )

        return F.when(F.col("t").rlike(gate), bound(F.struct(found.alias("f"), parts.alias("p")), zipped))

    kinds = [of(k, pattern, gate) for k, (_, pattern, gate) in enumerate(KINDS)]
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,m:string,before:string,after:string>>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), text.alias("t"))
    rows = rows.select("row", id_col, F.explode_outer(F.concat(*[F.coalesce(k, empty) for k in kinds])).alias("c")).select("row", id_col, "c.*")
    # the rows of one text stay in one task, but for a text's kinds, which go apart
    upto = F.sum(F.col("gap") + F.length("m")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", upto.cast("long")).withColumn("start", (upto - F.length("m")).cast("long"))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    m, n, letters = F.col("m"), F.length(_digits(F.col("m"))), F.length(F.regexp_replace("m", "[^A-Za-z]", ""))
    number = {name: k for k, (name, _, _) in enumerate(KINDS)}

    def by_kind(found: dict[str, Column], otherwise: Column) -> Column:
        votes = None
        for name, v in found.items():
            votes = F.when(F.col("kind") == number[name], v) if votes is None else votes.when(F.col("kind") == number[name], v)
        return votes.otherwise(otherwise)

    shape = by_kind(
        {
            "email": vote(F.length("m").between(6, 64), F.length("m") > 128), "email_spelled": vote(F.length("m").between(10, 100), F.length("m") > 320),
            "ip": vote(F.length("m").between(7, 15), F.length("m") > 15), "card": vote(n.isin(16, 19), ~n.between(13, 19)), "phone": vote(n.between(10, 13), ~n.between(8, 15)),
            "secret": vote((n >= 6) & (letters >= 10), n == 0), "access_key": vote((n > 0) & (letters > 0), F.length("m") < 20), "iban": vote(n >= 10, n < 6),
        },
        vote(n.between(9, 10), ~n.between(9, 10)),
    )
    value = F.regexp_extract("m", r"([A-Za-z0-9+/=_-]+)$", 1)
    plain = F.regexp_replace("m", " ", "")
    checked = by_kind(
        {
            "secret": vote(value.rlike("(?=.*[0-9])(?=.*[A-Za-z])") & (F.length(value) >= 16), value.rlike("^[A-Za-z_-]+$")),
            "iban": F.coalesce(F.when(F.col("kind") == number["iban"], vote(mod97(plain), ~mod97(plain))), F.lit(0)),
            "national_id": vote(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), m.rlike("^(?:000|666|9)|-00-|-0000")),
            "phone_local": vote(m.rlike(r"^\(?[2-9][0-9]{2}\)?.[2-9]"), m.rlike(r"^\(?[01]")), "email_spelled": F.lit(1), "access_key": F.lit(1),
        },
        F.when(F.col("valid"), 1).otherwise(-1),
    )
    near = F.lower(F.concat_ws(" ", "before", "after"))
    glued = F.col("before").rlike("[0-9A-Za-z]$")
    context = by_kind({name: vote(near.rlike(cue), (near.rlike(_AGAINST[name]) | glued) if name in _AGAINST else glued) for name, cue in _CUES.items()}, F.lit(0))
    rows = rows.withColumn("valid", _valid()).withColumn("regex", checked).withColumn("gazetteer", by_kind({name: vote(m.rlike(p), ~m.rlike(p)) for name, p in _KNOWN.items()}, F.lit(0)))
    return rows.select("row", id_col, "kind", "start", "end", "valid", "regex", "gazetteer", context.alias("context"), shape.alias("shape"))


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], int]]) -> tuple[dict, dict]:
    """(probability of each (kind, votes), reliability of each (kind, labeler)) from (kind, votes, count).

    Two classes; a labeler's votes are independent given kind and class. What a labeler says for a kind is drawn to what
    it says for all kinds, as by SMOOTH spans. Reliability is the chance that a vote cast is right.
    """
    prob = {(k, v): min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for k, v, _ in patterns}
    kinds, votes = sorted({k for k, _, _ in patterns}), (-1, 0, 1)
    reliability = {}
    for _ in range(ROUNDS):
        prior: dict[int, list[float]] = {k: [1.0, 1.0] for k in kinds}
        says: dict[tuple[int, int, int, int], float] = {}
        for k, v, n in patterns:
            for c, share in ((1, prob[k, v]), (0, 1 - prob[k, v])):
                prior[k][c] += n * share
                for j, vote in enumerate(v):
                    says[k, j, c, vote] = says.get((k, j, c, vote), 0.0) + n * share
        chance = {}
        for j, name in enumerate(LABELERS):
            for c in (0, 1):
                toward = 1 if c else -1
                weights = {vote: sum(says.get((k, j, c, vote), 0.0) for k in kinds) + (4.0 if vote == toward else 1.0) for vote in votes}
                shared = {vote: w / sum(weights.values()) for vote, w in weights.items()}
                for k in kinds:
                    own = {vote: says.get((k, j, c, vote), 0.0) + SMOOTH * shared[vote] for vote in votes}
                    chance |= {(k, j, c, vote): w / sum(own.values()) for vote, w in own.items()}
            for k in kinds:
                right = chance[k, j, 1, 1] + chance[k, j, 0, -1]
                reliability[k, name] = right / (right + chance[k, j, 1, -1] + chance[k, j, 0, 1])
        for k, v, _ in patterns:
            log = [math.log(prior[k][c] / sum(prior[k])) + sum(math.log(chance[k, j, c, vote]) for j, vote in enumerate(v)) for c in (0, 1)]
            prob[k, v] = 1 / (1 + math.exp(max(-50.0, min(50.0, log[0] - log[1]))))
    return prob, reliability


def _features(k: int, v: tuple[int, ...]) -> list[int]:
    return [*v, *(int(k == i) for i in range(len(KINDS)))]


def train(patterns: list[tuple[int, tuple[int, ...], int]], prob: dict) -> list[float]:
    """Weights of the span classifier, one for each vote and each kind, fitted to the probabilities by count."""
    w = [0.0] * (len(LABELERS) + len(KINDS))
    of = {k: sum(n for j, _, n in patterns if j == k) for k, _, _ in patterns}  # kinds weigh alike, however many their spans
    for _ in range(800):
        slope = [0.005 * x for x in w]
        for k, v, n in patterns:
            x = _features(k, v)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for j, value in enumerate(x):
                slope[j] += n / of[k] / len(of) * (p - prob[k, v]) * value
        w = [a - 1.0 * b for a, b in zip(w, slope, strict=True)]
    return w


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, spans) for each row of docs.

    base and spans are arrays of (kind, start, end), code points, by kind and start. spans holds the base spans and
    those that the classifier accepts. A null or empty text has none. Rows are told apart even if they repeat or have
    no id; an empty table gives no rows.
    """
    found = cut(candidates(docs, id_col, text_col), "pii")
    votes = F.struct(F.col("regex").alias("v0"), F.col("gazetteer").alias("v1"), F.col("context").alias("v2"), F.col("shape").alias("v3"))
    counts = found.where(F.col("kind").isNotNull()).groupBy("kind", votes.alias("v")).count().collect()  # at most 10 * 3^4 rows
    patterns = [(r.kind, tuple(r.v), r["count"]) for r in sorted(counts)]
    prob, _ = expectation_maximisation(patterns)
    w = train(patterns, prob)
    own = F.get(F.array(*[F.lit(float(x)) for x in w[len(LABELERS) :]]), F.col("kind"))
    logit = sum((F.col(f"v.v{j}") * float(x) for j, x in enumerate(w[: len(LABELERS)])), own)
    chosen = found.withColumn("v", votes).withColumn("base", F.col("valid") & (F.col("kind") < BASE))
    chosen = chosen.withColumn("also", F.col("base") | ((F.col("kind") >= BASE) & (1 / (1 + F.exp(-logit)) >= ACCEPT)))
    span = F.struct("kind", "start", "end")
    rows = chosen.groupBy("row", id_col).agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{name}") for k, (name, _, _) in enumerate(KINDS[:BASE])],
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("also"), span))).alias("spans"),
    )
    names = F.array(*[F.lit(name) for name, _, _ in KINDS])
    named = lambda a: F.transform(a, lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.select(id_col, *[f"n_{name}" for name, _, _ in KINDS[:BASE]], named(F.col("base")).alias("base"), named(F.col("spans")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return find(read(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
