r"""Personal data by pattern, checksum and context, in SQL operations only.

Patterns propose spans, validators confirm them (parts of an address up to 255,
Luhn for cards, mod 97 for account numbers, digit counts), and nearby words move
the score: a span with a telling word shortly before or after it is surer, and one
next to a word that tells of something else (a version, an order number) less so.
Offsets are code points, end exclusive.

Spark's pattern functions return strings, not places; so a text is split at a
pattern, which leaves the gaps, and the places follow from the lengths of gaps and
matches one after another. Both functions walk the same leftmost matches. The
patterns are written so that no text makes them take more than linear time: runs
are possessive and are only entered at their start.

Base kinds are email, ip, card and phone, none of which context can drop; their
scores are returned. The method adds iban, the longest start of a run of groups that mod 97 confirms whatever the context, and secret, a key or
token value that must have its telling word right before it.

Defined cases: a null text is an empty one, without spans; a span at the edge of
a text has shorter context; repeated rows are judged each. Kinds may overlap one
another; spans of one kind never do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a string that every match holds, or empty
    context: str  # telling words, as a pattern
    score: float  # without context
    base: bool


KINDS = (
    # a local part is entered at its start or where the last match ended
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"(?i)mail|contact|write", 0.8, True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", r"(?i)\bip\b|host|server|addr", 0.6, True),
    # at least 13 digits: shorter runs cannot pass, and a longer one is matched whole from its start
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", "", r"(?i)card|visa|pay", 0.7, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"(?i)phone|call|tel|mobile", 0.6, True),
    # the head of a run of 15 to 34; group 1 looks ahead at the rest and one character more, of which _accounts takes what is valid
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", "", r"(?i)iban|account|bank", 0.8, False),
    Kind("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,64}+(?![A-Za-z0-9_])", "", r"(?i)(?:token|secret|passw(?:or)?d|api_?key|key)\"?\s*[:=]\s*\"?$", 0.3, False),
)
CONTEXT_CHARS = 24
CONTEXT_GAIN = 0.2
#: Words before a match that tell of something else, and what they take from its score.
OTHERWISE = r"(?i)\b(?:version|release|order|invoice|isbn|build|v)\W{0,3}$"
CONTEXT_LOSS = 0.3
WALKED = 256
LEAST_SCORE = 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn: every second digit from the right counts double, less 9 over 9."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") >= 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end and letters as 10 to 35."""
    bare = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0).cast("long"),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("long")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return value == 1


def _valid(kind: Kind, match: Column) -> Column:
    if kind.name == "ip":
        # parts may have leading zeros and any length; their value counts
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind.name == "card":
        return F.length(_digits(match)).between(13, 19) & luhn(_digits(match))
    if kind.name == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind.name == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def _places(text: Column, kind: Kind) -> Column:
    """All matches with their places and the text shortly before and after, in order.

    The walk goes over ``WALKED`` matches at a time, as each step copies what the walk has found.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.transform(
        F.arrays_zip(matches.alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.greatest(F.lit(1), F.size(gaps))).alias("next")),
        lambda x: F.struct(x["m"].alias("m"), F.length(x["g"]).alias("gap"), F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(x["next"], F.lit(CONTEXT_CHARS)).alias("after")),
    )

    def size(x: Column) -> Column:
        return x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0))

    def walk(part: Column, at: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["gap"]
            one = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))
            return F.when(x["m"].isNull(), a).otherwise(F.struct((a["at"] + size(x)).alias("at"), F.concat(a["found"], F.array(one)).alias("found")))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("found")), step, lambda a: a["found"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / WALKED).cast("int")), lambda i: F.slice(pairs, i * WALKED + 1, F.lit(WALKED)))
    begun = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, p: F.struct((a["at"] + F.aggregate(p, F.lit(0), lambda n, x: n + size(x))).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
        lambda a: a["starts"],
    )
    walked = F.flatten(F.zip_with(parts, begun, walk))
    there = F.contains(text, F.lit(kind.hint)) & text.rlike(kind.pattern) if kind.hint else text.rlike(kind.pattern)
    return F.when(there, walked).otherwise(F.array().cast(_SPAN))


def _account(run: Column) -> Column:
    """The longest start of a run that is an account number and ends where a group does, or null."""
    groups = F.split(run, " ")
    starts = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    return F.get(F.filter(starts, lambda s: s.rlike("^[A-Z0-9 ]+$") & F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & mod97(s)), F.lit(0))


def _accounts(text: Column, kind: Kind) -> Column:
    """Account numbers with their places, as _places gives them; of those that overlap, the first."""
    heads = _places(text, kind)
    rests = F.when(F.size(heads) > 0, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))

    def whole(head: Column, rest: Column) -> Column:
        return F.struct(head["start"].alias("start"), head["end"].alias("end"), _account(F.concat(head["match"], rest)).alias("match"), head["before"].alias("before"), rest.alias("rest"))

    found = F.filter(F.zip_with(heads, rests, whole), lambda s: s["match"].isNotNull())
    def ended_by(s: Column) -> Column:
        taken = F.length(s["match"])
        after = F.left(F.substring(s["rest"], taken - 3, F.lit(2 * CONTEXT_CHARS)), F.lit(CONTEXT_CHARS))  # the head is four characters of the match
        return F.struct(s["start"].alias("start"), (s["start"] + taken).alias("end"), s["match"].alias("match"), s["before"].alias("before"), after.alias("after"))

    ended = F.transform(found, ended_by)
    return F.aggregate(
        ended,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["found"], F.array(s)).alias("found"))),
        lambda a: a["found"],
    )


def _confirmed(spans: Column, kind: Kind) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["match"]))


def _scored(spans: Column, kind: Kind, least_score: float) -> Column:
    def one(s: Column) -> Column:
        telling = s["before"].rlike(kind.context) if kind.context.endswith("$") else s["before"].rlike(kind.context) | s["after"].rlike(kind.context)
        score = F.lit(kind.score) + F.when(telling, CONTEXT_GAIN).when(s["before"].rlike(OTHERWISE), -CONTEXT_LOSS).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), score.alias("score"))

    spans = F.transform(spans, one)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= least_score)


def _only(names: list[str]) -> Column:
    return F.filter("found", lambda s: s["kind"].isin(names))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, text and found: array of (kind, start, end, match, score), by kind as listed, then start."""
    df = keyed_text(docs)
    for kind in kinds:
        spans = _accounts(F.col("text"), kind) if kind.name == "iban" else _confirmed(_places(F.col("text"), kind), kind)
        df = df.withColumn(f"_{kind.name}", spans)
    each = [_scored(F.col(f"_{kind.name}"), kind, least_score) for kind in kinds]
    return df.select("doc_id", "text", F.concat(*each).alias("found"))


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id and the text with each span replaced by its kind in brackets. Spans that overlap are one, named by the first (by start, then the longer)."""
    found = find_pii(docs, kinds, least_score)
    region = "array<struct<start:int,end:int,kind:string>>"
    spans = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        last, end = F.element_at(a, -1), -s["less"]
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["kind"].alias("kind"))
        new = F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))
        return F.when((F.size(a) > 0) & (s["start"] < F.try_element_at(a, F.lit(-1))["end"]), F.concat(F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)), F.array(wider))).otherwise(F.concat(a, F.array(new)))

    regions = F.aggregate(spans, F.array().cast(region), step)
    ends = F.concat(F.array(F.lit(0)), F.transform("regions", lambda r: r["end"]))
    pieces = F.zip_with(F.col("regions"), ends, lambda r, at: F.concat(F.substring("text", at + 1, F.coalesce(r["start"], F.length("text")) - at), F.coalesce(F.concat(F.lit("["), r["kind"], F.lit("]")), F.lit(""))))
    return found.withColumn("regions", regions).select("doc_id", F.array_join(pieces, "").alias("text"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *(F.size(_only([n])).cast("long").alias(f"n_{n}") for n in base),
        F.sha2(_joined(_only(base)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
