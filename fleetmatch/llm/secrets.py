"""Secret scans with a trigram inverted index, DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: a list of
alternatives, each a set of trigrams that every match of that alternative must
contain.  Postings (trigram, doc_id) are intersected per alternative, and only the
documents that satisfy some alternative are verified with the expression itself.
A rule with an alternative that forces no trigram is scanned over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmatch.llm.store import fresh, numbered, others, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` without groups of its own but one, ``value``, whose code points must be ``least`` or more."""

    kind: str
    pattern: str
    least: int
    value: bool = False


# The base rules.  Letters of a keyword stand in either case.
BASE_RULES = (
    Rule("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),  # a match of [0-9a-f]+ is a whole run, so the shorter runs can be left out here
)
# Spans that this library adds.
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("gh", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
)
RULES = BASE_RULES + ADDED_RULES


def _alternatives(parsed) -> list[list[str]]:
    """Ways a pattern can match, each as the runs of lower-cased literals it must contain."""
    ways: list[list[str]] = [[""]]

    def times(more: list[list[str]]) -> None:
        nonlocal ways
        ways = [[*w[:-1], w[-1] + m[0], *m[1:]] for w in ways for m in more]

    for op, arg in parsed:
        if op is C.LITERAL:
            times([[chr(arg).lower()]])
        elif op is C.IN and len({chr(a).lower() for o, a in arg if o is C.LITERAL}) == 1 and all(o is C.LITERAL for o, _ in arg):
            times([[chr(arg[0][1]).lower()]])  # one letter in either case
        elif op is C.SUBPATTERN:
            times(_alternatives(arg[-1]))
        elif op is C.BRANCH:
            times([w for branch in arg[1] for w in _alternatives(branch)])
        elif op is C.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            times([[""], *_alternatives(arg[2])])
        else:
            times([["", ""]])  # anything: the run of literals ends
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives as sets of trigrams (of the lower-cased text); None if one of them forces none."""
    ways = {frozenset(run[k : k + 3] for run in way for k in range(len(run) - 2)) for way in _alternatives(regex_parser.parse(pattern))}
    return None if frozenset() in ways else sorted(ways, key=sorted)


SPANS = "array<struct<start:bigint,end:bigint>>"


def found(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end>> in code points.

    Each step of ``\\G(.*?)(match)`` begins where the last match ended, so the lengths
    of what is skipped and of what is matched add up to positions.  An array that grows
    is copied at each step, so n matches are taken in about sqrt(n) blocks: positions
    within each block, then the blocks' own.
    """
    step = F.lit(rf"(?s)\G(.*?)({rule.pattern})")
    skipped, matched = F.regexp_extract_all(text, step, 1), F.regexp_extract_all(text, step, 2)
    valued = F.regexp_extract_all(text, step, 3) if rule.value else matched
    parts = F.arrays_zip(skipped.alias("s"), matched.alias("m"), valued.alias("v"))

    def state(kind: str) -> Column:
        return F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))

    def move(state: Column, part: Column) -> Column:
        first = state["at"] + F.length(part["s"])
        end = first + F.length(part["m"])
        span = F.struct(first.cast("long").alias("start"), end.cast("long").alias("end"))
        spans = F.when(F.length(part["v"]) >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    def append(state: Column, block: Column) -> Column:
        moved = F.transform(block["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["spans"], F.array(moved)).alias("spans"))

    def spans(parts: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(parts))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), width), lambda k: F.aggregate(F.slice(parts, k, width), state(SPANS), move))
        return F.flatten(F.aggregate(blocks, state(f"array<{SPANS}>"), append, lambda whole: whole["spans"]))

    every = F.transform(F.array(parts), spans)[0]  # a lambda's variable: the expressions run once
    return F.when(F.rlike(text, F.lit(rule.pattern)), every).otherwise(F.array().cast(SPANS))


def postings(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """Inverted index (trigram, key) over the trigrams that the rules' queries name."""
    grams = sorted({g for r in rules for way in trigram_query(r.pattern) or [] for g in way})
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(F.col(key), F.lower(F.col(text)).alias("low")).select(key, F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], key: str) -> DataFrame:
    """Keys with ``rules``: the kinds of which some alternative has all its trigrams in the key's postings."""
    spark = index.sparkSession
    ways = [(r.kind, k, g, len(way)) for r in rules for k, way in enumerate(trigram_query(r.pattern) or []) for g in way]
    query = F.broadcast(spark.createDataFrame(ways, "kind string, way int, trigram string, needed int"))  # fixed by the rules
    met = index.join(query, "trigram").groupBy(key, "kind", "way", "needed").agg(F.count(F.lit(1)).alias("n"))
    return met.filter("n >= needed").groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def _tagged(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _of_kind(kind: str) -> Column:
    return F.filter("found", lambda s: s["kind"] == kind)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``found``: array<struct<start, rank, kind, end>> by start, then rule.

    Null and empty texts have none; long texts are scanned whole.  Repeated rows, repeated
    and null ids are scanned each for itself.  A column ``found`` is replaced, others stay.
    Where matches of two rules start together, the rule listed first comes first.
    """
    rows, row, _ = numbered(docs, id_, text)
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = rows.select(F.col(row).alias("row"), body.alias("text")).filter(F.length("text") > 0)
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    name = fresh(rows, "_kinds")
    wanted = candidates(postings(narrow, indexed, "row", "text"), indexed, "row").select(F.col("row").alias(row), F.col("kinds").alias(name))
    full = [r for r in rules if not trigram_query(r.pattern)]
    checked = rows.join(wanted, row, "left")
    kinds = F.coalesce(F.col(name), F.array().cast("array<string>"))
    spans = []
    for rank, rule in enumerate(rules):
        own = found(body, rule)
        if rule not in full:
            own = F.when(F.array_contains(kinds, rule.kind), own)
        spans.append(F.coalesce(_tagged(own, rank, rule.kind), F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")))
    return checked.select(*others(docs, ["found"]), F.array_sort(F.concat(*spans)).alias("found"))


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.size(_of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
