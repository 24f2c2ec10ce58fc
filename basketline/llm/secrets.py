"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query is derived: an OR of alternatives, each an AND
of the trigrams that any match of that alternative must hold. The index has a posting (trigram,
document) for every trigram that some query names; trigrams are of text lower-cased in ASCII, so
they are sound for rules that ignore case. A document is a rule's candidate if, for one
alternative, it is in the postings of all its trigrams. Only candidates are verified by the regular
expression; a rule with an alternative that lacks mandatory trigrams scans every document.

All of it is DataFrame expressions. Matches get their places from the pieces between them: the
lengths, in code points, of pieces and matches add up to starts and ends.

Defined results: a null or empty text has no spans; repeated rows are scanned each (rows of one
doc_id share candidates, which the expressions verify); rows without a doc_id take no part; further
columns may be kept by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as kind
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import documents, with_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, whose group `group` has `least` characters or more."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Well-known shapes of further secrets.
MORE = (
    # from BEGIN through END; without END, as long as lines (real or escaped breaks) are base64 or a header of a key
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\t\r\n:,\\-]*?-----END [A-Z ]*PRIVATE KEY-----"
                r"|(?:(?:(?:\\r)?\\n|\r?\n)+(?:[A-Za-z0-9+/]{32,}={0,2}|[A-Za-z]*[0-9+][A-Za-z0-9+/]{12,}={0,2}"
                r"|[A-Za-z]{12,}[0-9+][A-Za-z0-9+/]*={0,2}|[A-Za-z0-9+/]+={1,2}|(?:Proc-Type|DEK-Info):[\x20A-Za-z0-9,-]*))*+)"),  # possessive: no recursion on long keys
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def literals(tree) -> list[list[str]]:
    """Alternatives of the literal runs that a match must hold, one after the other; "" parts two runs."""
    found = [[""]]
    for op, arg in tree:
        if op is kind.LITERAL:
            found = [[*runs[:-1], runs[-1] + chr(arg)] for runs in found]
            continue
        if op is kind.SUBPATTERN:
            inner = literals(arg[3])
        elif op is kind.BRANCH:
            inner = [runs for branch in arg[1] for runs in literals(branch)]
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT) and arg[0] >= 1:
            inner = [["", *runs, ""] for runs in literals(arg[2])]
        elif op is kind.AT:
            continue
        else:
            inner = [["", ""]]
        found = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in found for b in inner]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR over the list, AND over each set; an empty list if some alternative has no trigram."""
    asked = []
    for runs in literals(parser.parse(pattern)):
        lowered = [r.lower() for r in runs if r.isascii()]
        grams = frozenset(r[i:i + 3] for r in lowered for i in range(len(r) - 2))
        if not grams:
            return []
        asked.append(grams)
    return [a for a in dict.fromkeys(asked) if not any(b < a for b in asked)]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """trigram, doc_id for the given trigrams."""
    lowered = docs.select("doc_id", ascii_lower(F.col("text")).alias("text"))
    held = F.array(*[F.when(F.contains("text", F.lit(g)), F.lit(g)) for g in grams])
    return lowered.select("doc_id", F.explode(F.array_compact(held)).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """doc_id, rules: the names of the rules whose query the postings of a document satisfy."""
    asked = [(r.name, n, g, len(grams)) for r in rules for n, grams in enumerate(trigram_query(r.pattern)) for g in sorted(grams)]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(asked, "rule string, alternative int, trigram string, needed int")  # a row for a rule's trigram
    lists = postings(docs, sorted({g for _, _, g, _ in asked}))
    met = (lists.join(F.broadcast(wanted), "trigram").groupBy("doc_id", "rule", "alternative")
           .agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).where("n = needed"))
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def spans_of(rule: Rule, text: Column) -> Column:
    """The rule's matches as structs (start, rank, end), from left to right, those that fail dropped."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.transform(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("match"), part.alias("part")),
                        lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["match"]).alias("match"), F.length(z["part"]).alias("part")))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("found"))

    def step(state: Column, z: Column) -> Column:
        begin = state["at"] + z["gap"]
        end = begin + F.coalesce(z["match"], F.lit(0))
        hit = F.array(F.struct(begin.alias("start"), end.alias("end")))
        good = z["part"].isNotNull() & (z["part"] >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(state["found"], hit)).otherwise(state["found"]).alias("found"))

    spans = F.aggregate(steps, start, step, lambda s: s["found"])
    return F.when(text.rlike(rule.pattern), spans)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, whole_rows: bool = False) -> DataFrame:
    """doc_id, text, spans: array of (start, rank, end) by start and then rank, rank being the rule's place in `rules`.

    With `whole_rows`, the document itself is kept as the struct `row`.
    """
    rows = documents(docs, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []))
    met = candidates(rows, rules).withColumnRenamed("doc_id", "_id")
    rows = rows.join(met, F.col("doc_id") == F.col("_id"), "left")
    empty = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int>>)")
    found = []
    for rank, rule in enumerate(rules):
        place = F.lit(rank)
        spans = F.transform(spans_of(rule, F.col("text")),
                            lambda s: F.struct(s["start"].alias("start"), place.alias("rank"), s["end"].alias("end")))
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains(F.coalesce(F.col("rules"), F.array().cast("array<string>")), rule.name), spans)
        found.append(F.coalesce(spans, empty))
    return rows.withColumn("spans", F.sort_array(F.concat(*found))).drop("_id", "rules")


def joined(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_rank(spans: Column, rank: int) -> Column:
    return F.filter(spans, lambda s: s["rank"] == rank)


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with every span of the text replaced by `mark`; spans that overlap are one. n_chars follows the text."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        upto = F.substring("text", state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], upto, F.lit(mark))).otherwise(state["out"]).alias("out"))

    text = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text"))))
    rows = scan(docs, rules, whole_rows=True).withColumn("clean", F.when(F.size("spans") > 0, text).otherwise(F.col("row.text")))
    return with_text(rows, "row", F.col("clean"), docs.columns)
