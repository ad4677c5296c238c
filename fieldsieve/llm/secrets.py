"""Secret scans over a trigram index, with DataFrame operations only.

Each rule's regular expression is turned into a Boolean trigram query: alternatives, each a set of
trigrams that a match must contain. The inverted index holds (trigram, doc_id) postings for the
trigrams that some rule asks for. Postings are intersected per alternative, and only the documents
left are verified with the rule's expression; rules without mandatory trigrams scan every text.

Defined cases: null text is empty; rows may repeat a doc_id or have none, as postings go by id and a hash
of the text, and each row is verified by itself; whole texts are read;
other columns ride along, whatever their names; an empty table gives no rows; positions are code points.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # Java and Python syntax
    group: int = 0  # the group that has a least length
    least: int = 0


#: The three base kinds in their order, then the kinds this method adds.
BASE = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the maximal runs of 24 and more
)
#: After the header line of a key: its fields, then all through the END line; without one, the base64 that follows.
#: Loops over groups are bounded (as many lines as a key can have), as Java recurs in them; loops over characters are not.
KEY_BODY = r"(?:[\r\n\\]+[A-Za-z][A-Za-z-]*:[^\r\n\\]*){0,8}(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----|" + r"(?:[\x20\t\r\n]+[A-Za-z0-9+/=]{16,}){0,60}" * 4 + r"[A-Za-z0-9+/=\r\n\\]*)"
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + KEY_BODY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
MARK, STAND_IN = "\ufdd0", "\ufdd1"  # noncharacters: one marks matches, the other stands for it in texts


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]] | None:
    """Alternatives of trigrams (lower case): a match contains all of some alternative. None: no such query.

    Over the parsed expression, each branch is followed as a list of fixed strings; anything that is
    not one known letter, or a choice of case, ends the current string.
    """
    # each state: (finished strings, the string that still grows)
    def step(states: list, node) -> list:
        op, arg = node
        if op is rc.LITERAL:
            return [(done, run + chr(arg).lower()) for done, run in states]
        if op is rc.IN and (one := only_letter(arg)):
            return [(done, run + one) for done, run in states]
        if op is rc.SUBPATTERN:
            return walk(states, arg[3])
        if op is rc.BRANCH:
            return [s for branch in arg[1] for s in walk(states, branch)]
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[:2] == (0, 1):
            return states + walk(states, arg[2])
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:  # what is repeated stands there at least once
            return [(done + (run,), "") for done, run in walk([(done + (run,), "") for done, run in states], arg[2])]
        return [(done + (run,), "") for done, run in states]

    def walk(states: list, nodes) -> list:
        for node in nodes:
            states = list(dict.fromkeys(step(states, node)))
            if len(states) > most:  # too many branches: their common part only
                states = [((), "")]
        return states

    def only_letter(choices) -> str | None:
        letters = {chr(x).lower() for kind, x in choices if kind is rc.LITERAL}
        return letters.pop() if len(letters) == 1 and all(kind is rc.LITERAL for kind, _ in choices) else None

    found = [frozenset(s[i : i + 3] for s in (*done, run) for i in range(len(s) - 2)) for done, run in walk([((), "")], rp.parse(pattern))]
    return None if any(not x for x in found) else list(dict.fromkeys(x for x in found if not any(y < x for y in found)))


def text_key(text: Column) -> Column:
    """Told with the doc_id, so that rows without an id, or of one id, do not all meet."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index (trigram, doc_id, key) of the lower-cased texts for these trigrams."""
    low = F.lower(F.coalesce("text", F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select("doc_id", text_key(F.col("text")).alias("key"), low.alias("low")).select("doc_id", "key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, key, rules): for each document that some indexed rule may match, those rules."""
    queries = [(r.name, i, g, len(q)) for r in rules for i, q in enumerate(trigram_query(r.pattern) or []) for g in sorted(q)]
    index = postings(docs, sorted({g for _, _, g, _ in queries}))
    asked = docs.sparkSession.createDataFrame(queries, "rule string, alternative int, trigram string, least int")  # bounded by the rules
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "key", "rule", "alternative", "least").agg(F.collect_set("trigram").alias("met"))
    return met.filter(F.size("met") == F.col("least")).groupBy("doc_id", "key").agg(F.collect_set("rule").alias("rules"))


def matches(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, kind), ends exclusive, in code points.

    The matches are set between marks; the pieces between marks then are, in turn, text and match.
    """
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), F.lit(rule.pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    zero = F.struct(F.lit(0).alias("end"), F.lit(False).alias("match"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))

    def add(state: Column, piece: Column) -> Column:
        end = state["end"] + F.char_length(piece)
        long_enough = F.char_length(F.regexp_extract(piece, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        span = F.struct(state["end"].alias("start"), end.alias("end"), F.lit(rule.name).alias("kind"))
        return F.struct(end.alias("end"), (~state["match"]).alias("match"), F.when(state["match"] & long_enough, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.aggregate(pieces, zero, add, lambda s: s["out"])


def scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, secrets): each row of docs as it is, and its spans (start, end, kind), by start and then in the order of the rules."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    found = candidates(docs, tuple(indexed))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.join(found.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (text_key(F.col("row.text")) == F.col("key")), "left")
    text, none = F.coalesce("row.text", F.lit("")), F.array().cast("array<struct<start:int,end:int,kind:string>>")
    spans = [F.when(F.array_contains("rules", r.name), matches(text, r)).otherwise(none) if r in indexed else F.when(F.regexp_like(text, F.lit(r.pattern)), matches(text, r)).otherwise(none) for r in rules]
    rank = {r.name: i for i, r in enumerate(rules)}
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    keyed = F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select("row", F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("secrets"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """docs with ``into``: array of (start, end, kind). A column of that name that docs have is replaced."""
    return scanned(docs, rules).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != into], F.col("secrets").alias(into))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, put: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced; overlapping spans count as one; n_chars follows the text."""
    zero, text = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), F.col("row.text")

    def cut(state: Column, span: Column) -> Column:
        between = F.substr(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        piece = F.when(span["start"] >= state["at"], F.array(between, F.lit(put))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    cleaned = F.aggregate("secrets", zero, cut, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1)))
    held = F.size("secrets") > 0
    found = scanned(docs, rules).withColumn("clean", F.when(held, cleaned).otherwise(text))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in own:
        own["n_chars"] = F.when(held, F.char_length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return found.select(*[c.alias(name) for name, c in own.items()])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(name: str):
    return lambda s: F.when(s["kind"] == name, s["start"])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.name for r in BASE]
    counts = [F.size(F.array_compact(F.transform("secrets", of_kind(n)))).cast("long").alias(f"n_{n}") for n in base]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _sql_spans(rule: Rule) -> str:
    """DuckDB: list of (start, rank, text) of a rule's matches in t."""
    quoted = rule.pattern.replace("'", "''")
    rank = [r.name for r in RULES].index(rule.name)
    pieces = f"string_split(regexp_replace(t, '{quoted}', chr(64976) || '\\0' || chr(64976), 'g'), chr(64976))"
    starts = "list_sum(list_transform(p[1:i-1], lambda x: length(x)))"
    held = f" and length(regexp_extract(p[i], '{quoted}', {rule.group})) >= {rule.least}" if rule.least else ""
    return f"""(select coalesce(list({{'start': {starts}::bigint, 'rank': {rank}, 'span': '{rule.name}:' || {starts}::bigint || ':' || ({starts} + length(p[i]))::bigint}}), [])
      from (select p, unnest(range(2, len(p) + 1, 2)) as i from (select {pieces} as p)) where true{held})"""


QUERIES = {"op9_secret_scan": op9_secrets}
ORACLES = {
    "op9_secret_scan": f"""
with docs as (select doc_id, replace(coalesce(text, ''), chr(64976), chr(64977)) as t from documents),
found as (select doc_id, {", ".join(f"{_sql_spans(r)} as s_{r.name}" for r in RULES)} from docs)
select doc_id, {", ".join(f"len(s_{r.name})::bigint as n_{r.name}" for r in BASE)},
  sha256(coalesce(array_to_string(list_transform(list_sort({" || ".join(f"s_{r.name}" for r in BASE)}), lambda x: x.span), ','), '')) as base_sha256,
  coalesce(array_to_string(list_transform(list_sort({" || ".join(f"s_{r.name}" for r in RULES)}), lambda x: x.span), ','), '') as spans
from found
""",
}
