"""Personal data by bootstrapped contextual extraction, in built-in expressions only.

Seeds are the valid matches of four rules: email, ip, card, phone. Every identifier-like string of a text (a word with "@", or
a run of figures and their separators) is an instance; the words next to it make lexical patterns: the two words before it, the word before it, and that one
with the word after it. Patterns and distinct instances are the two sides of a graph that Spark scores in turn: a
pattern of a kind is trusted by the share of its instances that are of that kind, an instance without a rule of its own by the trusted
patterns that it stands in (one minus the product of their doubts). After ROUNDS, instances of at least ACCEPT are of the kind wherever they stand. So "tel 555-1234" is found
where "tel" stands before many whole phone numbers, and nothing is found next to words that stand before anything.

The texts are read once; what leaves that pass are spans and short contexts. Patterns and instances are counted before they are moved, so
a word before a third of all instances is a few rows of sums. Each round is checkpointed.

Defined cases. A null or empty text has no spans. Positions are code points, ends exclusive. Null ids and repeated rows are judged like others and
each gives a row. An instance longer than LONGEST is none; of a context's words the LETTERS nearest to the instance count. Patterns see lower-case words and any figure as 0.
Ties between kinds go to the first of KINDS. An added span that meets a base span or an earlier kind's added span is left out. Very long
texts are whole, their matching time grows in proportion to their length. An empty table gives no rows. Other columns, whatever their names, are left aside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, maybe_broadcast, staged

#: In the order in which spans are listed (fixed values).
KINDS = ("email", "ip", "card", "phone")
#: Rules of the kinds (fixed values), written so that a failed start isn't tried again within the same run of characters.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What can be an identifier: a word with "@", or figures with at most two separators between them, not within a word.
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D]++|(?<![0-9A-Za-z_.%@+(/-])(?<![0-9][\x20().:/-]{1,2})\+?+\(?+[0-9](?:[\x20().:/-]{0,2}+[0-9])*+(?![0-9A-Za-z_@%])"
#: Around a word with "@" these don't belong to it.
OPENING, CLOSING = r"^[\"'<(\[{:;,]++", r"[\"'>)\]},.:;!?]++$"
LONGEST, LETTERS = 254, 24
#: A pattern needs so many distinct seeds and this share; an instance this score; scores settle within so many rounds.
SEEDS, TRUST, ACCEPT, ROUNDS = 5, 0.7, 0.7, 3
#: Sides of joins of at most so many rows, none of them over a kilobyte, are broadcast; larger ones are joined by a shuffle.
FEW = 20_000
#: Lists are summed in blocks of this length.
_BLOCK = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, also where then uses it within a function of elements."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running_sums(numbers: Column) -> Column:
    """For each number of an array, the sum up to and with it; in blocks, so that a long array isn't summed anew for each element."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def of(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, _BLOCK))

        def joined(bs: Column) -> Column:
            def within(sums: Column) -> Column:
                return F.flatten(F.transform(bs, lambda x, i: _let(total(F.slice(sums, F.lit(1), i)), lambda base: F.transform(x, lambda _, j: base + total(F.slice(x, F.lit(1), j + 1))))))

            return _let(F.transform(bs, total), within)

        return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(_let(blocks, joined))

    return _let(numbers, of)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value, left, right) of the leftmost matches: left and right are what lies between it and the next ones.

    A split by the pattern gives the text between the matches, whose lengths tell where they are."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(m: Column, s: Column) -> Column:
        lengths = F.zip_with(F.slice(s, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        ends = running_sums(lengths)
        rows = F.zip_with(m, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
        return F.transform(rows, lambda r, i: F.struct(r["start"], r["end"], r["value"], F.element_at(s, i + 1).alias("left"), F.element_at(s, i + 2).alias("right")))

    return _let(found, lambda m: _let(between, lambda s: placed(m, s)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether the last digit of a string of digits is its Luhn check digit."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's rule counts."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits(value)).between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """(kind, start, end) of all valid matches; kind is the place in KINDS. A text without the sign or the figures that a kind needs isn't searched for it."""
    needs = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]")}

    def of(i: int, kind: str) -> Column:
        good = F.filter(matches(text, RULES[kind]), lambda m: valid(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(needs[kind], spans).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int>>"))

    return F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)])


def own_kind(value: Column) -> Column:
    """The kind of which the whole value is a valid match; null without one."""
    out = F.when(F.lit(False), F.lit(0))
    for i, kind in enumerate(KINDS):
        out = out.when(value.rlike(f"^(?:{RULES[kind]})$") & valid(kind, value), i)
    return out


def possible_kinds(value: Column) -> Column:
    """The kinds that a value without a rule of its own may be one of, by its characters alone."""
    n = F.length(digits(value))
    number = ~value.rlike(r"[^0-9\x20().:/+-]")
    tests = [value.rlike("^[^@]*[^@\\W][^@]*@[^@]*[^@\\W]"), value.rlike(r"^[0-9]+(?:[.:][0-9]+){3,7}$"), number & n.between(12, 19), number & n.between(7, 15)]
    return F.filter(F.array(*[F.when(t, i) for i, t in enumerate(tests)]), lambda x: x.isNotNull())


def instances(text: Column) -> Column:
    """(start, end, value, before2, before, after) of everything in a text that can be an identifier."""
    def shaped(m: Column) -> Column:
        mail = m["value"].contains("@")
        lead = F.when(mail, F.length(F.regexp_extract(m["value"], OPENING, 0))).otherwise(0)
        trail = F.when(mail, F.length(F.regexp_extract(m["value"], CLOSING, 0))).otherwise(0)
        value = F.substring(m["value"], lead + 1, F.greatest(F.length(m["value"]) - lead - trail, F.lit(0)))
        # the nearest words, with what stands right before the match, as in "tel:555"; "^" where the text or another instance begins
        plain = lambda t: F.regexp_replace(F.lower(t), "[0-9]+", "0")
        left = F.split(F.regexp_replace(plain(F.right(m["left"], F.lit(2 * LETTERS))), r"[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
        right = F.split(F.regexp_replace(plain(F.left(m["right"], F.lit(2 * LETTERS))), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
        word = lambda words, at: F.coalesce(F.nullif(F.right(F.try_element_at(words, F.lit(at)), F.lit(LETTERS)), F.lit("")), F.lit("^"))
        before, before2 = word(left, -1), word(left, -2)
        return F.struct((m["start"] + lead).alias("start"), (m["end"] - trail).alias("end"), value.alias("value"), before2.alias("before2"), before.alias("before"), word(right, 1).alias("after"))

    found = F.filter(matches(text, INSTANCE), lambda m: F.length(m["value"]) <= LONGEST)
    some = F.filter(F.transform(found, shaped), lambda m: m["end"] > m["start"])
    return F.when(text.rlike("[0-9@]"), some).otherwise(F.array().cast(_INSTANCES))


_INSTANCES = "array<struct<start:int,end:int,value:string,before2:string,before:string,after:string>>"


def graph(found: DataFrame) -> DataFrame:
    """(pattern, value, own, kinds): the distinct edges between patterns and instances, from rows of found (array "instances")."""
    rows = found.select(F.inline("instances"))
    patterns = F.array(F.concat_ws(" ", "before2", "before", F.lit("_")), F.concat_ws(" ", "before", F.lit("_")), F.concat_ws(" ", "before", F.lit("_"), "after"))
    edges = rows.select("value", F.explode(F.array_distinct(patterns)).alias("pattern")).groupBy("pattern", "value").count()
    return edges.select("pattern", "value", own_kind(F.col("value")).alias("own"), possible_kinds(F.col("value")).alias("kinds"))


def learn(edges: DataFrame, seeds: int = SEEDS, trust: float = TRUST, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score) of the instances without a rule of their own that the graph accepts."""
    # a pattern's distinct instances, and the seeds among them of each kind: what doesn't change from round to round
    fixed = edges.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(F.col("own") == i).alias(f"seeds{i}") for i in range(len(KINDS))])
    by_kind = fixed.select("pattern", "n", F.posexplode(F.array(*[f"seeds{i}" for i in range(len(KINDS))])).alias("kind", "n_seeds")).where(F.col("n_seeds") >= seeds)
    open_edges = edges.where("own IS NULL").select("pattern", "value", F.explode("kinds").alias("kind"))
    # the most that a pattern can reach if all its open instances are of the kind; the others never are trusted
    most = open_edges.groupBy("pattern", "kind").agg(F.count("*").alias("n_open"))
    hopeful = cut(by_kind.join(most, ["pattern", "kind"]).where(F.col("n_seeds") + F.col("n_open") >= trust * (F.col("n") + 1)))
    open_edges = cut(open_edges.join(maybe_broadcast(hopeful.select("pattern", "kind"), FEW), ["pattern", "kind"]))
    scores = None
    for _ in range(rounds):
        gained = hopeful.withColumn("gained", F.lit(0.0)) if scores is None else hopeful.join(open_edges.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained")), ["pattern", "kind"], "left").fillna(0.0, ["gained"])
        trusted = gained.select("pattern", "kind", ((F.col("n_seeds") + F.col("gained")) / (F.col("n") + 1)).alias("trust")).where(F.col("trust") >= trust)
        doubt = F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999))))
        scores = cut(open_edges.join(maybe_broadcast(trusted, FEW), ["pattern", "kind"]).groupBy("value", "kind").agg(F.round(1 - F.exp(doubt), 9).alias("score")))
    best = F.max_by("kind", F.struct("score", -F.col("kind")))
    return scores.where(F.col("score") >= accept).groupBy("value").agg(best.alias("kind"), F.max("score").alias("score"))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def _count_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def find(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_added, the number of spans beyond the rules'. how: see learn()."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), base_spans(text).alias("base"), instances(text).alias("instances"))
    found, _ = staged(read, "private-spans")
    learned = learn(cut(graph(found)), **how)
    # a text's spans don't depend on its row: rows that repeat an id and a text ask once
    unsure = F.filter("instances", lambda m: own_kind(m["value"]).isNull() & (F.size(possible_kinds(m["value"])) > 0))
    asked = found.select("doc_id", "digest", F.inline(unsure)).select("doc_id", "digest", "start", "end", "value").distinct()
    told = asked.join(maybe_broadcast(learned.select("value", "kind"), FEW), "value")
    added = told.groupBy(F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    no_spans = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest"))
    all_rows = found.select("doc_id", "digest", "base").join(added, same, "left").select("doc_id", "base", F.coalesce("added", no_spans).alias("added"))
    new = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    rows = all_rows.select("doc_id", "base", new.alias("added"))
    counts = [_count_of(i).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
