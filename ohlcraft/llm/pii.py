"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans of four kinds come from patterns over whole texts. They are the seeds: the words around a seed make lexical
patterns (two words before it; one before and one after). Looser, identifier-like strings that no base pattern takes are
instances still open. Patterns and instances form a graph that is scored in rounds: a pattern is as sure as the share of
its instances that are (a seed counts 1, an open instance its score), an open instance as sure as its patterns together. An
open instance beyond the threshold, in a pattern with enough different seeds, is added as a span of the pattern's kind and
is a seed from then on: its other contexts make patterns too, until no instance is added.

Offsets are code points: ``split`` gives what stands between the matches of ``regexp_extract_all``, and running lengths give
the places. Patterns use possessive quantifiers, so no text makes them backtrack beyond a run.

Nulls: a null text is empty. Empty texts and tables give no spans; repeated rows keep their own row each. A very long text is
searched whole, its matches placed in blocks. Other columns may have any name: only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
#: A match may start where its leading run starts, or where the match before it ended; within a run it would fail alike.
PATTERNS = {
    "email": rf"{_LOCAL}(?:(?<!{_LOCAL}{{2}})|(?<=\G.)){_LOCAL}*+@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
    # chains of 13 to 19 digits; longer and shorter ones fail anyway
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What an open instance looks like; ``number`` may turn out to be of any kind that has digits.
LOOSE = {
    "number": rf"{PATTERNS['phone']}|{PATTERNS['ip']}|[(0-9](?<![0-9A-Za-z+(].)[0-9]*+(?:[\x20().:/-]{{0,2}}[0-9]){{6,20}}+",
    "mail": rf"{_LOCAL}(?<!{_LOCAL}{{2}}){_LOCAL}*+\x20?(?:\(at\)|\[at\])\x20?{_LABEL}++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?{_LABEL}++)++",
}
#: Code points around a match that are searched for context words.
AROUND = 64
#: Matches whose places are summed up together.
BLOCK = 512
MIN_SEEDS = 5
ROUNDS = 3
SURE = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = _digits(value)

    def doubled(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _is_valid(kind: str):
    return lambda m: valid(kind, m["value"])


def _is_of(kind: str):
    return lambda s: s["kind"] == kind


def _none() -> Column:
    return F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>)")


def with_matches(df: DataFrame, name: str, pattern: str, kind: str, need: Column) -> DataFrame:
    """Add the array ``name`` of all matches in ``text``: kind, start, end, value and the context on either side.

    Running lengths are taken within blocks of ``BLOCK`` matches and then over blocks, so a text of very many matches costs
    no square of them. Each step is a column of its own that later steps name twice, which keeps the optimizer from
    inlining it into a lambda.
    """
    length = lambda x: F.length(x["gap"]) + F.length(x["value"])

    def append(s: Column, n: Column) -> Column:
        return F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def place(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        end = at + F.length(x["value"])
        one = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    def gap(i: Column) -> Column:
        return F.element_at("pii_g", i)

    pair = lambda i: F.struct(gap(i).alias("gap"), F.element_at("pii_v", i).alias("value"), F.right(gap(i), F.lit(AROUND)).alias("left"), F.left(gap(i + 1), F.lit(AROUND)).alias("right"))
    bases = F.aggregate(F.transform("pii_b", lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + length(x))),
                        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), append, lambda s: s["out"])
    placed = F.flatten(F.transform(F.arrays_zip(F.col("pii_b").alias("b"), F.col("pii_l").alias("l")), lambda z: F.aggregate(
        z["b"], F.struct(z["l"].alias("at"), _none().alias("out")), place, lambda s: s["out"])))
    some = F.size("pii_v") > 0
    return (
        df.withColumn("pii_v", F.when(need, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")))
        .withColumn("pii_g", F.when(some, F.split("text", pattern, -1)))
        .withColumn("pii_p", F.when(some, F.transform(F.sequence(F.lit(1), F.size("pii_v")), pair)))
        .withColumn("pii_b", F.when(some, F.transform(F.sequence(F.lit(0), F.floor((F.size("pii_p") - 1) / BLOCK).cast("int")), lambda b: F.slice("pii_p", b * BLOCK + 1, F.lit(BLOCK)))))
        .withColumn("pii_l", F.when(some, bases))
        .withColumn(name, F.when(some, placed).otherwise(_none()))
        .drop("pii_v", "pii_g", "pii_p", "pii_b", "pii_l")
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """Add to rows with a ``text`` the arrays base and loose: valid base matches by kind as listed, then start; loose ones that are no base span."""
    text = F.col("text")
    # cheap tests spare texts that can't match
    need = {"email": text.contains("@"), "phone": text.contains("+"), "mail": text.contains("at)") | text.contains("at]")}
    rows = docs
    for name, pattern in [*PATTERNS.items(), *LOOSE.items()]:
        rows = with_matches(rows, f"pii_{name}", pattern, name, need.get(name, F.lit(True)))
    number = F.filter("pii_number", lambda m: ~(
        m["value"].startswith("+") | m["value"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$") | (F.length(_digits(m["value"])).between(13, 19) & luhn(m["value"]))))
    base = F.concat(*[F.filter(f"pii_{k}", _is_valid(k)) for k in KINDS])
    return rows.select(*docs.columns, base.alias("base"), F.concat(number, F.col("pii_mail")).alias("loose"))


def contexts(spans: DataFrame) -> DataFrame:
    """One row per span and lexical pattern. A span with no word before it makes no pattern."""
    before = F.split(F.trim(F.regexp_replace(F.lower("left"), r"[^\p{L}\p{N}]+", " ")), " ")
    after = F.split(F.trim(F.regexp_replace(F.lower("right"), r"[^\p{L}\p{N}]+", " ")), " ")
    last = F.element_at(before, -1)
    two = F.when(F.size(before) > 1, F.concat_ws(" ", F.element_at(before, -2), last, F.lit("_")))
    around = F.when((last != "") & (F.element_at(after, 1) != ""), F.concat_ws(" ", last, F.lit("_"), F.element_at(after, 1)))
    return spans.withColumn("pattern", F.explode(F.array_compact(F.array(two, around))))


def _fits(shape: str, kind: str) -> Column:
    """Written-out mail addresses can be e-mails, everything else the other kinds."""
    return (F.col(shape) == "mail") == (F.col(kind) == "email")


def bootstrap(seeds: DataFrame, loose: DataFrame, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """kind, pattern and value of the open instances that the scored graph accepts.

    What is accepted joins the seeds: its other contexts may make new patterns, and the graph is scored again until nothing
    is added. Edges are distinct before anything is joined, patterns without enough different seeds go first, and the seeds
    of a pattern are one number, so the rounds run over the open edges alone.
    """
    seed_edges = staged(seeds.select("kind", "pattern", F.xxhash64("value").alias("instance")).distinct(), "pii-seeds")
    open_edges = staged(loose.select(F.col("kind").alias("shape"), "pattern", "value").distinct(), "pii-open")
    accepted = None
    while True:
        known = seed_edges.groupBy("kind", "pattern").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= min_seeds)
        edges = open_edges.join(known, "pattern").filter(_fits("shape", "kind")).drop("shape")
        if accepted is not None:
            edges = edges.join(accepted, ["kind", "value"], "left_anti")
        state = staged(edges.withColumn("score", F.lit(0.0)), "pii-graph")
        for _ in range(rounds):
            sureness = state.groupBy("kind", "pattern").agg(((F.max("seeds") + F.sum("score")) / (F.max("seeds") + F.count("*") + 1)).alias("sureness"))
            weighed = state.drop("score", "sureness").join(sureness, ["kind", "pattern"])
            scores = weighed.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.least("sureness", F.lit(0.999999)))))).alias("score"))
            state = staged(weighed.join(scores, ["kind", "value"]), "pii-graph")
        new = staged(state.filter(F.col("score") >= sure).select("kind", "value").distinct(), "pii-accepted")
        accepted = new if accepted is None else accepted.unionByName(new)
        if new.isEmpty():
            return open_edges.join(known, "pattern").filter(_fits("shape", "kind")).join(accepted, ["kind", "value"]).select("kind", "pattern", "value")
        grown = open_edges.join(new, "value").filter(_fits("shape", "kind"))
        seed_edges = staged(seed_edges.unionByName(grown.select("kind", "pattern", F.xxhash64("value").alias("instance"))).distinct(), "pii-seeds")


def find(docs: DataFrame, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """doc_id, base and added: the spans of each document, in one scan of the texts plus joins of the spans found."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    rows = staged(with_spans(rows).drop("text"), "pii-spans")
    each = lambda name: contexts(rows.filter(F.size(name) > 0).select("row", F.explode(name).alias("s")).select("row", "s.*"))
    loose = each("loose")
    accepted = bootstrap(each("base"), loose, min_seeds, rounds, sure)
    added = (
        loose.drop("kind").join(accepted, ["pattern", "value"]).select("row", F.struct("kind", "start", "end", "value").alias("s")).distinct()
        .groupBy("row").agg(F.collect_list("s").alias("added"))
    )
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return rows.select("doc_id", "row", base.alias("base")).join(added, "row", "left").select(
        "doc_id", "base", F.coalesce("added", F.slice("base", 1, 0)).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined, by kind as listed, then start."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = find(docs)
    counts = [F.size(F.filter("base", _is_of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))

