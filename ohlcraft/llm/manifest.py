"""Merkle manifest of a dataset: a tree of digests per language, one over the languages, and a proof of every row.

Rows are numbered by a range sort, cut into aligned blocks of ``FAN ** LEVELS`` nodes, and each block keeps every level as
one string of hexadecimal digests. Parents are digests of fixed-width substrings of that string; the substrings beside a
node in its run are its sibling segments. The roots of the blocks are the nodes of the next round, until one is left. The
same rounds join the roots of the languages. On the way back each block hands its nodes the segments above them.

A row is hashed once, its digest moves in the sort and once more into its block; no task holds more than one block of a
language, however many rows the language has. Rounds follow the logarithm (base ``FAN ** LEVELS``) of the row count.

Nulls: a null field is hashed as ``-``. Rows without language form a group of their own, before all others. Rows without
doc_id come first in their language and are never tampered with. Rows of one doc_id are ordered by their digest; repeated
rows are leaves of their own and have different proofs. A very long text is hashed whole. Only the five columns named in
``FIELDS`` are read, so that other columns can have any name. An empty table gives an empty result and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
LEVELS = 3
BLOCK = FAN**LEVELS
#: Hexadecimal digits of a digest, and of a full run.
DIGEST = 64
RUN = FAN * DIGEST
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEGMENT = "struct<left:string,right:string>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(**fields: Column) -> Column:
    """Digest of the fields, each with its length in front."""

    def framed(x: Column) -> Column:
        text = x.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(F.concat(*[framed(x) for x in fields.values()]))


def tampered(text: Column) -> Column:
    """What the check of the manifest does to a text: capital letters A to Z become small."""
    return F.translate(text, UPPER, LOWER)


def leaves(docs: DataFrame) -> DataFrame:
    """Language key, doc_id, digest of each row, and the digest after tampering (null where the row is left alone)."""
    fields = {c: F.col(c) for c in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select(
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf(**fields).alias("digest"), F.when(touched, leaf(**{**fields, "text": tampered(F.col("text"))})).alias("changed"))


def _levels(n: Column) -> Column:
    """Levels that a block of a tree of ``n`` nodes goes up: to the top if it is the only block, else all."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(n <= FAN**k, F.lit(k)).otherwise(out)
    return out


def _parents(level: Column) -> Column:
    """The next level: digests of the level's runs, in one string."""
    runs = F.sequence(F.lit(0), F.expr("0") + F.floor((F.octet_length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda r: digest(F.substring(level.cast("binary"), r * RUN + 1, F.lit(RUN)))), "")


def blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Blocks of numbered nodes (key, n, idx, digest): their members, the string of each level, and their root."""
    packed = nodes.groupBy("key", "n", F.floor(F.col("idx") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "digest", *more))).alias("members"))
    out = packed.withColumn("levels", _levels(F.col("n"))).withColumn("level_0", F.array_join(F.col("members.digest"), ""))
    for k in range(LEVELS):
        out = out.withColumn(f"level_{k + 1}", F.when(F.col("levels") > k, _parents(F.col(f"level_{k}"))))
    return out.withColumn("root", F.coalesce(*[F.col(f"level_{k}") for k in reversed(range(LEVELS + 1))]))


def _segments(place: Column) -> Column:
    """Sibling segments of the node at a place of its block, from the lowest level up."""
    found = []
    for k in range(LEVELS):
        node = F.floor(place / FAN**k).cast("int")
        run = F.substring(F.col(f"level_{k}").cast("binary"), F.floor(node / FAN).cast("int") * RUN + 1, F.lit(RUN)).cast("string")
        at = (node % FAN) * DIGEST
        found.append(F.when(F.col("levels") > k, F.struct(F.substring(run, F.lit(1), at).alias("left"), F.substring(run, at + DIGEST + 1, F.lit(RUN)).alias("right"))))
    return F.array_compact(F.array(*found))


def tree(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all rounds, the lowest first, and the root of each key."""
    size = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [staged(blocks(nodes, *more), "manifest-blocks")]
    while size > BLOCK:
        size = -(-size // BLOCK)
        up = rounds[-1].select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("idx"), F.col("root").alias("digest"))
        rounds.append(staged(blocks(up), "manifest-blocks"))
    return rounds, rounds[-1].select("key", F.col("root").alias("digest"))


def _down(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Blocks of the lowest round with ``above``, the segments over their roots; ``top`` has them for the root of each key."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for blocks_of in reversed(rounds[1:]):
        children = F.transform("members", lambda m: F.struct(
            m["idx"].alias("block"), F.concat(_segments(F.floor(m["idx"] % BLOCK)), F.col("above")).alias("above")))
        carried = [c for c in above.columns if c not in ("key", "block", "above")]
        above = blocks_of.join(above, ["key", "block"]).select("key", *carried, F.inline(children))
    return rounds[0].join(above, ["key", "block"])


def folded(node: Column, path: Column) -> Column:
    """The root that a digest and its sibling segments give."""
    return F.aggregate(path, node, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, language root, root, digest of the proof, and the root folded from the (tampered) leaf, of every row."""
    rows = ranked(staged(leaves(docs), "manifest-leaves"), ["key"], ["doc_id", "digest"], "idx", "n")
    lower, subroots = tree(rows, "doc_id", "changed")
    upper, roots = tree(ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "digest"), [], ["lang_key"], "idx", "n"), "lang_key")
    root = roots.first()
    whole = _down(upper, roots.select("key", F.expr(f"cast(array() as array<{SEGMENT}>)").alias("above")))
    tops = whole.select(F.inline(F.transform("members", lambda m: F.struct(
        m["lang_key"].alias("key"), m["digest"].alias("subroot"), F.concat(_segments(F.floor(m["idx"] % BLOCK)), F.col("above")).alias("above")))))

    def row(m: Column) -> Column:
        path = F.concat(_segments(F.floor(m["idx"] % BLOCK)), F.col("above"))
        return F.element_at(F.transform(F.array(path), lambda p: F.struct(
            m["doc_id"].alias("doc_id"), m["digest"].alias("leaf"),
            digest(F.array_join(F.transform(p, lambda s: F.concat(s["left"], s["right"])), "")).alias("proof_sha256"),
            folded(F.coalesce(m["changed"], m["digest"]), p).alias("folded_root"))), 1)

    out = _down(lower, tops).select("subroot", F.inline(F.transform("members", row)))
    return out.withColumn("root", F.lit(root and root.digest).cast("string")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
