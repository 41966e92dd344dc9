"""Queries of the training-text operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, manifest, minhash, mixing, pii, quality, repeats, resampling, sharding, token_counts, token_files, toxicity, vectors
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("op2_virtual_slots")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op4_decontamination", r"""
with d as (
    select doc_id, row_number() over () as row_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
b as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark),
win as (
    select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as phrase
    from b, unnest(range(1, greatest(2, len(w) - 8))) as t(i) where len(w) > 0),
lengths as (select distinct n from win),
grams as (
    select row_id, n, i, array_to_string(w[i : i + n - 1], ' ') as phrase
    from d, lengths, unnest(range(1, len(w) - n + 2)) as t(i) where len(w) >= n),
hits as (select g.row_id, g.i, g.n, win.item_id from grams g join win on win.n = g.n and win.phrase = g.phrase),
hit_words as (select row_id, count(distinct i + k) as n_hit from hits, unnest(range(0, n)) as t(k) group by row_id),
found as (select row_id, count(distinct cast(item_id as varchar)) as n_items, list_sort(list(distinct cast(item_id as varchar))) as ids from hits group by row_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (row_id) left join found using (row_id)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_pivotal_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op3_simple8b_tokens")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


@query("op7_transducer_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op6_cap_filters", """
with recursive v as (
    select vec_id, cast(embedding as double[]) as e from embeddings
    where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as a, vec_id as b from v union select reach.a, links.b from reach join links on reach.b = links.a),
roots as (select a as vec_id, min(b) as root from reach group by a),
counts as (select a as vec_id, count(*) as n from links group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(root, vec_id) as component_id, vec_id = coalesce(root, vec_id) as kept
from embeddings left join counts using (vec_id) left join roots using (vec_id)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_weighted_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


@query("op5_repeated_phrases", r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, doc_id, i, array_to_string(w[i : i + 49], ' ') as k from d, unnest(range(1, len(w) - 48)) as t(i) where len(w) >= 50),
firsts as (select k, min(doc_id) as f from win group by k),
gone as (select distinct r, i + j as p from win join firsts using (k), unnest(range(0, 50)) as u(j) where f < doc_id),
words as (select r, unnest(w) as x, generate_subscripts(w, 1) as p from d),
kept as (select r, string_agg(x, ' ' order by p) as t, count(*) as n from words anti join gone using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(table(spark, sf_dir, "documents"))


#: CRC-32 of a text in SQL: the table of the reflected polynomial, then one step per byte.
CRC_TABLE = """
crc_table as (select list(c order by b) as steps from (
    select b, list_reduce(range(0, 8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b) as c from unnest(range(0, 256)) as t(b)))"""


def crc32_sql(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast('0x' || x as bigint))"
    return f"xor(list_reduce({codes}, lambda c, x: xor(c // 256, steps[xor(c, x) % 256 + 1]), 4294967295), 4294967295)"


@query("op11_crc_resampling", r"""
with """ + CRC_TABLE + r""",
d as (select row_number() over () as r, doc_id, text from documents),
texts as (select r, text, 'd' as side from d union all select -1, text, 'b' from benchmark),
words as (
    select r, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from texts),
features as (
    select r, side, array_to_string(w[i : i + n - 1], ' ') as f
    from words, unnest([1, 2, 3]) as g(n), unnest(range(1, len(w) - n + 2)) as t(i) where len(w) >= n),
counted as (select r, side, f, count(*) as k from features group by all),
names as (select f, cast(""" + crc32_sql("f") + r""" % 10000 as bigint) as bucket from (select distinct f from counted), crc_table),
sides as (
    select bucket, coalesce(sum(k) filter (side = 'd'), 0) as s, coalesce(sum(k) filter (side = 'b'), 0) as t from counted join names using (f) group by bucket),
whole as (select coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from sides),
gains as (
    select bucket, cast(floor(1000 * ln((sides.t + 1)::double * (whole.s + 10000)::double / ((sides.s + 1)::double * (whole.t + 10000)::double))) as bigint) as gain
    from sides, whole),
weights as (select r, sum(k) as n, sum(k * gain) as weight from counted join names using (f) join gains using (bucket) where side = 'd' group by r),
scored as (
    select r, doc_id, cast(coalesce(n, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight, len(w) >= 20 as long_enough,
        cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || sha256('42:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
    from d left join weights using (r) join (select r, w from words where side = 'd') using (r)),
placed as (select *, row_number() over (order by not long_enough, score desc, doc_id nulls first, n_features) as place, count(*) filter (long_enough) over () as n from scored)
select doc_id, n_features, weight, score, case when long_enough and place <= 5 * n // 100 then place end as rank from placed
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _rule_sql(rule: quality.Rule) -> str:
    bounds = [f"{rule.part} / {rule.whole} {sign} {bound}" for sign, bound in ((">=", rule.low), ("<=", rule.high)) if bound is not None]
    return f"case when {rule.whole} > 0 and not ({' and '.join(bounds)}) then '{rule.name}' end"


@query("op12_threshold_rules", r"""
with d as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from documents),
win as (select r, i, array_to_string(w[i : i + 4], ' ') as k from d, unnest(range(1, len(w) - 3)) as t(i) where len(w) >= 5),
twice as (select r, i from (select r, i, count(*) over (partition by r, k) as n from win) where n > 1),
covered as (select r, count(distinct i + j) as n from twice, unnest(range(0, 5)) as u(j) group by r),
measures as (
    select doc_id, cast(len(w) as bigint) as n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, cast(len(lines) as bigint) as n_lines,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
        cast(len(list_filter(w, lambda x: list_contains(""" + str(quality.STOP_WORDS) + r""", lower(trim(x, '""" + quality.EDGES.replace("'", "''") + r"""'))))) as bigint) as n_stop_words,
        cast(len(list_filter(lines, lambda x: ltrim(x, ' ')[1] in ('-', '*', '•', '·'))) as bigint) as n_bullet_lines,
        cast(len(list_filter(lines, lambda x: ends_with(rtrim(x, ' '), '...') or ends_with(rtrim(x, ' '), '…'))) as bigint) as n_ellipsis_lines
    from d left join covered using (r)),
judged as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        array_to_string(list_filter([""" + ", ".join(_rule_sql(r) for r in quality.RULES) + r"""], lambda x: x is not null), ',') as broken
    from measures)
select *, not base_failed and broken = '' as kept from judged
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def _framed_sql(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_framed_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str, first: str) -> str:
    """Nodes of all levels of the trees of ``first`` (key, i, h), and the siblings beside each node but the last."""
    return f"""
{name}_nodes(level, key, i, h) as (
    select 0, key, i, h from {first}
    union all
    select level + 1, key, i // 8, sha256(string_agg(h, '' order by i)) from (select *, count(*) over (partition by key) as n from {name}_nodes) where n > 1 group by level, key, i // 8),
{name}_beside as (
    select a.level, a.key, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as l, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as r
    from {name}_nodes a join {name}_nodes b on a.level = b.level and a.key = b.key and a.i // 8 = b.i // 8
    where a.level < (select max(level) from {name}_nodes c where c.key = a.key) group by all),
{name}_root as (select key, arg_max(h, level) as root from {name}_nodes group by key)"""


@query("op13_merkle_manifest", "with recursive" + CRC_TABLE + r""",
leaves as (
    select coalesce('=' || lang, '') as key, doc_id, """ + _leaf_sql("text") + r""" as h,
        case when """ + crc32_sql("cast(doc_id as varchar)") + r""" % 3 = 0 then """ + _leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + r""" end as changed
    from documents, crc_table),
numbered as (select *, row_number() over (partition by key order by doc_id nulls first, h) - 1 as i from leaves),
""" + _tree_sql("low", "numbered") + r""",
subroots as (select '' as key, row_number() over (order by key) - 1 as i, root as h, key as lang_key from low_root),
""" + _tree_sql("top", "subroots") + r""",
walk(key, i, place, level, node, proof, top) as (
    select key, i, i, 0, coalesce(changed, h), '', false from numbered
    union all
    select w.key, w.i, case when s.i is null then w.place // 8 else s.i end, case when s.i is null then w.level + 1 else 0 end,
        case when s.i is null then sha256(coalesce(b.l, t.l) || w.node || coalesce(b.r, t.r)) else w.node end,
        case when s.i is null then w.proof || coalesce(b.l, t.l) || coalesce(b.r, t.r) else w.proof end, w.top or s.i is not null
    from walk w
    left join low_beside b on not w.top and b.level = w.level and b.key = w.key and b.i = w.place
    left join subroots s on not w.top and b.i is null and s.lang_key = w.key
    left join top_beside t on w.top and t.level = w.level and t.i = w.place
    where b.i is not null or s.i is not null or t.i is not null),
ends as (select key, i, arg_max(node, level) as folded_root, arg_max(proof, level) as proof from walk where top group by key, i)
select doc_id, h as leaf, low_root.root as subroot, top_root.root as root, sha256(proof) as proof_sha256, folded_root, folded_root = top_root.root as verified
from numbered join ends using (key, i) join low_root using (key), top_root
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))
