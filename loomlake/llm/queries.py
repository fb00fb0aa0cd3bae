"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, katz, near_dedup, packing, quality, run_index, secrets, sharding, spelling, token_counts, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file, the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_table(token_counts.lengths(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.digest(run_index.drop_repeats(table(spark, sf_dir, "documents")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("deviation_exact")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_decontamination, op3_token_counts, op4_katz, op5_sharding, op6_toxicity, op7_packing, op8_near_dedup, op9_quality, op10_exact_dedup, op11_run_index, op12_spelling, op13_whitening)}



def secrets_sql() -> str:
    """Brute force: positions by summing lengths, entropy by counting every window afresh."""
    assign, access, hexes = (
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "AKIA[A-Z0-9]+",
        "[0-9a-f]+",
    )
    patterns = [("assign", assign, 2, 12), ("access", access, 0, 18), ("hex", hexes, 0, 16)]
    patterns += [(k.name, k.pattern, 0, k.window) for k in secrets.CLASSES]
    each = " union all ".join(
        f"select doc_id, {no} as no, '{kind}' as kind, {least} as least, regexp_split_to_array(t, '{regex}') as pieces, regexp_extract_all(t, '{regex}', 0) as found, regexp_extract_all(t, '{regex}', {group}) as value from docs"
        for no, (kind, regex, group, least) in enumerate(patterns)
    )
    classes = ", ".join(f"({3 + n}, {k.window}, {k.limit})" for n, k in enumerate(secrets.CLASSES))
    allow = secrets.ALLOW
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
every as ({each}),
placed as (
    select doc_id, no, kind, least, value[i] as value, found[i] as found,
        list_sum(list_transform(pieces[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0) as start
    from (select *, unnest(range(1, len(found) + 1)) as i from every)),
base as (select doc_id, no, kind, cast(start as bigint) as start, cast(start + length(found) as bigint) as stop from placed where no < 3 and length(value) >= least),
classes(no, w, most) as (values {classes}),
windows as (
    select doc_id, no, kind, start, w, most, found, unnest(range(0, length(found) - w + 1)) as k
    from (select distinct * from placed) join classes using (no)),
allowed as (
    select doc_id, no, start, list_sum(list_transform(between[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0) as a, length(hits[i]) as len
    from (
        select doc_id, no, start, hits, regexp_split_to_array(found, '{allow}') as between, unnest(range(1, len(hits) + 1)) as i
        from (select distinct doc_id, no, start, found, regexp_extract_all(found, '{allow}') as hits from placed where no >= 3))),
free as (
    select * from windows as x where not exists (
        select 1 from allowed as y where y.doc_id = x.doc_id and y.no = x.no and y.start = x.start and k < a + len + w and k + w > a - w)),
counted as (
    select doc_id, no, kind, start, w, most, k, c, count(*) as n
    from (select *, unnest(string_split(substr(found, k + 1, w), '')) as c from free) group by all),
hot as (
    select doc_id, no, kind, start, w, k from counted group by all having sum(cast(round(n * log2(n) * {secrets.UNIT}) as bigint)) <= min(most)),
islands as (
    select *, sum(fresh) over (partition by doc_id, no, start order by k) as island
    from (select *, case when k <= lag(k) over (partition by doc_id, no, start order by k) + w then 0 else 1 end as fresh from hot)),
added as (
    select doc_id, no, kind, cast(start + min(k) as bigint) as start, cast(start + max(k) + w as bigint) as stop from islands group by doc_id, no, kind, w, start, island),
spans as (
    select doc_id, string_agg(kind || ':' || start || ':' || stop, ',' order by start, no) as spans
    from (select * from base union all select * from added) group by doc_id),
sums as (
    select doc_id, count(*) filter (no = 0) as n_assign, count(*) filter (no = 1) as n_access, count(*) filter (no = 2) as n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, no) as base
    from base group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join sums using (doc_id) left join spans using (doc_id)
"""


ORACLE_SQL = {
    "op1_secrets": secrets_sql(),
    "op2_decontamination": r"""
with word_lists as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
items as (
    select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark where item_id is not null),
patterns as (
    select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + 9], ' ') as pattern
    from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
starts as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as pattern
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
          from word_lists, (select distinct n from patterns))),
found as (select doc_id, i, n, item from starts join patterns using (n, pattern)),
hit as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(i, i + n)) as word from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from word_lists left join hit using (doc_id) left join named using (doc_id)
""",
    # All pairs that share a shingle, counted on full sets, and what can be reached along links.
    "op8_near_dedup": r"""
with recursive word_lists as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
sets as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from word_lists where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from sets a join sets b using (s) where a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
both_ways as (select x, y from links union all select y, x from links),
reached as (select x as doc_id, x as other from both_ways union select r.doc_id, y from reached r join both_ways on x = other)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(least(doc_id, component), doc_id) as component_id, doc_id <= coalesce(component, doc_id) as kept
from word_lists left join sizes using (doc_id) left join (select doc_id, min(other) as component from reached group by doc_id) using (doc_id)
""",
    "op10_exact_dedup": r"""
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
    doc_id = min(doc_id) over same as kept, sha256(content) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content from documents)
window same as (partition by content)
""",
}
