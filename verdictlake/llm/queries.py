"""The opN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import doc_fingerprint, exact_dedup, hard_negatives, langid, license_scan, mixing, packing, pii, prefix_trie, simhash_dedup, suffix_dedup, super_kmer_dedup, toxicity
from .common import load


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_classes(load(spark, sf_dir, "documents")).drop("fp")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(load(spark, sf_dir, "documents"), passages=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    tokens = (F.size("offsets") / 2).cast("int")
    spans = F.transform(F.sequence(F.lit(1), tokens), lambda i: F.concat_ws("-", F.get("offsets", 2 * i - 2).cast("string"), F.get("offsets", 2 * i - 1).cast("string")))
    spans = F.when(tokens > 0, F.array_join(spans, ",")).otherwise("")
    return scored.select("doc_id", "held_out", "score", "predicted", tokens.alias("n_toxic_tokens"), spans.alias("toxic_spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op6_doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_fingerprint.fingerprint_pairs(load(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("found")


def op11_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmer_dedup.super_kmer_dedup(load(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_simhash_dedup,
        op3_suffix_dedup,
        op4_toxicity,
        op5_language_id,
        op6_doc_fingerprint,
        op7_license_scan,
        op8_source_mix,
        op9_packing,
        op10_pii,
        op11_super_kmer_dedup,
        op12_prefix_trie,
        op13_hard_negatives,
    )
}

def _license_sql() -> str:
    """Every block that starts at a word of the template: no other holds more of its words."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in license_scan.PHRASES.items())
    templates = ", ".join(f"('{label}', {quoted(dict.fromkeys(t.split()))})" for label, texts in license_scan.TEMPLATES.items() for t in texts)
    upper, lower = (f"'{''.join(map(chr, range(a, a + 26)))}'" for a in (65, 97))
    block = license_scan.BLOCK
    return f"""
        with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper}, {lower}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
        p as (select * from (values {phrases}) p(phrase, label)), t as (select * from (values {templates}) t(label, tokens)),
        place as (select doc_id, label, i from (select doc_id, w, unnest(range(len(w))) as i from w) w, p where w[i + 1 : i + len(phrase)] = phrase),
        base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_distinct(list(label)) as labels from place group by doc_id),
        spot as (select doc_id, label, tokens, word, i from (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from w) w, t where list_contains(tokens, word)),
        b as (select doc_id, label, tokens, count(distinct word) over (partition by doc_id, label, tokens order by i range between current row and {block - 1} following) as n from spot),
        hit as (select doc_id, label, n / len(tokens) as c from b where n >= {license_scan.THRESHOLD} * len(tokens) - 1e-9),
        more as (select doc_id, list_distinct(list(label)) as labels, max(c) as best from hit group by doc_id)
        select w.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
          coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') as labels,
          case when n_base > 0 then 1.0 else coalesce(best, 0.0) end::double as score
        from w left join base on base.doc_id = w.doc_id left join more on more.doc_id = w.doc_id
    """


#: CRC-32 of a text of ASCII, bit by bit; 3988292384 is its reversed polynomial.
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda x: ascii(x)::bigint)), "
    "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))))"
)

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as text from documents)
        select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
               doc_id = max(doc_id) over (partition by text) as kept, sha256(text) as text_sha256
        from d
    """,
    "op7_license_scan": _license_sql(),
    "op8_source_mix": f"""
        with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
            ('0x' || substr(md5(cast(doc_id as varchar)), 1, 12))::bigint as place from documents),
        s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as r from d group by source),
        c as (select *, {list(mixing.WEIGHTS)}[(r - 1) % {len(mixing.WEIGHTS)} + 1] as weight, {mixing.CAP} * source_size as cap from s),
        o as (select *, sum(source_size) over () as total, coalesce(sum(cap) over (order by cap / weight, r rows between unbounded preceding and 1 preceding), 0) as filled,
            sum(weight) over (order by cap / weight, r rows between current row and unbounded following) as unfilled from c),
        l as (select *, (total * {mixing.SHARE} - filled) / unfilled as level from o),
        k as (select min_by(level, cap / weight) as level from l where level <= cap / weight),
        t as (select source, source_size, r, least(cast(cap as double), coalesce(k.level * weight, cap)) as target from l left join k on true),
        a as (select d.*, coalesce(sum(size) over (partition by source order by place % greatest(64, (select count(*) from d) // {mixing.RANGE_ROWS}), place, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start from d)
        select doc_id, size, source_size, target, case when source_size = 0 then 0 else cast(size * (cast(round(target) as bigint) // source_size) + greatest(0, least(size, cast(round(target) as bigint) % source_size - start)) as bigint) end as taken
        from a join t on a.source is not distinct from t.source
    """,
    "op11_super_kmer_dedup": f"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
        p as (select doc_id, i, w[i + 1 : i + {super_kmer_dedup.WINDOW}] as k from (select doc_id, w, unnest(range(len(w) - {super_kmer_dedup.WINDOW - 1})) as i from w where len(w) >= {super_kmer_dedup.WINDOW})),
        f as (select k, min(doc_id) as earliest from p group by k),
        gone as (select distinct doc_id, i + j as i from p join f using (k), range({super_kmer_dedup.WINDOW}) as r(j) where earliest < doc_id),
        s as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from w),
        kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n from s anti join gone using (doc_id, i) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)
    """,
    "op12_prefix_trie": f"""
        with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, [coalesce(role, ''), coalesce(text, '')] as said from conversations where conv_id is not null),
        c as (select conv_id, conv_id - conv_id % {prefix_trie.BLOCK} as head, {_CRC32.format("cast(conv_id as varchar)")} % {prefix_trie.SHARES} as share from (select distinct conv_id from t)),
        b as (select c.conv_id, 0 as part, pos, said from c join t on t.conv_id = head and pos <= share union all select c.conv_id, 1, pos, said from c join t on t.conv_id = c.conv_id and pos > share),
        v as (select c.conv_id, coalesce(list(said order by part, pos) filter (said is not null), []) as turns from c left join b using (conv_id) group by all),
        e as (select conv_id, turns[1 : d] as path, d, len(turns) as len from (select *, unnest(range(len(turns) + 1)) as d from v)),
        n as (select path, d as depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (d = len), '')) as ends_sha256 from e group by path, d),
        k as (select path[1 : depth - 1] as path, count(*) as n from n where depth > 0 group by 1),
        m as (select n.*, coalesce(k.n, 0) as n_children, case when depth > 0 then (n_convs - 1) * length(n.path[depth][2]) else 0 end as saved from n left join k using (path)),
        s as (select a.path, sum((b.n_children = 0)::int) as n_leaves, sum(b.saved) as saved_tokens from m b, unnest(range(b.depth + 1)) as r(d) join m a on a.path = b.path[1 : r.d] group by a.path)
        select m.conv_id, m.depth, up.conv_id as parent_conv_id, m.n_convs, m.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, m.ends_sha256
        from m join s using (path) left join m up on m.depth > 0 and up.path = m.path[1 : m.depth - 1]
    """,
    "op13_hard_negatives": f"""
        with e as (select vec_id, case when vec_id % {hard_negatives.RELABELLED} = 0 then (label + 1) % {hard_negatives.CLASSES} else label end as label, list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::double)) as v
            from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, e.vec_id, a.label = e.label as same, cast(list_inner_product(a.v, e.v) as bigint) as score from e a join e on a.vec_id % {hard_negatives.ANCHORS} = 0 and a.vec_id <> e.vec_id),
        p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same),
        q as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
            from p join s on r <= {hard_negatives.POSITIVES} and s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
        select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from q where rank <= {hard_negatives.NEGATIVES}
    """,
}
