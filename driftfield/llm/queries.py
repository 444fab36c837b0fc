"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, fingerprints, lm, neardup, negatives, packing, quality, sharding, spelling, tokencount, toxicity, warc
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of documents. As the operator says of odd rows."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every query row of embeddings, against all rows. As the operator says of odd rows."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document. As the operator says of odd rows."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by a model fitted on labels. As the operator says of odd rows."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every piece of every document. As the operator says of odd rows."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, held out or not. As the operator says of odd rows."""
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. As the operator says of odd rows."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back. As the operator says of odd rows."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op9_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document. As the operator says of odd rows."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests. As the operator says of odd rows."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and near words of every word of documents. As the operator says of odd rows."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text. As the operator says of odd rows."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op13_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of embeddings and its positives. As the operator says of odd rows."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def _tree_sql(tree: sharding.Node, at: str) -> str:
    """The descent as nested CASEs: draws by the digest of a child's name and the key."""
    if not tree.children:
        return str(tree.shard)
    live = [c for c in tree.children if c.total > 0]
    if len(live) == 1:
        return _tree_sql(live[0], at)
    draws = ", ".join(f"{{'at': -ln((('0x' || substr(md5('{c.name}|' || k), 1, {sharding.DIGITS}))::bigint + 0.5::double) / {16**sharding.DIGITS}.0::double) / {float(c.total)!r}::double, 'child': {i}}}" for i, c in enumerate(live))
    picks = " ".join(f"when {i} then {_tree_sql(c, at)}" for i, c in enumerate(live))
    return f"case list_min([{draws}]).child {picks} end"


#: CRC-32 by table: the table from its rule, then one step a byte of the UTF-8 text.
_CRC_TABLE_SQL = "crc_table as (select list(v order by i) as tab from (select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as v from range(256) as r(i)))"


def _crc_sql(text: str) -> str:
    return f"xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])))"


_CRC_SQL = f"""{_CRC_TABLE_SQL},
texts as (select distinct text from documents),
crcs as (select text, {_crc_sql("coalesce(text, '')")} as text_crc32 from texts, crc_table)"""


def _op7_sql() -> str:
    shard, grown = (_tree_sql(sharding.layout(n), "k") for n in (40, 41))
    return f"""with {_CRC_SQL}, placed as (select doc_id, octet_length(encode(coalesce(d.text, '')))::bigint + 16 as size, c.text_crc32, coalesce(doc_id::varchar, 'null') as k, greatest(1, ceil((select count(*) from documents) / 4096.0)::bigint) as n from documents d left join crcs c on d.text is not distinct from c.text),
sharded as (select *, {shard} as shard, {grown} as grown_shard, ('0x' || substr(md5(concat_ws('|', doc_id, text_crc32, size)), 1, 8))::bigint % n as cell from placed)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by cell, doc_id, text_crc32, size) - 1 as slot, grown_shard from sharded"""


_OP8_SQL = f"""with p as (select page_id, url, coalesce(html, '') as h from pages), q as (select *, octet_length(encode(h))::bigint as payload_bytes, sha1(encode(h)) as payload_digest from p),
w as (select payload_digest, max(page_id) as first from q where payload_bytes >= {warc.REVISIT_BYTES} group by 1 having count(*) > 1),
r as (select q.*, case when w.first is not null and q.page_id is distinct from w.first then w.first end as refers_to from q left join w using (payload_digest))
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to, coalesce(nullif(url, ''), 'urn:page:' || page_id) as target_uri, case when refers_to is null then payload_bytes else 0 end as stored_bytes from r"""


_OP11_SQL = f"""with recursive {_CRC_TABLE_SQL},
found as (select coalesce(doc_id::varchar, 'null') as id, unnest(regexp_extract_all(text, '[{spelling.LETTERS}]{{{spelling.LEAST_LENGTH},}}')) as run from documents),
runs as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c from found group by all),
dealt as (select run, c, {_crc_sql("id || ':' || run")} as h from runs, crc_table),
words as (select case when h % {spelling.EVERY} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(c)::bigint as n from dealt group by 1),
w as (select word, n from words where length(word) >= {spelling.LEAST_LENGTH} and n >= {spelling.LEAST_COUNT}),
gaps as (select word, n, unnest(range(1, length(word) + 1)) as gap from w),
e as (select word, n, gap, substr(word, 1, gap::int - 1) || substr(word, gap::int + 1) as rest from gaps),
cut as (select distinct e.word as long, w.word as short from e join w on w.word = e.rest),
near as (select a.word, b.word as other from e a join e b on a.rest = b.rest and a.gap = b.gap and a.word <> b.word union all select long, short from cut union all select short, long from cut),
ranked as (select near.word, near.other, w.n as other_n, count(*) over (partition by near.word) as n_near, row_number() over (partition by near.word order by w.n desc, near.other) as r from near join w on w.word = near.other),
forms as (select w.word, w.n, coalesce(r.n_near, 0)::bigint as n_near, case when r.other_n >= {spelling.RATIO} * w.n then r.other end as form, case when r.other_n >= {spelling.RATIO} * w.n then r.other_n end as form_n from w left join ranked r on r.word = w.word and r.r = 1),
way as (select word, word as at from forms union all select way.word, forms.form from way join forms on forms.word = way.at where forms.form is not null)
select f.word, f.form, way.at as root, f.n, f.n_near, f.form_n from forms f join way on way.word = f.word join forms l on l.word = way.at and l.form is null"""


_OP13_SQL = f"""with r as (select row_number() over () as rid, vec_id, case when vec_id % {negatives.MOVED} = 0 then (label + 1) % {negatives.LABELS} else label end as label, list_transform(embedding, lambda x: floor({negatives.SCALE} * x::double)) as v
from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.rid as anchor, a.vec_id as anchor_id, b.rid as other, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from r a join r b on a.rid <> b.rid where a.vec_id % {negatives.ANCHORS} = 0),
p as (select * from (select *, row_number() over (partition by anchor order by score desc, other_id, other) as k from s where same) where k <= {negatives.POSITIVES}),
n as (select p.anchor_id, p.other_id as positive_id, p.score as positive_score, s.other_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor, p.other order by s.score desc, s.other_id, s.other) as rank
from p join s on s.anchor = p.anchor and not s.same where {negatives.LOW} * p.score <= 100 * s.score and 100 * s.score <= {negatives.HIGH} * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= {negatives.NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the other operators are tested by brute force."""
    return {"op7_hash_tree_shards": _op7_sql(), "op8_dictionary_warc": _OP8_SQL, "op11_spelling_variants": _OP11_SQL, "op13_voronoi_negatives": _OP13_SQL}
