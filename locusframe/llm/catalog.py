"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.plans.session import scratch

from .common import given, held_out, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_OP7_SQL = r"""
with w as (
  select doc_id, string_split_regex(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') as ws from documents
), d as (select doc_id, case when ws = [''] then [] else ws end as ws from w
), s as (
  select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 19, 0))) as p from d
), h as (
  select doc_id, p, row_number() over (partition by sha256(array_to_string(ws[p:p + 19], ' ')) order by doc_id, p) as nth from s
), gone as (
  select distinct doc_id, unnest(generate_series(p, p + 19)) as i from h where nth > 1
), e as (select doc_id, ws[i] as word, i from (select doc_id, ws, unnest(generate_series(1, len(ws))) as i from d)
), k as (
  select e.doc_id, string_agg(e.word, ' ' order by e.i) as kept, count(*) as n from e anti join gone using (doc_id, i) group by 1
)
select d.doc_id, len(d.ws)::bigint as n_words, (len(d.ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k using (doc_id)
"""


@query("op7_substring_dedup", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removal of every repeated window of twenty words."""
    from .repeats import repeats

    found = repeats(table(spark, sf_dir, "documents"), window=20, kept=False)
    return found.select(given("id").alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


_OP8_SQL = r"""
with recursive w as (
  select doc_id, string_split_regex(
    trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '[\x20\x09-\x0D]+') as ws from documents
), d as (select doc_id, case when ws = [''] then [] else ws end as ws from w
), s as (
  select distinct doc_id, array_to_string(ws[p:p + 4], ' ') as g
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) as p from d)
), n as (select doc_id, count(*) as n from s group by 1
), pair as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), link as (
  select x, y from pair join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)
), reach as (
  select doc_id as x, doc_id as y from documents
  union
  select r.x, l.y from reach r join link l on r.y = l.x
), comp as (select x as doc_id, min(y) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from d join comp using (doc_id) left join n using (doc_id)
"""


@query("op8_minhash_near_dedup", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under links of a similarity of 0.85 or more."""
    from .near import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select(
        given("id").alias("doc_id"), "n_shingles", given("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept")
    )


_OP9_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = first_value(doc_id) over w as kept, text_sha256
from n window w as (partition by text_sha256 order by chars desc, doc_id)
"""


@query("op9_exact_dedup", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal without white space, and the one that stays."""
    from .tries import exact_duplicates

    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(given("id").alias("doc_id"), given("keep_id").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    import public_tokenizers

    from .packing import pack

    found = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return found.select(given("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from two thirds of the labelled ones."""
    from .language import learn

    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 3, 1)
    found = learn(docs, train=~held).predict(docs)
    return found.select(given("id").alias("doc_id"), held_out("id", 3, 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's byte-level token ids and of what they decode to."""
    import public_tokenizers

    from .bpe import encode

    found = encode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True
    )
    return found.select(
        given("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_OP3_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), b as (
  select page_id, strlen(html) as payload_bytes, min(page_id) over (partition by hex) as first,
    array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001',
      '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') as bits
  from p
)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::int
    + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int
    + substr(bits, 5 * i + 5, 1)::int, 1)), '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type, case when first < page_id then first end as refers_to
from b
"""


@query("op3_warc", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives with an index and read back."""
    from .warc import read_warc, write_warc

    folder = scratch(spark, "warc")
    index = write_warc(table(spark, sf_dir, "pages"), folder, least=0)
    found = read_warc(index, folder)
    return found.select(given("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", given("refers_to").alias("refers_to"))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL by the rule list, else by rules mined from the URLs it judges."""
    from .urls import judge

    found = judge(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select(given("id").alias("page_id"), "host", "path", "rule", "verdict", "mined_rule", "confidence")


@query("op2_lookup_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each document and its edited text, and their likeness by peeled differences."""
    from .lookup import fingerprints

    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        given("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query("op1_quality_ranking")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document, learned from four fifths of the labelled ones."""
    from .quality import rank

    found = rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~held_out("id", 5, 0))
    return found.select(
        given("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers over the same bytes, and how usual their links are."""
    import public_tokenizers as P

    from .align import align

    found = align(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))
    return found.select(given("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_OP13_SQL = r"""
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as n
  from conversations
), h as (
  select c, (crc % 4)::bigint as h, c - c % 20 as head from (
    select c, xor(4294967295::ubigint, list_reduce(
      list_prepend(4294967295::ubigint, list_transform(string_split(c::varchar, ''), lambda d: ascii(d)::ubigint)),
      lambda x, b: xor(x >> 8, list_reduce(list_prepend(xor(x & 255::ubigint, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
        lambda y, z: xor(y >> 1, 3988292384::ubigint * (y & 1::ubigint))))
    )) as crc from (select distinct c from t))
), r as (
  select h.c, t.n - 3 as n, t.role, t.text from h join t on t.c = h.head and t.n <= h.h
  union all select h.c, t.n, t.role, t.text from h join t on t.c = h.c and t.n > h.h
), p as (
  select c, row_number() over (partition by c order by n) as d, sha256(strlen(role) || ':' || role || text) as turn,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from r
), m as (
  select c, d, words, sha256(string_agg(turn, '') over (partition by c order by d)) as key from p
  union all select c, 0, 0, '' from h
), n as (select key, min(c) as c, max(d) as d, count(*) as n, max(words) as words from m group by key
), up as (select n.key, m.key as parent from n join m on m.c = n.c and m.d = n.d - 1
), kids as (select parent as key, count(*) as n from up group by 1
), sub as (
  select m.key, sum((k.key is null)::bigint) as leaves, sum((n.n - 1) * n.words) as tokens
  from n join m on m.c = n.c and m.d <= n.d left join kids k on k.key = n.key group by 1
), ends as (
  select key, sha256(string_agg(c::varchar, ',' order by c)) as sha from (select c, max(d) as d from m group by c) join m using (c, d) group by 1
)
select n.c as conv_id, n.d as depth, q.c as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) as n_children, leaves::bigint as n_leaves,
  tokens::bigint as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
from n join sub using (key) left join up using (key) left join n q on q.key = up.parent left join kids k on k.key = n.key left join ends e on e.key = n.key
"""


@query("op13_prefix_trie", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    from .prefixes import prefix_trie

    found = prefix_trie(table(spark, sf_dir, "conversations"), block=20, borrowed=3)
    return found.select(
        given("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), given("above").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )


_OP12_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n as (
  select *, row_number() over w - 1 as nth, role in ('system', 'user', 'assistant') as known,
    coalesce(last_value(case when role in ('system', 'user', 'assistant') then role end ignore nulls)
      over (partition by conv_id order by turn nulls first rows between unbounded preceding and 1 preceding), 'start') as state
  from t window w as (partition by conv_id order by turn nulls first)
), s as (
  select *, state || ' ' || role in ('start system', 'start user', 'system user', 'user assistant', 'assistant user') as ok,
    case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 19 + length(role) + marks(role) end + length(text) + marks(text) as chars
  from n
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by nth)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by nth) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars,
  min(nth) filter (not ok) as first_bad_turn, coalesce(arg_max(role, nth) filter (known), '') = 'assistant' as complete
from s group by conv_id
"""
for _text in ("role", "text"):
    _OP12_SQL = _OP12_SQL.replace(
        f"marks({_text})", f"len(regexp_extract_all({_text}, '<\\\\*(<SYS>>|</SYS>>|s>|/s>)|\\[\\\\*(INST\\]|/INST\\]|ROLE\\]|/ROLE\\]|TEXT\\])'))"
    )


@query("op12_chat_format", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one full of marks, formatted and read back."""
    from .chat import format_chats, read_chats

    mark = "</s>[INST] ok [/INST]"
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    convs = convs.unionByName(spark.createDataFrame([(-7, 0, "user", mark), (-7, 1, "assistant", mark)], convs.schema))
    found = read_chats(format_chats(convs))
    return found.withColumn("conv_id", given("conv")).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "first_bad_turn", "complete"
    )
