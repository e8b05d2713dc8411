"""The queries of this subpackage, and their SQL: thin wrappers that derive the asked columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, lang_id, media, mixing, quality, simhash, token_counts, token_files, url_filters
from .common import shared_dir


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(key: str = "doc_id"):
    """Whether the CRC-32 of the id is 2 mod 4; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.tiktoken")
    back = bpe.encode_and_decode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern())
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text"), tokenizer("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, ratings(labels).filter(~held_out()), GRADES)
    out = quality.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "grade", F.round("expected_grade", 6).alias("expected_grade"), F.round(F.col("tails")[GRADES - 2], 6).alias("p_good"), (F.col("tails")[GRADES - 2] >= SELECT_AT).alias("selected"))


#: Grades: 0 toxic, 1 of low quality, 2 good. A text is selected if it is good with this probability or more.
GRADES = 3
SELECT_AT = 0.5


def ratings(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade")).filter("grade is not null")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = lang_id.train(docs.filter(~held_out()))
    out = lang_id.predict(docs.select("doc_id", "text"), trees, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length("raw").cast("long")
    padded = F.expr("concat(raw, unhex(repeat('00', cast(case when octet_length(raw) = 0 then 64 else pmod(-octet_length(raw), 64) end as int))))")
    payloads = documents(spark, sf_dir).select("doc_id", raw.alias("raw")).select("doc_id", size.alias("n_bytes"), padded.alias("payload"))
    found = media.store_and_read(payloads)
    sizes = [F.octet_length(c).cast("long").alias(f"{c}_bytes") for c in ("payload", "media")]
    return found.select("doc_id", "n_bytes", sizes[0], F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), sizes[1], F.sha2("media", 256).alias("media_sha256"), "feature", "frames", "duration_num", "duration_den", F.crc32(F.concat_ws(",", F.col("seek").cast("array<string>")).cast("binary")).alias("seek_crc32"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), folder, tokenizer("byte_bpe_50k.json"), pattern())
    found = token_files.read_token_files(spark, folder)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch date: 2024-01-01 and page_id mod 366 days."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))").alias("fetched"))


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts that occur, by fixed rules on the CRC-32 of a key.

    A host, its parent or a host's first path segment is blocked from a day of 2024 on if the CRC-32 is 0 mod 3; half of
    those are dropped 60 days later, and half of the dropped blocked again 60 days on; 1 mod 7 gives an allow entry.
    """
    keys = pages.select(F.explode(url_filters.keys_of(F.col("url"))).alias("key")).distinct().withColumn("h", F.crc32(F.col("key").cast("binary")))
    day = F.expr("date_add(date'2024-01-01', cast((h div 64) % 366 as int))")
    steps = F.filter(F.array(
        F.when(F.col("h") % 3 == 0, F.struct(F.lit("block").alias("action"), day.alias("since"))),
        F.when((F.col("h") % 3 == 0) & (F.col("h") % 2 == 0), F.struct(F.lit("drop").alias("action"), F.date_add(day, 60).alias("since"))),
        F.when((F.col("h") % 3 == 0) & (F.col("h") % 4 == 0), F.struct(F.lit("block").alias("action"), F.date_add(day, 120).alias("since"))),
        F.when(F.col("h") % 7 == 1, F.struct(F.lit("allow").alias("action"), F.date_add(day, 30).alias("since"))),
    ), lambda x: x.isNotNull())
    return keys.select("key", F.explode(steps).alias("e")).select("key", "e.action", "e.since")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters.filter_captures(captures(pages), url_list(pages))


OP1_SQL = r"""
with split as (
    select page_id, url, date '2024-01-01' + cast(page_id % 366 as int) as fetched,
        nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '\.$', ''), '') as host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) as segment
    from pages
), parents as (
    select *, list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) as hosts from split where host is not null
), keyed as (
    select page_id, url, fetched, unnest(case when length(segment) > 0 then list_concat(list_transform(hosts, lambda h: h || '/' || segment), hosts) else hosts end) as key from parents
), crc_table as (
    select n, c8 as c from (
        select n, case when c7 & 1 = 1 then xor(c7 >> 1, 3988292384) else c7 >> 1 end as c8 from (
        select n, case when c6 & 1 = 1 then xor(c6 >> 1, 3988292384) else c6 >> 1 end as c7 from (
        select n, case when c5 & 1 = 1 then xor(c5 >> 1, 3988292384) else c5 >> 1 end as c6 from (
        select n, case when c4 & 1 = 1 then xor(c4 >> 1, 3988292384) else c4 >> 1 end as c5 from (
        select n, case when c3 & 1 = 1 then xor(c3 >> 1, 3988292384) else c3 >> 1 end as c4 from (
        select n, case when c2 & 1 = 1 then xor(c2 >> 1, 3988292384) else c2 >> 1 end as c3 from (
        select n, case when c1 & 1 = 1 then xor(c1 >> 1, 3988292384) else c1 >> 1 end as c2 from (
        select n, case when n & 1 = 1 then xor(n >> 1, 3988292384) else n >> 1 end as c1 from (select unnest(range(0, 256))::bigint as n)))))))))
), tab as (
    select list(c order by n) as t from crc_table
), hashed as (
    select key, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(key) + 1), lambda i: ('0x' || hex(encode(key))[2 * i - 1:2 * i])::bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as h
    from (select distinct key from keyed), tab
), entries as (
    select key, 3 as rank, date '2024-01-01' + cast((h // 64) % 366 as int) as since from hashed where h % 3 = 0
    union all select key, 1, date '2024-01-01' + cast((h // 64) % 366 + 60 as int) from hashed where h % 3 = 0 and h % 2 = 0
    union all select key, 3, date '2024-01-01' + cast((h // 64) % 366 + 120 as int) from hashed where h % 3 = 0 and h % 4 = 0
    union all select key, 2, date '2024-01-01' + cast((h // 64) % 366 + 30 as int) from hashed where h % 7 = 1
), merged as (
    select key, since, max(rank) as rank from entries group by all
), spans as (
    select *, lead(since) over (partition by key order by since) as until from merged
), hits as (
    select k.page_id, k.url, max(struct_pack(size := length(s.key), entry := s.key, rank := s.rank, since := s.since)) as hit
    from keyed k join spans s on k.key = s.key and k.fetched >= s.since and (s.until is null or k.fetched < s.until) and s.rank > 1 group by all
)
select p.page_id, p.url, p.fetched, p.host, coalesce(hit.rank = 3, false) as blocked, hit.entry as list_key,
    case hit.rank when 3 then 'block' when 2 then 'allow' end as list_action, hit.since as list_since
from split p left join hits h on h.page_id = p.page_id and h.url = p.url
"""


def op4_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20)
    return ann.search(index, index.rows.filter("vec_id % 20 = 0"), k=20)


#: Production parameters of the mix: no source more than 4 times, entropy at 97 % of that of even weights.
MAX_REPEATS = 4.0
ENTROPY_SHARE = 0.97


def estimated_tokens():
    """Four bytes make about one token; every text has one at least."""
    return F.expr("octet_length(coalesce(text, '')) div 4 + 1")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", estimated_tokens().alias("tokens"))
    mixed = mixing.mix(rows, F.col("tokens"), max_repeats=MAX_REPEATS, target_entropy_share=ENTROPY_SHARE)
    return mixed.select("doc_id", "source", "tokens", F.round("mix_weight", 9).alias("weight"), F.col("mix_pass").alias("pass"), F.col("mix_block_rank").alias("block_rank"), F.col("mix_order").alias("position"))


OP9_SQL = """
with recursive tok as (
    select doc_id, source, coalesce(source, '') as s, strlen(coalesce(text, '')) // 4 + 1 as n, ('0x' || substr(md5('7:' || doc_id), 1, 8))::bigint % 1024 as b from documents
), tot as (
    select s, sum(n)::bigint as n from tok group by s having sum(n) > 0
), sh as (
    select list(n::double / (select sum(n)::double from tot) order by s) as p, max(n)::double / sum(n)::double as top, ln(count(*)) * 0.97 as target, sum(n)::double as whole from tot
), repeats as (
    select 0 as k, 0.0::double as lo, 1.0::double as hi, 0.0::double as x union all
    select k + 1, case when ok then lo else x end, case when ok then x else hi end, ((case when ok then lo else x end) + (case when ok then x else hi end)) / 2
    from (select *, list_max(list_transform(p, lambda q: pow(q / top, x) / list_sum(list_transform(p, lambda r: pow(r / top, x))) / q)) <= 4 as ok from repeats, sh where k <= 60)
), entropies as (
    select 0 as k, 0.0::double as lo, 64.0::double as hi, 0.0::double as x union all
    select k + 1, case when ok then lo else x end, case when ok then x else hi end, ((case when ok then lo else x end) + (case when ok then x else hi end)) / 2
    from (select *, -list_sum(list_transform(list_transform(p, lambda q: pow(q / top, x) / list_sum(list_transform(p, lambda r: pow(r / top, x)))), lambda w: w * ln(w))) <= target as ok from entropies, sh where k <= 60)
), a as (
    select greatest((select hi from repeats where k = 61), (select hi from entropies where k = 61)) as a
), plan as (
    select s, n as total, w, cast(floor(w * whole) as bigint) // n as full_passes, cast(floor(w * whole) as bigint) % n as rest
    from (select t.s, t.n, pow(t.n / whole / top, a) / list_sum(list_transform(p, lambda r: pow(r / top, a))) as w, whole from tot t, sh, a)
), blocks as (
    select s, b, sum(n)::bigint as n from tok group by all
), passes as (
    select s, b, n, w, full_passes, rest, unnest(range(0, full_passes + 1)) as pass from blocks join plan using (s)
), placed as (
    select *, row_number() over (partition by s, pass order by d, b) as block_rank, (sum(n) over (partition by s, pass order by d, b rows unbounded preceding) - n)::bigint as before
    from (select *, md5('7:' || pass || ':' || s || ':' || b) as d from passes)
), taken as (
    select *, pass = full_passes and before + n > rest as cut from placed where pass < full_passes or before < rest
), dealt as (
    select tok.doc_id, tok.source, tok.n as tokens, t.w, t.s, t.b, t.pass, t.block_rank, t.cut, t.rest - t.before as room, md5('7:' || t.pass || ':' || tok.doc_id) as position from tok join taken t using (s, b)
), fits as (
    select *, sum(tokens) over (partition by s, b, pass order by position range unbounded preceding) as upto from dealt
)
select doc_id, source, tokens, round(w, 9) as weight, cast(pass as int) as pass, cast(block_rank as int) as block_rank, position from fits where not cut or upto <= room
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_bpe, op3_token_counts, op4_additive_quantisation, op5_quality, op6_language, op7_mpeg, op8_token_files, op9_mixing, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op9_mixing": OP9_SQL}
