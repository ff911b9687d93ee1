"""Queries over the test tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import ann, decontaminate, language_id, lexical_search, line_dedup, lm_score, merkle, near_dedup, secret_scan, sentencepiece_codec, token_count, url_filter, warc
from lodestack.llm.common import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = secret_scan.train(secret_scan.labelled_samples(docs))
    return secret_scan.digest(secret_scan.scan(docs, ratios))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 7) == 2)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.pages_of(warc.read(spark, path))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def crc_mod(c: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(n))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    said = docs.select("doc_id", held_out.alias("held_out"), model.predict(F.col("text")).alias("p"))
    return said.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A public vocabulary file; copied nowhere.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    vocabulary = sentencepiece_codec.load(model_file)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.withColumn("ids", sentencepiece_codec.encode(spark, F.col("text"), vocabulary))
    coded = coded.withColumn("decoded", sentencepiece_codec.decode(spark, F.col("ids"), vocabulary))
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece_codec.SPACE), F.lit(" "))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


def op11_token_count(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    return token_count.token_counts(_table(spark, sf_dir, "documents"), token_count.compile_tokenizer(tokenizer_file), limit=512)


#: The values of a leaf, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = merkle.leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF])
    claims = {"doc_id": F.col("doc_id"), "tampered": F.when(crc_mod("doc_id", 7) == 0, tampered)}
    made = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), merkle.leaf_of([F.col(c) for c in LEAF]), claims)
    said = merkle.verified(made, F.coalesce("tampered", "leaf")).select("doc_id", *merkle.digests(made), merkle.hexed(F.col("folded_root")).alias("folded_root"))
    return said.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_lm_score": op3_lm_score,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_ann": op6_ann,
    "op7_language_id": op7_language_id,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_token_count": op11_token_count,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
}


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"


#: CRC-32 of a decimal number, bit by bit; the constant is the reflected polynomial.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(p.doc_id as varchar), ''), lambda d: ascii(d)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"

_SORTED = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))

ORACLES: dict[str, str] = {
    "op1_url_filter": f"""
with p as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path
  from pages)
select page_id, host, path,
  case {' '.join(f"when {_fits(h, p)} then '{h}{p}'" for h, p, _ in _SORTED)} end as rule,
  case {' '.join(f"when {_fits(h, p)} then '{v}'" for h, p, v in _SORTED)} else 'allow' end as verdict
from p""",
    "op4_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct size from iw),
dw as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
hits as (select doc_id, i, size, item from dw join iw using (size, win)),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
who as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover using (doc_id) left join who using (doc_id)""",
    "op5_warc": """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select *, max(page_id) over (partition by payload_digest) as origin from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id is distinct from origin then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from origin then origin end as refers_to
from g""",
    "op8_minhash_near_dedup": r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n group by all),
l as (select x, y from p where 100 * c >= 80 * (nx + ny - c)),
links as (select x, y from l union all select y, x from l),
r(x, y) as (select doc_id, doc_id from documents union select r.x, links.y from r join links on r.y = links.x)
select doc_id, cast(len(s) as bigint) as n_shingles, c.component_id, doc_id = c.component_id as kept
from s join (select x, min(y) as component_id from r group by x) c on s.doc_id = c.x""",
    "op12_merkle_manifest": f"""
with recursive d as (select doc_id, lang, {_LEAF.format(n='n_chars')} as leaf, {_LEAF.format(n='n_chars + 1')} as other from documents),
p as (select *, row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as size from d),
w(lang, lvl, pos, size, h) as (
  select lang, 0, pos, size, leaf from p
  union all select lang, lvl + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' order by pos)) from w where size > 1 group by lang, lvl, pos // 2, (size + 1) // 2),
s as (select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as size from w where size = 1),
t(lvl, pos, size, h) as (
  select 0, pos, size, h from s
  union all select lvl + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' order by pos)) from t where size > 1 group by lvl, pos // 2, (size + 1) // 2),
steps as (
  select p.doc_id, 0 as part, w.lvl, x.h, (p.pos >> w.lvl) % 2 as side from p join w on w.lang is not distinct from p.lang and w.pos = p.pos >> w.lvl and w.size > 1
    left join w x on x.lang is not distinct from p.lang and x.lvl = w.lvl and x.pos = xor(w.pos, 1)
  union all
  select p.doc_id, 1, t.lvl, x.h, (s.pos >> t.lvl) % 2 from p join s on s.lang is not distinct from p.lang join t on t.pos = s.pos >> t.lvl and t.size > 1
    left join t x on x.lvl = t.lvl and x.pos = xor(t.pos, 1)),
proof as (select doc_id, list({{'h': coalesce(h, ''), 'side': side}} order by part, lvl) as steps from steps group by doc_id),
f as (
  select p.doc_id, leaf, s.h as subroot, (select h from t where size = 1) as root, coalesce(steps, []) as steps,
    case when {_CRC} % 7 = 0 then coalesce(other, leaf) else leaf end as claim
  from p join s on s.lang is not distinct from p.lang left join proof using (doc_id)),
g as (select *, list_reduce(list_concat([claim], list_transform(steps, lambda x: x.side || x.h)), lambda a, x: sha256(case when x[1] = '1' then x[2:] || a else a || x[2:] end)) as folded_root from f)
select doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(steps, lambda x: x.h), 'string_agg', ''), '')) as proof_sha256, folded_root, folded_root = root as verified
from g""",
    "op13_lexical_search": r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
p as (select doc_id, term, count(*) as tf from t group by all),
n as (select doc_id, sum(tf)::bigint as n from p group by all),
s as (select count(*) as docs, sum(n)::bigint as words from n),
m as (select doc_id, 50 + (50 * n * docs) // words as m from n, s),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from p group by all), s),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from i join p using (term) join w using (term) join m using (doc_id) group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from r where score > 0
qualify rank <= 50""",
}
