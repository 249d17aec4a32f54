"""The registered queries of the operators: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake.llm import alignment, chat, language, media, mixing, simhash, suffix, tokencount, topk, toxicity, trie, urls
from evlake.llm.common import bounded_batches, held_out_rows
from evlake.llm.packing import pack
from evlake.llm.trie_sql import TRIE_SQL
from evlake.plans.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return table(spark, sf_dir, "documents")


def tokenizer_path() -> str:
    """The public byte-level vocabulary; the package stands on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 ids by minimum bin slack."""
    return pack(documents(spark, sf_dir), tokenizer_path())


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; rows whose crc32 modulo 4 is 2 are held out."""
    docs = documents(spark, sf_dir)
    held_out = held_out_rows(F.col("doc_id"), 4, 2)
    model = language.fit(docs, F.col("doc_id").isNotNull() & ~held_out)
    return language.predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHash of four-word shingles differs in at most four bits."""
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op8_suffix")
def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the bytes under repeated strings of 200 bytes."""
    return suffix.repeated_bytes(documents(spark, sf_dir))


OP9_SQL = r"""
with docs as (
    select doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
           substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 16) as k
    from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from docs group by source),
weighed as (
    select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, encode(source)) - 1) % 3) + 1]::double as w,
           source_size * 2.0::double as cap
    from sizes),
ordered as (
    select *, sum(source_size) over () * 1.5::double as pool, sum(w) over () as total_w,
           coalesce(sum(cap) over before, 0) as caps, coalesce(sum(w) over before, 0) as ws
    from weighed
    window before as (order by cap / w, source is null, encode(source)
                      rows between unbounded preceding and 1 preceding)),
capped as (select *, (pool - caps) * w >= cap * (total_w - ws) as full_ from ordered),
goals as (
    select source, source_size,
           case when full_ then cap else least(
               (pool - sum(case when full_ then cap else 0 end) over ())
               / nullif(total_w - sum(case when full_ then w else 0 end) over (), 0) * w, cap) end as target
    from capped),
budgets as (
    select *, coalesce(floor(target)::bigint // nullif(source_size, 0), 0) as epochs,
           floor(target)::bigint - coalesce(floor(target)::bigint // nullif(source_size, 0), 0) * source_size as rest
    from goals),
placed as (
    select *, coalesce(sum(size) over (partition by source order by k, doc_id
                       rows between unbounded preceding and 1 preceding), 0)::bigint as before_
    from docs)
select doc_id, p.source, size, source_size, target,
       cast(epochs * size + greatest(least(rest - before_, size), 0) as bigint) as taken
from placed p join budgets b on p.source is not distinct from b.source
"""


@query("op9_mixing", OP9_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix by source weights takes of every document."""
    return mixing.mix(documents(spark, sf_dir))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document; rows whose crc32 modulo 5 is 0 are held out."""
    docs = documents(spark, sf_dir)
    held_out = held_out_rows(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op6_media")
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as telephony audio, read back and resampled."""
    return media.text_media(documents(spark, sf_dir))


RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

OP10_SQL = r"""
with urls as (
    select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (
    select page_id,
           coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), '') as host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
    from urls),
rules(h, p, v) as (
    values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
    select page_id, h || p as rule, v,
           row_number() over (partition by page_id order by length(h || p) desc, h || p) as place
    from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select parts.page_id, host, path, rule, coalesce(v, 'allow') as verdict
from parts left join fits on parts.page_id = fits.page_id and place = 1
"""


@query("op10_urls", OP10_SQL)
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules, told by a cascade of Bloom filters."""
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


OP5_SQL = """
with rows_ as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
    from rows_ q join rows_ c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank
    from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


@query("op5_topk", OP5_SQL)
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector with all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op4_chat")
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with repaired roles, rendered."""
    return chat.formatted(table(spark, sf_dir, "conversations"))


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document by the piece-wise model; above 4096 is over the limit."""
    return tokencount.count_tokens(documents(spark, sf_dir), piece_model_path())


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations as a node, with its subtree's figures."""
    return trie.prefix_trie(trie.rebuilt(trie.turn_rows(table(spark, sf_dir, "conversations"))))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document, with their corpus-wide counts."""
    return alignment.align(documents(spark, sf_dir), tokenizer_path(), piece_model_path())
