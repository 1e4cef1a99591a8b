"""The registered ``opN_*`` queries: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import bpe, fst, hamming, jaccard, langid, lines, lm, media, packing, toxicity
from tracemill.llm.common import held_out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), width=4, percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(documents(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(documents(spark, sf_dir).withColumn("held", held_out("doc_id", 7, 2)), "held")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.fit(docs.where(~held_out("doc_id", 3, 1)), labels.where(~held_out("doc_id", 3, 1)))
    found = toxicity.score_toxicity(docs, net)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies (five words, similarity 0.8) are one duplicate cluster."""
    return packing.pack(jaccard.near_clusters(documents(spark, sf_dir)), cluster="cluster", words="words")


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(rows, rows.where("vec_id % 100 = 0"), k=10, row_id="vec_id", query_id="vec_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    found = langid.predict_language(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return fst.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    found = {f.__name__: f for f in (op1_ngram_jaccard, op2_line_dedup, op3_lm_scoring, op4_toxicity, op5_best_fit_packing, op6_hamming_top_k, op7_language_id, op8_byte_bpe, op9_matroska, op10_token_counts)}
    return found


#: Oracles by query; an operator that SQL cannot express is tested against
#: brute force, an exact round trip or held-out accuracy in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), shingles as (
  select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end as s
  from words
), sizes as (
  select doc_id, cast(len(s) as bigint) as n from shingles
), flat as (
  select doc_id, unnest(s) as g from shingles
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), edges as (
  select a, b from links union select b, a from links
), reach(id, other) as (
  select doc_id, doc_id from sizes union select r.id, e.b from reach r join edges e on e.a = r.other
)
select s.doc_id, s.n as n_shingles, min(r.other) as component_id from sizes s join reach r on r.id = s.doc_id group by all
""",
    "op2_line_dedup": r"""
with recursive parts as (
  select doc_id, string_split(text, chr(10)) as parts from documents where text is not null
), lines as (
  select doc_id, unnest(parts) as line, unnest(range(len(parts))) as line_no from parts
), distinct_lines as (
  select line, min({'d': doc_id, 'n': line_no}) as first, length(line) as size from lines where regexp_matches(line, '[^ \t\x0B\f\r]') group by line
), numbered as (
  select *, row_number() over (order by line) as id from distinct_lines
), links as (
  select a.id as a, b.id as b from numbered a join numbered b on a.size >= 32 and b.size between a.size and a.size + 2 and a.id <> b.id
  where (contains(b.line, left(a.line, a.size // 3)) or contains(b.line, substr(a.line, a.size // 3 + 1, a.size // 3))
         or contains(b.line, substr(a.line, 2 * (a.size // 3) + 1)))
    and levenshtein(a.line, b.line) <= 2
), edges as (
  select a, b from links union select b, a from links
), reach(id, other) as (
  select id, id from numbered union select r.id, e.b from reach r join edges e on e.a = r.other
), heads as (
  select n.line, min(o.first) as head from numbered n join reach r on r.id = n.id join numbered o on o.id = r.other group by n.line
), dropped as (
  select distinct l.doc_id, l.line_no from lines l join heads h using (line) where {'d': l.doc_id, 'n': l.line_no} <> h.head
), lists as (
  select doc_id, list_sort(list(cast(line_no as int))) as dropped from dropped group by doc_id
)
select d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) as int) as n_lines,
       cast(coalesce(len(l.dropped), 0) as int) as n_dropped, coalesce(l.dropped, []::int[]) as dropped
from documents d left join lists l using (doc_id)
""",
    "op6_hamming_top_k": """
with codes as (
  select vec_id, array_to_string(list_transform(embedding[1:64], lambda x: case when x > 0 then '1' else '0' end), '')::bit as code
  from embeddings where embedding is not null
), pairs as (
  select q.vec_id as query_id, r.vec_id as id, cast(bit_count(xor(q.code, r.code)) as int) as distance
  from codes q, codes r where q.vec_id % 100 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by distance, id) as rank from pairs
)
select query_id, cast(rank as int) as rank, id, distance from ranked where rank <= 10
""",
}
