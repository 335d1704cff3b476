"""Queries of keyword search, vector search and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import fulltext, fusion, vectors
from tidemark.plans import tables
from tidemark.sources.shared import written

TERMS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
INDEX = f"""
toks as (select chunk_id, unnest({TERMS.format("text")}) as term from chunks where text <> ''),
postings as (select term, chunk_id, count(*) as tf from toks group by all),
lengths as (select chunk_id, len({TERMS.format("text")}) as len from chunks where text <> ''),
stats as (select count(*) as n_chunks, avg(len) as avglen from lengths)"""
ASKED = f"""
qtoks as (select item_id as query_id, unnest({TERMS.format("text")}) as term from benchmark),
asked as (select query_id, term, count(*) as times from qtoks group by all)"""
BM25 = f"""{INDEX},{ASKED},
df as (select term, count(*) as n from postings group by term),
scored as (
  select query_id, chunk_id, round(sum(times * greatest(ln((n_chunks - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 6) as score
  from postings join asked using (term) join df using (term) join lengths using (chunk_id) cross join stats group by all),
keyword as (
  select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from scored)
  where rank < {{k}})"""
KEYWORD, WIDER = BM25.replace("{k}", "20"), BM25.replace("{k}", "60")
COSINE = "round(list_dot_product(q.embedding::double[], e.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]) * list_dot_product(e.embedding::double[], e.embedding::double[])), 6)"
VECTOR = f"""
vec as (
  select * from (
    select item_id as query_id, e.vec_id as chunk_id, {COSINE} as score,
           row_number() over (partition by item_id order by {COSINE} desc, e.vec_id) - 1 as rank
    from benchmark b join embeddings q on q.vec_id = b.item_id cross join embeddings e {{where}})
  where rank < 20)"""
ROUTED = """
signals as (
  select item_id as query_id, text as question,
         regexp_matches(text, '"[^"]+"')::int + regexp_matches(text, '(^|[^\\p{L}\\p{N}_])\\d{4}[-/]\\d{1,2}')::int
         + regexp_matches(text, '\\.[\\p{L}\\p{N}_]{2,4}([^\\p{L}\\p{N}_]|$)')::int + regexp_matches(text, '[A-Z]{2,}\\d+')::int as n
  from benchmark),
routed as (
  select query_id, question, n,
         case when n >= 2 then 2.0 when length(question) > 20 and n = 0 then 0.5 else 1.0 end::double as bm25_weight,
         case when n >= 2 then 0.5 when length(question) > 20 and n = 0 then 2.0 else 1.0 end::double as vec_weight,
         regexp_matches(lower(question), '%s') as prefer_tables
  from signals)""" % "|".join(T.TABLE_WORDS)
FUSED = """
fused as (
  select query_id, chunk_id, round((coalesce(vec_weight / (60 + v.rank + 1), 0) + coalesce(bm25_weight / (60 + k.rank + 1), 0)){boost}, 9) as rrf_score,
         v.score as vec_score, coalesce(v.rank, k.rank + 1000000) as place
  from vec v full join keyword k using (query_id, chunk_id) join routed using (query_id) left join chunks c using (chunk_id))"""
BOOST = " * case when prefer_tables and coalesce(chunk_type, '') in ('table', 'table_summary') then 1.5 else 1.0 end"
FIRST = """
firsts as (
  select * from (select *, row_number() over (partition by query_id order by rrf_score desc, place) - 1 as rank from fused {where}) where rank < 20)"""
UP_TO_FIRST = f"with {tables.CHUNKS},{KEYWORD},{VECTOR.format(where='')},{ROUTED},{FUSED.format(boost=BOOST)},{FIRST.format(where='where vec_score is null or vec_score >= 0.2')}"
DEDUPED = """
carried as (select f.*, file_name, file_path, page_num, section, text from firsts f join chunks using (chunk_id)),
deduped as (
  select * exclude (nth, rank), first_rank as rank from (
    select *, row_number() over (partition by query_id, file_path, page_num, substr(text, 1, 128) order by rrf_score desc, rank) as nth,
           min(rank) over (partition by query_id, file_path, page_num, substr(text, 1, 128)) as first_rank
    from carried) where nth = 1)"""
RERANKED = f"""
lexical as (
  select d.*, round(case when len(list_distinct({TERMS.format("question")})) > 0
         then len(list_intersect(list_distinct({TERMS.format("question")}), {TERMS.format("text")})) / len(list_distinct({TERMS.format("question")})) else 0 end, 6) as rerank_score
  from deduped d join routed using (query_id)),
reranked as (
  select * exclude (rank, best, new_rank), new_rank as rank from (
    select *, row_number() over (partition by query_id order by rerank_score desc, rank) - 1 as new_rank
    from (select *, max(rerank_score) over (partition by query_id) as best from lexical) where rerank_score >= 0.1 * best)
  where new_rank < 5)"""
#: The driver's random vectors are seldom as near as 0.4: a lower threshold lets the filter tell.
THRESHOLD = 0.2


def _index(spark, sf):
    chunks = tables.chunks(spark, sf)
    return chunks, fulltext.build_index(chunks)


def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.chunks(spark, sf).select("chunk_id", F.posexplode(T.terms(F.col("text"))).alias("pos", "term"))
    return found.groupBy("term").agg(F.count("*").alias("occurrences"), F.countDistinct("chunk_id").alias("n_chunks"))


def postings_build(spark, sf):
    return fulltext.postings_of(fulltext.counted_terms(tables.chunks(spark, sf)))


def doc_length_stats(spark, sf):
    lengths = fulltext.lengths_of(fulltext.index_terms(tables.chunks(spark, sf)))
    return fulltext.index_of(None, lengths).stats.select("n_chunks", F.round("avglen", 6).alias("avglen"))


def bm25_topk(spark, sf):
    _, index = _index(spark, sf)
    return fulltext.bm25_topk(index, tables.questions(spark, sf)).select("query_id", "chunk_id", "score", "rank")


def bm25_postfilter(spark, sf):
    chunks, index = _index(spark, sf)
    hits = fulltext.bm25_topk(index, tables.questions(spark, sf), 3 * fulltext.TOP_K)
    allowed = F.col("section").isin("src0", "src1", "src2")
    return fulltext.filtered_topk(hits, chunks.select("chunk_id", "section"), allowed).select("query_id", "chunk_id", "score", "rank")


def phrase_search(spark, sf):
    """All pairs of neighbouring terms of every question as phrases."""
    chunks = tables.chunks(spark, sf)
    # Phrases are looked for in the texts: of the index, the lengths do.
    index = fulltext.index_of(None, written(fulltext.lengths_of(fulltext.index_terms(chunks))))
    terms = T.terms(F.col("question"))
    pairs = F.when(F.size(terms) > 1, F.transform(F.sequence(F.lit(0), F.size(terms) - 2), lambda i: F.concat_ws(" ", F.get(terms, i), F.get(terms, i + 1))))
    phrases = tables.questions(spark, sf).select("query_id", F.posexplode(pairs).alias("phrase_id", "phrase"))
    return fulltext.phrase_topk(chunks, index, phrases).select("query_id", "chunk_id", "score", "rank")


#: What is no letter, digit or white space, and so no part of a bare word.
MARKS = r"[^\p{L}\p{N}\s]"


def trigram_search(spark, sf):
    """Every word of every question as a substring, one as good as another."""
    words = F.split(T.strip(F.regexp_replace("question", MARKS, "")), r"\s+")
    asked = tables.questions(spark, sf).select("query_id", F.array_join(words, " OR ").alias("question"))
    return fulltext.trigram_topk(tables.chunks(spark, sf), asked).select("query_id", "chunk_id", "score", "rank")


def fts_fallback(spark, sf):
    """Every word of every question, without its first letter, asks by itself: few are terms, substrings find others."""
    chunks, index = _index(spark, sf)
    words = tables.questions(spark, sf).select("query_id", F.posexplode(F.split("question", " ")).alias("pos", "word"))
    cut = F.regexp_replace(F.expr("substring(word, 2)"), r"[^\p{L}\p{N}]", "")
    asked = words.select((F.col("query_id") * 100_000 + F.col("pos")).alias("query_id"), cut.alias("question"))
    return fulltext.search(chunks, index, asked).select("query_id", "chunk_id", "score", "rank", "path")


def filtered_fallback(spark, sf):
    """Every word of every question asks in the files of one section: where they have no keyword hit, substrings do."""
    chunks, index = _index(spark, sf)
    words = tables.questions(spark, sf).select("query_id", F.posexplode(F.split("question", " ")).alias("pos", "word"))
    bare = F.regexp_replace("word", r"[^\p{L}\p{N}]", "")
    asked = words.select((F.col("query_id") * 100_000 + F.col("pos")).alias("query_id"), bare.alias("question"))
    return fulltext.search(chunks, index, asked, allowed=F.col("section") == "src0").select("query_id", "chunk_id", "score", "rank", "path")


def _long_words(spark, sf):
    words = F.regexp_extract_all(F.lower("question"), F.lit("[a-z]{4,}"), F.lit(0))
    return tables.questions(spark, sf).select("query_id", words.alias("w"))


def expression_search(spark, sf):
    """The first five long words of every question as an expression with brackets."""
    asked = _long_words(spark, sf).where(F.size("w") >= 5).select("query_id", F.format_string("(%s OR %s) AND ((%s OR %s) NOT %s)", *(F.get("w", F.lit(i)) for i in range(5))).alias("question"))
    return fulltext.trigram_topk(tables.chunks(spark, sf), asked).select("query_id", "chunk_id", "score", "rank")


def near_search(spark, sf):
    """The first two long words of every question, near each other."""
    asked = _long_words(spark, sf).where(F.size("w") >= 2).select("query_id", F.format_string("NEAR(%s %s, 40)", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("question"))
    return fulltext.trigram_topk(tables.chunks(spark, sf), asked).select("query_id", "chunk_id", "score", "rank")


#: Letters, and the ideographs that stand for them where a text has to be in CJK.
LETTERS, IDEOGRAPHS = "aeioutnrs", "数据统计报告合同款"


def _cjk_chunks(spark, sf):
    """Every document with its most common letters written as ideographs: a chunk of a file of its own."""
    chunks = tables.chunks(spark, sf).withColumn("text", F.translate(F.lower("text"), LETTERS, IDEOGRAPHS))
    return chunks.withColumn("is_cjk", T.is_cjk(F.col("text")))


def cjk_terms(spark, sf):
    """Postings of texts in CJK: files with few ideographs keep their runs, others are segmented."""
    return fulltext.postings_of(fulltext.counted_terms(_cjk_chunks(spark, sf)))


def cjk_bm25_topk(spark, sf):
    asked = tables.questions(spark, sf).withColumn("question", F.translate(F.lower("question"), LETTERS, IDEOGRAPHS))
    return fulltext.bm25_topk(fulltext.build_index(_cjk_chunks(spark, sf)), asked).select("query_id", "chunk_id", "score", "rank")


def vector_topk(spark, sf):
    return vectors.topk(tables.vectors(spark, sf), tables.question_vectors(spark, sf)).select("query_id", "chunk_id", "score", "rank")


def vector_index_topk(spark, sf):
    """The same by way of an inverted file: lists that cannot hold a better vector are not read."""
    held = tables.vectors(spark, sf)
    centroids = vectors.train_lists(held)
    return vectors.indexed_topk(written(vectors.with_list(held, centroids)), tables.question_vectors(spark, sf), centroids).select("query_id", "chunk_id", "score", "rank")


def vector_topk_prefilter(spark, sf):
    return vectors.topk(tables.vectors(spark, sf), tables.question_vectors(spark, sf), allowed=F.col("label").isin(0, 1, 2)).select("query_id", "chunk_id", "score", "rank")


def vector_search_blocks(spark, sf):
    """Every vector whose id is divisible by 20 asks for its ten nearest among all."""
    every = tables.vectors(spark, sf)
    asked = every.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    return vectors.topk(every, asked, 10).select("query_id", "chunk_id", "score", "rank")


def router_classify(spark, sf):
    asked = tables.questions(spark, sf).unionByName(tables.table(spark, sf, "pages").select((F.col("page_id") + 1_000_000).alias("query_id"), F.col("url").alias("question")))
    return fusion.route(asked).select("query_id", T.signal_count(F.col("question")).alias("signals"), "bm25_weight", "vec_weight")


def table_intent(spark, sf):
    talk = tables.table(spark, sf, "conversations").where("role = 'user'")
    return talk.select("conv_id", "turn", T.asks_for_table(F.col("text")).alias("prefer_tables"))


def _fused(spark, sf, boost=True):
    chunks, index = _index(spark, sf)
    asked = tables.questions(spark, sf)
    hits = fulltext.bm25_topk(index, asked)
    near = vectors.topk(tables.vectors(spark, sf), tables.question_vectors(spark, sf))
    return chunks, asked, fusion.rrf(near, hits, fusion.route(asked), chunks if boost else None)


def rrf_fusion(spark, sf):
    return _fused(spark, sf, False)[2]


def rrf_table_boost(spark, sf):
    """As if every question asked for tables."""
    chunks, index = _index(spark, sf)
    asked = tables.questions(spark, sf)
    routed = fusion.route(asked).withColumn("prefer_tables", F.lit(True))
    near = vectors.topk(tables.vectors(spark, sf), tables.question_vectors(spark, sf))
    return fusion.rrf(near, fulltext.bm25_topk(index, asked), routed, chunks)


def fused_threshold(spark, sf):
    return fusion.first(fusion.over_threshold(_fused(spark, sf)[2], THRESHOLD)).select("query_id", "chunk_id", "rrf_score", "rank")


def _candidates(spark, sf):
    chunks, asked, fused = _fused(spark, sf)
    kept = fusion.first(fusion.over_threshold(fused, THRESHOLD))
    return asked, fusion.deduplicate(kept.join(chunks, "chunk_id"))


def dedup_candidates(spark, sf):
    return _candidates(spark, sf)[1].select("query_id", "chunk_id", "rrf_score", "rank")


def _hits(spark, sf):
    asked, candidates = _candidates(spark, sf)
    return fusion.rerank(candidates, asked)


def rerank_cutoff(spark, sf):
    return _hits(spark, sf).select("query_id", "chunk_id", "rerank_score", "rank")


def citations_by_file(spark, sf):
    return fusion.citations(_hits(spark, sf))


def context_build(spark, sf):
    return fusion.contexts(_hits(spark, sf))


def hybrid_retrieve(spark, sf):
    """The whole of it: both searches, fusion, threshold, reranking, and the sources of every question."""
    return _hits(spark, sf).select("query_id", "rank", "chunk_id", "file_name", "rrf_score", "rerank_score", F.substring("text", 1, fusion.SNIPPET).alias("snippet"))


def vector_encode_norms(spark, sf):
    """The default encoder on all documents: equal texts share a vector of unit length."""
    texts = tables.chunks(spark, sf).select(F.col("chunk_id").cast("string").alias("key"), "text")
    out = vectors.encode(texts)
    return out.select(F.col("key").cast("long").alias("chunk_id"), F.size("vector").alias("dims"), F.round(vectors.norm(F.col("vector")), 4).alias("norm"))


def l2_normalize(spark, sf):
    """Every component of every vector, doubled first, at unit length."""
    doubled = F.transform("embedding", lambda x: x.cast("double") * 2)
    unit = tables.table(spark, sf, "embeddings").select("vec_id", vectors.l2_normalized(doubled).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("place", "value")).withColumn("value", F.round("value", 6))


def softmax_score(spark, sf):
    """Neighbouring components of every vector as the logits of yes and no."""
    e = F.col("embedding")
    pairs = F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: vectors.probability_of_yes(F.get(e, i).cast("double"), F.get(e, i + 1).cast("double")))
    return tables.table(spark, sf, "embeddings").select("vec_id", F.posexplode(pairs).alias("place", "p_yes")).withColumn("p_yes", F.round("p_yes", 6))


def position_ids(spark, sf):
    mask = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return tables.table(spark, sf, "embeddings").select("vec_id", F.array_join(vectors.position_ids(mask), ",").alias("position_ids"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, postings_build, doc_length_stats, bm25_topk, bm25_postfilter, phrase_search, trigram_search, fts_fallback, filtered_fallback, expression_search, near_search, cjk_terms, cjk_bm25_topk, vector_topk, vector_index_topk,
        vector_topk_prefilter, vector_search_blocks, router_classify, table_intent, rrf_fusion, rrf_table_boost, fused_threshold, dedup_candidates,
        rerank_cutoff, citations_by_file, context_build, hybrid_retrieve, vector_encode_norms, l2_normalize, softmax_score, position_ids,
    )
}

#: Every row of ``asked_words(query_id, word)`` is an alternative of its question.
TRIGRAM = """
words as (select query_id, word, count(*) as times from (select query_id, lower(word) as word from asked_words) where length(word) >= 3 group by all),
lens as (select distinct length(word) as l from words),
blocks as (select chunk_id, n, substr(low, 256 * b + 1, 356) as block, least(256, n - 256 * b) as here
  from (select chunk_id, lower(text) as low, length(text) as n, unnest(range(0, (length(text) + 255) // 256)) as b from chunks)),
pieces as (select chunk_id, n, l, substr(block, i, l) as word from (select *, unnest(range(1, here + 1)) as i from blocks) cross join lens),
counted as (select word, chunk_id, count(*) as f, any_value(n) - 2 as len from pieces join (select distinct word from words) using (word) where length(word) = l group by all),
dfw as (select word, count(*) as n from counted group by all),
tstats as (select count(*) as n_chunks, avg(greatest(length(text) - 2, 0)) as avglen from chunks where text <> ''),
parts as (
  select query_id, chunk_id, sum(times * greatest(ln((n_chunks - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avglen))) as part
  from words join counted using (word) join dfw using (word) cross join tstats group by all),
substrings as (
  select * from (select query_id, chunk_id, round(part, 6) as score, row_number() over (partition by query_id order by round(part, 6) desc, chunk_id) - 1 as rank from parts)
  where rank < 20)"""
LONG_WORDS = """
long_words as (select item_id as query_id, regexp_extract_all(lower(text), '[a-z]{4,}') as w from benchmark)"""
#: ``toks`` and ``qtoks`` of texts in CJK, ``cjk(chunk_id, text)`` and ``asked_cjk(item_id, text)``.
RUN = "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]"
SEGMENTED = f"""flatten(list_transform(flatten(list_transform({TERMS.format("text")}, lambda t: regexp_extract_all(t, '{RUN}+|[^{RUN[1:]}+'))),
  lambda r: case when regexp_matches(r, '^{RUN}{{2}}') then list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) else [r] end))"""
CJK_INDEX = f"""
cjk as (select doc_id as chunk_id, translate(lower(text), '{LETTERS}', '{IDEOGRAPHS}') as text from documents where text <> ''),
shared as (select *, length(regexp_replace(text, '[^{RUN[1:]}', '', 'g'))::double / length(text) > 0.2 as is_cjk from cjk),
held as materialized (select chunk_id, case when is_cjk then {SEGMENTED} else {TERMS.format("text")} end as terms from shared),
toks as (select chunk_id, unnest(terms) as term from held),
postings as (select term, chunk_id, count(*) as tf from toks group by all),
lengths as materialized (select chunk_id, len(terms) as len from held),
stats as (select count(*) as n_chunks, avg(len) as avglen from lengths)"""

ORACLE_SQL = {
    "tokenize_terms": f"with {tables.CHUNKS},{INDEX} select term, count(*) as occurrences, count(distinct chunk_id) as n_chunks from toks group by term",
    "postings_build": f"with {tables.CHUNKS},{INDEX} select term, chunk_id, tf from postings",
    "doc_length_stats": f"with {tables.CHUNKS},{INDEX} select n_chunks, round(avglen, 6) as avglen from stats",
    "bm25_topk": f"with {tables.CHUNKS},{KEYWORD} select query_id, chunk_id, score, rank from keyword",
    "bm25_postfilter": f"""with {tables.CHUNKS},{WIDER}
select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank
from keyword join chunks using (chunk_id) where section in ('src0', 'src1', 'src2')) where rank < 20""",
    "phrase_search": f"""with {tables.CHUNKS},{INDEX},
qterms as (select item_id as query_id, {TERMS.format("text")} as t from benchmark),
phrases as (select query_id, i as phrase_id, t[i] as a, t[i + 1] as b from (select query_id, t, unnest(range(1, len(t))) as i from qterms)),
pairs as (select chunk_id, t[i] as a, t[i + 1] as b, count(*) as f from (
  select chunk_id, t, unnest(range(1, len(t))) as i from (select chunk_id, {TERMS.format("text")} as t from chunks where text <> '')) group by all),
g as (select query_id, phrase_id, chunk_id, f from phrases join pairs using (a, b)),
n as (select query_id, phrase_id, count(*) as n from g group by all),
s as (select query_id, chunk_id, round(sum(greatest(ln((n_chunks - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avglen))), 6) as score
  from g join n using (query_id, phrase_id) join lengths using (chunk_id) cross join stats group by all)
select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from s) where rank < 20""",
    "trigram_search": f"""with {tables.CHUNKS},
asked_words as (select item_id as query_id, unnest(regexp_split_to_array(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+')) as word from benchmark),
{TRIGRAM} select query_id, chunk_id, score, rank from substrings""",
    "fts_fallback": f"""with {tables.CHUNKS},
each_word as (select item_id, i - 1 as pos, w[i] as word from (select item_id, string_split(text, ' ') as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from benchmark)),
cut as (select item_id * 100000 + pos as item_id, regexp_replace(substr(word, 2), '[^\\p{{L}}\\p{{N}}]', '', 'g') as text from each_word),
{KEYWORD.replace("from benchmark", "from cut")},
asked_words as (select item_id as query_id, text as word from cut where item_id not in (select query_id from keyword)),
{TRIGRAM}
select query_id, chunk_id, score, rank, 'terms' as path from keyword union all select query_id, chunk_id, score, rank, 'substrings' from substrings""",
    "filtered_fallback": f"""with {tables.CHUNKS},
each_word as (select item_id, i - 1 as pos, w[i] as word from (select item_id, string_split(text, ' ') as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from benchmark)),
bare as (select item_id * 100000 + pos as item_id, regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g') as text from each_word),
{WIDER.replace("from benchmark", "from bare")},
section0 as (select chunk_id from chunks where section = 'src0'),
terms as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from keyword join section0 using (chunk_id)) where rank < 20),
asked_words as (select item_id as query_id, text as word from bare where item_id not in (select query_id from terms)),
{TRIGRAM.replace("rank < 20", "rank < 60")},
rest as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from substrings join section0 using (chunk_id)) where rank < 20)
select query_id, chunk_id, score, rank, 'terms' as path from terms union all select query_id, chunk_id, score, rank, 'substrings' from rest""",
    "expression_search": f"""with {tables.CHUNKS},{LONG_WORDS},
places as (select query_id, i, w[i] as word from (select query_id, w, unnest(range(1, 6)) as i from long_words where len(w) >= 5)),
asked_words as (select query_id, word from places),
{TRIGRAM},
found as (
  select query_id, chunk_id, i, greatest(ln((n_chunks - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avglen)) as part
  from places join counted using (word) join dfw using (word) cross join tstats),
matched as (
  select query_id, chunk_id, round(sum(part) filter (i <= 4), 6) as score from found group by all
  having bool_or(i in (1, 2)) and bool_or(i in (3, 4)) and not bool_or(i = 5))
select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from matched) where rank < 20""",
    "near_search": f"""with {tables.CHUNKS},{LONG_WORDS},
places as (select query_id, i, w[i] as word from (select query_id, w, unnest(range(1, 3)) as i from long_words where len(w) >= 2)),
asked_words as (select query_id, word from places),
{TRIGRAM},
held_at as (
  select word, chunk_id, n, 256 * b + i as pos from (
    select chunk_id, n, b, i, l, substr(block, i, l) as word from (
      select chunk_id, n, b, block, unnest(range(1, here + 1)) as i from (
        select chunk_id, n, b, substr(low, 256 * b + 1, 356) as block, least(256, n - 256 * b) as here
        from (select chunk_id, lower(text) as low, length(text) as n, unnest(range(0, (length(text) + 255) // 256)) as b from chunks))) cross join lens)
  where length(word) = l and word in (select word from asked_words)),
pairs as (
  select a.query_id, x.chunk_id, x.n - 2 as len, a.word as word1, b.word as word2, x.pos as pos1, y.pos as pos2
  from places a join places b on a.query_id = b.query_id and a.i = 1 and b.i = 2 join held_at x on x.word = a.word join held_at y on y.word = b.word and y.chunk_id = x.chunk_id
  where x.pos >= y.pos - (length(a.word) - 2) - 40 and y.pos >= x.pos - (length(b.word) - 2) - 40),
counts as (select query_id, chunk_id, len, word1, word2, count(distinct pos1) as f1, count(distinct pos2) as f2 from pairs group by all),
matched as (
  select query_id, chunk_id, round(
    greatest(ln((n_chunks - d1.n + 0.5) / (d1.n + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / avglen))
    + greatest(ln((n_chunks - d2.n + 0.5) / (d2.n + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len / avglen)), 6) as score
  from counts join dfw d1 on d1.word = word1 join dfw d2 on d2.word = word2 cross join tstats)
select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from matched) where rank < 20""",
    "cjk_terms": f"with {CJK_INDEX} select term, chunk_id, tf from postings",
    "cjk_bm25_topk": f"""with {CJK_INDEX},
asked_cjk as (select item_id as query_id, translate(lower(text), '{LETTERS}', '{IDEOGRAPHS}') as text from benchmark),
asked as (select query_id, term, count(*) as times from (select query_id, unnest({SEGMENTED}) as term from asked_cjk) group by all),
{KEYWORD[KEYWORD.index("df as ("):]} select query_id, chunk_id, score, rank from keyword""",
    "vector_topk": f"with {VECTOR.format(where='')} select query_id, chunk_id, score, rank from vec",
    "vector_index_topk": f"with {VECTOR.format(where='')} select query_id, chunk_id, score, rank from vec",
    "vector_topk_prefilter": f"with {VECTOR.format(where='where e.label in (0, 1, 2)')} select query_id, chunk_id, score, rank from vec",
    "vector_search_blocks": f"""select * from (select q.vec_id as query_id, e.vec_id as chunk_id, {COSINE} as score,
row_number() over (partition by q.vec_id order by {COSINE} desc, e.vec_id) - 1 as rank from embeddings q cross join embeddings e where q.vec_id % 20 = 0) where rank < 10""",
    "router_classify": f"""with {ROUTED.replace("from benchmark", "from (select item_id, text from benchmark union all select page_id + 1000000, url from pages)")}
select query_id, n as signals, bm25_weight, vec_weight from routed""",
    "table_intent": f"select conv_id, turn, regexp_matches(lower(text), '{'|'.join(T.TABLE_WORDS)}') as prefer_tables from conversations where role = 'user'",
    "rrf_fusion": f"with {tables.CHUNKS},{KEYWORD},{VECTOR.format(where='')},{ROUTED},{FUSED.format(boost='')} select query_id, chunk_id, rrf_score, vec_score, place from fused",
    "rrf_table_boost": f"with {tables.CHUNKS},{KEYWORD},{VECTOR.format(where='')},{ROUTED},{FUSED.format(boost=BOOST.replace('prefer_tables and ', ''))} select query_id, chunk_id, rrf_score, vec_score, place from fused",
    "fused_threshold": f"{UP_TO_FIRST} select query_id, chunk_id, rrf_score, rank from firsts",
    "dedup_candidates": f"{UP_TO_FIRST},{DEDUPED} select query_id, chunk_id, rrf_score, rank from deduped",
    "rerank_cutoff": f"{UP_TO_FIRST},{DEDUPED},{RERANKED} select query_id, chunk_id, rerank_score, rank from reranked",
    "citations_by_file": f"""{UP_TO_FIRST},{DEDUPED},{RERANKED}
select query_id, position, file_name, file_path, page_num, substr(text, 1, 200) as snippet, round_even(rerank_score, 4) as score from (
select *, row_number() over (partition by query_id, file_path order by rerank_score desc, rank) as nth, min(rank) over (partition by query_id, file_path) as position from reranked) where nth = 1""",
    "context_build": f"""{UP_TO_FIRST},{DEDUPED},{RERANKED}
select query_id, string_agg('[片段' || (rank + 1) || '] 来源: ' || file_name || ', 第' || page_num || '页' || case when coalesce(section, '') <> '' then ' > ' || section else '' end || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context
from reranked group by query_id""",
    "hybrid_retrieve": f"{UP_TO_FIRST},{DEDUPED},{RERANKED} select query_id, rank, chunk_id, file_name, rrf_score, rerank_score, substr(text, 1, 200) as snippet from reranked",
    "vector_encode_norms": "select doc_id as chunk_id, 64 as dims, 1.0::double as norm from documents",
    "l2_normalize": """with u as (select vec_id, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n, embedding::double[] as v from embeddings)
select vec_id, (i - 1)::int as place, round(v[i] / n, 6) as value from (select *, unnest(range(1, len(v) + 1)) as i from u)""",
    "softmax_score": """select vec_id, (i - 1)::int as place, round(exp(v[i]) / (exp(v[i]) + exp(v[i + 1])), 6) as p_yes
from (select vec_id, embedding::double[] as v, unnest(range(1, len(embedding))) as i from embeddings)""",
    "position_ids": """select vec_id, array_to_string(list_transform(range(1, len(embedding) + 1), lambda i: case when embedding[i] > 0 then len(list_filter(embedding[1:i], lambda x: x > 0)) - 1 else 0 end), ',') as position_ids from embeddings""",
}
