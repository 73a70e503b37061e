"""Queries of retrieval: lexical, by vector, packing into a token budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import ranking as R
from marlstone.operators import retrieval as V
from marlstone.operators import vectors
from marlstone.operators.changes import latest
from marlstone.plans import sql as S
from marlstone.plans.registry import register
from marlstone.session import ship_package, spread
from marlstone.sources.tables import read_table

QUERIES = [
    V.Query("police_check", "How long does a police check take?"), V.Query("documents", "required documents for employment verification"), V.Query("compliance", "Recruitment compliance checklist for employers"),
    V.Query("retention", "privacy notice retention schedule"), V.Query("travel", "best beaches in summer"),
]


def _list(ws) -> str:
    return "[" + ", ".join(S.q(w) for w in ws) + "]"


def _points(query: V.Query) -> str:
    s = f"len(list_intersect(toks, {_list(query.tokens)}))"
    for signs, favoured, worth, parts, more in V.KINDS:
        if query.has(signs):
            s += f" + case when list_has_any(toks, {_list(favoured)}) then {worth} else 0 end"
            if parts:
                s += f" + case when {S.has('stem', '|'.join(parts))} then {more} else 0 end"
    s += f" + 2 * len(list_intersect(topic_toks, {_list(query.tokens)})) + case when approved then 1 else 0 end + points"
    for signs, types, worth in V.TYPES:
        if query.has(signs):
            s += f" + case when document_type in ({', '.join(map(S.q, types))}) then {worth} else 0 end"
    norm = sum(x * x for x in query.concepts) ** 0.5
    sim = f"coalesce(case when c_norm > 0 then ({' + '.join(f'c{i} * {x}' for i, x in enumerate(query.concepts) if x)}) / (c_norm * {norm!r}) end, 0.0)" if norm else "0.0"
    return f"select {S.q(query.name)} as query, doc_id, cast({s} + floor({sim} * 4 + 1e-9) as bigint) as score, round({sim}, 6) as semantic_score from n"


SCORED = f"""
b as (select doc_id, list_distinct({S.tokens("coalesce(text, '')")}) as toks, coalesce(file_stem, '') as stem, list_distinct({S.tokens("coalesce(topic, '')")}) as topic_toks, coalesce(document_type, '') as document_type,
  coalesce(approved, false) as approved, cast(round_even(least(1.0, greatest(0.0, coalesce(authority_score, 0.5))) * 3, 0) as bigint) as points from documents),
c as (select *, {', '.join(f"cast(len(list_intersect(toks, {_list(g.split())})) as double) as c{i}" for i, g in enumerate(V.CONCEPTS.values()))} from b),
n as (select *, sqrt({' + '.join(f'c{i} * c{i}' for i in range(len(V.CONCEPTS)))}) as c_norm from c),
s as (select * from ({' union all '.join(_points(x) for x in QUERIES)}) where score > 0),
k as (select *, row_number() over (partition by query order by score desc, doc_id) as rank from s)"""


def _docs(spark, folder):
    return spread(read_table(spark, folder, "documents")).select("doc_id", "text", "file_stem", "topic", "document_type", "approved", "authority_score")


@register("lexical_top_k", f"with {SCORED} select query, doc_id, score, semantic_score, rank from k where rank <= 5")
def lexical_top_k(spark, folder):
    return V.top_k(V.scored(_docs(spark, folder), QUERIES), 5)


_QT = " union all ".join(f"select {S.q(x.name)} as query, {S.q(t)} as w, {str(t in V.DOMAIN).lower()} as known" for x in QUERIES for t in x.tokens)
_DOMAIN = f"""q as ({_QT}), w as (select distinct unnest({S.tokens("concat_ws(' ', topic, document_type)")}) as w from documents),
o as (select query, sum(case when known or w.w is not null then 1 else 0 end)::bigint as overlap from q left join w on q.w = w.w group by query)"""


@register("domain_overlap", f"with {_DOMAIN} select query, overlap from o")
def domain_overlap(spark, folder):
    return V.in_domain(_docs(spark, folder), QUERIES)


@register("lexical_guard", f"""
with {SCORED}, {_DOMAIN}, f as (select query, max(score) filter (rank = 1) as first, coalesce(max(score) filter (rank = 2), 0) as second from k group by query),
j as (select o.query, overlap, first, round((first - second) / (first + 1), 6) as conf from o left join f using (query))
select query, case when overlap = 0 then 'out_of_domain' when first is null then 'no_match' when first < 3 or conf < 0.35 then 'low_confidence' else 'ok' end as status,
  case when overlap > 0 and first is not null then conf else 0 end as confidence, case when overlap > 0 and first is not null then first else 0 end as top_score from j""")
def lexical_guard(spark, folder):
    return V.guarded(_docs(spark, folder), QUERIES)


_COS = "round(list_cosine_similarity({a}.embedding::double[], {b}.embedding::double[]), 6)"


@register("vector_top_k", f"""
with s as (select q.vec_id as query_id, e.vec_id as id, {_COS.format(a='q', b='e')} as similarity from embeddings q, embeddings e where q.vec_id % 100 = 0)
select query_id, id, similarity, rank from (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from s) where rank <= 10""")
def vector_top_k(spark, folder):
    """Queries: every vector whose id is divisible by 100, against all."""
    ship_package(spark)
    e = read_table(spark, folder, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 100 = 0"), key="vec_id", vector="embedding", k=10)


@register("vector_cells")
def vector_cells(spark, folder):
    """The approximate form of ``vector_top_k``: an inverted-file index over all vectors, 20 cells of 32 probed (recall 0.935 at sf0.1, 0.98 at sf0.01)."""
    ship_package(spark)
    e = read_table(spark, folder, "embeddings")
    centres = vectors.centroids_of(e, vector="embedding")
    return vectors.nearest_by_cells(e, e.where("vec_id % 100 = 0"), key="vec_id", vector="embedding", k=10, centres=centres)


_KNOW = S.latest("validex_knowledge", "chunk_id", "created_at desc, chunk_hash")


@register("vector_blend", f"""
with k as (select * from {_KNOW}), e as (select * from k where approved and coalesce(embedding_provider, 'unknown') <> 'fake' and embedding is not null), q as (select * from k where ('0x' || substr(md5(chunk_id), 1, 8))::bigint % 100 = 0 and embedding is not null),
s as (select q.chunk_id as query_id, e.chunk_id as id, {_COS.format(a='q', b='e')} as similarity, coalesce(e.authority_score, 0) as authority from q, e),
r as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from s)
select query_id, id, rank, similarity, cast(round(100 * least(1.0, greatest(0.0, similarity + 0.08 * authority)), 0) as bigint) as score from r where rank <= 8 and similarity >= 0.15""")
def vector_blend(spark, folder):
    """The nearest approved chunks with genuine embeddings, in order of distance, with a score blended with authority. Queries: every
    chunk whose id, by its hash, is divisible by 100, against all rows."""
    ship_package(spark)
    cols = ["chunk_id", "embedding", "authority_score", "approved", "embedding_provider"]
    know = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), cols)
    rows = know.where("approved and coalesce(embedding_provider, 'unknown') <> 'fake'")
    near = vectors.nearest(rows, know.where(F.conv(F.substring(F.md5("chunk_id"), 1, 8), 16, 10).cast("bigint") % 100 == 0), key="chunk_id", vector="embedding", k=8).where("similarity >= 0.15")
    met = near.join(rows.select(F.col("chunk_id").alias("id"), F.coalesce("authority_score", F.lit(0.0)).alias("a")), "id")
    blended = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity") + 0.08 * F.col("a")))
    return met.select("query_id", "id", "rank", "similarity", F.round(100 * blended).cast("bigint").alias("score"))


@register("vector_self_distance", f"select chunk_id, round(1 - list_cosine_similarity(embedding::double[], embedding::double[]), 6) + 0.0 as distance, len(embedding) as dimensions from {_KNOW} where embedding is not null")
def vector_self_distance(spark, folder):
    know = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), ["chunk_id", "embedding"]).where("embedding is not null")
    return know.select("chunk_id", (F.round(1 - vectors.cosine(F.col("embedding"), F.col("embedding")), 6) + 0.0).alias("distance"), F.size("embedding").cast("bigint").alias("dimensions"))


#: Output tokens and bounds of k for each length of article; input tokens per output token; tokens per chunk.
BUDGETS = {"short": (600, 3, 4), "medium": (1200, 6, 8), "long": (1800, 10, 12)}
RATIOS, CHUNK_TOKENS = (1.5, 2.0), 260


def budget(length: str) -> tuple[int, int, int, int, int]:
    """Output tokens, least, target and most input tokens, and the recommended k."""
    import math

    out, low, high = BUDGETS[length]
    least, most = math.ceil(out * RATIOS[0]), math.ceil(out * RATIOS[1])
    target = round((least + most) / 2)
    return out, least, target, most, min(max(math.ceil(target / CHUNK_TOKENS), low), high)


@register("token_budgets", " union all ".join(
    f"select {S.q(n)} as length, {o} as output_tokens, cast(ceil({o} * 1.5) as bigint) as input_min, cast(round_even((ceil({o} * 1.5) + ceil({o} * 2.0)) / 2, 0) as bigint) as input_target, cast(ceil({o} * 2.0) as bigint) as input_max, "
    f"least(greatest(cast(ceil(round_even((ceil({o} * 1.5) + ceil({o} * 2.0)) / 2, 0) / 260.0) as bigint), {a}), {b}) as top_k" for n, (o, a, b) in BUDGETS.items()))
def token_budgets(spark, folder):
    return spark.createDataFrame([(n, *budget(n)) for n in BUDGETS], "length string, output_tokens bigint, input_min bigint, input_target bigint, input_max bigint, top_k bigint")


_MEDIUM = budget("medium")


@register("context_pack", f"""
with k as (select chunk_id, topic, authority_score, cast(ceil(length({S.one_line('content')}) / 4.0) as bigint) as e from {_KNOW} where approved and content is not null),
r as (select *, sum(e) over w as running_tokens, row_number() over w as n from k where e > 0 window w as (partition by topic order by authority_score desc nulls last, chunk_id rows between unbounded preceding and current row))
select topic, chunk_id, running_tokens::bigint as running_tokens from r where running_tokens - e < {_MEDIUM[2]} and (n = 1 or running_tokens <= {_MEDIUM[3]})""")
def context_pack(spark, folder):
    know = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), ["chunk_id", "topic", "content", "authority_score", "approved"]).where("approved and content is not null")
    got = V.packed(know, ["topic"], [F.desc_nulls_last("authority_score"), F.asc("chunk_id")], T.token_estimate(F.col("content")), _MEDIUM[2], _MEDIUM[3])
    return got.select("topic", "chunk_id", "running_tokens")


@register("distinct_results")
def distinct_results(spark, folder):
    """The ten best documents of each query without near-duplicates of better ones, with their relevance for it."""
    docs = _docs(spark, folder)
    best = V.top_k(V.scored(docs, QUERIES), 10).join(docs.select("doc_id", "text"), "doc_id")
    kept = R.greedy_distinct(best, "query", "rank", "text", 10)
    texts = spark.createDataFrame([(x.name, x.text) for x in QUERIES], "query string, topic string")
    return kept.join(F.broadcast(texts), "query").select("query", "doc_id", "rank", F.round(R.relevance(F.col("topic"), F.col("text")), 6).alias("relevance"))


_FW = f"list_distinct({S.words('lower(substr(coalesce(content, {0}), 1, 200))').replace('{0}', chr(39) * 2)})"


@register("near_dup_earlier", f"""
with k as (select chunk_id, source_url, {_FW} as w from {_KNOW} where content is not null),
p as (select b.chunk_id, min(a.chunk_id) as earlier from k a join k b on a.source_url = b.source_url and a.chunk_id < b.chunk_id
  where len(a.w) > 0 and len(b.w) > 0 and len(list_intersect(a.w, b.w)) > 0.8 * greatest(len(a.w), len(b.w)) group by b.chunk_id)
select k.chunk_id, p.earlier from k left join p on k.chunk_id = p.chunk_id""")
def near_dup_earlier(spark, folder):
    """Each chunk with the first earlier chunk of its page whose beginning is nearly the same."""
    know = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), ["chunk_id", "source_url", "content"]).where("content is not null")
    return R.earlier_near_duplicate(know, key="chunk_id", within="source_url", text="content")


@register("answer_overlap", f"""
with t as (select distinct session_id, turn_no, t.user_prompt as p, t.assistant_output as a from (select session_id, unnest(turns) as t, unnest(range(0, len(turns))) as turn_no from chat_sessions)),
x as (select session_id, turn_no, list_distinct({S.tokens("coalesce(p, '')")}) as p, list_distinct({S.tokens("coalesce(a, '')")}) as a from t)
select session_id, turn_no, case when len(p) = 0 or len(a) = 0 then 0.0 else round(len(list_intersect(p, a)) / len(list_distinct(list_concat(p, a))), 6) end as jaccard,
  case when len(p) = 0 then 0.5 else round(len(list_intersect(p, a)) / len(p), 6) end as coverage from x""")
def answer_overlap(spark, folder):
    """Token-set similarity of each answer with its prompt, and the prompt's share found in it."""
    t = read_table(spark, folder, "chat_sessions").select("session_id", F.posexplode("turns").alias("turn_no", "t")).select("session_id", F.col("turn_no").cast("bigint").alias("turn_no"), F.col("t.user_prompt").alias("p"), F.col("t.assistant_output").alias("a")).distinct()
    x = t.select("session_id", "turn_no", *(F.array_distinct(T.tokens(F.coalesce(c, F.lit("")))).alias(c) for c in ("p", "a")))
    both, either = F.size(F.array_intersect("p", "a")), F.size(F.array_union("p", "a"))
    return x.select(
        "session_id", "turn_no", F.when((F.size("p") == 0) | (F.size("a") == 0), 0.0).otherwise(F.round(both / either, 6)).alias("jaccard"), F.when(F.size("p") == 0, 0.5).otherwise(F.round(both / F.size("p"), 6)).alias("coverage"))
