"""Queries of chunks and retrieval, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import search
from quern.plans.fixtures import CHUNKS_SQL, chunks
from quern.sources import transcripts
from quern.sources.tables import table


def chunk_ids(spark, d):
    return chunks(spark, d).select("id", "source", "ord")


def source_catalog_page(spark, d):
    return search.source_catalog(chunks(spark, d), contains="SRC1", offset=20, page_size=100)


def read_document_page(spark, d):
    return search.document_page(chunks(spark, d), max_chars=1500)


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, d, k):
    return search.top_per(_bm25_scores(spark, d), "query_id", k)


def _bm25_scores(spark, d):
    return search.bm25(_questions(spark, d), search.tokenised(table(spark, d, "documents").filter("text is not null"), "doc_id", "text"))


def bm25_topk(spark, d):
    return _bm25(spark, d, 30)


BM25_SQL = """p AS (
  SELECT doc_id AS id, token, count(*) AS tf, any_value(len) AS len FROM (
    SELECT doc_id, unnest(ts) AS token, len(ts) AS len FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS ts FROM documents WHERE text IS NOT NULL)
  ) GROUP BY doc_id, token
), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS token FROM benchmark),
st AS (SELECT count(*) AS n, avg(len) AS al FROM (SELECT id, any_value(len) AS len FROM p GROUP BY id)),
dfs AS (SELECT token, count(*) AS df FROM p GROUP BY token),
s AS (
  SELECT q.query_id, p.id, round(sum(greatest(1e-6, ln((st.n - dfs.df + 0.5) / (dfs.df + 0.5))) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.len / st.al))), 6) AS score
  FROM q JOIN p ON q.token = p.token JOIN dfs ON dfs.token = p.token, st GROUP BY q.query_id, p.id
), bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 30)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("doc"))


def _centroids(spark, d):
    """Mean vector of each label: one row per label and dimension, then one array."""
    flat = _vectors(spark, d).select("doc", F.posexplode("embedding").alias("k", "x"))
    mean = flat.groupBy("doc", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("embedding"))


def _vector_hits(spark, d, k):
    """The k nearest vectors of each label's centroid."""
    return search.top_per(_vector_scores(spark, d), "query_id", k)


def _vector_scores(spark, d):
    c = F.broadcast(_centroids(spark, d).select(F.col("doc").alias("query_id"), F.col("embedding").alias("q")))  # a row per label
    return _vectors(spark, d).join(c, F.lit(True)).select("query_id", "id", F.round(tx.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


def _lifecycle(spark, d):
    """Documents as chunks with a lifecycle: some superseded, some without a status, some valid from or to a day only."""
    k = F.col("doc_id")
    day = lambda n: F.to_timestamp(F.lit(f"2024-0{n}-01"))
    return table(spark, d, "documents").select(
        k.alias("id"), "source", F.when(k % 6 == 0, "SUPERSEDED").when(k % 6 < 4, "ACTIVE").alias("status"), F.when(k % 5 == 0, day(3)).alias("valid_from"), F.when(k % 7 == 0, day(6)).alias("valid_to"),
    )


def _searched(spark, d):
    x = _lifecycle(spark, d)
    return search.hybrid([(_bm25_scores(spark, d), 0.4), (_vector_scores(spark, d), 0.6)], x, tags=x.filter("id % 4 = 1").select("id"), tag_boost=True, source_contains="SRC1", as_of="2024-07-01")


def search_knowledge(spark, d):
    return _searched(spark, d)[0]


def search_hints(spark, d):
    return _searched(spark, d)[1]


def source_names(spark, d):
    x = table(spark, d, "documents")
    s = x.select(F.when(F.col("source") == "src7", "SRC7").otherwise(F.col("source")).alias("source"))
    names = spark.createDataFrame([("src1",), ("SRC2",), ("src7",), ("c19",), ("rc1",), ("nothing",), ("Src",), ("s",)], "name string")
    return search.resolve_names(names, s)


NAMES_SQL = """WITH s AS (SELECT DISTINCT CASE WHEN source = 'src7' THEN 'SRC7' ELSE source END AS source FROM documents), n AS (SELECT unnest(['src1', 'SRC2', 'src7', 'c19', 'rc1', 'nothing', 'Src', 's']) AS name),
g AS (SELECT name, max(CASE WHEN source = name THEN source END) AS exact, count(*) FILTER (WHERE lower(source) = lower(name)) AS nf, max(CASE WHEN lower(source) = lower(name) THEN source END) AS folded, count(source) AS n_matches, max(source) AS one
  FROM n LEFT JOIN s ON contains(lower(source), lower(name)) GROUP BY name)
SELECT name, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN nf = 1 THEN 'folded' WHEN n_matches = 1 THEN 'unique' WHEN n_matches > 1 THEN 'ambiguous' ELSE 'not_found' END AS status,
  CASE WHEN exact IS NOT NULL THEN exact WHEN nf = 1 THEN folded WHEN n_matches = 1 THEN one END AS source, n_matches FROM g"""


def vector_topk_cosine(spark, d):
    return _vector_hits(spark, d, 30)


VECTOR_SQL = """c AS (
  SELECT label AS query_id, list(x ORDER BY k) AS q FROM (
    SELECT label, k, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings) GROUP BY label, k
  ) GROUP BY label
), vs AS (
  SELECT CAST(c.query_id AS BIGINT) AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.q), 6) AS score FROM embeddings e, c
), ve AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= 30)"""


LIFE_SQL = """life AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 6 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-03-01' END AS f, CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-06-01' END AS u FROM documents)"""


def hybrid_rrf(spark, d):
    words = _bm25(spark, d, 30).select("query_id", "id", "rank")
    near = _vector_hits(spark, d, 30).select("query_id", "id", "rank")
    return search.fuse([(words, 0.4), (near, 0.6)], 10)


HYBRID_SQL = f"""WITH {BM25_SQL}, {VECTOR_SQL}, f AS (
  SELECT query_id, id, round(sum(s), 6) AS score FROM (
    SELECT query_id, id, 0.4 / (60 + rank) AS s FROM bm UNION ALL SELECT query_id, id, 0.6 / (60 + rank) FROM ve
  ) GROUP BY query_id, id
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10"""


def related_pairs(spark, d):
    return search.related_pairs(_vectors(spark, d), k=6, min_score=0.3)


RELATED_SQL = """WITH s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label <> b.label
), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE score >= 0.3)
SELECT least(a, b) AS chunk_id, greatest(a, b) AS related_id, max(score) AS score FROM r WHERE k <= 6 GROUP BY 1, 2"""


def related_ranked(spark, d):
    pairs = search.related_pairs(_vectors(spark, d), k=6, min_score=0.3).withColumn("edge_type", F.when((F.col("chunk_id") + F.col("related_id")) % 3 == 0, "REFERENCES").otherwise("SIMILAR"))
    return search.related_of(pairs, _vectors(spark, d).select("id")).filter("rank <= 5")


RELATED_RANKED_SQL = f"""WITH p AS ({RELATED_SQL}), e AS (SELECT *, CASE WHEN (chunk_id + related_id) % 3 = 0 THEN 'REFERENCES' ELSE 'SIMILAR' END AS edge_type FROM p),
b AS (SELECT chunk_id AS id, related_id AS other, edge_type, score FROM e UNION ALL SELECT related_id, chunk_id, edge_type, score FROM e)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(edge_type = 'SIMILAR' AS INT), score DESC, other) AS rank FROM b) WHERE rank <= 5"""


def retrieval_mrr(spark, d):
    """Does a benchmark passage find the documents that contain one of its lines?"""
    ranked = _bm25(spark, d, 30).select(F.col("query_id").alias("case_id"), F.col("id").alias("source"), "rank")
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = _questions(spark, d).select(F.col("query_id").alias("case_id"), F.explode(F.split("text", "\n")).alias("line"))
    expected = lines.join(docs, "line").select("case_id", F.col("doc_id").alias("source")).distinct()
    return search.retrieval_scores(ranked, expected, 30)


MRR_SQL = f"""WITH {BM25_SQL}, x AS (
  SELECT DISTINCT b.item_id AS case_id, l.doc_id AS source FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) b JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l ON l.line = b.line
), f AS (SELECT x.case_id, min(bm.rank) AS r FROM x LEFT JOIN bm ON bm.query_id = x.case_id AND bm.id = x.source GROUP BY x.case_id)
SELECT count(*) AS n_cases, count(r) AS hits, round(count(r) / count(*), 6) AS hit_rate, round(sum(coalesce(1.0 / r, 0)) / count(*), 6) AS mrr FROM f"""


def _dated_chunks(spark, d):
    """Documents as chunks with validity spans and a status from their own columns."""
    day = lambda c: F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), c), "yyyy-MM-dd")
    n = F.col("n_chars").cast("int")
    return table(spark, d, "documents").select(
        "doc_id", F.when(n % 4 != 0, day(n % 300)).alias("valid_from"), F.when(n % 3 == 0, day(n % 300 + n % 90)).alias("valid_to"), F.when(n % 3 == 0, "SUPERSEDED").when(n % 5 == 0, None).otherwise("ACTIVE").alias("status")
    )


DATED_SQL = """dated AS (
  SELECT doc_id, CASE WHEN n_chars % 4 <> 0 THEN strftime(DATE '2025-01-01' + CAST(n_chars % 300 AS INT), '%Y-%m-%d') END AS valid_from,
         CASE WHEN n_chars % 3 = 0 THEN strftime(DATE '2025-01-01' + CAST(n_chars % 300 + n_chars % 90 AS INT), '%Y-%m-%d') END AS valid_to,
         CASE WHEN n_chars % 3 = 0 THEN 'SUPERSEDED' WHEN n_chars % 5 = 0 THEN NULL ELSE 'ACTIVE' END AS status FROM documents
)"""


def asof_chunks(spark, d):
    return search.visible(_dated_chunks(spark, d), as_of="2025-06-15")


def superseded_hint(spark, d):
    """What the visibility rule hides: count and first and last dates by status."""
    every = _dated_chunks(spark, d)
    hidden = every.join(search.visible(every).select("doc_id"), "doc_id", "left_anti")
    return hidden.groupBy("status").agg(F.count("*").alias("n"), F.min("valid_from").alias("first_from"), F.max("valid_to").alias("last_to"))


def conversation_export(spark, d):
    """Assistant turns of 50 characters or more, in order, parted by a rule, one text per conversation."""
    said = table(spark, d, "conversations").filter("role = 'assistant' and length(text) >= 50")
    per = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    return per.select("conv_id", F.size("ts").alias("n"), F.array_join(F.transform("ts", lambda t: t["text"]), "\n\n---\n\n").alias("markdown"))


def shingle_containment(spark, d):
    """Benchmark passages in documents: share of the passage's 5-word shingles, through an inverted index."""
    sh = tx.shingles(F.col("ts"), 5)  # of a column: an expression would be computed again for every shingle
    b = table(spark, d, "benchmark").select("item_id", tx.words(F.col("text")).alias("ts")).select("item_id", sh.alias("s"))
    q = b.select("item_id", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", tx.words(F.col("text")).alias("ts")).select("doc_id", F.explode(sh).alias("shingle"))
    return docs.join(q, "shingle").groupBy("item_id", "doc_id").agg(F.round(F.count("*") / F.first("n"), 6).alias("share")).filter("share >= 0.5")


CONTAIN_SQL = """WITH w AS (SELECT 'b' AS k, item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM benchmark UNION ALL SELECT 'd', doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT k, id, ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2] || ' ' || ts[i + 3] || ' ' || ts[i + 4] AS sh FROM (SELECT *, unnest(range(1, len(ts) - 3)) AS i FROM w WHERE len(ts) >= 5)),
n AS (SELECT id, count(*) AS n FROM s WHERE k = 'b' GROUP BY id)
SELECT b.id AS item_id, x.id AS doc_id, round(count(*) / any_value(n.n), 6) AS share FROM s b JOIN s x ON b.sh = x.sh AND b.k = 'b' AND x.k = 'd' JOIN n ON n.id = b.id GROUP BY 1, 2 HAVING round(count(*) / any_value(n.n), 6) >= 0.5"""

QUERIES = {
    f.__name__: f
    for f in (
        chunk_ids, source_catalog_page, read_document_page, bm25_topk, vector_topk_cosine, hybrid_rrf, related_pairs, related_ranked, retrieval_mrr, asof_chunks, superseded_hint,
        conversation_export, shingle_containment, search_knowledge, search_hints, source_names,
    )
}

KNOWLEDGE_SQL = f"""WITH {BM25_SQL}, {VECTOR_SQL}, {LIFE_SQL}, v AS (SELECT id FROM life WHERE (f IS NULL OR f <= TIMESTAMP '2024-07-01') AND (u IS NULL OR u > TIMESTAMP '2024-07-01') AND contains(lower(source), 'src1')),
x AS (SELECT query_id, id, 0.4 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s WHERE id IN (SELECT id FROM v)
  UNION ALL SELECT query_id, id, 0.6 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM vs WHERE id IN (SELECT id FROM v)),
z AS (SELECT query_id, id, round(sum(w) + CASE WHEN id % 4 = 1 THEN 0.6 / 61 ELSE 0 END, 5) AS score FROM x WHERE k <= 30 GROUP BY query_id, id)
SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM z) WHERE rank <= 10"""
HINTS_SQL = f"""WITH {BM25_SQL}, {VECTOR_SQL}, {LIFE_SQL} SELECT query_id, count(*) AS n_hidden FROM (SELECT query_id, id FROM s UNION SELECT query_id, id FROM vs) WHERE id IN (SELECT id FROM life WHERE f > TIMESTAMP '2024-07-01' OR u <= TIMESTAMP '2024-07-01') GROUP BY query_id"""

ORACLES = {
    "search_knowledge": KNOWLEDGE_SQL, "search_hints": HINTS_SQL, "source_names": NAMES_SQL,
    "chunk_ids": f"WITH {CHUNKS_SQL} SELECT id, source, ord FROM chunks",
    "source_catalog_page": f"""WITH {CHUNKS_SQL} SELECT source, count(*) AS n_chunks, sum(length(text)) AS n_chars FROM chunks WHERE contains(lower(source), 'src1') GROUP BY source ORDER BY source LIMIT 100 OFFSET 20""",
    "read_document_page": f"""WITH {CHUNKS_SQL}, r AS (SELECT source, ord, sum(length(text)) OVER (PARTITION BY source ORDER BY ord) AS cumulative, row_number() OVER (PARTITION BY source ORDER BY ord) AS k FROM chunks),
m AS (SELECT *, k = 1 OR cumulative <= 1500 AS kept FROM r), x AS (SELECT *, min(CASE WHEN NOT kept THEN ord END) OVER (PARTITION BY source) AS next_ord FROM m)
SELECT source, ord, cumulative, next_ord FROM x WHERE kept""",
    "bm25_topk": f"WITH {BM25_SQL} SELECT query_id, id, score, rank FROM bm",
    "vector_topk_cosine": f"WITH {VECTOR_SQL} SELECT query_id, id, score, rank FROM ve",
    "hybrid_rrf": HYBRID_SQL,
    "related_pairs": RELATED_SQL,
    "related_ranked": RELATED_RANKED_SQL,
    "retrieval_mrr": MRR_SQL,
    "asof_chunks": f"WITH {DATED_SQL} SELECT * FROM dated WHERE (valid_from IS NULL OR valid_from <= '2025-06-15') AND (valid_to IS NULL OR valid_to > '2025-06-15')",
    "superseded_hint": f"WITH {DATED_SQL} SELECT status, count(*) AS n, min(valid_from) AS first_from, max(valid_to) AS last_to FROM dated WHERE coalesce(status, 'ACTIVE') <> 'ACTIVE' GROUP BY status",
    "conversation_export": """SELECT conv_id, count(*) AS n, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, text) AS markdown
FROM conversations WHERE role = 'assistant' AND length(text) >= 50 GROUP BY conv_id""",
    "shingle_containment": CONTAIN_SQL,
}


def breadcrumbs(spark, d):
    """Lines of documents under their headings; table rows and shouted lines count as headings of levels 2 and 1 here, as the texts have few of their own."""
    text = F.regexp_replace(F.regexp_replace("text", r"(?m)^(?=[A-Z]{3})", "# "), r"(?m)^(?=[A-Z][a-z]+\.)", "## ")
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", text.alias("text"))
    return transcripts.headings(docs, "doc_id", "text").select("id", "pos", "level", "breadcrumb", "parent")


def section_chunks(spark, d):
    return transcripts.sections(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", 1200).groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("n_chars"))


BREADCRUMBS_SQL = r"""WITH l AS (
  SELECT doc_id AS id, CAST(unnest(range(0, len(ls))) AS INTEGER) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), m AS (SELECT id, pos, CASE WHEN regexp_matches(line, '^[A-Z]{3}') THEN '# ' || line WHEN regexp_matches(line, '^[A-Z][a-z]+\.') THEN '## ' || line ELSE line END AS line FROM l),
t AS (SELECT *, CAST(nullif(length(regexp_extract(line, '^(#{1,6})\s+\S', 1)), 0) AS INTEGER) AS level, trim(regexp_replace(line, '^#{1,6}\s+', '')) AS title FROM m),
s AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN title WHEN level < 2 THEN '' END IGNORE NULLS) OVER w AS h2,
  last_value(CASE WHEN level = 3 THEN title WHEN level < 3 THEN '' END IGNORE NULLS) OVER w AS h3 FROM t WINDOW w AS (PARTITION BY id ORDER BY pos)),
p AS (SELECT id, pos, level, list_filter([h1, h2, h3], lambda h: h IS NOT NULL AND h <> '') AS path FROM s)
SELECT id, pos, level, array_to_string(path, ' > ') AS breadcrumb, CASE WHEN len(path) > 1 THEN path[len(path) - 1] END AS parent FROM p"""

QUERIES |= {"breadcrumbs": breadcrumbs, "section_chunks": section_chunks}
ORACLES["breadcrumbs"] = BREADCRUMBS_SQL
