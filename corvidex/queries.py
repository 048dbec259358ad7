"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import catalog, chunking, filters, fts, fusion, vector
from .operators.packed import unpack
from .plans import search
from .session import materialize, table
from .sources.files import ignored, size_ok

FLAGSHIP = "hybrid_search"
TERMS = "stem rec"
WIDTH = 64


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name)


_documents, _chunks, _vectors, _hits, _embeddings, _events = map(_t, ("documents", "chunks", "vec_chunks", "search_hits", "embeddings", "events"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(_documents(spark, sf_dir), "doc_id", "tags")


# --- keyword retrieval; the SQL of all but bm25_folded keeps diacritics, so these do


def bm25_topk(s, d):
    hits = fts.bm25(_chunks(s, d), TERMS, {"text": 1.0}, fold=False).select("chunk_id", F.round("fts_rank", 9).alias("fts_rank"))
    return hits.orderBy("fts_rank", "chunk_id").limit(20)


def bm25_weighted_fields(s, d):
    hits = fts.bm25(_chunks(s, d), TERMS, fold=False).select("chunk_id", F.round("fts_rank", 9).alias("fts_rank"))
    return hits.orderBy("fts_rank", "chunk_id").limit(20)


def bm25_all_matches(s, d):
    return fts.bm25(_chunks(s, d), "wor gate", fold=False).select("chunk_id", F.round("fts_rank", 9).alias("fts_rank"))


def bm25_folded(s, d):
    """All matches, diacritics folded, as keyword_search and the hybrid plan have it."""
    return fts.bm25(_chunks(s, d), TERMS).select("chunk_id", F.round("fts_rank", 9).alias("fts_rank"))


def bm25_filtered_global_idf(s, d):
    allowed = _documents(s, d).where("lang = 'en'").select("doc_id").join(_chunks(s, d), "doc_id").select("chunk_id")
    hits = fts.bm25(_chunks(s, d), TERMS, {"text": 1.0}, allowed, fold=False).select("chunk_id", F.round("fts_rank", 9).alias("fts_rank"))
    return hits.orderBy("fts_rank", "chunk_id").limit(20)


def bm25_norm_best_per_doc(s, d):
    paths = _chunks(s, d).select("chunk_id", "doc_path").dropDuplicates(["chunk_id"])
    hits = fts.bm25(_chunks(s, d), TERMS, {"text": 1.0}, fold=False).join(paths, "chunk_id")
    return hits.groupBy("doc_path").agg(F.round(F.max(fts.normalised(F.col("fts_rank"))), 9).alias("best"))


def bm25_shortcut_decision(s, d):
    best = bm25_norm_best_per_doc(s, d).select("doc_path", F.col("best").alias("score"))
    return s.createDataFrame([(search.shortcut(best, 0.8, 0.001),)], "shortcut boolean")


def term_document_frequency(s, d):
    return fts.build_postings(_chunks(s, d), stemmed=False, fold=False).groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("wtf").alias("weight"))


_BM25 = """
with c as (select distinct on (chunk_id) * from chunks order by chunk_id),
t as (select chunk_id, doc_id, doc_path, {fields} from c),
f as (select chunk_id, doc_id, doc_path, {length} as len, {w0} as f0, {w1} as f1 from t),
s as (select count(*) as n, avg(len) as a, sum((f0 > 0)::int) as n0, sum((f1 > 0)::int) as n1 from f),
i as (select a, case when ln((n - n0 + 0.5) / (n0 + 0.5)) > 0 then ln((n - n0 + 0.5) / (n0 + 0.5)) else 1e-6 end as i0,
  case when ln((n - n1 + 0.5) / (n1 + 0.5)) > 0 then ln((n - n1 + 0.5) / (n1 + 0.5)) else 1e-6 end as i1 from s),
h as (select f.*, -(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a))) as r from f, i where f0 > 0 and f1 > 0)
"""


def _bm25_sql(terms: str, weights: dict[str, float], tail: str) -> str:
    a, b = terms.split()
    fields = ", ".join(f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+') as t_{c}" for c in weights)
    w = [" + ".join(f"{k}::double * len(list_filter(t_{c}, lambda x: starts_with(x, '{p}')))" for c, k in weights.items()) for p in (a, b)]
    return _BM25.format(fields=fields, length=" + ".join(f"len(t_{c})" for c in weights), w0=w[0], w1=w[1]) + tail


_TEXT = {"text": 1.0}
_TOP = "select chunk_id, round(r, 9) as fts_rank from h {} order by 2, 1 limit 20"



def _indexed(s, d) -> search.Index:
    """The stored index of the chunks, unstemmed and unfolded as SQL can say it, cut and written as the catalog keeps it."""
    chunks = _chunks(s, d)
    postings = materialize(fts.build_postings(chunks, stemmed=False, fold=False).repartition("term").sortWithinPartitions("term", "chunk_id"), "postings")
    total = chunks.select("chunk_id").distinct().count()
    words = postings.groupBy("chunk_id").agg(F.first("len").alias("len")).agg(F.sum("len")).first()[0] or 0
    return search.Index(chunks, _vectors(s, d), _documents(s, d), postings, total, words / max(total, 1), False, False)


def keyword_search(s, d):
    """The keyword plan with a filter, on stored postings."""
    index = _indexed(s, d)
    found = search.keyword_search(f"type:m* {TERMS}", index.chunks, index.documents, 10, index)
    return found.select("rank", "chunk_id", "doc_path", F.round("bm25", 6).alias("bm25"))


def keyword_phrase(s, d):
    """A word that ``_`` parts is a phrase whose last part is a prefix; all matches, from postings."""
    index = _indexed(s, d)
    return index.words("the_p").select("chunk_id", F.round("fts_rank", 9).alias("fts_rank"))


def keyword_stemmed(s, d):
    """All matches on a stemmed and folded index; SQL has no stemmer, so tests compare it with SQLite's."""
    postings = materialize(fts.build_postings(_chunks(s, d)), "postings")
    return fts.search_postings(postings, TERMS, *fts.lengths(postings)).select("chunk_id", F.round("fts_rank", 9).alias("fts_rank"))


# --- vectors


def _some_vector(s, d) -> list[float]:
    rows = _vectors(s, d).where(vector.usable(F.col("embedding"), WIDTH))
    return [float(x) for x in rows.agg(F.min_by("embedding", "chunk_id")).first()[0]]


def knn_cosine_topk(s, d):
    near = vector.knn(_vectors(s, d), _some_vector(s, d), k=20).select("chunk_id", F.round("distance", 9).alias("distance"))
    return near.orderBy("distance", "chunk_id").limit(20)


def knn_cosine_filtered(s, d):
    allowed = _vectors(s, d).where("heading is not null")
    near = vector.knn(_vectors(s, d), _some_vector(s, d), allowed=allowed, k=20).select("chunk_id", F.round("distance", 9).alias("distance"))
    return near.orderBy("distance", "chunk_id").limit(20)


def centroid_per_label(s, d):
    return vector.centroids(_embeddings(s, d), "label", WIDTH).select("label", "pos", F.round("value", 6).alias("value"))


def similar_docs(s, d):
    path = _vectors(s, d).where(vector.usable(F.col("embedding"), WIDTH)).agg(F.min_by("doc_path", "chunk_id")).first()[0]
    return vector.similar_documents(_vectors(s, d), path, WIDTH).select("doc_path", F.round("distance", 6).alias("distance")).orderBy("distance", "doc_path").limit(20)


def best_of_two_vec(s, d):
    rows = _vectors(s, d).where(vector.usable(F.col("embedding"), WIDTH))
    a = [float(x) for x in rows.agg(F.min_by("embedding", "chunk_id")).first()[0]]
    b = vector.centroid_of(rows.dropDuplicates(["chunk_id"]), WIDTH)
    lists = [vector.knn(_vectors(s, d), q, k=10) for q in (b, a)]
    return vector.better_of(*lists).select("chunk_id", F.round("distance", 6).alias("distance"))


_USABLE = "len(embedding) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_V = f"with v as (select distinct on (chunk_id) chunk_id, embedding::double[] as e, doc_path, heading from vec_chunks where {_USABLE} order by chunk_id), q as (select arg_min(e, chunk_id) as e, arg_min(doc_path, chunk_id) as p from v) "

# --- fusion


def _hit_lists(s, d) -> DataFrame:
    """The two lists behind search_hits, of every query, ranked again."""
    rows = _hits(s, d).dropDuplicates(["query_id", "chunk_id"])
    vec = fusion.rank_list(rows.where("distance is not null"), [F.col("distance"), F.col("chunk_id")], ["query_id"])
    words = fusion.rank_list(rows.where("fts_rank is not null"), [F.col("fts_rank"), F.col("chunk_id")], ["query_id"])
    none = F.lit(None).cast("double")
    return vec.select("query_id", F.lit(0).alias("list_idx"), F.lit("vec").alias("kind"), F.lit(1.0).alias("weight"), "chunk_id", "rank", (1 - F.col("distance")).alias("score"), "distance", none.alias("fts_rank")).unionByName(
        words.select("query_id", F.lit(1).alias("list_idx"), F.lit("fts").alias("kind"), F.lit(1.0).alias("weight"), "chunk_id", "rank", fts.normalised(F.col("fts_rank")).alias("score"), none.alias("distance"), "fts_rank"))


def rrf_two_list(s, d):
    return fusion.fuse(_hit_lists(s, d), ["query_id"]).select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "in_vec", "in_fts")


def rrf_multi_list(s, d):
    """Each list twice: as asked (weight 2) and again as an expansion's (weight 1)."""
    one = _hit_lists(s, d)
    both = one.withColumn("weight", F.lit(2.0)).unionByName(one.withColumn("list_idx", F.col("list_idx") + 2))
    return fusion.fuse(both, ["query_id"]).select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "best_rank")


def rank_bonus(s, d):
    out = fusion.fuse(_hit_lists(s, d), ["query_id"])
    return out.groupBy(fusion.rank_bonus(F.col("best_rank")).alias("bonus")).agg(F.count(F.lit(1)).alias("n"))


_LISTS = """with r as (select distinct on (query_id, chunk_id) * from search_hits order by query_id, chunk_id),
l as (select query_id, chunk_id, 'vec' as kind, row_number() over (partition by query_id order by distance, chunk_id) - 1 as rank, 1 - distance as score from r where distance is not null
 union all select query_id, chunk_id, 'fts', row_number() over (partition by query_id order by fts_rank, chunk_id) - 1, abs(fts_rank) / (1 + abs(fts_rank)) from r where fts_rank is not null),
g as (select query_id, chunk_id, sum(score / (60 + rank)) as s, min(rank) as best, bool_or(kind = 'vec') as in_vec, bool_or(kind = 'fts') as in_fts from l group by all),
b as (select *, case when best = 0 then 0.05 when best <= 2 then 0.02 else 0.0 end::double as bonus from g) """


def hybrid_search(s, d):
    found = search.hybrid_search(TERMS, _some_vector(s, d), _chunks(s, d), _vectors(s, d), _documents(s, d), 10, fold=False)
    return found.select("rank", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "sources", "doc_path")


def hybrid_threshold_no_backfill(s, d):
    found = search.hybrid_search(TERMS, _some_vector(s, d), _chunks(s, d), _vectors(s, d), _documents(s, d), 10, threshold=0.9, fold=False)
    return found.select("chunk_id", F.round("rrf_score", 6).alias("rrf_score"))


def hybrid_search_filtered(s, d):
    found = search.hybrid_search(f'type:markdown dt>"2025-06-01" {TERMS}', _some_vector(s, d), _chunks(s, d), _vectors(s, d), _documents(s, d), 10, fold=False)
    return found.select("chunk_id", F.round("rrf_score", 6).alias("rrf_score"))


_HYBRID = """, c as (select distinct on (chunk_id) * from chunks order by chunk_id),
t as (select chunk_id, regexp_extract_all(lower(coalesce(fts_path, '')), '[\\p{L}\\p{N}]+') as tp, regexp_extract_all(lower(coalesce(heading, '')), '[\\p{L}\\p{N}]+') as th, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as tt from c),
f as (select chunk_id, len(tp) + len(th) + len(tt) as len,
  10.0::double * len(list_filter(tp, lambda x: starts_with(x, 'stem'))) + 2.0::double * len(list_filter(th, lambda x: starts_with(x, 'stem'))) + len(list_filter(tt, lambda x: starts_with(x, 'stem'))) as f0,
  10.0::double * len(list_filter(tp, lambda x: starts_with(x, 'rec'))) + 2.0::double * len(list_filter(th, lambda x: starts_with(x, 'rec'))) + len(list_filter(tt, lambda x: starts_with(x, 'rec'))) as f1 from t),
st as (select count(*) as n, avg(len) as a, sum((f0 > 0)::int) as n0, sum((f1 > 0)::int) as n1 from f),
i as (select a, greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) as i0, greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) as i1 from st),
w as (select chunk_id, -(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a))) as r from f, i where f0 > 0 and f1 > 0),
n as (select v.chunk_id, 1 - list_cosine_similarity(v.e, q.e) as dist from v, q),
lf as (select chunk_id, row_number() over (order by r, chunk_id) - 1 as rank, abs(r) / (1 + abs(r)) as score from w),
lv as (select chunk_id, row_number() over (order by dist, chunk_id) - 1 as rank, 1 - dist as score from n),
l as (select *, 'fts' as kind from lf where rank < FETCH union all select *, 'vec' from lv where rank < FETCH),
g as (select chunk_id, round(sum(score / (60 + rank)) + max(case when rank = 0 then 0.05 when rank <= 2 then 0.02 else 0.0 end), 9) as rrf, min(rank) as best, max(case when kind = 'vec' then score end) as sim,
  bool_or(kind = 'fts') as in_fts, bool_or(kind = 'vec') as in_vec from l group by 1),
o as (select g.*, c.doc_path, d.type, d.indexed_at, row_number() over (order by rrf desc, best, g.chunk_id) as place from g join c using (chunk_id) left join documents d on d.doc_id = c.doc_id) """

# --- filters, over all chunks


def _joined(s, d) -> DataFrame:
    docs = _documents(s, d).select("doc_id", "type", "tags", "indexed_at")
    return _chunks(s, d).select("chunk_id", "doc_id", "doc_path", "text").dropDuplicates(["chunk_id"]).join(docs, "doc_id", "left")


def _filter(query: str):
    def run(s, d):
        return _joined(s, d).where(filters.predicate(filters.parse_filters(query)[1])).select("chunk_id", "doc_path")

    return run


def tagged_chunks(s, d):
    return filters.tagged_chunks(_chunks(s, d), _documents(s, d), ("runbook",))


_FILTERED = "select c.chunk_id, c.doc_path from (select distinct on (chunk_id) * from chunks order by chunk_id) c left join documents d on d.doc_id = c.doc_id where "
_TAGS = "list_transform(string_split(coalesce(d.tags, ''), ','), lambda t: lower(trim(t, ' ')))"
FILTERS = {
    "filter_file_glob": ("file:notes/*.md", "regexp_full_match(coalesce(c.doc_path, ''), 'notes/.*\\.md')"),
    "filter_type": ("type:ma*", "regexp_full_match(coalesce(d.type, ''), 'ma.*')"),
    "filter_tags_all": ("tag:runbook tag:on-call", f"list_contains({_TAGS}, 'runbook') and list_contains({_TAGS}, 'on-call')"),
    "filter_date_after": ('dt>"2025-06-01"', "coalesce(d.indexed_at, '') >= '2025-06-01'"),
    "filter_date_before": ('dt<"2025-06-01"', "coalesce(d.indexed_at, '') <= '2025-06-01'"),
    "filter_must_contain": ('+"gateway" +"report"', "contains(lower(coalesce(c.text, '')), 'gateway') and contains(lower(coalesce(c.text, '')), 'report')"),
    "filter_must_not_contain": ('-"the"', "not contains(lower(coalesce(c.text, '')), 'the')"),
    "filter_combined": ('type:pdf dt>"2025-04-01" -"socket"', "coalesce(d.type, '') = 'pdf' and coalesce(d.indexed_at, '') >= '2025-04-01' and not contains(lower(coalesce(c.text, '')), 'socket')"),
}

# --- catalog


def tag_histogram(s, d):
    return catalog.tag_histogram(_documents(s, d))


def type_counts(s, d):
    return _documents(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def type_rollup(s, d):
    return catalog.type_rollup(_documents(s, d))


def ext_histogram(s, d):
    return catalog.extension_histogram(_documents(s, d))


def corpus_stats(s, d):
    chunks = _chunks(s, d).dropDuplicates(["chunk_id"])
    docs = _documents(s, d)
    parts = [docs.agg(F.lit("documents").alias("what"), F.count(F.lit(1)).alias("n")), chunks.agg(F.lit("chunks").alias("what"), F.count(F.lit(1)).alias("n")),
             chunks.agg(F.lit("chars").alias("what"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")),
             chunks.agg(F.lit("tokens_estimated").alias("what"), F.floor(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)) / 4).alias("n")),
             _vectors(s, d).agg(F.lit("vectors").alias("what"), F.countDistinct("chunk_id").alias("n"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def doc_listing(s, d):
    """The listing: one row per path, its last indexing, whether it is large."""
    return catalog.latest(_documents(s, d)).select("path", "type", "title", "chunk_count", "versions", (F.col("size_bytes") >= 1_000_000).alias("large"))


def stale_char_counts(s, d):
    """Chunks whose stored char_count is missing or not the text's number of code points."""
    rows = _chunks(s, d).select("chunk_id", "char_count", F.length("text").alias("actual")).distinct()
    return rows.where("char_count is distinct from actual")


# --- text of chunks and documents


def fts_path(s, d):
    return _chunks(s, d).select("chunk_id", tx.last_parts(F.col("doc_path")).alias("fts_path")).distinct()


def embedding_text(s, d):
    return _chunks(s, d).select("chunk_id", F.md5(tx.embedding_text(F.col("text"), F.col("heading_ancestry"), F.col("doc_path"))).alias("h")).distinct()


def doc_title(s, d):
    return _documents(s, d).select("doc_id", tx.title(F.col("text"), F.col("path")).alias("title"))


def snippet(s, d):
    return _chunks(s, d).where(F.contains(F.lower("text"), F.lit("gateway"))).select("chunk_id", tx.snippet(F.col("text"), ["gateway"], 120).alias("snippet")).distinct()


def format_size(s, d):
    return _documents(s, d).select("doc_id", F.when(F.col("size_bytes") >= 1_000_000, "MB").when(F.col("size_bytes") >= 1000, "KB").otherwise("B").alias("unit"), F.element_at(F.split(tx.format_size(F.col("size_bytes")), " "), -1).alias("formatted_unit"))


def md_table(s, d):
    return _documents(s, d).select("doc_id", F.concat(F.lit("| "), tx.markdown_cell(F.col("doc_id")), F.lit(" | "), tx.markdown_cell(F.col("tags")), F.lit(" |")).alias("line"))


def json_rows(s, d):
    return _documents(s, d).select("doc_id", F.get_json_object(F.to_json(F.struct("path", "title")), "$.title").alias("title"))


def chunk_plain_pack(s, d):
    return chunking.chunk_plain(_documents(s, d).select("doc_id", "text"), 600).select("doc_id", F.col("chunk_index").alias("chunk_index"), F.md5("text").alias("h"))


def chunk_markdown_sections(s, d):
    return chunking.sections(_documents(s, d).select("doc_id", "text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum((F.col("heading").isNotNull()).cast("int")).alias("n_headed"))


def chunk_markdown(s, d):
    """Sections cut to 600 characters, short ones dropped, as they are indexed."""
    return chunking.chunk_markdown(_documents(s, d).select("doc_id", "text"), 600).select("doc_id", "chunk_index", "heading", F.md5("text").alias("h"))


def size_shown(s, d):
    """Sizes as a listing shows them, in whole tenths."""
    shown = F.split(tx.format_size(F.col("size_bytes")), " ")
    return _documents(s, d).select("doc_id", F.round(F.element_at(shown, 1).cast("double") * 10).cast("long").alias("tenths"), F.element_at(shown, 2).alias("unit"))


def heading_ancestry(s, d):
    return chunking.sections(_documents(s, d).select("doc_id", "text")).where("heading is not null").select("doc_id", "section", "heading", "heading_ancestry")


# --- incremental indexing: each path's last indexing against the one before


def _versions(s, d) -> tuple[DataFrame, DataFrame]:
    docs = _documents(s, d).select("doc_id", "path", F.expr("row_number() over (partition by path order by doc_id desc)").alias("age")).where("age <= 2")
    rows = _chunks(s, d).select("chunk_id", "doc_id", "chunk_index", "content_hash").dropDuplicates(["chunk_id"]).join(docs, "doc_id")
    return rows.where("age = 2"), rows.where("age = 1")


def incremental_diff(s, d):
    old, new = _versions(s, d)
    return catalog.change_plan(old, new).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def orphan_chunks(s, d):
    return catalog.orphans(*_versions(s, d)).select("chunk_id")


def reused_chunks(s, d):
    return catalog.reusable(*_versions(s, d)).select("chunk_id")


# the same over the whole history: every indexing of a path against the one before it


def _history(s, d) -> tuple[DataFrame, DataFrame]:
    """(old, new) sides of all indexings, a path's first against nothing: ``version`` is the number of the one that ``new`` came with."""
    by_path = "over (partition by path order by doc_id)"
    docs = _documents(s, d).select("doc_id", "path", F.expr(f"row_number() {by_path}").alias("version"), F.expr(f"lead(doc_id) {by_path} is null").alias("last"))
    rows = _chunks(s, d).select("chunk_id", "doc_id", "chunk_index", "content_hash").dropDuplicates(["chunk_id"]).join(docs, "doc_id")
    return rows.where("not last").withColumn("version", F.col("version") + 1), rows


def incremental_diff_all(s, d):
    old, new = _history(s, d)
    return catalog.change_plan(old, new, ("path", "version")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def orphan_chunks_all(s, d):
    """Chunks of any earlier indexing that the path's last one does not have."""
    old, new = _history(s, d)
    return catalog.orphans(old, new.where("last")).select("chunk_id")


def reused_chunks_all(s, d):
    """Chunks that the indexing before theirs had already."""
    old, new = _history(s, d)
    return catalog.reusable(old, new, ("path", "version")).select("chunk_id")


def unchanged_docs(s, d):
    return catalog.unchanged(_documents(s, d)).select("doc_id")


def dup_chunks_by_hash(s, d):
    return _chunks(s, d).select("chunk_id", "content_hash").distinct().groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_id")).where("n > 1")


# --- answers, files, events


def _contexts(s, d, keep: int) -> DataFrame:
    top = _hits(s, d).where(F.col("hit_pos") <= keep).select("query_id", F.col("hit_pos").alias("rank"), "doc_path", "text").distinct()
    return search.context(top, ("query_id",), headed=False).select("query_id", F.md5("context").alias("h"))


def context_assembly(s, d):
    """Each query's three best hits as one numbered context."""
    return _contexts(s, d, 3)


def context_assembly_full(s, d):
    """Each query's five best hits as one numbered context, as many as an answer is given."""
    return _contexts(s, d, 5)


def source_dedupe(s, d):
    return search.distinct_sources(_hits(s, d), ("query_id",))


def ignore_patterns(s, d):
    name = F.element_at(F.split("path", "/"), -1)
    return _documents(s, d).where(~ignored(F.col("path"), name, ["*.log", "drafts/", "*.bak.*", "archive/2024/*"])).select("doc_id")


def size_guard(s, d):
    return _documents(s, d).where(size_ok(F.col("size_bytes"), F.col("path"), 4000 / 1024**2, ["shared/journal/shift-journal.md"])).select("doc_id")


def windowed_events(s, d):
    from .streaming.indexer import windowed_counts

    return windowed_counts(_events(s, d)).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (hybrid_search, hybrid_threshold_no_backfill, hybrid_search_filtered, bm25_topk, bm25_weighted_fields, bm25_all_matches, bm25_folded, bm25_filtered_global_idf, bm25_norm_best_per_doc, bm25_shortcut_decision, keyword_search, keyword_phrase, keyword_stemmed,
             term_document_frequency, knn_cosine_topk, knn_cosine_filtered, centroid_per_label, similar_docs, best_of_two_vec, rrf_two_list, rrf_multi_list, rank_bonus, tag_histogram, type_counts, type_rollup,
             ext_histogram, corpus_stats, doc_listing, stale_char_counts, fts_path, embedding_text, doc_title, snippet, format_size, md_table, json_rows, chunk_plain_pack, chunk_markdown_sections, heading_ancestry, chunk_markdown, size_shown, tagged_chunks,
             incremental_diff, orphan_chunks, reused_chunks, incremental_diff_all, orphan_chunks_all, reused_chunks_all, unchanged_docs, dup_chunks_by_hash, context_assembly, context_assembly_full, source_dedupe, ignore_patterns, size_guard, windowed_events)
    return {"p3_found": p3_found} | {f.__name__: f for f in plain} | {name: _filter(q) for name, (q, _) in FILTERS.items()}


_VERSIONS = """with d as (select doc_id, path, row_number() over (partition by path order by doc_id desc) as age from documents),
r as (select distinct on (chunk_id) c.chunk_id, c.doc_id, c.chunk_index, c.content_hash, d.path, d.age from chunks c join d using (doc_id) where age <= 2 order by chunk_id),
o as (select * from r where age = 2), n as (select * from r where age = 1) """


_HISTORY = """with d as (select doc_id, path, row_number() over (partition by path order by doc_id) as version, row_number() over (partition by path order by doc_id desc) as age from documents),
r as (select distinct on (chunk_id) c.chunk_id, c.doc_id, c.chunk_index, c.content_hash, d.path, d.version, d.age from chunks c join d using (doc_id) order by chunk_id),
o as (select * replace (version + 1 as version) from r where age > 1), n as (select * from r) """


_LINES = """with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as b from documents where text is not null),
m as (select *, regexp_matches(b, '^#{1,6}\\s+.+$') as is_h from l), n as (select *, sum(is_h::int) over (partition by doc_id order by i) as section from m),
h as (select doc_id, i, section, length(regexp_extract(b, '^(#{1,6})\\s+(.+?)$', 1)) as lv, regexp_replace(regexp_extract(b, '^(#{1,6})\\s+(.+?)$', 2), '^\\s+|\\s+$', '', 'g') as name from n where is_h) """
_BLANK = "[\\s\\p{Z}\\x{85}\\x0b\\x1c-\\x1f]+"


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{_BLANK}|{_BLANK}$', '', 'g')"


def _packed(text: str, limit: int) -> str:
    fold = (f"list_reduce(list_transform(string_split_regex({text}, '\\n\\n+'), lambda p: {{'done': []::varchar[], 'now': p}}), lambda a, b: case when length(a.now) + length(b.now) <= {limit} "
            "then {'done': a.done, 'now': case when a.now = '' then b.now else a.now || chr(10) || chr(10) || b.now end} else {'done': case when a.now = '' then a.done else list_append(a.done, a.now) end, 'now': b.now} end)")  # fmt: skip
    return f"case when length({text}) <= {limit} then [{text}] else list_filter(list_append(({fold}).done, ({fold}).now), lambda x: x <> '') end"


_PHRASE = """with c as (select distinct on (chunk_id) * from chunks order by chunk_id),
t as (select chunk_id, regexp_extract_all(lower(coalesce(fts_path, '')), '[\\p{L}\\p{N}]+') as tp, regexp_extract_all(lower(coalesce(heading, '')), '[\\p{L}\\p{N}]+') as th, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as tt from c),
f as (select chunk_id, len(tp) + len(th) + len(tt) as len, """ + " + ".join(f"{k}::double * len(list_filter(range(1, len({t})), lambda i: {t}[i] = 'the' and starts_with({t}[i + 1], 'p')))" for t, k in (("tp", 10), ("th", 2), ("tt", 1))) + """ as f0 from t),
s as (select avg(len) as a, greatest(ln((count(*) - sum((f0 > 0)::int) + 0.5) / (sum((f0 > 0)::int) + 0.5)), 1e-6) as i0 from f)
select chunk_id, round(-(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a))), 9) as fts_rank from f, s where f0 > 0"""


def oracle_sql() -> dict[str, str]:
    hybrid = lambda fetch: _V + _HYBRID.replace("FETCH", str(fetch))
    return {name: _FILTERED + sql for name, (_, sql) in FILTERS.items()} | {
        "bm25_topk": _bm25_sql(TERMS, _TEXT, _TOP.format("")),
        "bm25_weighted_fields": _bm25_sql(TERMS, fts.WEIGHTS, _TOP.format("")),
        "bm25_all_matches": _bm25_sql("wor gate", fts.WEIGHTS, "select chunk_id, round(r, 9) as fts_rank from h"),
        "bm25_folded": _bm25_sql(TERMS, fts.WEIGHTS, "select chunk_id, round(r, 9) as fts_rank from h").replace("lower(coalesce", "translate(lower(coalesce").replace(", '')), '[", f", '')), '{tx.ACCENTED + tx.MARKS}', '{tx.BARE}'), '["),
        "bm25_filtered_global_idf": _bm25_sql(TERMS, _TEXT, _TOP.format("where doc_id in (select doc_id from documents where lang = 'en')")),
        "bm25_norm_best_per_doc": _bm25_sql(TERMS, _TEXT, "select doc_path, round(max(abs(r) / (1 + abs(r))), 9) as best from h group by 1"),
        "bm25_shortcut_decision": _bm25_sql(TERMS, _TEXT, ", b as (select doc_path, round(max(abs(r) / (1 + abs(r))), 9) as best from h group by 1), o as (select best, row_number() over (order by best desc) as k from b) select coalesce(max(best) >= 0.8 and max(best) - coalesce(max(case when k = 2 then best end), 0) >= 0.001, false) as shortcut from o"),
        "term_document_frequency": """with c as (select distinct on (chunk_id) * from chunks order by chunk_id),
            t as (select chunk_id, 10.0::double as k, unnest(regexp_extract_all(lower(fts_path), '[\\p{L}\\p{N}]+')) as term from c union all select chunk_id, 2.0, unnest(regexp_extract_all(lower(heading), '[\\p{L}\\p{N}]+')) from c
              union all select chunk_id, 1.0, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) from c)
            select term, count(distinct chunk_id) as n_chunks, sum(k) as weight from t group by term""",
        "keyword_search": _bm25_sql(TERMS, fts.WEIGHTS, """, o as (select *, row_number() over (order by r, chunk_id) as place from h),
            k as (select o.*, row_number() over (order by place) as rank from o left join documents d on d.doc_id = o.doc_id where place <= 50 and regexp_full_match(coalesce(d.type, ''), 'm.*'))
            select rank::int as rank, chunk_id, doc_path, round(abs(r) / (1 + abs(r)), 6) as bm25 from k where rank <= 10"""),
        "keyword_phrase": _PHRASE,
        "tagged_chunks": f"select distinct c.chunk_id from chunks c join documents d on d.doc_id = c.doc_id where list_contains({_TAGS}, 'runbook')",
        "heading_ancestry": _LINES + """select a.doc_id, a.section::int as section, any_value(a.name) as heading, string_agg(x.name, ' > ' order by x.i) as heading_ancestry from h a join h x on a.doc_id = x.doc_id and x.i <= a.i
            and not exists (select 1 from h k where k.doc_id = a.doc_id and k.i > x.i and k.i <= a.i and k.lv <= x.lv) group by a.doc_id, a.section""",
        "chunk_plain_pack": f"""with p as (select doc_id, list_filter(list_transform({_packed("text", 600)}, lambda x: {_stripped("x")}), lambda x: length(x) >= 50) as c from documents where text is not null)
            select doc_id, (generate_subscripts(c, 1) - 1)::int as chunk_index, md5(unnest(c)) as h from p""",
        "chunk_markdown": _LINES + f""", t as (select n.doc_id, n.section, {_stripped("string_agg(b, chr(10) order by n.i)")} as text, any_value(h.name) as heading from n left join h on h.doc_id = n.doc_id and h.section = n.section group by 1, 2),
            p as (select doc_id, section, heading, {_packed("text", 600)} as c from t), q as (select doc_id, section, heading, generate_subscripts(c, 1) as part, unnest(c) as x from p)
            select doc_id, (row_number() over (partition by doc_id order by section, part) - 1)::int as chunk_index, heading, md5(x) as h from q where length({_stripped("x")}) >= 50""",
        "size_shown": "select doc_id, case when size_bytes >= 1000000 then round(round(size_bytes::double / 1000000, 1) * 10) when size_bytes >= 1000 then round(round(size_bytes::double / 1000, 1) * 10) else size_bytes * 10 end::bigint as tenths, case when size_bytes is null then null when size_bytes >= 1000000 then 'MB' when size_bytes >= 1000 then 'KB' else 'B' end as unit from documents",
        "knn_cosine_topk": _V + "select v.chunk_id, round(1 - list_cosine_similarity(v.e, q.e), 9) as distance from v, q order by 2, 1 limit 20",
        "knn_cosine_filtered": _V + "select v.chunk_id, round(1 - list_cosine_similarity(v.e, q.e), 9) as distance from v, q where heading is not null order by 2, 1 limit 20",
        "centroid_per_label": "with x as (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings where len(embedding) = 64) select label, pos::int as pos, round(avg(x), 6) as value from x group by all",
        "similar_docs": _V + ", m as (select i, avg(v.e[i]) as x from v, q, range(1, 65) r(i) where doc_path = q.p group by i), c as (select list(x order by i) as e from m) select doc_path, round(min(1 - list_cosine_similarity(v.e, c.e)), 6) as distance from v, c, q where doc_path <> q.p group by 1 order by 2, 1 limit 20",
        "best_of_two_vec": _V + "select v.chunk_id, round(1 - list_cosine_similarity(v.e, q.e), 6) as distance from v, q order by 1 - list_cosine_similarity(v.e, q.e), 1 limit 10",
        "rrf_two_list": _LISTS + "select query_id, chunk_id, round(s + bonus, 6) as rrf_score, in_vec, in_fts from b",
        "rrf_multi_list": _LISTS + "select query_id, chunk_id, round(3 * s + bonus, 6) as rrf_score, best::int as best_rank from b",
        "rank_bonus": _LISTS + "select bonus, count(*) as n from b group by 1",
        "hybrid_search": hybrid(30) + "select place::int as rank, chunk_id, round(rrf, 6) as rrf_score, case when in_fts and in_vec then 'fts+vec' when in_fts then 'fts' else 'vec' end as sources, doc_path from o where place <= 10 and (sim is null or sim >= 0.001)",
        "hybrid_threshold_no_backfill": hybrid(30) + "select chunk_id, round(rrf, 6) as rrf_score from o where place <= 10 and (sim is null or sim >= 0.9)",
        "hybrid_search_filtered": hybrid(50) + "select chunk_id, round(rrf, 6) as rrf_score from (select * from o where place <= 50 and coalesce(type, '') = 'markdown' and coalesce(indexed_at, '') >= '2025-06-01' order by place limit 10) where sim is null or sim >= 0.001",
        "tag_histogram": "with t as (select unnest(list_transform(string_split(tags, ','), lambda t: lower(trim(t, ' ')))) as tag from documents) select tag, count(*) as n from t where tag <> '' group by 1",
        "type_counts": "select type, count(*) as n from documents group by 1",
        "type_rollup": "select case when grouping(k) = 1 then '(all)' else k end as type, count(*) as docs, coalesce(sum(size_bytes), 0)::bigint as bytes, coalesce(sum(chunk_count), 0)::bigint as chunks from (select *, coalesce(type, 'unknown') as k from documents) group by rollup (k)",
        "ext_histogram": "select lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as ext, count(*) as n from documents group by 1",
        "corpus_stats": "with c as (select distinct on (chunk_id) * from chunks order by chunk_id) select 'documents' as what, count(*) as n from documents union all select 'chunks', count(*) from c union all select 'chars', coalesce(sum(length(text)), 0)::bigint from c union all select 'tokens_estimated', floor(coalesce(sum(length(text)), 0) / 4)::bigint from c union all select 'vectors', count(distinct chunk_id) from vec_chunks",
        "doc_listing": "select path, arg_max(struct_pack(t := type), doc_id).t as type, arg_max(struct_pack(t := title), doc_id).t as title, arg_max(struct_pack(t := chunk_count), doc_id).t as chunk_count, count(*) as versions, arg_max(struct_pack(t := size_bytes), doc_id).t >= 1000000 as large from documents group by path",
        "stale_char_counts": "select distinct chunk_id, char_count, length(text)::int as actual from chunks where char_count is distinct from length(text)",
        "fts_path": "select distinct chunk_id, case when len(string_split(doc_path, '/')) <= 2 then doc_path else array_to_string(string_split(doc_path, '/')[-2:], '/') end as fts_path from chunks",
        "embedding_text": "select distinct chunk_id, md5(doc_path || case when coalesce(heading_ancestry, '') <> '' then ' > ' || heading_ancestry else '' end || chr(10) || chr(10) || text) as h from chunks",
        "snippet": """with c as (select distinct chunk_id, text, instr(lower(text), 'gateway') - 1 as p from chunks where contains(lower(text), 'gateway')), s as (select *, greatest(0, least(p - 60, length(text) - 120)) as a from c)
            select chunk_id, case when length(text) <= 120 then text else (case when a > 0 then '...' else '' end) || substr(text, a + 1, 120) || (case when a + 120 < length(text) then '...' else '' end) end as snippet from s""",
        "format_size": "select doc_id, case when size_bytes >= 1000000 then 'MB' when size_bytes >= 1000 then 'KB' else 'B' end as unit, case when size_bytes is null then null when size_bytes >= 1000000 then 'MB' when size_bytes >= 1000 then 'KB' else 'B' end as formatted_unit from documents",
        "md_table": "select doc_id, '| ' || doc_id || ' | ' || replace(replace(coalesce(tags, ''), '|', '\\|'), chr(10), ' ') || ' |' as line from documents",
        "json_rows": "select doc_id, title from documents",
        "doc_title": "select doc_id, case when regexp_extract(text, '^#[ \\t]+([^\\n]+)', 1) <> '' then trim(regexp_extract(text, '^#[ \\t]+([^\\n]+)', 1)) else regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1') end as title from documents",
        "chunk_markdown_sections": "with l as (select doc_id, unnest(string_split(text, chr(10))) as b from documents where text is not null), h as (select doc_id, b, regexp_matches(b, '^#{1,6}\\s+.') as is_h, row_number() over () as i from l) select doc_id, (sum(is_h::int) + max(case when first_line and not is_h then 1 else 0 end))::bigint as n_sections, sum(is_h::int)::bigint as n_headed from (select *, row_number() over (partition by doc_id order by i) = 1 as first_line from h) group by 1",
        "incremental_diff": _VERSIONS + ", a as (select path, content_hash, row_number() over (partition by path, content_hash order by chunk_id) as k from o), b as (select path, content_hash, row_number() over (partition by path, content_hash order by chunk_index) as k from n) select case when a.path is null then 'insert' when b.path is null then 'delete' else 'reuse' end as action, count(*) as n from a full join b on a.path = b.path and a.content_hash = b.content_hash and a.k = b.k group by 1",
        "orphan_chunks": _VERSIONS + "select chunk_id from o where not exists (select 1 from n where n.path = o.path and n.content_hash = o.content_hash)",
        "reused_chunks": _VERSIONS + "select chunk_id from n where exists (select 1 from o where n.path = o.path and n.content_hash = o.content_hash)",
        "incremental_diff_all": _HISTORY + ", a as (select path, version, content_hash, row_number() over (partition by path, version, content_hash order by chunk_id) as k from o), b as (select path, version, content_hash, row_number() over (partition by path, version, content_hash order by chunk_index) as k from n) select case when a.path is null then 'insert' when b.path is null then 'delete' else 'reuse' end as action, count(*) as n from a full join b on a.path = b.path and a.version = b.version and a.content_hash = b.content_hash and a.k = b.k group by 1",
        "orphan_chunks_all": _HISTORY + "select chunk_id from o where not exists (select 1 from n where age = 1 and n.path = o.path and n.content_hash = o.content_hash)",
        "reused_chunks_all": _HISTORY + "select chunk_id from n where exists (select 1 from o where n.path = o.path and n.version = o.version and n.content_hash = o.content_hash)",
        "unchanged_docs": "select doc_id from (select doc_id, content_hash, lag(content_hash) over (partition by path order by doc_id) as b from documents) where content_hash = b",
        "dup_chunks_by_hash": "select content_hash, count(*) as n, min(chunk_id) as first_id from (select distinct chunk_id, content_hash from chunks) group by 1 having count(*) > 1",
        "context_assembly": "select query_id, md5(string_agg('[' || hit_pos || '] ' || doc_path || chr(10) || text, chr(10) || chr(10) order by hit_pos)) as h from (select distinct query_id, hit_pos, doc_path, text from search_hits where hit_pos <= 3) group by 1",
        "context_assembly_full": "select query_id, md5(string_agg('[' || hit_pos || '] ' || doc_path || chr(10) || text, chr(10) || chr(10) order by hit_pos)) as h from (select distinct query_id, hit_pos, doc_path, text from search_hits where hit_pos <= 5) group by 1",
        "source_dedupe": "select query_id, doc_path, row_number() over (partition by query_id order by p, doc_path) as source_rank from (select query_id, doc_path, min(hit_pos) as p from search_hits group by 1, 2)",
        "ignore_patterns": "select doc_id from documents where not (path like '%.log' or starts_with(path, 'drafts/') or path like '%.bak.%' or path like 'archive/2024/%')",
        "size_guard": "select doc_id from documents where size_bytes <= 4000 or path = 'shared/journal/shift-journal.md'",
        "windowed_events": "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    }
