"""Index and search queries over documents: path = source/doc_id, segment = doc_id % 4 + 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, text
from ..functions.ids import segment_name
from ..operators import index, search
from ..session import scratch_folder
from ..sources.segments import SegmentStore
from ..sources.segments import next_segment_id as next_id
from .registry import query, table

TERMS = "tion ble"
PHRASE = "of the"

DOCS = """docs AS (SELECT printf('seg_%06d', doc_id % 4 + 1) AS segment_id, doc_id, source || '/' || doc_id AS path, text FROM documents)"""
TOKENS = DOCS + r""",
raw AS (SELECT segment_id, doc_id, unnest(regexp_extract_all(text, '\S+')) AS w, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS pos FROM docs),
tokens AS (SELECT segment_id, doc_id, lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')) AS term, CAST(pos AS BIGINT) AS pos FROM raw WHERE regexp_replace(w, '[^\p{L}\p{N}]', '', 'g') <> '')"""
POSTINGS = TOKENS + """,
postings AS (SELECT segment_id, term, doc_id, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY ALL)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return t.select(segment_name(F.col("doc_id") % 4 + 1).alias("segment_id"), "doc_id", path.alias("path"), "text")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return index.tokens(index.spread(docs(spark, d).drop("path")))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.text_postings(docs(spark, d)).drop("tf", "doc_len")


@query(f"WITH {TOKENS} SELECT doc_id, term, pos FROM tokens")
def tokenize(spark, d):
    return tokens(spark, d).select("doc_id", "term", "pos")


@query(r"""SELECT raw, lower(regexp_replace(raw, '[^\p{L}\p{N}]', '', 'g')) AS term, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS raw FROM documents) GROUP BY 1""")
def normalize_terms(spark, d):
    raw = table(spark, d, "documents").select(F.explode(text.raw_tokens(F.col("text"))).alias("raw"))
    return raw.groupBy("raw").agg(F.count("*").alias("n")).select("raw", text.normalize(F.col("raw")).alias("term"), "n")


@query(f"WITH {POSTINGS} SELECT segment_id, term, doc_id, array_to_string(positions, ' ') AS positions FROM postings")
def inverted_index(spark, d):
    shown = F.array_join(F.col("positions").cast("array<string>"), " ")
    return postings(spark, d).select("segment_id", "term", "doc_id", shown.alias("positions"))


@query(f"WITH {TOKENS} SELECT segment_id, term, count(DISTINCT doc_id) AS doc_freq FROM tokens GROUP BY ALL")
def document_frequency(spark, d):
    return index.document_frequency(tokens(spark, d).groupBy("segment_id", "term", "doc_id").agg(F.count("*")))


@query(f"WITH {TOKENS} SELECT segment_id, doc_id, count(*) AS doc_len FROM tokens GROUP BY ALL")
def doc_lengths(spark, d):
    return index.doc_lengths(tokens(spark, d))


@query(f"""WITH {TOKENS} SELECT count(DISTINCT term) AS terms, count(DISTINCT struct_pack(t := term, d := doc_id)) AS postings,
count(*) AS positions FROM tokens""")
def index_stats(spark, d):
    return index.index_stats(postings(spark, d))


META = POSTINGS + """,
counts AS (SELECT segment_id, count(DISTINCT term) AS term_count, count(*) AS posting_count, CAST(sum(len(positions)) AS BIGINT) AS position_count FROM postings GROUP BY 1),
sizes AS (SELECT segment_id, count(*) AS doc_count FROM docs GROUP BY 1),
meta AS (SELECT segment_id, doc_count, coalesce(term_count, 0) AS term_count, coalesce(posting_count, 0) AS posting_count, coalesce(position_count, 0) AS position_count FROM sizes LEFT JOIN counts USING (segment_id))"""


def meta(spark, d):
    return index.text_meta(docs(spark, d))


@query(f"WITH {META} SELECT *, round(position_count / doc_count, 6) AS avg_doc_len FROM meta")
def segment_meta(spark, d):
    return meta(spark, d).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


@query(f"""WITH {META} SELECT coalesce(segment_id, 'total') AS segment_id, CAST(sum(doc_count) AS BIGINT) AS doc_count, CAST(sum(term_count) AS BIGINT) AS term_count,
CAST(sum(posting_count) AS BIGINT) AS posting_count, CAST(sum(position_count) AS BIGINT) AS position_count FROM meta GROUP BY ROLLUP (segment_id)""")
def inspect_segments(spark, d):
    return index.inspect_segments(meta(spark, d))


def _ranking(mode: str, scorer: str, terms: list[str], limit: str) -> str:
    """SQL for a ranked search: counts, statistics and scores spelled out."""
    names = list(dict.fromkeys(terms))
    tf = ", ".join(f"count(*) FILTER (term = '{t}') AS tf{i}" for i, t in enumerate(names))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(names)))
    group, using = ("segment_id, ", "USING (segment_id)") if scorer == "bm25" else ("", "ON true")
    idx = [names.index(t) for t in terms]
    if scorer == "bm25":
        one = "CASE WHEN tf{0} > 0 THEN ln((n - df{0} + 0.5e0) / (df{0} + 0.5e0) + 1e0) * tf{0} * 2.2e0 / (tf{0} + 1.2e0 * (0.25e0 + 0.75e0 * doc_len / (total / n))) ELSE 0e0 END"
    else:
        one = "CASE WHEN df{0} > 0 THEN tf{0} * ln(n / df{0}) ELSE 0e0 END"
    test = (" AND " if mode == "and" else " OR ").join(f"tf{i} > 0" for i in range(len(names)))
    by = "GROUP BY segment_id" if scorer == "bm25" else ""
    return f"""WITH {TOKENS},
counts AS (SELECT segment_id, doc_id, count(*) AS doc_len, {tf} FROM tokens GROUP BY 1, 2),
sums AS (SELECT {group}sum(doc_len) AS total, {df} FROM counts {by}),
sizes AS (SELECT {group}count(*) AS n FROM docs {by}),
stats AS (SELECT * FROM sums JOIN sizes {using}),
scored AS (SELECT counts.segment_id, counts.doc_id, {" + ".join(one.format(i) for i in idx)} AS s FROM counts JOIN stats {using} WHERE {test})
SELECT scored.segment_id, scored.doc_id, path, round(s, 6) AS score FROM scored JOIN docs USING (doc_id) {limit}"""


BEST = "ORDER BY score DESC, path, doc_id LIMIT 10"


def _search(spark, d, q, mode, scorer):
    found = search.search(docs(spark, d), tokens(spark, d), q, mode, scorer)
    return found.select("segment_id", "doc_id", "path", F.round("score", 6).alias("score"))


def _register(name: str, mode: str, scorer: str) -> None:
    @query(_ranking(mode, scorer, TERMS.split(), BEST), name=name)
    def run(spark, d):
        return search.top_k(_search(spark, d, TERMS, mode, scorer), 10)


for _scorer in ("tfidf", "bm25"):
    for _mode in ("and", "or"):
        _register(f"{_scorer}_{_mode}", _mode, _scorer)


@query(_ranking("or", "bm25", ["tion", "the", "tion"], "ORDER BY score DESC, path, doc_id LIMIT 25"))
def topk(spark, d):
    return search.top_k(_search(spark, d, "tion the tion", "or", "bm25"), 25)


@query(_ranking("or", "tfidf", ["tion", "ble"], ""))
def ranked_full(spark, d):
    return _search(spark, d, TERMS, "or", "tfidf").orderBy(*search.ranked(None))


@query(f"""SELECT segment_id, doc_id, path, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, path, doc_id) AS rank
FROM ({_ranking("or", "bm25", TERMS.split(), "")})) WHERE rank <= 3""")
def topk_per_segment(spark, d):
    return search.top_k_per_segment(_search(spark, d, TERMS, "or", "bm25"), 3)


@query(f"SELECT * FROM (SELECT * FROM ({_ranking('and', 'bm25', TERMS.split(), '')})) {BEST}")
def segmented_search(spark, d):
    """Local top k of each segment, then the global one: exact, as scores belong to a segment."""
    local = search.top_k_per_segment(_search(spark, d, TERMS, "and", "bm25"), 10).drop("rank")
    return search.top_k(local, 10)


@query(f"SELECT count(*) AS matches FROM ({_ranking('and', 'bm25', TERMS.split(), '')})")
def match_count(spark, d):
    return _search(spark, d, TERMS, "and", "bm25").agg(F.count("*").alias("matches"))


@query(f"""WITH {TOKENS}, hits AS (SELECT a.segment_id, a.doc_id, CAST(count(*) AS DOUBLE) AS score FROM tokens a JOIN tokens b
ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY ALL)
SELECT hits.segment_id, hits.doc_id, path, score FROM hits JOIN docs USING (doc_id)""")
def phrase_search(spark, d):
    return search.search(docs(spark, d), tokens(spark, d), PHRASE, "phrase").select("segment_id", "doc_id", "path", "score")


@query(f"WITH {POSTINGS} SELECT term, doc_id, len(positions) AS tf FROM postings WHERE term IN ('tion', 'ble', 'und')")
def term_lookup(spark, d):
    tf = F.size("positions").cast("long").alias("tf")
    return search.term_lookup(postings(spark, d), ["tion", "ble", "und"]).select("term", "doc_id", tf)


@query(f"WITH {TOKENS} SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM tokens WHERE term = 'tion')")
def contains_doc(spark, d):
    return search.contains_doc(postings(spark, d), "tion", table(spark, d, "labels").select("doc_id"))


@query(f"""WITH {TOKENS}, wanted AS (SELECT * FROM (VALUES (0, 'the'), (1, 'ble'), (2, 'absentterm'), (3, 'of')) AS v(pos_, term)),
found AS (SELECT term, count(DISTINCT doc_id) AS doc_freq FROM tokens GROUP BY 1)
SELECT row_number() OVER (ORDER BY doc_freq NULLS LAST, pos_) AS ord, term, doc_freq FROM wanted LEFT JOIN found USING (term)""")
def plan_terms(spark, d):
    return search.plan_terms(postings(spark, d), ["the", "ble", "absentterm", "of"])


GAPS = "list_transform(range(len({0})), lambda i: {0}[i + 1] - coalesce({0}[i], 0))"
GAP_ROWS = POSTINGS + ", gaps AS (SELECT segment_id, term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY segment_id, term ORDER BY doc_id) AS gap FROM postings)"


def _joined(c):
    return F.array_join(c.cast("array<string>"), " ")


@query(f"WITH {GAP_ROWS} SELECT segment_id, term, doc_id, gap FROM gaps")
def doc_gap_encode(spark, d):
    """A row an id: a common term's list isn't built."""
    within = index.term_ranges(docs(spark, d))
    return index.gap_rows(index.ids_by_term(docs(spark, d), within=within), within).select("segment_id", "term", "doc_id", "gap")


@query(f"WITH {POSTINGS} SELECT segment_id, term, doc_id FROM postings")
def doc_gap_decode(spark, d):
    within = index.term_ranges(docs(spark, d))
    return index.ungap_rows(index.gap_rows(index.ids_by_term(docs(spark, d), within=within), within), "doc_id", within)


@query(f"WITH {POSTINGS} SELECT segment_id, term, doc_id, array_to_string({GAPS.format('positions')}, ' ') AS gaps FROM postings")
def position_gap_encode(spark, d):
    return postings(spark, d).select("segment_id", "term", "doc_id", _joined(codec.gap_encode(F.col("positions"))).alias("gaps"))


def _varint(x: str) -> str:
    return "(1 + " + " + ".join(f"CAST({x} >= {s} AS BIGINT)" for s in codec.VARINT_STEPS) + ")"


@query(f"SELECT event_id, CAST({_varint('event_id * event_id * 1000')} AS BIGINT) AS bytes FROM events")
def varint_bytes(spark, d):
    x = F.col("event_id") * F.col("event_id") * 1000
    return table(spark, d, "events").select("event_id", codec.varint_length(x).alias("bytes"))


@query(f"""WITH {POSTINGS}, gaps AS (SELECT segment_id, term, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY segment_id, term ORDER BY doc_id) AS g,
len(positions) AS tf, {GAPS.format('positions')} AS pg FROM postings),
own AS (SELECT segment_id, term, {_varint('g')} + {_varint('tf')} + list_sum(list_transform(pg, lambda x: {_varint('x')})) AS b FROM gaps)
SELECT segment_id, term, CAST(sum(b) + {_varint('count(*)')} AS BIGINT) AS bytes FROM own GROUP BY 1, 2""")
def postings_size(spark, d):
    own = postings(spark, d).select("segment_id", "term", "doc_id", index.own_size(F.col("positions")).alias("own"))
    within = index.term_ranges(docs(spark, d))
    return index.postings_size(index.by_term(own, docs(spark, d), within=within), within)


@query("""SELECT 'seg_' || lpad(CAST(max(doc_id % 4 + 1) + 1 AS VARCHAR), 6, '0') AS segment_id FROM documents""")
def next_segment_id(spark, d):
    extra = spark.createDataFrame([("notes",), ("seg_x",)], "segment_id string")
    return next_id(docs(spark, d).select("segment_id").distinct().unionByName(extra))


@query(f"WITH {DOCS} SELECT doc_id, path FROM docs WHERE doc_id % 3 <> 0")
def incremental_new_docs(spark, d):
    all_docs = docs(spark, d).select("doc_id", "path")
    return index.incremental_new_docs(all_docs, all_docs.where("doc_id % 3 = 0")).select("doc_id", "path")


@query(f"WITH {DOCS} SELECT segment_id, doc_id, path FROM docs WHERE segment_id IN ('seg_000001', 'seg_000003')")
def manifest_visible_docs(spark, d):
    manifest = spark.createDataFrame([(0, "seg_000003"), (1, "seg_000001")], "ord int, segment_id string")
    return index.visible(docs(spark, d).select("segment_id", "doc_id", "path"), manifest)


@query(f"""WITH {POSTINGS}, largest AS (SELECT segment_id, max(doc_id) AS m FROM docs GROUP BY 1),
shift AS (SELECT segment_id, coalesce(sum(m) OVER (ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM largest)
SELECT 'seg_000005' AS segment_id, term, CAST(p.doc_id + s AS BIGINT) AS doc_id, path, len(positions) AS tf
FROM postings p JOIN docs USING (segment_id, doc_id) JOIN shift USING (segment_id)""")
def merge_segments(spark, d):
    ids = [(i, f"seg_{i + 1:06d}") for i in range(4)]
    manifest = spark.createDataFrame(ids, "ord int, segment_id string")
    new_docs, new_posts = index.merge_segments(manifest, docs(spark, d).drop("text"), postings(spark, d), "seg_000005")
    joined = new_posts.join(new_docs, ["segment_id", "doc_id"])
    return joined.select("segment_id", "term", "doc_id", "path", F.size("positions").cast("long").alias("tf"))


@query(f"WITH {DOCS} SELECT path, row_number() OVER (ORDER BY path) AS doc_id FROM docs")
def assign_doc_ids(spark, d):
    return index.number_rows(docs(spark, d).select("path"), "path", piece_rows=200).select("path", "doc_id")


@query(r"""SELECT page_id, url, coalesce(list_contains(['txt', 'html', 'htm', 'rs', 'c', 'cc', 'cpp', 'h', 'hpp', 'md'],
regexp_extract(url, '[^/]\.([^./]+)$', 1)), false) AS accepted FROM pages""")
def crawl_extension_filter(spark, d):
    return table(spark, d, "pages").select("page_id", "url", text.indexable(F.col("url")).alias("accepted"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' TEST ***' || text || chr(10) WHEN 1 THEN text WHEN 2 THEN text || chr(10) || 'END OF THE PROJECT GUTENBERG START OF THE PROJECT GUTENBERG'
ELSE text || chr(10) END AS body FROM documents""")
def gutenberg_clean(spark, d):
    """Texts wrapped in markers: in both, in none, in the wrong order, and an end only."""
    t, nl = F.col("text"), F.lit("\n")
    case = F.col("doc_id") % 4
    wrapped = (
        F.when(case == 0, F.concat(F.lit("head\n*** START OF THIS PROJECT GUTENBERG EBOOK TEST ***"), t, nl, F.lit("*** END OF THE PROJECT GUTENBERG EBOOK")))
        .when(case == 1, t)
        .when(case == 2, F.concat(t, nl, F.lit("END OF THE PROJECT GUTENBERG START OF THE PROJECT GUTENBERG")))
        .otherwise(F.concat(t, nl, F.lit("*** END OF THIS PROJECT GUTENBERG EBOOK TEST ***\nlicence")))
    )
    return table(spark, d, "documents").select("doc_id", text.gutenberg_clean(wrapped).alias("body"))


def _sets(spark, d):
    found = tokens(spark, d).where("term IN ('tion', 'ble')")
    return [found.where(F.col("term") == t).select("doc_id").distinct() for t in ("tion", "ble")]


def _set_sql(word: str) -> str:
    return f"WITH {TOKENS} SELECT doc_id FROM tokens WHERE term = 'tion' {word} SELECT doc_id FROM tokens WHERE term = 'ble'"


@query(_set_sql("UNION"))
def doc_union(spark, d):
    a, b = _sets(spark, d)
    return a.unionByName(b).distinct()


@query(_set_sql("INTERSECT"))
def doc_intersect(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


@query(_set_sql("EXCEPT"))
def doc_except(spark, d):
    a, b = _sets(spark, d)
    return a.subtract(b)


_stores: dict[tuple[str, str, bool], SegmentStore] = {}


def store(spark: SparkSession, d: str, merged: bool = False) -> SegmentStore:
    """A stored index of documents in four segments, or of these merged into one; written once in a session."""
    key = (spark.sparkContext.applicationId, d, merged)
    if key not in _stores:
        made = SegmentStore(spark, scratch_folder(spark, "store"))
        found = docs(spark, d)
        for i in range(4):  # one scan a segment: the id says where a document goes
            made.append(found.where(F.col("doc_id") % 4 == i).drop("segment_id"))
        if merged:
            made.merge()
        _stores[key] = made
    return _stores[key]


def _stored(spark, d, q, mode, scorer, merged=False):
    found = store(spark, d, merged).search(q, mode, scorer)
    return found.select("segment_id", "doc_id", "path", F.round("score", 6).alias("score"))


def _register_stored(name: str, mode: str, scorer: str) -> None:
    @query(_ranking(mode, scorer, TERMS.split(), BEST), name=name)
    def run(spark, d):
        return search.top_k(_stored(spark, d, TERMS, mode, scorer), 10)


for _scorer in ("tfidf", "bm25"):
    for _mode in ("and", "or"):
        _register_stored(f"stored_{_scorer}_{_mode}", _mode, _scorer)



@query(_ranking("or", "bm25", ["tion", "the", "tion"], "ORDER BY score DESC, path, doc_id LIMIT 7"))
def stored_topk(spark, d):
    """The 7 best by score bounds: segments that can't reach them aren't read."""
    found = store(spark, d).search("tion the tion", "or", "bm25", k=7)
    return found.select("segment_id", "doc_id", "path", F.round("score", 6).alias("score"))


@query(_ranking("and", "bm25", ["tion", "the", "ble", "of"], ""))
def stored_rare_and(spark, d):
    """An AND of frequent terms and a rarer one, whose documents filter the scans of the others."""
    return _stored(spark, d, "tion the ble of", "and", "bm25")


@query(_ranking("and", "tfidf", ["tion", "the"], ""))
def stored_bloom_and(spark, d):
    """As stored_rare_and, with a Bloom filter in place of lists of documents."""
    found = store(spark, d).plan("tion the", "and", "tfidf", id_list=0).frame
    return found.select("segment_id", "doc_id", "path", F.round("score", 6).alias("score"))


@query(f"""WITH {POSTINGS}, lengths AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1)
SELECT segment_id, term, count(*) AS doc_freq, CAST(sum(len(positions)) AS BIGINT) AS positions, max(len(positions)) AS max_tf, min(n) AS min_len
FROM postings JOIN lengths USING (doc_id) WHERE term IN ('tion', 'ble', 'the') GROUP BY 1, 2""")
def stored_dictionary(spark, d):
    """The dictionary's rows of four terms, one of which is nowhere."""
    return store(spark, d).lookup(["tion", "ble", "the", "absentterm"]).select("segment_id", "term", "doc_freq", "positions", "max_tf", "min_len")


@query(f"""WITH {TOKENS}, starts AS (SELECT a.segment_id, a.doc_id FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
JOIN tokens c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'of' AND b.term = 'the' AND c.term = 'of')
SELECT s.segment_id, s.doc_id, path, CAST(count(*) AS DOUBLE) AS score FROM starts s JOIN docs USING (doc_id) GROUP BY ALL ORDER BY score DESC, path, doc_id LIMIT 5""")
def stored_phrase_topk(spark, d):
    """The five documents with most occurrences of a phrase in which a term stands twice."""
    return store(spark, d).search("of the of", "phrase", k=5).select("segment_id", "doc_id", "path", "score")


PHRASES = f"""WITH {TOKENS}, hits AS (SELECT a.segment_id, a.doc_id, CAST(count(*) AS DOUBLE) AS score FROM tokens a JOIN tokens b
ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY ALL)
SELECT hits.segment_id, hits.doc_id, path, score FROM hits JOIN docs USING (doc_id)"""


@query(PHRASES)
def stored_phrase(spark, d):
    return _stored(spark, d, PHRASE, "phrase", "bm25")


@query(f"SELECT path, score FROM ({PHRASES})")
def merged_phrase(spark, d):
    return _stored(spark, d, PHRASE, "phrase", "bm25", merged=True).select("path", "score")


@query(f"SELECT path, score FROM ({_ranking('or', 'tfidf', TERMS.split(), '')})")
def merged_tfidf(spark, d):
    """All segments are one snapshot for TF-IDF: merging them changes no score."""
    return _stored(spark, d, TERMS, "or", "tfidf", merged=True).select("path", "score")


@query(f"SELECT path, score FROM ({_ranking('and', 'bm25', TERMS.split(), '')})".replace("printf('seg_%06d', doc_id % 4 + 1)", "'seg_000005'"))
def merged_bm25(spark, d):
    """After the merge BM25's statistics are those of the single segment."""
    return _stored(spark, d, TERMS, "and", "bm25", merged=True).select("path", "score")


@query(f"""WITH {META} SELECT count(*) AS segments, CAST(sum(doc_count) AS BIGINT) AS docs, CAST(sum(term_count) AS BIGINT) AS terms, CAST(sum(posting_count) AS BIGINT) AS postings, CAST(sum(position_count) AS BIGINT) AS positions,
round(sum(position_count) / sum(doc_count), 6) AS avg_doc_len FROM meta""")
def store_stats(spark, d):
    return store(spark, d).stats().withColumn("avg_doc_len", F.round("avg_doc_len", 6))


@query(f"""WITH {POSTINGS}, gaps AS (SELECT segment_id, term, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY segment_id, term ORDER BY doc_id) AS g,
len(positions) AS tf, {GAPS.format('positions')} AS pg FROM postings),
own AS (SELECT segment_id, term, {_varint('g')} + {_varint('tf')} + list_sum(list_transform(pg, lambda x: {_varint('x')})) AS b FROM gaps),
t AS (SELECT segment_id, term, sum(b) + {_varint('count(*)')} AS bytes FROM own GROUP BY 1, 2) SELECT segment_id, round(CAST(sum(bytes) AS DOUBLE) / 1e6, 2) AS mb FROM t GROUP BY 1""")
def postings_size_mb(spark, d):
    sizes = postings_size(spark, d).groupBy("segment_id").agg(F.sum("bytes").alias("b"))
    return sizes.select("segment_id", codec.size_mb(F.col("b")).alias("mb"))
