"""The registered queries of the operators, each with its contract's columns, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import (
    conversations, decontamination, language_id, line_dedup, minhash, packing, quality, substring_dedup, topk, toxicity, url_filter, vector_codes, warc,
)
from .common import in_training_fold, ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_pack(spark, d):
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), tokenizer_path())


KEY = "translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT doc_id, l, i, {KEY} AS k FROM lines), common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (FROM common)) AS n_dropped,
sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (k NOT IN (FROM common)), '')) AS kept_sha256 FROM keyed GROUP BY doc_id""")
def op5_line_dedup(spark, d):
    kept = line_dedup.drop_common_lines(table(spark, d, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op10_language_id(spark, d):
    docs = table(spark, d, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", (~in_training_fold()).alias("held_out"), "lang_pred", "score")


@query("""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM r""")
def op2_warc(spark, d):
    read = warc.read_records(warc.archive(table(spark, d, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op8_topk(spark, d):
    return topk.top_k(table(spark, d, "embeddings").select("vec_id", "embedding"))


@query()
def op9_toxicity(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, table(spark, d, "labels"))
    # the text is read for its words only; no other column reaches the score
    scored = toxicity.score(docs.select("doc_id", "text"), model, ("doc_id",))  # texts don't travel with their words
    return scored.select("doc_id", (~in_training_fold()).alias("held_out"), "score", "predicted")


@query()
def op3_minhash(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents").select("doc_id", "text"), words=2)


@query()
def op7_decontamination(spark, d):
    return decontamination.contaminated(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


DAY = "2024-01-01"


def dated_lists(pages: DataFrame) -> DataFrame:
    """Events of three lists for the hosts of pages, dated by a rule: the tables hold no list of their own.

    n is from the host's MD5. Hosts with n % 4 < 2 are added on day n % 200; with n % 3 = 0 removed 60 days later; with
    n % 7 = 0 added again after 120 days. The last two labels of hosts with n % 50 = 0 are added as a domain on day 300;
    the language folder of hosts with n % 5 = 0 as a prefix on day 100.
    """
    h = pages.select(url_filter.host(F.col("url")).alias("h")).where("h <> ''").distinct()
    h = h.withColumn("n", F.conv(F.substring(F.md5("h"), 1, 6), 16, 10).cast("int"))
    domain = F.array_join(F.slice(F.split("h", r"\."), -2, 2), ".")

    def event(test: str, name: str, kind: str, value, action: str, day):
        at = F.date_add(F.lit(DAY).cast("date"), day).cast("timestamp")
        return h.where(test).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), at.alias("at"))

    first, host = (F.col("n") % 200).cast("int"), F.col("h")
    events = event("n % 4 < 2", "hosts", "host", host, "add", first)
    for part in (
        event("n % 4 < 2 AND n % 3 = 0", "hosts", "host", host, "remove", first + 60),
        event("n % 4 < 2 AND n % 7 = 0", "hosts", "host", host, "add", first + 120),
        event("n % 50 = 0 AND h LIKE '%.%.%'", "domains", "domain", domain, "add", F.lit(300)).distinct(),
        event("n % 5 = 0", "folders", "prefix", F.concat(host, F.lit("/en")), "add", F.lit(100)),
    ):
        events = events.unionByName(part)
    return events


HOST_SQL = r"rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.')"


@query(rf"""WITH c AS (SELECT page_id, {HOST_SQL} AS h, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) AS p, CAST(page_id * 7 % 366 AS INTEGER) AS day FROM pages),
hosts AS (SELECT DISTINCT h, CAST('0x' || substring(md5(h), 1, 6) AS INTEGER) AS n FROM c WHERE h <> ''),
ev AS (SELECT h, n % 200 AS d, 1 AS a FROM hosts WHERE n % 4 < 2 UNION ALL SELECT h, n % 200 + 60, 0 FROM hosts WHERE n % 4 < 2 AND n % 3 = 0 UNION ALL SELECT h, n % 200 + 120, 1 FROM hosts WHERE n % 4 < 2 AND n % 7 = 0),
hit AS (SELECT c.page_id, 1 AS e FROM c JOIN (SELECT c.page_id, arg_max(a, d) AS a FROM c JOIN ev ON c.h = ev.h AND ev.d <= c.day GROUP BY 1) s ON c.page_id = s.page_id AND s.a = 1
UNION ALL SELECT page_id, 1 FROM c JOIN hosts USING (h) WHERE n % 5 = 0 AND day >= 100 AND (p = '/en' OR p LIKE '/en/%')
UNION ALL SELECT page_id, 1 FROM c WHERE day >= 300 AND len(string_split(h, '.')) >= 2 AND EXISTS (SELECT 1 FROM hosts WHERE n % 50 = 0 AND hosts.h LIKE '%.%.%'
AND array_to_string(list_slice(string_split(hosts.h, '.'), -2, -1), '.') = array_to_string(list_slice(string_split(c.h, '.'), -2, -1), '.')))
SELECT c.page_id, count(hit.e) > 0 AS blocked, count(hit.e) AS n_entries FROM c LEFT JOIN hit USING (page_id) GROUP BY 1""")
def op6_url_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    day = (F.col("page_id") * 7 % 366).cast("int")
    captures = pages.withColumn("at", F.date_add(F.lit(DAY).cast("date"), day).cast("timestamp"))
    return url_filter.judge(captures, dated_lists(pages)).select("page_id", "blocked", "n_entries")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@query()
def op4_substring_dedup(spark, d):
    """A row for each document and repeated stretch, with its class: no row for each pair."""
    return substring_dedup.stretches_in_classes(substring_dedup.repeated_passages(table(spark, d, "documents").select("doc_id", "text")))


def _code_sql(rounds: int = 6) -> str:
    """Every round spelled out: nearest entries of all parts, then the floor of their means."""
    parts = """WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT rid, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS x FROM kept, range(8) AS r(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM part WHERE rid <= 16)"""
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts += f""",
near{r} AS MATERIALIZED (SELECT rid, p, min(struct_pack(d := d, e := e)) AS m FROM (SELECT rid, part.p, e, CAST({far} AS BIGINT) AS d FROM part JOIN book{r} USING (p)) GROUP BY 1, 2)"""
        if r < rounds:
            parts += f""",
mean{r} AS (SELECT p, e, list(f ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS f FROM near{r} JOIN part USING (rid, p), range(1, 9) AS t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN mean{r} USING (p, e))"""
    return parts + f""",
coded AS (SELECT rid, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM kept JOIN coded USING (rid)"""


@query(_code_sql())
def op11_vector_codes(spark, d):
    coded, books = vector_codes.compress(table(spark, d, "embeddings").select("vec_id", "embedding", "label"))
    digits = F.array_join(F.transform("code", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
    return coded.select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error", F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"))


#: A fixed rule of five damages: by crc32(conv_id:turn) % 20, 0 drops a row, 1 empties it, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's.
def damaged(turns: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    k = F.crc32(F.concat_ws(":", *parts).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = turns.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


@query()
def op13_conversation_repair(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    reports, _ = conversations.repair(damaged(turns))
    reports = reports.withColumnRenamed("conv_id", "own")
    ids = turns.select("conv_id").distinct()
    found = ids.join(reports, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256))
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest.alias("repaired_sha256"))


@query()
def op12_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, d, "labels"))
    scored = quality.score(docs, model)  # no other column than the text reaches the score
    return scored.select("doc_id", (~in_training_fold()).alias("held_out"), "score", "predicted")
