"""A folder of immutable index segments and a manifest that names the visible ones.

Layout below root, one folder a segment in each table: postings (term, doc_id, tf, doc_len, positions) and docs (doc_id, path, doc_len),
both bucketed by document, so that the terms of a query meet without a shuffle; terms (term, doc_freq, positions, max_tf, min_len), the
dictionary, in ranges of terms; segment_meta; claims/<segment id> and manifest/v<n>.json.

Writers: a segment's number is claimed by making a file that nobody else has made, so no two writers share a folder. A commit makes the next version of
the manifest in the same way; whoever finds that version taken reads the manifest again and adds to it. Making a file is a rename that
doesn't overwrite: atomic on HDFS-like systems; on a local disk it is safe between the threads of one process.

Readers: postings are sorted by term within a bucket, with Bloom filters on terms, small pages and page indexes, so a term that
a file doesn't hold costs no row group, and a document that is asked for costs its page.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import json
import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import segment_number
from ..functions.text import query_terms
from ..operators.index import merge_segments, text_postings
from ..operators.search import RESULT, TermStats, bloom, bounded, listed, rarest, score_of, search_segment, top_k

MAX_SEGMENTS, ATTEMPTS = 8, 50
TABLES = ("docs", "postings", "terms", "segment_meta")
#: Columns that are bucketed tables' own, and what files are sorted by within a bucket.
BUCKETED = {"postings": ("term string, doc_id long, tf long, doc_len long, positions array<long>", ("term", "doc_id")), "docs": ("doc_id long, path string, doc_len long", ("doc_id",))}
#: Row groups of 32 MB with pages of 1000 rows; Bloom filters grow with a file's terms up to this number.
PARQUET = {"parquet.block.size": 32 << 20, "parquet.page.row.count.limit": 1000, "parquet.bloom.filter.enabled#term": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.expected.ndv#term": 1_000_000}
#: Documents of the rarest term of a search, over all segments, that are pushed to scans as lists.
ID_LIST = 4096
#: What floating point may err in a bound, as a share of it.
SLACK = 1e-9

_making = threading.Lock()
_declared: set[tuple[str, str]] = set()


@dataclass
class Manifest:
    version: int = 0
    segments: list[str] = field(default_factory=list)
    buckets: int = 0
    #: Of each stream the last batch whose documents are in.
    batches: dict[str, int] = field(default_factory=dict)


@dataclass
class SearchPlan:
    """What a search reads: segments, those that lack a term, and those whose best score can't reach the k best."""

    frame: DataFrame
    read: list[str]
    absent: list[str]
    skipped: list[str]


class SegmentStore:
    """Builds, appends, merges and reads segments with Spark's own readers and writers."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """buckets: of a new store; by default spark.sql.shuffle.partitions. A bucket of a segment is a task's."""
        self.spark, self.root = spark, root.rstrip("/")
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._known: dict[str, tuple[int, int]] = {}

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _make(self, name: str, content: str) -> bool:
        """A new file; False if it is there already, then nothing changes."""
        (new, fs), (draft, _) = self._path(name), self._path(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        with _making:
            try:
                fs.mkdirs(new.getParent())
                context.rename(fs.makeQualified(draft), fs.makeQualified(new), options)
                return True
            except Exception:
                fs.delete(draft, True)
                if not fs.exists(new):
                    raise
                return False

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        """Manifest versions, ascending."""
        return sorted(int(m[1]) for n in self._names("manifest") if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def _state(self, version: int | None = None) -> Manifest:
        versions = [version] if version else self.versions()
        if not versions:
            return Manifest(buckets=self._buckets)
        path, fs = self._path(f"manifest/v{versions[-1]:08d}.json")
        stream = fs.open(path)
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def manifest(self) -> list[str]:
        """Visible segment ids in order."""
        return self._state().segments

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> bool:
        """Make the next version of the manifest from the newest one, again as long as others are faster; None changes nothing."""
        for _ in range(ATTEMPTS):
            state = self._state()
            version = state.version + 1
            if (new := change(state)) is None:
                return False
            new.version = version
            if self._make(f"manifest/v{version:08d}.json", json.dumps(new.__dict__)):
                return True
        raise RuntimeError(f"{ATTEMPTS} other writers were faster")

    def next_id(self) -> str:
        """One past the largest number in the manifest; other names don't count."""
        numbers = [int(s[4:]) for s in self.manifest() if s.startswith("seg_") and s[4:].isdigit()]
        return f"seg_{max(numbers, default=0) + 1:06d}"

    def _claim(self) -> str:
        """A segment id that no other writer has or had."""
        number = int(self.next_id()[4:])
        for _ in range(ATTEMPTS * MAX_SEGMENTS):
            if self._make(f"claims/seg_{number:06d}", ""):
                return f"seg_{number:06d}"
            number += 1
        raise RuntimeError("no free segment number")

    def _folder(self, name: str, segment_id: str) -> str:
        return f"{self.root}/{name}/segment_id={segment_id}"

    def _save(self, name: str, segment_id: str, frame: DataFrame) -> DataFrame:
        path = self._folder(name, segment_id)
        writer = frame.drop("segment_id").write
        for key, value in PARQUET.items():
            writer = writer.option(key, value)
        if name not in BUCKETED:
            writer.parquet(path)
            return self.spark.read.parquet(path)
        table = f"lodestone_write_{uuid.uuid4().hex}"
        by = BUCKETED[name][1]
        writer.bucketBy(self._state().buckets, "doc_id").sortBy(*by).option("path", path).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # its files stay: the folder is given
        return self.bucketed(name, segment_id)

    def bucketed(self, name: str, segment_id: str) -> DataFrame:
        """A table of one segment that Spark knows to be bucketed by doc_id."""
        path = self._folder(name, segment_id)
        table = f"lodestone_{hashlib.md5(path.encode()).hexdigest()}"
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _declared:
            schema, by = BUCKETED[name]
            n = self._state().buckets
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY (doc_id) SORTED BY ({', '.join(by)}) INTO {n} BUCKETS LOCATION '{path}'")
            _declared.add(key)
            atexit.register(self._undeclare, table)
        return self.spark.table(table)

    def _undeclare(self, table: str) -> None:
        with contextlib.suppress(Exception):  # the session has ended, and a catalogue in memory with it
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _write(self, segment_id: str, docs: DataFrame, posts: DataFrame, terms: DataFrame | None = None) -> None:
        """docs(doc_id, path, and doc_len if terms are given), posts(term, doc_id, tf, doc_len, positions). Each is computed once."""
        posts = self._save("postings", segment_id, posts.select("term", "doc_id", "tf", "doc_len", "positions"))
        if terms is None:
            bounds = [F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len")]
            terms = posts.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("positions"), *bounds)
            lengths = posts.groupBy("doc_id").agg(F.first("doc_len").alias("doc_len"))  # bucketed: no shuffle
            docs = docs.join(lengths, "doc_id", "left").na.fill(0, ["doc_len"])
        terms = self._save("terms", segment_id, terms.repartitionByRange("term").sortWithinPartitions("term"))
        docs = self._save("docs", segment_id, docs.select("doc_id", "path", "doc_len").repartition(self._state().buckets, "doc_id"))
        zero = F.lit(0).cast("long")
        counts = terms.agg(F.count("*").alias("term_count"), F.coalesce(F.sum("doc_freq"), zero).alias("posting_count"), F.coalesce(F.sum("positions"), zero).alias("position_count"))
        meta = docs.agg(F.count("*").alias("doc_count")).crossJoin(counts)  # one row each
        self._save("segment_meta", segment_id, meta.withColumn("avg_doc_len", F.col("position_count") / F.nullif("doc_count", zero)))

    def prepare(self, docs: DataFrame) -> str:
        """Write docs (doc_id, path, text) as a segment that no reader sees yet; commit() shows it."""
        if not self.versions():  # the first writer fixes the number of buckets
            self._commit(lambda state: state if not state.version else None)
        segment_id = self._claim()
        posts = text_postings(docs.select(F.lit(segment_id).alias("segment_id"), "doc_id", "text"), buckets=self._state().buckets)
        # texts are dealt by document, so neither this nor the bucketed write shuffles tokens
        self._write(segment_id, docs.drop("text"), posts)
        return segment_id

    def commit(self, segment_id: str, stream: str | None = None, batch: int = 0) -> bool:
        """Show a prepared segment; False if a stream's batch is in already, then the segment stays unseen."""

        def add(state: Manifest) -> Manifest | None:
            if stream is not None:
                if state.batches.get(stream, -1) >= batch:
                    return None
                state.batches[stream] = batch
            state.segments.append(segment_id)
            return state

        return self._commit(add)

    def append(self, docs: DataFrame, max_segments: int = MAX_SEGMENTS) -> str:
        """Index docs (doc_id, path, text) as a new segment, then merge if there are more than max_segments.

        All of docs: a path may be in several segments. See update().
        """
        segment_id = self.prepare(docs)
        self.commit(segment_id)
        return self.merge() if should_merge(len(self.manifest()), max_segments) else segment_id

    def update(self, docs: DataFrame, max_segments: int = MAX_SEGMENTS) -> str | None:
        """append() of the documents whose path no visible segment has; None if there are none."""
        docs = self.unseen(docs)
        return self.append(docs, max_segments) if docs.limit(1).count() else None

    def unseen(self, docs: DataFrame) -> DataFrame:
        """docs whose path no visible segment has."""
        return docs.join(self.read("docs").select("path"), "path", "left_anti") if self.manifest() else docs

    def ingest_batch(self, docs: DataFrame, stream: str, batch: int, max_segments: int = MAX_SEGMENTS) -> bool:
        """A micro-batch's new documents, once: a batch that the manifest has already changes nothing.

        Of equal paths in a batch the document with the smallest id is taken.
        """
        if self._state().batches.get(stream, -1) >= batch:
            return False
        first = F.row_number().over(Window.partitionBy("path").orderBy("doc_id"))
        docs = self.unseen(docs.withColumn("_first", first).where("_first = 1").drop("_first"))
        if docs.limit(1).count():
            done = self.commit(self.prepare(docs), stream, batch)
        else:
            done = self._commit(lambda s: None if s.batches.get(stream, -1) >= batch else Manifest(s.version, s.segments, s.buckets, s.batches | {stream: batch}))
        if done and should_merge(len(self.manifest()), max_segments):
            self.merge()
        return done

    def build(self, docs: DataFrame) -> str:
        """Start again with docs alone."""
        path, fs = self._path("")
        fs.delete(path, True)
        self._known.clear()
        return self.append(docs)

    def read(self, name: str) -> DataFrame:
        """A table of the visible segments; segment folders that the manifest doesn't list stay unread."""
        ids = self.manifest()
        if not ids:
            raise ValueError("the manifest lists no segment")
        paths = [self._folder(name, s) for s in ids]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)

    def check(self) -> DataFrame:
        """(segment_id, fault, n) of what a whole index never has: postings and ids without a document, or counts that differ."""
        docs, posts, meta = self.read("docs"), self.read("postings"), self.read("segment_meta")
        key = ["segment_id", "doc_id"]
        lost = posts.select(*key).distinct().join(docs.select(*key), key, "left_anti").groupBy("segment_id").agg(F.count("*").alias("n"))
        twice = docs.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").groupBy("segment_id").agg(F.count("*").alias("n"))
        found = docs.groupBy("segment_id").agg(F.count("*").alias("c")).join(meta, "segment_id", "full").where(~F.col("c").eqNullSafe(F.col("doc_count")) & (F.coalesce("doc_count", F.lit(-1)) != F.coalesce("c", F.lit(0))))
        parts = [("posting without document", lost), ("document twice", twice), ("document count", found.withColumn("n", F.lit(1).cast("long")))]
        out = None
        for name, frame in parts:
            own = frame.select("segment_id", F.lit(name).alias("fault"), "n")
            out = own if out is None else out.unionByName(own)
        return out

    def lookup(self, terms: list[str]) -> DataFrame:
        """(segment_id, term, doc_freq, positions, max_tf, min_len) of exact terms: the dictionary's rows alone."""
        return self.read("terms").where(F.col("term").isin(*terms))

    def _sizes(self, ids: list[str]) -> dict[str, tuple[int, int]]:
        """Documents and positions of each segment; segments don't change, so they are read once."""
        new = [s for s in ids if s not in self._known]
        if new:
            paths = [self._folder("segment_meta", s) for s in new]
            rows = self.spark.read.option("basePath", f"{self.root}/segment_meta").parquet(*paths).select("segment_id", "doc_count", "position_count").collect()
            self._known |= {r.segment_id: (r.doc_count, r.position_count) for r in rows}
        return {s: self._known[s] for s in ids}

    def search(self, query: str, mode: str = "and", scorer: str = "bm25", k: int | None = None) -> DataFrame:
        """(segment_id, doc_id, path, score) of the matches in the visible segments, the k best if k is given."""
        return self.plan(query, mode, scorer, k).frame

    def _filters(self, ids: list[str], words: list[str], found: dict[str, dict[str, TermStats]], id_list: int) -> dict:
        """A test of doc_id for each segment, from its rarest term: a list of documents, or a Bloom filter of more for the other terms."""
        rare = {s: rarest(words, found[s]) for s in ids}
        few, left = [], id_list
        for s in sorted(ids, key=lambda s: found[s][rare[s]].doc_freq):
            left -= found[s][rare[s]].doc_freq
            if left >= 0:
                few.append(s)
        own: dict[str, list[int]] = {s: [] for s in few}
        every = None
        for s in few:
            one = self.bucketed("postings", s).where(F.col("term") == rare[s]).select(F.lit(s).alias("s"), "doc_id")
            every = one if every is None else every.unionByName(one)
        for r in every.collect() if every is not None else []:  # id_list rows at most, as the dictionary says
            own[r.s].append(r.doc_id)
        # a term of most documents sorts nothing out
        more = [s for s in ids if s not in own and len(set(words)) > 1 and found[s][rare[s]].doc_freq * 2 <= self._sizes(ids)[s][0]]
        return {s: listed(x) for s, x in own.items()} | {s: bloom(self.bucketed("postings", s), rare[s], found[s][rare[s]].doc_freq) for s in more}

    def plan(self, query: str, mode: str = "and", scorer: str = "bm25", k: int | None = None, id_list: int = ID_LIST) -> SearchPlan:
        """A search, from the dictionary's rows of its terms on.

        Segments that lack a term of an AND or a phrase aren't read. Within a segment the terms of a document meet in its bucket, and an AND
        or a phrase reads of the other terms only what the rarest term's documents can be. With k, the segment with the best bound is
        searched first; others whose bound is below its k-th score aren't read.
        """
        nothing = self.spark.createDataFrame([], RESULT)
        words, ids = query_terms(self.spark, query), self.manifest()
        if not ids:
            raise ValueError("the manifest lists no segment")
        if not words or k == 0:
            return SearchPlan(nothing, [], [], ids if words else [])
        found: dict[str, dict[str, TermStats]] = {s: {} for s in ids}
        for r in self.lookup(list(dict.fromkeys(words))).collect():  # a row a word and segment
            found[r.segment_id][r.term] = TermStats(r.doc_freq, r.max_tf, r.min_len)
        sizes = self._sizes(ids)
        whole = (sum(n for n, _ in sizes.values()), {w: sum(t[w].doc_freq for t in found.values() if w in t) for w in set(words)})
        need = len(set(words)) if mode != "or" else 1
        wanted = [s for s in ids if len(found[s]) >= need]
        absent = [s for s in ids if s not in wanted]
        score = {s: score_of(words, scorer, found[s], *sizes[s], whole) for s in wanted}

        keep = self._filters(wanted, words, found, id_list) if mode != "or" else {}

        def frame(segments: list[str]) -> DataFrame:
            out = nothing
            for i, s in enumerate(segments):
                docs, posts = self.bucketed("docs", s), self.bucketed("postings", s)
                own = search_segment(docs, posts, words, mode, score[s], found[s], keep.get(s))
                own = own.select(F.lit(s).alias("segment_id"), "doc_id", "path", "score")
                out = own if i == 0 else out.unionByName(own)
            return out

        if k is None or len(wanted) < 2:
            every = frame(wanted)
            return SearchPlan(every if k is None else top_k(every, k), wanted, absent, [])
        best = {s: bounded(words, mode, scorer, found[s], *sizes[s], whole) * (1 + SLACK) for s in wanted}
        order = sorted(wanted, key=lambda s: -best[s])
        first = top_k(frame(order[:1]), k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        read = [s for s in order if s == order[0] or first.n < k or best[s] >= first.least]
        return SearchPlan(top_k(frame(read), k), read, absent, [s for s in order if s not in read])

    def stats(self) -> DataFrame:
        """One row: segments, docs, terms (one in two segments counts twice), postings, positions and avg_doc_len."""
        sums = [F.coalesce(F.sum(f"{n}_count"), F.lit(0).cast("long")).alias(f"{n}s") for n in ("doc", "term", "posting", "position")]
        found = self.read("segment_meta").agg(F.count("*").alias("segments"), *sums)
        return found.withColumn("avg_doc_len", F.when(F.col("docs") > 0, F.col("positions") / F.col("docs")).otherwise(0.0))

    def merge(self, keep_old: bool = True) -> str:
        """One new segment in place of all; of a single one its id; an empty store is an error.

        The old folders stay for readers of the old manifest until vacuum(), unless keep_old is false. Segments that others add meanwhile stay
        beside the new one; if others have merged, this merge fails and its segment stays unseen.
        """
        ids = self.manifest()
        if not ids:
            raise ValueError("nothing to merge")
        if len(ids) == 1:
            return ids[0]
        new = self._claim()
        order = self.spark.createDataFrame(list(enumerate(ids)), "ord int, segment_id string")
        docs, posts = merge_segments(order, self.read("docs"), self.read("postings"), new)
        sums = [F.sum(c).alias(c) for c in ("doc_freq", "positions")]
        terms = self.read("terms").groupBy("term").agg(*sums, F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        self._write(new, docs, posts.repartition(self._state().buckets, "doc_id"), terms)

        def replace(state: Manifest) -> Manifest:
            if not set(ids) <= set(state.segments):
                raise RuntimeError("another writer has merged these segments")
            at = state.segments.index(ids[0])
            rest = [s for s in state.segments if s not in ids]
            state.segments = rest[:at] + [new] + rest[at:]
            return state

        self._commit(replace)
        if not keep_old:
            self.vacuum()
        return new

    def vacuum(self, orphans: bool = False) -> None:
        """Delete segment folders that older manifests listed and the newest doesn't; orphans: also those that none listed.

        A folder that no manifest lists may be a running writer's.
        """
        kept = set(self.manifest())
        gone = {s for v in self.versions() for s in self._state(v).segments} - kept
        for name in TABLES:
            path, fs = self._path(name)
            for x in fs.listStatus(path) if fs.exists(path) else []:
                own = x.getPath().getName().removeprefix("segment_id=")
                if own in gone or orphans and own not in kept:
                    fs.delete(x.getPath(), True)


def save_snapshot(docs: DataFrame, posts: DataFrame, path: str) -> None:
    """An index in memory (docs, postings) as one folder; an older snapshot there is replaced."""
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    posts.write.mode("overwrite").parquet(f"{path}/postings")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The inverse of save_snapshot(); a missing or broken one is an error."""
    return spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")


def should_merge(segments: int, most: int = MAX_SEGMENTS) -> bool:
    return segments > most


def next_segment_id(manifest: DataFrame) -> DataFrame:
    """As SegmentStore.next_id(), over a manifest table with segment_id."""
    number = F.coalesce(F.max(segment_number(F.col("segment_id"))), F.lit(0)) + 1
    return manifest.agg(F.format_string("seg_%06d", number).alias("segment_id"))
