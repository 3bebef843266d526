"""The segment store: several writers, what searches read, bounds of the best k, and ingest by stream."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, search
from lodestone.sources import files
from lodestone.sources.segments import Manifest, SegmentStore
from lodestone.streaming.ingest import ingest

DOCS = "doc_id long, path string, text string"


@pytest.fixture()
def store(spark, tmp_path):
    return SegmentStore(spark, f"file://{tmp_path}/index", buckets=2)


def docs(spark, *rows):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows, 1)], DOCS)


def scans(frame):
    """({part of a scan's path or name: rows that it read}, the plan) of a frame that has been computed."""
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        for kind in ("plan", "child"):
            if node.nodeName().endswith("QueryStage") and kind == "plan":
                todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().length())]
        if node.nodeName().startswith("Scan parquet"):
            found.append((node.output().mkString(","), node.metrics().apply("numOutputRows").value()))
    return found, plan.toString()


def test_two_writers_that_began_from_one_manifest(spark, store):
    """Neither overwrites the other's folder, both are seen, and each row is there once."""
    first = store.append(docs(spark, ("base", "a b")))
    assert first == "seg_000001"
    other = SegmentStore(spark, store.root, buckets=2)
    stale = other._state()
    w = store.prepare(docs(spark, ("w", "x y")))
    listed, other.manifest = other.manifest, lambda: ["seg_000001"]  # it doesn't see w's segment
    lost = other.prepare(docs(spark, ("l", "x z")))
    other.manifest = listed
    assert w != lost
    state, calls = other._state, []

    def once():  # the second writer commits from the manifest of before
        calls.append(1)
        return Manifest(stale.version, list(stale.segments), stale.buckets) if len(calls) == 1 else state()

    assert store.commit(w)
    other._state = once
    assert other.commit(lost) and len(calls) == 2
    assert sorted(r.path for r in store.read("docs").collect()) == ["base", "l", "w"]
    assert store.manifest() == ["seg_000001", w, lost] and store.check().collect() == []
    assert sorted(r.path for r in store.search("x").collect()) == ["l", "w"]


def test_writers_in_threads(spark, store):
    store.append(docs(spark, ("base", "a")))
    errors = []

    def write(i):
        try:
            SegmentStore(spark, store.root, buckets=2).append(docs(spark, (f"p{i}", f"a w{i}")), max_segments=99)
        except Exception as e:  # shown by the assertion
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(set(store.manifest())) == 4
    assert sorted(r.path for r in store.search("a").collect()) == ["base", "p0", "p1", "p2"]


def test_merge_beside_another_writer_and_vacuum(spark, store):
    a, b = (store.append(docs(spark, (p, f"a {p}"))) for p in "xy")
    running = store.prepare(docs(spark, ("z", "a z")))  # not committed yet
    merged = store.merge()
    assert store.manifest() == [merged]
    store.vacuum()
    assert store.commit(running) and sorted(r.path for r in store.search("a").collect()) == ["x", "y", "z"]
    names = {x.getPath().getName() for x in store._path("docs")[1].listStatus(store._path("docs")[0])}
    assert names == {f"segment_id={merged}", f"segment_id={running}"}
    late = SegmentStore(spark, store.root, buckets=2)
    late.manifest = lambda: [a, b]
    late.read = lambda name: spark.read.option("basePath", f"{store.root}/{name}").parquet(f"{store.root}/{name}/segment_id={merged}")
    with pytest.raises(RuntimeError):
        late.merge()
    assert store.manifest() == [merged, running]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Two segments of 8000 documents with a common word; a rare one in 12 neighbouring documents, a middling one in 2000."""
    made = SegmentStore(spark, f"file://{tmp_path_factory.mktemp('large')}/index", buckets=2)
    for s in range(2):
        n = spark.range(1, 8001).withColumnRenamed("id", "doc_id")
        words = [F.lit("common stuff"), F.when(F.col("doc_id").between(3000, 3011), "rare"), F.when(F.col("doc_id") <= 2000, "middling"), F.when((F.col("doc_id") % 7 == 0) & F.lit(s == 1), "only")]
        made.append(n.select("doc_id", F.format_string(f"{s}/%05d", "doc_id").alias("path"), F.concat_ws(" ", *words, F.col("doc_id").cast("string")).alias("text")))
    return made


def test_rows_read_follow_the_rarest_term(large):
    read = {}
    for word in ("rare", "middling", "stuff"):
        frame = large.search(f"common {word}")
        n = len(frame.collect())
        found, plan = scans(frame)
        assert "Exchange" not in plan
        read[word] = (n, sum(r for cols, r in found if "path" in cols), sum(r for cols, r in found if "term" in cols))
    assert [n for n, _, _ in read.values()] == [24, 4000, 16000]
    # two segments of two buckets; a page has 1000 rows at most
    assert read["rare"][1] <= 4 * 2000 and read["rare"][2] <= 4 * 4000
    assert read["rare"][1] < read["middling"][1] <= read["stuff"][1] and read["rare"][2] < read["stuff"][2] / 2


def test_absent_terms_read_no_posting(spark, large):
    plan = large.plan("common nowhere")
    assert plan.read == [] and len(plan.absent) == 2 and plan.frame.collect() == []
    assert large.plan("common only").absent == ["seg_000001"] and large.plan('common only', "phrase").read == ["seg_000002"]
    assert large.plan("common only", "or").absent == []
    posts = large.read("postings").where("term = 'nowhere'")  # between two terms that are there
    assert posts.collect() == [] and sum(r for _, r in scans(posts)[0]) == 0


def test_a_filter_of_more_documents_than_are_listed(large):
    for mode, query in (("and", "common middling"), ("phrase", "stuff middling"), ("and", "common rare middling")):
        listed, bloom = (sorted(map(tuple, large.plan(query, mode, id_list=n).frame.collect())) for n in (10**6, 0))
        assert listed == bloom and len(listed) == (0 if "rare" in query else 4000)


def test_phrases_meet_without_a_shuffle(spark, store):
    rows = [("p", "a b a b a"), ("q", "b a"), ("r", "a x b"), ("s", "a a a"), ("t", "b")]
    store.append(docs(spark, *rows))
    for query, want in {"a b": {"p": 2.0}, "a b a": {"p": 2.0}, "a a": {"s": 2.0}, "b a": {"p": 2.0, "q": 1.0}, "a": {"p": 3.0, "q": 1.0, "r": 1.0, "s": 3.0}, "x a": {}}.items():
        frame = store.search(query, "phrase")
        assert {r.path: r.score for r in frame.collect()} == want
        assert "Exchange" not in scans(frame)[1]


@pytest.fixture(scope="module")
def four(spark, tmp_path_factory):
    made = SegmentStore(spark, f"file://{tmp_path_factory.mktemp('four')}/index", buckets=2)
    texts = [[("a1", "x"), ("a2", "x x x x y"), ("a3", "y")], [("b1", "z z z z z z x y"), ("b2", "z x y"), ("b3", "z")], [("c1", "x x x x y"), ("c2", "q")], [("d1", "q q q"), ("d2", "q x " + "w " * 50)]]
    for own in texts:
        made.append(docs(spark, *own))
    return made


@pytest.mark.parametrize("mode, scorer", [("and", "bm25"), ("or", "bm25"), ("or", "tfidf"), ("phrase", "bm25")])
def test_best_k_equal_a_whole_search(four, scorer, mode):
    store = four
    query = "x y" if mode == "phrase" else "x y x"
    whole = store.search(query, mode, scorer)
    ranked = [tuple(r) for r in search.top_k(whole, 100).collect()]
    for k in (0, 1, 3, 50):
        plan = store.plan(query, mode, scorer, k)
        want = ranked[:k]
        assert [tuple(r) for r in plan.frame.collect()] == want
        assert len(plan.read) + len(plan.absent) + len(plan.skipped) == 4
    if mode == "or" and scorer == "bm25":
        assert "seg_000004" in store.plan(query, mode, scorer, 1).skipped


def test_index_faults_are_found(spark, store):
    seg = store.append(docs(spark, ("a", "x y"), ("b", "x")))
    assert store.check().collect() == []
    path = f"{store.root}/docs/segment_id={seg}"
    kept = spark.createDataFrame([r for r in spark.read.parquet(path).collect() if r.path == "a"] * 2, "doc_id long, path string, doc_len long")
    kept.write.mode("overwrite").parquet(path)
    assert sorted((r.fault, r.n) for r in store.check().collect()) == [("document twice", 1), ("posting without document", 1)]


def test_a_batch_played_again_adds_nothing(spark, store):
    batch = docs(spark, ("a", "one"), ("b", "two"), ("b", "two again"))
    assert store.ingest_batch(batch, "s", 0) and not store.ingest_batch(batch, "s", 0)
    ready = store.prepare(docs(spark, ("c", "three")))  # written, then the driver was lost
    assert store.ingest_batch(docs(spark, ("c", "three")), "s", 1) and not store.commit(ready, "s", 1)
    assert store.ingest_batch(docs(spark, ("a", "one")), "s", 2)  # nothing new, yet the batch is known
    assert store._state().batches == {"s": 2} and len(store.manifest()) == 2
    assert sorted((r.path, r.doc_len) for r in store.read("docs").collect()) == [("a", 1), ("b", 1), ("c", 1)]
    assert store.ingest_batch(docs(spark, ("d", "four")), "other", 0, max_segments=2) and len(store.manifest()) == 1
    assert store._state().batches == {"s": 2, "other": 0}


def test_files_are_ingested_as_they_come(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("rust one")
    (folder / "b.o").write_bytes(b"\xff")

    def run():
        stream = files.stream_documents(spark, f"file://{folder}")
        ingest(stream, store, "files", f"file://{tmp_path}/checkpoint", available_now=True).awaitTermination(120)

    run()
    (folder / "c.md").write_text("rust two")
    (folder / "d.txt").write_bytes(b"\xff\xfe")
    run()
    run()
    names = lambda q: sorted(r.path.rsplit("/", 1)[1] for r in store.search(q).collect())
    assert names("rust") == ["a.txt", "c.md"] and names("two") == ["c.md"] and store.read("docs").count() == 2


def test_rejected_files_are_never_opened(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    closed = tmp_path / "huge.o"
    with open(closed, "wb") as f:
        f.truncate(3 << 30)  # no cell can hold it, so reading it would fail
    (tmp_path / ".txt").write_text("hidden")
    assert [r.path.rsplit("/", 1)[1] for r in files.crawl(spark, str(tmp_path)).collect()] == ["a.txt"]
    plan = files.crawl(spark, str(tmp_path))
    assert len(plan.inputFiles()) == 1


@pytest.mark.parametrize("within", [1, 7, 1 << 20])
def test_gaps_of_a_hot_term_in_ranges(spark, within):
    ids = [1, 2, 9, 10, 31, 32, 33, 500]
    rows = [("s", "hot", i, [0, 5]) for i in ids] + [("s", "cold", 7, [1]), ("t", "hot", 3, [0])]
    posts = spark.createDataFrame(rows, "segment_id string, term string, doc_id long, positions array<long>")
    gaps = index.gap_rows(posts, within)
    got = [r.gap for r in sorted(gaps.where("term = 'hot' AND segment_id = 's'").collect(), key=lambda r: r.doc_id)]
    assert got == [b - a for a, b in zip([0, *ids], ids)]
    back = index.ungap_rows(gaps, "doc_id", within)
    assert sorted(map(tuple, back.collect())) == sorted(r[:3] for r in rows)
    assert {tuple(r) for r in index.postings_size(posts, within).collect()} == {tuple(r) for r in index.postings_size(posts).collect()}
    tasks = gaps.where("term = 'hot'")._jdf.queryExecution().executedPlan().toString()
    assert "_range" in tasks
