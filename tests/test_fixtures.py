"""Golden cases of the operators and properties of the codecs."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import codec, ids, text
from lodestone.operators import blocks, cluster, index, kv, search
from lodestone.sources import block_store, files, segments
from lodestone.sources.segments import SegmentStore, should_merge
from lodestone.streaming import kv as kv_stream


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("s", 1, "a.txt", "rust memory safety"), ("s", 2, "b.txt", "Rust distributed !!! system"), ("s", 3, "c.txt", "python memory")], "segment_id string, doc_id long, path string, text string")
    return docs, index.tokens(docs)


@pytest.mark.parametrize("query, mode, paths", [("rust", "and", "ab"), ("golang", "and", ""), ("!!!", "and", ""), ("Rust!!! MEMORY", "or", "abc"), ("rust memory", "and", "a"), ("rust memory safety", "phrase", "a"), ("rust safety", "phrase", ""), ("distributed system", "phrase", "")])
@pytest.mark.parametrize("scorer", ["bm25", "tfidf"])
def test_search(corpus, query, mode, paths, scorer):
    got = sorted(r.path[0] for r in search.search(*corpus, query, mode, scorer).collect())
    assert got == list(paths)


def test_phrase_counts_and_ties(spark):
    docs = spark.createDataFrame([("s", 1, "b", "white whale x y white whale"), ("s", 2, "a", "the the the")], "segment_id string, doc_id long, path string, text string")
    found = index.tokens(docs)
    assert [(r.path, r.score) for r in search.search(docs, found, "white whale", "phrase").collect()] == [("b", 2.0)]
    assert [(r.path, r.score) for r in search.search(docs, found, "the the", "phrase").collect()] == [("a", 2.0)]
    scores = spark.createDataFrame([("s", 1, "b", 1.0), ("s", 2, "a", 1.0), ("s", 3, "c", 3.0)], search.RESULT)
    assert [r.path for r in search.top_k(scores, 2).collect()] == ["c", "a"] and search.top_k(scores, 0).collect() == []


def test_tokens(spark):
    rows = [(1, "hello, world!"), (2, "!!! hello ???"), (3, "  a b"), (4, "a b"), (5, "don't"), (6, "ΟΣ"), (7, None), (8, "")]
    docs = spark.createDataFrame([("s", i, t) for i, t in rows], "segment_id string, doc_id long, text string")
    got = {}
    for r in index.tokens(docs).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.term, r.pos))
    assert got == {1: [("hello", 0), ("world", 1)], 2: [("hello", 1)], 3: [("a", 0), ("b", 1)], 4: [("a", 0), ("b", 1)], 5: [("dont", 0)], 6: [("οσ", 0)]}


def test_query_syntax(spark):
    assert text.parse_query('"a b"') == ("a b", "phrase") and text.parse_query("a", "ANY") == ("a", "or")
    assert text.query_terms(spark, "Rust!!! --- MEMORY") == ["rust", "memory"]
    with pytest.raises(ValueError):
        text.parse_mode("near")


@pytest.mark.parametrize("word", ["हिन्दी", "ภาษาไทย", "İstanbul", "ΟΔΟΣ", "Straße", "don't", "x\x1cy", "１２３"])
def test_query_words_are_index_terms(spark, word):
    """Letters with vowel signs, a dotted capital I, a sigma at the end and odd separators: the query finds the text."""
    docs = spark.createDataFrame([("s", 1, "a", f"before {word}, after"), ("s", 2, "b", "other")], "segment_id string, doc_id long, path string, text string")
    found = index.tokens(docs)
    terms = text.query_terms(spark, word)
    assert terms and set(terms) <= {r.term for r in found.where("doc_id = 1").collect()}
    for mode in ("and", "phrase"):
        assert [r.path for r in search.search(docs, found, word, mode).collect()] == ["a"]


@given(st.lists(st.integers(0, 2**63 - 1)))
def test_varints_round_trip(values):
    assert codec.decode_varints(codec.encode_varints(values)) == values


@given(st.dictionaries(st.integers(0, 10**9), st.lists(st.integers(0, 10**6), unique=True).map(sorted)))
def test_postings_round_trip(postings):
    assert codec.decode_postings(codec.encode_postings(postings)) == postings


def test_broken_codes():
    assert codec.decode_varints(b"\x80") is None and codec.decode_varints(b"") == []
    assert codec.decode_postings(codec.encode_postings({1: [0]}) + b"\x01") is None


def test_gaps(spark):
    row = spark.createDataFrame([([1, 5, 9, 13, 20],)], "x array<bigint>").select(codec.gap_encode(F.col("x")).alias("g"), codec.gap_decode(codec.gap_encode(F.col("x"))).alias("x")).first()
    assert (row.g, row.x) == ([1, 4, 4, 4, 7], [1, 5, 9, 13, 20])


def test_ids(spark):
    row = spark.createDataFrame([("momsbestpicture",)], "k string").select(ids.cas_path(F.col("k")).alias("p")).first()
    assert row.p == "68044/29f74/181a6/3c50c/3d81d/733a1/2f14a/353ff"


def test_segments(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "index"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert store.build(frame([(1, "a", "rust one"), (2, "b", "memory")])) == "seg_000001"
    assert store.append(frame([(1, "c", "rust two")])) == "seg_000002"
    assert store.manifest() == ["seg_000001", "seg_000002"] and store.read("segment_meta").count() == 2
    assert store.merge() == "seg_000003" and store.manifest() == ["seg_000003"] and store.merge() == "seg_000003"
    joined = store.read("postings").where("term = 'rust'").join(store.read("docs"), ["segment_id", "doc_id"])
    assert sorted((r.doc_id, r.path) for r in joined.collect()) == [(1, "a"), (3, "c")]
    assert should_merge(9) and not should_merge(8)
    assert store.update(frame([(1, "a", "changed"), (2, "c", "rust two")])) is None
    assert store.update(frame([(1, "a", "changed"), (2, "d", "rust rust ferris")])) == "seg_000004"
    assert {r.path: r.doc_len for r in store.read("docs").collect()} == {"a": 2, "b": 1, "c": 2, "d": 3}
    before = {mode: sorted((r.path, r.score) for r in store.search("rust two", mode, "tfidf").collect()) for mode in ("and", "or", "phrase")}
    assert [p for p, _ in before["or"]] == ["a", "c", "d"] and before["phrase"] == [("c", 1.0)] and store.search("!!!").collect() == []
    assert [r.path for r in store.search("rust", "or", k=1).collect()] == [min(store.search("rust", "or").collect(), key=lambda r: (-r.score, r.path)).path]
    old = store.manifest()
    assert store.merge(keep_old=True) == "seg_000005"
    assert {mode: sorted((r.path, r.score) for r in store.search("rust two", mode, "tfidf").collect()) for mode in before} == before
    row = store.stats().first()
    assert (row.segments, row.docs, row.terms, row.postings, row.positions, row.avg_doc_len) == (1, 4, 5, 7, 8, 2.0)
    assert spark.read.parquet(f"{store.root}/docs/segment_id={old[0]}").count() == 3
    store.vacuum()
    assert sorted(p.name for p in (tmp_path / "index" / "docs").iterdir()) == ["segment_id=seg_000005"]
    segments.save_snapshot(store.read("docs"), store.read("postings"), str(tmp_path / "snap"))
    segments.save_snapshot(store.read("docs"), store.read("postings"), str(tmp_path / "snap"))
    assert [x.count() for x in segments.load_snapshot(spark, str(tmp_path / "snap"))] == [4, 7]
    with pytest.raises(ValueError):
        SegmentStore(spark, str(tmp_path / "none")).merge()


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"x", "b.o": b"x", "README.TXT": b"x", ".txt": b"x", "d/m.rs": b"y", "bad.md": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1] for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt", "m.rs"}
    with pytest.raises(Exception):
        files.read_documents(spark, str(tmp_path), on_invalid="error").collect()


SCRIPT = [("SETEX", "v", 10, 1000), ("GET", None, None, 1009), ("TTL", None, None, 1009), ("GET", None, None, 1010), ("TTL", None, None, 1010), ("SETEX", "w", 10, 2000), ("PERSIST", None, None, 2005), ("TTL", None, None, 3000), ("PERSIST", None, None, 3000), ("EXISTS", None, None, 3000), ("DEL", None, None, 3001), ("DEL", None, None, 3002), ("SETEX", "z", 5, 4000), ("DEL", None, None, 4010), ("SETEX", "z", 5, 5000), ("GET", None, None, 5005), ("DEL", None, None, 5006)]
REPLIES = ["+OK", "$v", ":1", "$nil", ":-2", "+OK", ":1", ":-1", ":0", ":1", ":1", ":0", "+OK", ":1", "+OK", "$nil", ":0"]


def test_kv_script(spark):
    rows = [(i, t, op, "k", v, ttl) for i, (op, v, ttl, t) in enumerate(SCRIPT)]
    ops = spark.createDataFrame(rows, "seq long, now_ms long, op string, key string, value string, ttl_ms long")
    want = [(i, r + "\r\n") for i, r in enumerate(REPLIES)]
    assert sorted((r.seq, r.response) for r in kv.responses(ops).collect()) == want
    assert sorted((r.seq, r.response) for r in kv_stream.responses_batch(ops).collect()) == want


def sequential(log):
    """Replies of one pass over the whole log, with the eviction of the reference semantics."""
    store, out = {}, []

    def late(key, now):
        return key in store and store[key][1] is not None and now >= store[key][1]

    for seq, now, op, key, value, ttl in log:
        if op in ("GET", "EXISTS", "TTL", "PERSIST") and late(key, now):
            del store[key]
        if op in ("KEYS", "DBSIZE"):
            for k in [k for k in store if late(k, now)]:
                del store[k]
        if op in ("SET", "SETEX"):
            store[key], reply = (value, now + ttl if op == "SETEX" else None), "+OK"
        elif op == "CLEAR":
            store, reply = {}, "+OK"
        elif op == "DEL":
            reply = f":{int(store.pop(key, None) is not None)}"
        elif op == "GET":
            reply = f"${store[key][0]}" if key in store else "$nil"
        elif op == "EXISTS":
            reply = f":{int(key in store)}"
        elif op == "TTL":
            reply = ":-2" if key not in store else ":-1" if store[key][1] is None else f":{store[key][1] - now}"
        elif op == "PERSIST":
            reply = f":{int(key in store and store[key][1] is not None)}"
            if key in store:
                store[key] = (store[key][0], None)
        else:
            reply = {"PING": "+PONG", "DBSIZE": f":{len(store)}", "KEYS": "$" + " ".join(sorted(store))}[op]
        out.append((seq, reply + "\r\n"))
    return out, store


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_equal_a_sequential_fold(spark, monkeypatch, seed):
    import random

    monkeypatch.setattr(kv, "SLICE", 64)  # as-of lookups and sums go over many slices
    rng, log, now = random.Random(seed), [], 0
    for seq in range(1500):
        now += rng.choice([0, 0, 1, 3, 20])
        op = rng.choices(list(kv.ARITY), [1, 6, 4, 5, 3, 8, 4, 5, 1, 1, 0.3 if seed else 0])[0]
        alone = op in ("PING", "KEYS", "DBSIZE", "CLEAR")
        log.append((seq, now, op, None if alone else f"k{rng.randrange(12)}", f"v{seq}", rng.choice([0, 5, 40, 200])))
    ops = spark.createDataFrame(log, "seq long, now_ms long, op string, key string, value string, ttl_ms long")
    want, store = sequential(log)
    assert sorted((r.seq, r.response) for r in kv.responses(ops).collect()) == want
    live = {k: v for k, v in store.items() if v[1] is None or now < v[1]}
    assert {r.key: (r.value, r.expires_at_ms) for r in kv.state(ops, F.lit(now)).collect()} == live


def test_health_stream(spark, tmp_path):
    from lodestone.streaming import health

    beats = [(1, "a", "h:1", 10, 1, 5), (2, "b", "h:2", 10, 2, 6), (3, "a", "h:9", 10, 7, 4), (4, "", "x", 1, 1, 1), (5, "c", "", 1, 1, 1)]
    frame = spark.createDataFrame(beats, "arrival_seq long, id string, addr string, capacity long, used long, t long").withColumn("time", F.timestamp_seconds("t")).drop("t")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = []
    run = health.node_states(stream, timers=False).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.id, r.addr, r.used, r.state) for r in got) == [("a", "h:9", 7, "alive"), ("b", "h:2", 2, "alive")]


def test_kv_stream(spark, tmp_path):
    rows = [(i, t, op, "k", v, ttl) for i, (op, v, ttl, t) in enumerate(SCRIPT)]
    ops = spark.createDataFrame(rows, "seq long, now_ms long, op string, key string, value string, ttl_ms long")
    for a, b in ((0, 9), (9, 99)):
        ops.where(F.col("seq").between(a, b - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "in"))
        run = kv_stream.responses(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.seq, r.response) for r in got) == [(i, r + "\r\n") for i, r in enumerate(REPLIES)]


def test_blocks(spark):
    df = spark.createDataFrame([("p", bytearray(b"hello-world")), ("e", bytearray()), ("n", None), ("x", bytearray(b"0123456789"))], "path string, content binary")
    found = blocks.split_blocks(df, 5)
    assert [bytes(r.data) for r in found.where("path = 'p'").orderBy("idx").collect()] == [b"hello", b"-worl", b"d"]
    assert found.where("path IN ('e', 'n')").count() == 0 and found.where("path = 'x'").count() == 2
    assert {r.path: bytes(r.content) for r in blocks.reassemble(found).collect()} == {"p": b"hello-world", "x": b"0123456789"}


def test_placement_and_health(spark):
    rows = [("node-1", 1000, 900, "alive"), ("node-2", 1000, 100, "alive"), ("node-3", 1000, 500, "alive"), ("node-4", 1000, 0, "dead")]
    nodes = spark.createDataFrame(rows, "id string, capacity long, used long, state string")
    assert [r.id for r in cluster.place_block(nodes, 100, 2).collect()] == ["node-2", "node-3"]
    status = lambda size, r: cluster.place_status(nodes, size, r).first().status
    assert (status(100, 0), status(100, 4), status(2000, 1), status(1, 3)) == ("not_enough_nodes", "not_enough_nodes", "no_alive_nodes", "ok")
    seen = spark.createDataFrame([("a", 95), ("b", 85), ("c", 10), ("d", None)], "id string, t long").select("id", F.timestamp_seconds("t").alias("last_seen"), F.lit("dead").alias("state"))
    got = {r.id: r.state for r in cluster.evaluate_health(seen, F.timestamp_seconds(F.lit(100)), 15, 90).collect()}
    assert got == {"a": "alive", "b": "suspect", "c": "dead", "d": "unknown"}


def test_block_store(spark, tmp_path):
    store = block_store.BlockStore(spark, str(tmp_path / "b"), capacity=100)
    frame = lambda *rows: spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in rows], "id string, data binary")
    assert store.read().count() == 0 and not store.exists("a") and store.usage().first().used == 0
    store.put(frame(("a", b"hello"), ("b", b"x"), ("b", b"x"), ("e", b"")))
    store.put(frame(("a", b"again!")))
    store.delete(frame(("b", None), ("missing", None)))
    assert store.get("a") == b"again!" and store.get("e") == b"" and not store.exists("b") and not store.exists("")
    with pytest.raises(FileNotFoundError):
        store.get("b")
    with pytest.raises(ValueError):
        store.get("")
    for bad in (("", b"x"), (None, b"x"), ("c", None)):
        with pytest.raises(Exception):
            store.put(frame(bad, ("z", b"z")))
    assert not store.exists("z")
    row = store.usage().first()
    assert (row.capacity, row.used, row.blocks) == (100, 6, 2)
    store.put(frame(("b", b"back")))
    before = sorted((r.id, r.size, r.checksum) for r in store.stat().collect())
    store.compact()
    assert sorted((r.id, r.size, r.checksum) for r in store.stat().collect()) == before and [x[0] for x in before] == ["a", "b", "e"]
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == ["gone", "put"] and len(list((tmp_path / "b" / "put").glob("v=*"))) == 1


def test_file_store(spark, tmp_path):
    import io

    store = block_store.FileStore(spark, str(tmp_path / "f"))
    nodes = spark.createDataFrame([("n1", "h1", 100, 92, "alive"), ("n2", "h2", 100, 0, "alive"), ("n3", "h3", 100, 0, "dead"), ("n4", "h4", 100, 90, "alive")], "id string, addr string, capacity long, used long, state string")
    frame = lambda rows: spark.createDataFrame([(p, None if x is None else bytearray(x)) for p, x in rows], "path string, content binary")
    put = lambda rows, n=2, r=2, size=5: {x.path: x.status for x in store.put(frame(rows), nodes if n else nodes.limit(0), r, size).collect()}
    assert put([("/a", b"hello-world"), ("/e", b""), ("/n", None), ("", b"x")]) == {"/a": "ok", "/e": "ok", "/n": "ok", "": "empty_path"}
    assert put([("/x", b"0123456789abc")], size=11) == {"/x": "not_enough_nodes"} and put([("/x", b"y")], n=0) == {"/x": "no_alive_nodes"}
    assert put([("/x", b"y")], r=0) == {"/x": "not_enough_nodes"} and put([("/x", b"y")], r=4) == {"/x": "not_enough_nodes"}
    got = {r.path: r for r in store.stat().collect()}
    assert sorted(got) == ["/a", "/e", "/n"] and got["/a"].size == 11 and got["/e"].blocks == []
    assert [[n.node_id for n in b.nodes] for b in got["/a"].blocks] == [["n2", "n4"]] * 3
    out = io.BytesIO()
    assert store.get("/a", out) == 11 and out.getvalue() == b"hello-world" and store.get("/e", io.BytesIO()) == 0
    assert put([("/a", b"hello")]) == {"/a": "ok"}
    assert {r.path: bytes(r.content) for r in store.read().collect()} == {"/a": b"hello"}
    assert sorted(r.size for r in store.orphans().collect()) == [1, 5]
    store.delete(spark.createDataFrame([("/a",), ("/none",)], "path string"))
    assert sorted(r.path for r in store.stat().collect()) == ["/e", "/n"] and store.orphans().count() == 3
    with pytest.raises(FileNotFoundError):
        store.get("/a", io.BytesIO())


def test_registry_and_urls(spark):
    nodes = spark.createDataFrame([("a", "alive"), ("b", "alive")], "id string, state string")
    assert {r.id: r.state for r in cluster.update_state(nodes, "b", "dead").collect()} == {"a": "alive", "b": "dead"}
    with pytest.raises(ValueError):
        cluster.update_state(nodes, "b", "gone")
    asked = spark.createDataFrame([("b",), ("b",), ("c",)], "id string")
    assert [r.id for r in cluster.get_nodes(nodes, asked).collect()] == ["b"] and [r.id for r in cluster.unregister(nodes, asked).collect()] == ["a"]
    urls = spark.createDataFrame([("/files/x/y",), ("/files/",), ("/other",)], "u string")
    assert [r.p for r in urls.select(ids.path_from_url(F.col("u")).alias("p")).collect()] == ["/x/y", None, "//other"]
