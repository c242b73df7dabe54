import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_features import CONFIG, FRAUD, LEGIT, changed

from nearfold import __main__ as commands
from nearfold import session
from nearfold.operators import ivf, kmeans, knn, ranks, scoring
from nearfold.plans.engine import Engine
from nearfold.serving import server
from nearfold.sources import files
from nearfold.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def references(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.random(14)], "fraud" if i % 3 == 0 else "legit") for i in range(120)]
    return spark.createDataFrame(rows, "vec_id long, vector array<double>, label string")


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, [float(x) for x in rng.random(14)]) for i in range(9)], "q_id long, vector array<double>")


def test_exact_knn_is_sorted_and_both_strategies_agree(queries, references):
    a = knn.exact_knn(queries, references, 5).orderBy("q_id", "rank").collect()
    b = knn.exact_knn(queries, references, 5, strategy="blocks").orderBy("q_id", "rank").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    v = {r["vec_id"]: np.array(r["vector"]) for r in references.collect()}
    for q in queries.collect():
        best = sorted((float(((np.array(q["vector"]) - x) ** 2).sum()), i) for i, x in v.items())[:5]
        assert [r["vec_id"] for r in a if r["q_id"] == q["q_id"]] == [i for _, i in best]


def test_knn_errors(queries, references):
    for k in (0, -1, 121):
        with pytest.raises(ValueError):
            knn.exact_knn(queries, references, k)
    with pytest.raises(ValueError):
        knn.exact_knn(queries, references.limit(0), 1)


def test_more_queries_than_are_sent_give_the_same(queries, references, monkeypatch):
    expected = knn.exact_knn(queries, references, 5).orderBy("q_id", "rank").collect()
    monkeypatch.setattr(knn, "SENT_BYTES", 500)
    assert knn.exact_knn(queries, references, 5).orderBy("q_id", "rank").collect() == expected
    # Each pair of blocks passes on k rows for each query, and no more where there are no ties.
    blocks = 120 * (8 * 14 + 16) // 500 + 1
    assert knn.block_join(queries, references, 5, 14).count() <= 9 * blocks * 5


@pytest.mark.parametrize(("labels", "score", "ok"), [("LLLLL", 0.0, True), ("FFFFF", 1.0, False), ("FFLLL", 0.4, True), ("FFFLL", 0.6, False), ("FFFFL", 0.8, False), ("FFL", 2 / 3, False), ("XXL", 0.0, True)])
def test_votes(spark, labels, score, ok):
    rows = [(1, {"F": "fraud", "L": "legit", "X": None}[c]) for c in labels]
    (r,) = scoring.vote(spark.createDataFrame(rows, "q_id int, label string")).collect()
    assert (r["fraud_score"], r["approved"]) == (pytest.approx(score), ok)


def test_no_neighbours_approve(spark):
    votes = scoring.vote(spark.createDataFrame([], "q_id int, label string"))
    (r,) = scoring.decide(spark.createDataFrame([(7,)], "q_id int"), votes).collect()
    assert (r["fraud_score"], r["approved"]) == (0.0, True)


def test_probing_all_partitions_is_quantized_brute_force(spark, queries, references):
    index = ivf.build(references, kmeans.evenly_spaced(references, 8), 14)
    found = {(r["q_id"], r["rank"]): r["distance"] for r in ivf.search_labels(queries, index, 5, 8).collect()}
    for probes, expand in ((8, 0), (2, 0), (1, 30)):
        a, b = (ivf.search_labels(queries, index, 5, probes, expand, strategy=s).orderBy("q_id", "rank").collect() for s in ("columns", "blocks"))
        assert a == b
    lift = lambda x: np.where(np.array(x) < 0, 255, np.minimum(254, np.floor(np.array(x) * 254 + 0.5))).astype(int)
    refs = [lift(r["vector"]) for r in references.collect()]
    for q in queries.collect():
        best = sorted(int(((lift(q["vector"]) - r) ** 2).sum()) for r in refs)[:5]
        assert [found[q["q_id"], k + 1] for k in range(5)] == best


def test_index_comes_back_from_parquet_with_empty_partitions(spark, references, queries, tmp_path):
    centroids = kmeans.centroid_frame(spark, [[0.5] * 14, [99.0] * 14, [0.2] * 14])
    made = ivf.build(references, centroids, 14)
    ivf.write(made, str(tmp_path / "index"))
    index = ivf.load(spark, str(tmp_path / "index"), 14)
    assert (index.partition_count(), index.vector_count()) == (3, 120)
    _, offset, count = index.partition(1)
    assert count == 0 and index.partition(0)[2] * 14 == offset
    assert index.partition(77) == ([0.0] * 14, 0, 0)
    assert index.vectors(0).count() == index.partition(0)[2]
    assert ivf.search_labels(queries, index, 5, 1, expand_to=5).groupBy("q_id").count().where("count != 5").count() == 0
    with pytest.raises(ValueError):
        ivf.load(spark, str(tmp_path / "index"), 13)


def test_probe_count_from_the_environment(monkeypatch):
    for text, n in (("", 8), ("12", 12), ("-3", 8), ("x", 8), ("0", 8)):
        monkeypatch.setenv(ivf.PROBES_ENV, text)
        assert ivf.probe_count() == n
    assert ivf.probe_count(3) == 3


def test_assignment_of_many_vectors(spark):
    vector = lambda i: [((i * j + j) % 251) / 250 for j in range(1, 15)]
    points = spark.createDataFrame([(i, vector(i)) for i in range(600)], "vec_id long, vector array<double>")
    centres = np.array([vector(i * 7) for i in range(32)])
    got = {r["vec_id"]: r["c_id"] for r in kmeans.assign(points, kmeans.centroid_frame(spark, centres.tolist()), 14).collect()}
    for i in range(600):
        d = ((centres - np.array(vector(i))) ** 2).sum(axis=1)
        assert d[got[i]] == pytest.approx(d.min(), abs=1e-12)


def test_lloyd_and_two_levels(spark, references):
    done = kmeans.lloyd(references, kmeans.sample_start(references, 6, 3), 14, 5)
    assert done.count() == 6
    table = kmeans.two_level(references.limit(20), 14, 3, 8, 2).collect()
    assert len(table) == 24 and {r["coarse_id"] for r in table} == {0, 1, 2}
    assert any(set(r["centroid"]) == {0.0} for r in table)


def test_sources(spark, tmp_path):
    rows = [{"vector": [0.01] * 14, "label": "legit"}, {"vector": [0.5] * 14, "label": "fraud"}, {"vector": [0.7] * 14, "label": "odd"}]
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        json.dump(rows, f)
    got = files.load_examples(spark, str(tmp_path / "refs.json.gz")).orderBy("vec_id").collect()
    assert [r["label"] for r in got] == ["legit", "fraud", "odd"] and got[0]["vector"][0] == 0.01
    (tmp_path / "short.json").write_text(json.dumps([{"vector": [1.0], "label": "legit"}]))
    with pytest.raises(Exception, match="expected 14"):
        files.read_references(spark, str(tmp_path / "short.json")).collect()
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        files.load_examples(spark, str(tmp_path / "none.json"))
    (tmp_path / "config.json").write_text(json.dumps({"max_minutes": 1440, "max_amount": 5000}))
    (tmp_path / "risks.json").write_text(json.dumps({"5411": 0.15, "7802": 0.75}))
    config, risks = files.load_resources(spark, str(tmp_path / "config.json"), str(tmp_path / "risks.json"))
    assert config.max_amount == 5000 and risks.count() == 2


def test_binary_index(tmp_path):
    path = str(tmp_path / "index.bin")
    levels = np.arange(42, dtype=np.uint8).reshape(3, 14)
    files.write_binary_index(path, np.ones((2, 14), np.float32), np.array([1, 2]), [(levels[:2], np.array([0, 1])), (levels[2:], np.array([1]))])
    c, n, v, labels = files.read_binary_index(path)
    assert c.shape == (2, 14) and n.tolist() == [1, 2] and (v == levels).all() and labels.tolist() == [0, 1, 1]
    raw = open(path, "rb").read()
    for bad in (raw[:-1], raw[:10], b"XXXX" + raw[4:]):
        open(path, "wb").write(bad)
        with pytest.raises(ValueError):
            files.read_binary_index(path)


def test_binary_index_is_searched_like_the_one_it_was_made_of(spark, references, queries, tmp_path):
    path = str(tmp_path / "index.bin")
    made = ivf.build(references, kmeans.evenly_spaced(references, 8), 14)
    ivf.to_binary(made, path)
    back = ivf.from_binary(spark, path)
    rows = lambda i: [tuple(r)[:2] + (r["distance"], r["label"]) for r in ivf.search_labels(queries, i, 5, 3).orderBy("q_id", "rank").collect()]
    assert rows(back) == rows(made)
    assert [back.partition(p)[1:] for p in range(8)] == [made.partition(p)[1:] for p in range(8)]
    assert back.vector_at(2, 1) == made.vector_at(2, 1) and back.label_at(2, 1) == made.label_at(2, 1)
    with pytest.raises(IndexError):
        made.vector_at(2, 10**6)
    with pytest.raises(ValueError):
        files.write_binary_index(path, np.ones((1, 14), np.float32), np.array([5]), [])
    assert rows(ivf.from_binary(spark, path)) == rows(made)  # what fails leaves the old file


def test_nearest_by_product_and_by_distance():
    rng = np.random.default_rng(3)
    v, c = np.round(rng.random((700, 14)), 1), np.round(rng.random((60, 14)), 1)
    c[7] = c[3]  # ties
    at, d = kmeans.nearest(v, c)
    every = kmeans.distances(v[:, None, :], c[None])
    assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_values_at_ranks(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(x)) for g in (1, 2, None) for x in np.concatenate([np.round(rng.normal(size=300), 1), [1e9, -1e9, 5.0]])] + [(4, 7.0)] * 50
    got = {(r["g"], r["nth"]): r["value"] for r in ranks.values_at(spark.createDataFrame(rows, "g int, v double"), "v", ["g"], lambda n: [F.lit(0), F.floor(n * 0.5), n - 1]).collect()}
    for g in (1, 2, None, 4):
        own = sorted(v for x, v in rows if x == g)
        assert [got[g, k] for k in range(3)] == [own[0], own[len(own) // 2], own[-1]]


def test_server(spark, engine):
    import threading
    import urllib.error
    import urllib.request

    made = server(engine, 0, "127.0.0.1")
    threading.Thread(target=made.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{made.server_address[1]}"
    ask = lambda path, body=None: (lambda r: (r.status, r.read().decode()))(urllib.request.urlopen(url + path, body, timeout=90))
    with pytest.raises(urllib.error.HTTPError, match="503"):
        ask("/ready")
    assert ask("/fraud-score", b"{}") == (200, '{"approved":true,"fraud_score":0.0}')
    engine.prime()
    assert ask("/ready") == (200, '{"status":"ready"}')
    status, body = ask("/fraud-score", json.dumps(FRAUD).encode())
    assert status == 200 and set(json.loads(body)) == {"approved", "fraud_score"}
    assert ask("/fraud-score", b"\xff{") == (200, '{"approved":true,"fraud_score":0.0}')
    with pytest.raises(urllib.error.HTTPError, match="404"):
        ask("/other")
    made.shutdown()
    made.service.close()
    engine.close()


def test_commands(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        json.dump([{"vector": [float(x) for x in rng.random(14)], "label": "fraud" if i % 4 == 0 else "legit"} for i in range(200)], f)
    for output in ("index", "index.bin"):
        made = commands.index(spark, str(tmp_path / "refs.json.gz"), str(tmp_path / output), 4, 3, 2, 42)
        assert made.vector_count() == 200 and commands.load(spark, str(tmp_path / output)).partition_count() == 12
    told = commands.bench(spark, str(tmp_path / "index"), 20, 5, 4, 1)
    assert 0 < told["label_recall"] <= 1 and told["seconds"]["p50"] > 0 and told["memory_mb"]["most"] > 0


def test_sweeping(spark):
    one = session.stored(spark.range(5), "thing")
    session.cut(spark.range(3))
    assert session.sweep(spark) >= 2 and session.sweep(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|not found"):
        one.count()


@pytest.fixture(scope="module")
def engine(spark, references):
    risks = spark.createDataFrame([("5411", 0.15)], "mcc string, risk double")
    return Engine(ivf.build(references, kmeans.evenly_spaced(references, 8), 14), CONFIG, risks, probes=8)


def test_engine_answers_every_request(spark, engine):
    assert engine.ready()[0] == 503
    engine.prime()
    assert engine.ready() == (200, '{"status":"ready"}')
    bodies = [json.dumps(LEGIT), json.dumps(FRAUD), "{oops", json.dumps(changed("transaction.requested_at", "x")), None]
    got = engine.respond(spark.createDataFrame(list(enumerate(bodies)), "q_id int, value string")).orderBy("q_id").collect()
    answers = [json.loads(r["value"]) for r in got]
    assert len(answers) == 5
    assert answers[2:] == [{"approved": True, "fraud_score": 0.0}] * 3
    for a in answers[:2]:
        assert a["approved"] == (a["fraud_score"] < 0.6) and (a["fraud_score"] * 5) % 1 == 0
    engine.close()


def test_stream(spark, engine, tmp_path):
    spark.createDataFrame([(1, json.dumps(LEGIT)), (2, "bad")], "q_id long, value string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("q_id long, value string").json(str(tmp_path / "in"))
    score_stream(stream, engine, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("q_id").collect()
    assert [r["q_id"] for r in got] == [1, 2]
    assert json.loads(got[1]["value"]) == {"approved": True, "fraud_score": 0.0}


def test_order_statistics_and_offsets(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(1, 11)] + [(None,)], "v double")
    r = scoring.order_statistics(rows, "v").first()
    assert (r["avg"], r["p50"], r["p90"], r["p99"], r["min"], r["max"]) == (5.5, 6.0, 10.0, 10.0, 1.0, 10.0)
    counts = spark.createDataFrame([(0, 2), (1, 0), (2, 5)], "part_id int, cnt long")
    assert [x["byte_offset"] for x in scoring.running_offsets(counts, "part_id", F.col("cnt") * 14).orderBy("part_id").collect()] == [0, 28, 28]


def test_recall(spark):
    rows = lambda labels: spark.createDataFrame([(1, x) for x in labels], "q_id int, label string")
    assert scoring.label_recall(rows("aabbb"), rows("abbbb")).first()["recall"] == pytest.approx(0.8)
