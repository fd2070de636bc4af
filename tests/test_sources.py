"""Files, archives, sinks, incremental reading and metrics on small fixtures."""

import gzip
import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import analytics, cleaning, gates, metrics, tokens, training
from quarry.sources import files, notices, sinks
from quarry.streaming import incremental


def one(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], f"text {kind}").select(column.alias("x")).first().x


def test_discovery_and_size(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in {"a/x.TXT": b"one", "y.json": b"{}" * 50, "z.bin": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.discovered(spark, str(tmp_path))
    assert sorted(r.format for r in found.select("format").collect()) == ["json", "txt"]
    assert [r.format for r in files.within_size(found, 10).select("format").collect()] == ["txt"]


def test_decoding_and_marks(spark):
    assert one(spark, files.decoded(F.col("text")), b"a\x00b\xff", "binary") == "ab�"
    assert one(spark, files.marked(F.col("text")), "x<bos> a <eos>\n<bos>b<eos>junk<bos> <eos>") == ["a", "b"]
    assert one(spark, files.marked(F.col("text")), "") == []
    assert one(spark, files.chatml(F.col("text")), "<|im_start|>system\nS<|im_end|>") == ["<|im_start|>system\nS<|im_end|>"]


def test_archives(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("ok.txt", "hello")
        z.writestr("../out.txt", "no")
    rows = [("p.gz", gzip.compress(inner.getvalue())), ("plain", b"x"), ("none", None), ("cut.gz", gzip.compress(b"y" * 5000)[:-20]), ("bad.zip", b"PK\x03\x04nothing")]
    found = files.members(spark.createDataFrame(rows, "path string, content binary"))
    assert sorted((r.path, r.content and bytes(r.content)) for r in found.collect()) == [("bad.zip", None), ("cut.gz", None), ("p/ok.txt", b"hello"), ("plain", b"x")]


def test_xml_months_lists(spark):
    assert one(spark, files.xml_text(F.col("text")), b"<a>x<b>y</b>z</a>", "binary") == "y\nz\nx"
    assert one(spark, files.xml_text(F.col("text")), b"<a", "binary") is None
    assert [tuple(r) for r in files.months(spark, "2023-12", "2024-02").collect()] == [(2023, 12), (2024, 1), (2024, 2)]
    lines = spark.createDataFrame([(" Foo ",), ("# no",), ("",), (None,)], "value string")
    assert [r.value for r in files.listed(lines).collect()] == ["foo"]


def test_volume_cap(spark):
    rows = spark.createDataFrame([(k, 10) for k in range(100)] + [(None, None)], "k long, n long")
    assert files.volume_capped(rows, "k", "n", 95).where("n is not null").count() == 10
    assert files.volume_capped(rows.limit(0), "k", "n", 95).count() == 0


def test_chunks(spark, tmp_path):
    docs = spark.createDataFrame([("a" * 10,), ("b" * 10,), ("c" * 50,), (None,), ("d",)], "text string").coalesce(1)
    found = sinks.chunked(docs, 45).collect()
    assert [r.chunk for r in found] == [0, 0, 1, 2]
    sinks.write_chunks(docs, str(tmp_path / "out"), 45)
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_watching(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    seen = []
    for name, text in [("a", "1"), ("b", "2")]:
        (source / name).write_text(text)
        run = incremental.watch(spark, str(source), str(tmp_path / "journal"), str(tmp_path / "check"), "v1", lambda x: seen.extend(bytes(r.content) for r in x.collect()))
        run.awaitTermination(60)
    assert seen == [b"1", b"2"]


def test_lines(spark):
    assert one(spark, cleaning.without_corrupted_lines(F.col("text")), "fine\nǟǺǼȀ\n\nend") == "fine\n\nend"
    assert one(spark, cleaning.without_law_references(F.col("text")), "a ELI: http://data.europa.eu/eli/x b") == "a x b"


def test_metrics(spark):
    r = metrics.retrieval(spark.createDataFrame([(1,), (3,), (None,), (11,)], "rank int")).first()
    assert (r.recall_1, r.recall_5, r.mrr) == (0.25, 0.5, pytest.approx((1 + 1 / 3) / 4)) and r.ndcg == pytest.approx((1 + 1 / 2) / 4)
    r = metrics.paired(spark.createDataFrame([("a", 1, 3.0), ("a", 2, 5.0), ("b", 1, 2.0), ("b", 2, 2.0), ("b", 3, 9.0)], "variant string, seed int, value double"), "a", "b").first()
    assert (r.n, r.mean, r.positive) == (2, 2.0, 2) and r.t == pytest.approx(2.0)
    assert metrics.bits_per_byte(spark.createDataFrame([(math.log(2) * 8, "ab")], "nats double, text string")).first()[0] == pytest.approx(4)
    cases = spark.createDataFrame([("x", 0.9, True), ("x", 0.8, False), ("x", 0.8, True), ("y", 0.0, False)], "kind string, confidence double, correct boolean")
    found = {r.kind: r for r in metrics.decisions(cases, "kind").collect()}
    assert found["x"].aurc == pytest.approx((0 + 0.5 / 2 + 1 / 3) / 3) and found["y"].ece == 0.0 and found[None].cases == 4


def test_choices_and_preferences(spark):
    rows = [(1, 0, -4.0, 8, 0), (1, 1, -3.0, 3, 0), (2, 0, -1.0, 1, 0), (2, 1, -1.0, 1, 0)]
    r = metrics.choices(spark.createDataFrame(rows, "item int, option int, logp double, chars int, gold int")).first()
    assert (r.n, r.whole, r.per_char) == (2, 0.5, 1.0)
    r = metrics.preferences(spark.createDataFrame([(1, -1.0, -2.0), (1, -3.0, -2.0), (2, -1.0, -4.0)], "batch int, chosen double, rejected double")).first()
    assert (r.accuracy, r.margin) == (0.75, 1.5)


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"prompt": "p", "response": "r"}]))
    (tmp_path / "b.json").write_text(json.dumps({"x": [{"prompt": "1", "response": "2"}], "y": [{"prompt": "3", "response": None}]}))
    assert [tuple(r) for r in files.prompt_rows(spark, str(tmp_path / "a.json")).collect()] == [("p", "r")]
    assert [tuple(r) for r in files.prompt_rows(spark, str(tmp_path / "b.json")).collect()] == [("1", "2"), ("3", None)]
    (tmp_path / "c.jsonl").write_text('{"id": 1, "gold": "{\\"a\\": 0.5}"}\n\n{"id": 2, "gold": null}\n')
    assert files.lines_read(spark, str(tmp_path / "c.jsonl")).count() == 2
    found = {r.id: r.gold for r in files.cases(spark, str(tmp_path / "c.jsonl"), {"gold": "map<string,double>"}).collect()}
    assert found == {1: {"a": 0.5}, 2: None}
    spark.range(3).write.parquet(str(tmp_path / "d.parquet"))
    assert files.cases(spark, str(tmp_path / "d.parquet")).count() == 3


def test_notice_forms(spark):
    latin = "*** H ***\n\n1.00/1\nTI: Citt\u00e0: lavori\n  pubblici\nTX: uno\n due\n\n1.00/2\nND: 7\nAB: x\n\n1.00/3\nNO: nothing".encode("latin-1")
    rows = spark.createDataFrame([("a/IT_1.ISO", latin), ("b/none", b"")], "path string, content binary")
    found = sorted(tuple(r) for r in notices.legacy_notices(rows).collect())
    assert found == [("7", "", "x", "", "a/IT_1.ISO"), ("IT_1", "Citt\u00e0: lavori\npubblici", "", "uno\ndue", "a/IT_1.ISO")]
    assert [one(spark, notices.sniffed(F.col("text")), x, "binary") for x in (b"<?xml?>", b"x\n12.3/4", b"TI: a", b"no")] == ["xml", "txt", "txt", None]
    assert notices.xml_notices(spark.createDataFrame([("x.xml", b"<a"), ("y.xml", b"<a LG='EN'>an English text of some length</a>")], "path string, content binary")).count() == 0
    assert one(spark, notices.notice_document(F.col("text"), F.lit(""), F.lit("b")), "a") == "a\n\nb"


def test_token_shards(spark):
    docs = spark.createDataFrame([([1, 2, 3],), ([],), (None,), ([70_000],), (list(range(100)),)], "ids array<long>").coalesce(1)
    shards = sinks.token_shards(docs, 40, begin=9, end=8).cache()
    assert [(r.tokens, r.bytes) for r in shards.orderBy("shard").collect()] == [(10, 40), (102, 408)]
    read = sinks.shard_tokens(shards, rows=50).orderBy("shard", "first").collect()
    assert [x for r in read for x in r.ids] == [9, 1, 2, 3, 8, 9, 8, 9, 70_000, 8, 9, *range(100), 8]
    with pytest.raises(Exception, match="does not fit"):
        sinks.token_shards(docs, 40, wide=False).collect()
    with pytest.raises(Exception, match="not what was written"):
        sinks.shard_tokens(shards.withColumn("content", F.lit(b"1234"))).collect()


def test_written_forms(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'q"x\ny'), ("b", None)], "k string, v string")
    sinks.write_json(rows, str(tmp_path / "j"))
    assert sorted(json.loads(r.value)["k"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ["a", "b"]
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "c")).where("k = 'a'").first().v == 'q"x\ny'
    made = []
    work = lambda x: made.append(1) or x
    for _ in range(2):
        assert sinks.cached(rows, str(tmp_path / "cache"), "h1", work).count() == 2
    assert made == [1]
    assert [r.value for r in sinks.marked_documents(rows, "v").collect()] == ['<bos>\nq"x\ny\n<eos>\n\n']


def test_temperature(spark):
    pick = np.random.default_rng(1)
    logits = pick.standard_normal((400, 3)) * 3
    shares = np.exp(logits / 2.5)
    shares /= shares.sum(axis=1, keepdims=True)
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(logits, shares, strict=True)], "logits array<double>, target array<double>")
    assert analytics.best_temperature(rows) == pytest.approx(2.5, rel=1e-3)
    assert analytics.best_temperature(rows.limit(0)) == 1.0


def test_specifications(spark):
    assert analytics.mix_spec("a/b=0.5, c=x=2 ,") == [("a/b", 0.5), ("c=x", 2.0)]
    for wrong in ("a", "a=0", "=1", "a=1,a=2"):
        with pytest.raises(ValueError):
            analytics.mix_spec(wrong)
    old = spark.createDataFrame([("f", 1, "c", 9)], "folder string, seed int, content string, base long")
    with pytest.raises(Exception, match="have changed"):
        analytics.carried(old, spark.createDataFrame([("f", 2, "c")], "folder string, seed int, content string"), ("seed",)).collect()
    assert sum(tokens.merge_weights(10, "1sqrt")) == pytest.approx(1) and tokens.merge_weights(4) == [0.25] * 4
    with pytest.raises(Exception, match="longer than the budget"):
        training.budget_batches(spark.createDataFrame([(0, 9)], "place long, n int"), "n", "place", 8).collect()


def test_flops(spark):
    terms = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (2, 1, 1.0)], "id int, term int, weight double")
    assert metrics.flops_penalty(terms, 2).first().penalty == pytest.approx(9 + 0.25)


def test_pages(spark):
    words = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    rows = [("a", k, f"Head {k}\n{words(k)}\nELI: http://data.europa.eu/eli/r\nmore {words(k)} of page\nfoot") for k in range(4)]
    rows += [("a", 9, "an..35 n1 9x " * 10), ("b", 0, "an..35 n1 9x " * 10), ("c", 0, None), ("c", 1, "x")]
    found = {r.path: r.text for r in gates.paged_documents(spark.createDataFrame(rows, "path string, page int, text string")).collect()}
    assert found.keys() == {"a", "c"} and found["c"] == "x"
    assert found["a"] == "\n\n".join(f"{words(k)}\nr\nmore {words(k)} of page" for k in range(4))


def test_entities(spark):
    docs = spark.createDataFrame([(1, "Anna 😀 lives in Rome"), (2, "nobody"), (3, None)], "doc_id long, text string")
    entities = spark.createDataFrame([(1, 0, 4, "PERSON", 0.9), (1, 2, 6, "LOCATION", 0.9), (1, 16, 20, "LOCATION", 0.5), (1, 5, 6, "DATE_TIME", 0.1)], "doc_id long, start int, end int, label string, score double")
    assert sorted((r.doc_id, r.text) for r in gates.entities_redacted(docs, entities).collect()) == [(1, "<PERSONA> 😀 lives in <LUOGO>"), (2, "nobody"), (3, None)]


def test_gates(spark):
    assert [one(spark, gates.perplexity_gate(F.col("text")), x, "double") for x in (4.9, 5.0, 1500.5, None)] == ["low_perplexity", None, "high_perplexity", None]
    assert gates.unigram_perplexity(spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")).where("perplexity is null").count() == 2
