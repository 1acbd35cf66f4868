import hashlib
import json

from folioscope.sources import files, sinks
from folioscope.streaming.ingest import file_stream, ingest


def test_scan_and_cache(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, raw in (("a b.pdf", b"one"), ("sub/c.DOCX", b"two"), ("d.txt", b"no")):
        (tmp_path / "in" / name).write_bytes(raw)
    found = files.scan(spark, str(tmp_path / "in")).collect()
    assert {(r.relative_path, r.title, r.format, r.sha256) for r in found} == {("a b.pdf", "a b", "pdf", hashlib.sha256(b"one").hexdigest()), ("sub/c.DOCX", "c", "docx", hashlib.sha256(b"two").hexdigest())}
    keyed = files.with_cache_key(files.scan(spark, str(tmp_path / "in")))
    cache = keyed.where("format = 'pdf'")
    assert [r.format for r in files.new_work(keyed, cache).collect()] == ["docx"]
    hit = files.from_cache(keyed.select("cache_key", "relative_path", "title"), cache.select("cache_key", "sha256")).first()
    assert hit.cache_hit and hit.source_id == "S-" + hashlib.sha256(b"a b.pdf").hexdigest()[:16]


def test_json_sink(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "out"))
    assert [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()] == [{"a": 1, "b": "é"}]


def test_ingest_reads_each_content_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest(file_stream(spark, str(tmp_path / "in"), "*.bin"), lambda f: f.selectExpr("cache_key", "length(content) AS n"), str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in/a.bin").write_bytes(b"xyz")
    (tmp_path / "in/b.bin").write_bytes(b"xyz")
    run()
    (tmp_path / "in/c.bin").write_bytes(b"xyz")
    (tmp_path / "in/d.bin").write_bytes(b"other")
    run()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [3, 5]
