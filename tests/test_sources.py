"""Connectors: failure isolation, and the data source with its pruning."""

from quirelake.plans.feeds import SAMPLES
from quirelake.sources.registry import Connector, PayloadSource, scan_all


def test_scan_all_isolates_failures(spark, tmp_path):
    (tmp_path / "doaj.jsonl").write_text(SAMPLES["doaj"] + "\n" + SAMPLES["doaj"].replace('"41"', '"42"') + "\n")
    found, status = scan_all(spark, [Connector("doaj", str(tmp_path / "doaj.jsonl")), Connector("core", str(tmp_path / "missing")), Connector("arxiv", "x", enabled=False)])
    assert sorted(r.id for r in found.collect()) == ["doaj:41", "doaj:42"]
    assert {(r.source, r.ok) for r in status.collect()} == {("doaj", True), ("core", False), ("arxiv", False)}


def test_scan_all_isolates_what_fails_while_read(spark, tmp_path):
    (tmp_path / "doaj.jsonl").write_text(SAMPLES["doaj"] + "\n")
    broken = tmp_path / "broken.gz"
    broken.write_bytes(b"no archive at all")
    found, status = scan_all(spark, [Connector("core", str(broken)), Connector("doaj", str(tmp_path / "doaj.jsonl"))])
    assert [r.id for r in found.collect()] == ["doaj:41"]
    rows = {r.source: r for r in status.collect()}
    assert not rows["core"].ok
    assert rows["core"].error
    assert (rows["doaj"].ok, rows["doaj"].rows) == (True, 1)
    assert rows["doaj"].latency_ms > 0


def test_a_partition_a_file(spark, tmp_path):
    (tmp_path / "doaj").mkdir()
    for i in range(3):
        (tmp_path / "doaj" / f"{i}.jsonl").write_text("\n".join(SAMPLES["doaj"] for _ in range(4)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
    rows = spark.read.format("quirelake").option("root", str(tmp_path)).load()
    assert rows.rdd.getNumPartitions() == 3
    assert rows.count() == 12


def test_payload_source(spark, tmp_path):
    for name in ("doaj", "plos"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.jsonl").write_text(SAMPLES[name] + "\n\n")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
    rows = spark.read.format("quirelake").option("root", str(tmp_path)).load()
    assert sorted(r.source for r in rows.collect()) == ["doaj", "plos"]
    assert [r.source for r in rows.where("source = 'plos'").collect()] == ["plos"]
