"""A harvest that follows tokens: ends, errors, dry runs, and going on after it was stopped."""

import pytest

from scholarlake.sources import oai


def page(ids, token="", broken=False):
    one = "<record><header><identifier>oai:host:{0}v1</identifier><datestamp>2024-01-01</datestamp></header><metadata><t:title>On  {0}</t:title><abstract>x</abstract><categories>{1}</categories></metadata></record>"
    rows = "".join(one.format(i, c) for i, c in ids)
    if broken:
        rows += "<record><header><identifier>oai:host:gone</identifier></header></record>" + one.format("", "cs.CL").replace("oai:host:v1", "")
    return f"<OAI-PMH><ListRecords>{rows}<resumptionToken size='9'>{token}</resumptionToken></ListRecords></OAI-PMH>"


@pytest.fixture
def folder(tmp_path):
    pages = {
        "2024-01-01_2024-01-31": page([("1", "cs.CL"), ("2", "cs.AI math.CO"), ("3", "")], "t/1&amp;x"),
        "t%2F1%26x": page([("4", "math.CO"), ("5", "cs.CL")], "t2", broken=True),
        "t2": page([("6", "cs.AI")], "t3"),
        "t3": page([("7", "cs.CL, cs.AI")]),
        "2025-01-01_2025-01-02": "<OAI-PMH><error code='noRecordsMatch'>none</error></OAI-PMH>",
        "2026-01-01_2026-01-02": page([("8", "cs.CL")], "bad"),
        "bad": "<OAI-PMH><error code=\"badResumptionToken\">expired</error></OAI-PMH>",
    }
    (tmp_path / "pages").mkdir()
    for name, xml in pages.items():
        (tmp_path / "pages" / f"{name}.xml").write_text(xml)
    return tmp_path


def run(spark, folder, name="run", start="2024-01-01", until="2024-01-31", **more):
    return oai.harvest(spark, f"{folder}/{name}", f"{folder}/{name}-at", ["cs.CL", "cs.AI"], endpoint=f"file://{folder}/pages", **{"from": start, "until": until}, **more)


def ids(spark, folder, name="run"):
    return sorted(r.identifier for r in spark.read.parquet(f"{folder}/{name}").collect())


def test_whole_harvest(spark, folder):
    c = run(spark, folder)
    assert (c.pages, c.seen, c.no_metadata, c.no_id, c.no_categories, c.filtered, c.matched, c.written, c.error) == (4, 9, 1, 1, 1, 1, 5, 5, "")
    assert ids(spark, folder) == ["1", "2", "5", "6", "7"] and len(c.batches) == 4
    again = run(spark, folder)
    assert again.batches == [] and ids(spark, folder) == ["1", "2", "5", "6", "7"]
    assert run(spark, folder, "wide", pagesPerBatch="3").pages == 4 and ids(spark, folder, "wide") == ids(spark, folder)


def test_stopped_harvest_goes_on(spark, folder):
    class Stop(Exception):
        pass

    def stop(number):
        if number == 1:
            raise Stop

    # the second batch is written, but the stream did not note it yet
    with pytest.raises(Exception, match="Stop"):
        run(spark, folder, after_batch=stop)
    assert ids(spark, folder) == ["1", "2", "5"]
    c = run(spark, folder)
    assert c.batches == [1, 2, 3] and ids(spark, folder) == ["1", "2", "5", "6", "7"]


def test_dry_runs_write_nothing(spark, folder):
    c = run(spark, folder, "dry", dry_run=True)
    assert (c.matched, c.written, c.would_write) == (5, 0, 5) and not (folder / "dry").exists()
    c = run(spark, folder, "count", count_only=True)
    assert (c.matched, c.written, c.would_write) == (5, 0, 0) and not (folder / "count").exists()


def test_pages_of_error(spark, folder):
    c = run(spark, folder, "none", "2025-01-01", "2025-01-02")
    assert (c.seen, c.pages, c.error) == (0, 0, "")
    c = run(spark, folder, "bad", "2026-01-01", "2026-01-02")
    assert (c.written, c.pages, c.error) == (1, 1, "badResumptionToken") and ids(spark, folder, "bad") == ["8"]


def test_addresses():
    o = {"endpoint": "https://host/oai/", "from": "2024-01-01", "until": "", "prefix": "arX"}
    assert oai.address(o, "") == "https://host/oai?verb=ListRecords&metadataPrefix=arX&from=2024-01-01"
    assert oai.address(o, "a b") == "https://host/oai?verb=ListRecords&resumptionToken=a+b"
    assert oai.follows("<o:resumptionToken a='1'> x&amp;y </o:resumptionToken>") == ("x&y", "") and oai.follows("<resumptionToken/>") == ("", "")
