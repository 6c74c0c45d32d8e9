import gzip

import pytest
from seriespan.llm import warc


def pages(spark):
    rows = [
        (5, "http://www.a.com/x?q=1", "<p>one</p>"), (2, "https://a.com/y", "<p>one</p>"), (9, None, "<p>one</p>"),
        (7, "http://b.org:8080/ü z", None), (8, "http://b.org/", ""), (None, "http://c.net/", "<p>one</p>"),
        (3, "http://d.net/long", "x" * 300_000), (4, "weird url", "é\r\n\r\nbody"), (4, "weird url", "é\r\n\r\nbody"),
    ]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, key string")


@pytest.fixture
def written(spark, tmp_path):
    place = str(tmp_path / "archives")
    captures = warc.write_archives(pages(spark), place)
    return place, captures, warc.write_index(captures, place, lines=2)


def test_round_trip(spark, written):
    place, captures, files = written
    got = warc.read_records(warc.lookup(warc.keys_of(pages(spark)), files, place), place).collect()
    assert len(got) == pages(spark).count()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for r in pages(spark).collect():
        payload = (r["html"] or "").encode()
        mine = by[r["page_id"]][0]
        assert (mine["payload_bytes"], mine["payload_digest"]) == (len(payload), warc.payload_digest(payload))
        if mine["record_type"] == "response":
            assert mine["payload"] == (r["html"] or "")
    assert {p: (r[0]["record_type"], r[0]["refers_to"]) for p, r in by.items()} == {
        2: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2), None: ("revisit", 2), 7: ("response", None),
        8: ("revisit", 7), 3: ("response", None), 4: ("response", None),
    }
    assert [r["record_type"] for r in by[4]] == ["response"] * 2


def test_archives_are_ordinary_gzip_members(written):
    place, captures, _ = written
    names = {r["archive"] for r in captures.collect()}
    raw = b"".join(gzip.open(f"{place}/{n}").read() for n in names)
    assert raw.count(b"WARC/1.1\r\n") == 9 and b"WARC-Refers-To: <urn:uuid:" in raw


def test_lookup_reads_one_key_only(spark, written):
    place, _, files = written
    one = spark.createDataFrame([("https://a.com/y",), ("http://nowhere.example/",)], "url string")
    got = warc.lookup(warc.keys_of(one), files, place).collect()
    assert [r["page_id"] for r in got] == [2]


def test_keys_over_many_blocks_and_files(spark, tmp_path):
    place = str(tmp_path)
    rows = [(i, "http://hot.com/" if i % 3 else f"http://x{i}.com/", f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    files = warc.write_index(warc.write_archives(df, place), place, lines=7)
    hot = warc.lookup(warc.keys_of(df.where("page_id % 3 <> 0")), files, place).collect()
    assert sorted(r["page_id"] for r in hot) == [i for i in range(400) if i % 3]


def test_minimum_payload_and_empty_table(spark, tmp_path):
    least = {r["page_id"]: r["refers_to"] for r in warc.roles(pages(spark), min_payload=11).collect()}
    assert set(least.values()) == {None}
    none = pages(spark).limit(0)
    place = str(tmp_path / "none")
    files = warc.write_index(warc.write_archives(none, place), place)
    assert files.count() == 0 and warc.read_records(warc.lookup(warc.keys_of(none), files, place), place).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.A.com:80/b?c=d") == "com,a,www)/b?c=d"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"
    assert warc.url_key("") == ""


def test_malformed_urls_are_their_own_keys(spark, tmp_path):
    urls = ["http://[abc/x", "http://a]b/", "http://[1.2.3]/p", "http://ok.org/"]
    df = spark.createDataFrame([(i, u, f"t{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    place = str(tmp_path)
    files = warc.write_index(warc.write_archives(df, place), place)
    got = warc.read_records(warc.lookup(warc.keys_of(df), files, place), place).collect()
    assert {r["page_id"]: (r["target"], r["payload"]) for r in got} == {i: (u, f"t{i}") for i, u in enumerate(urls)}
    assert [warc.url_key(u) for u in urls[:3]] == urls[:3]
