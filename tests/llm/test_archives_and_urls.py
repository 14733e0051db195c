import gzip
import io
import random

import pytest

from axisflow.llm import queries, sql, urls, warc
from tests.compare import oracle, same

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, payload string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3)


def test_warc_query_equals_sql(spark):
    same(queries.op2_warc_normaliser(spark, SF).toPandas(), oracle(SF, sql.OP2))


def test_revisits_and_odd_pages(spark):
    long = "é" * 200_000
    rows = [(5, "http://a/", "x" * 100), (3, "http://b/", "x" * 100), (9, None, "x" * 100), (3, "http://b/", "x" * 100), (1, "u\r\nWARC/1.1 x", "x" * 99), (2, "http://c/ d", "x" * 99), (4, "http://d/", None), (6, "", ""), (None, "http://e/", "x" * 100), (7, "http://f/", long), (8, "http://g/", long)]
    got = {}
    for r in warc.archive_pages(pages(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append((r["payload_bytes"], r["record_type"], r["refers_to"]))
    assert got[3] == [(100, "response", None)] * 2 and got[5] == got[9] == got[None] == [(100, "revisit", 3)]
    assert got[1] == got[2] == [(99, "response", None)] and got[4] == got[6] == [(0, "response", None)]
    assert got[7] == [(400_000, "response", None)] and got[8] == [(400_000, "revisit", 7)]
    assert warc.archive_pages(pages(spark, rows).where("false")).count() == 0


def test_round_trip_by_offset(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 30) for i in range(50)]
    plan = warc.plan_records(pages(spark, rows), "page_id", "url", "html")
    raw, members = f"file://{tmp_path}/raw", f"file://{tmp_path}/members"
    written = spark.createDataFrame(warc.write_monolithic(plan, raw, most=5000).collect())
    assert written.count() == 50 and written.select("archive").distinct().count() > 3
    later = warc.revisits(written, 100, written.schema["place"].dataType)
    assert later.count() == 0
    index = warc.normalise(written, later, raw, members).persist()
    for r in index.collect():
        with open(f"{tmp_path}/members/{r['archive']}", "rb") as f:
            f.seek(r["offset"])
            (headers, block), = warc.parsed_records([gzip.decompress(f.read(r["length"]))])
            assert headers["WARC-Record-ID"] == r["record_id"]
        with open(f"{tmp_path}/members/{r['archive']}.idx") as f:
            assert f"{r['offset']} {r['length']} {r['record_id']}\n" in f.readlines()
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(index, members).collect()}
    assert back == {str(i): h for i, _, h in rows}


def test_a_damaged_archive_is_an_error():
    data = gzip.compress(warc.record({"WARC-Type": "response"}, b"abc"))
    assert [b for _, b in warc.parsed_records(warc.inflated(io.BytesIO(data)))] == [b"abc"]
    two = data + data
    assert len(list(warc.parsed_records(warc.inflated(io.BytesIO(two), 7)))) == 2
    with pytest.raises(ValueError):
        list(warc.parsed_records([warc.record({"WARC-Type": "response"}, b"abc")[:-6]]))
    with pytest.raises(ValueError):
        list(warc.parsed_records([b"HTTP/1.1 200\r\n\r\n"]))


def test_url_query_equals_sql(spark):
    same(queries.op6_url_range_join(spark, SF).toPandas(), oracle(SF, sql.OP6))


def test_urls_by_brute_force(spark):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "org", "Com", "x-y", "é"])
    rows = [(i, rng.choice(["http://", "HTTPS://", "", "x"]) + ".".join(label() for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", "/p", "/p/q?x://y", "#f", "?q"]), "") for i in range(400)]
    rows += [(None, "http://a.org/p", ""), (7, None, ""), (7, None, ""), (8, "http://" + "a." * 5000 + "org/p", ""), (9, "a://b://c.org/p", ""), (10, "http://a.org./p", "")]
    rules = [(".".join(label().lower() for _ in range(rng.randint(1, 3))), rng.choice(["", "/", "/p", "/p/"]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values()) + [(None, "/", "block"), ("", "/", "block")]
    got = urls.judge_urls(pages(spark, rows), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[3:] if fit else (None, "allow")))

    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=repr) == sorted(((i, *want(u)) for i, u, _ in rows), key=repr)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urls.judge_urls(pages(spark, rows), none, "block").collect()} == {"block"}
    assert urls.judge_urls(pages(spark, rows).where("false"), none).count() == 0




def test_a_hot_payload(spark):
    rows = [(1000 - i, f"http://h/{i}", "<p>same</p>" * 20 if i % 3 == 0 else f"<p>{i}</p>" * 20) for i in range(300)]
    got = warc.archive_pages(pages(spark, rows)).collect()
    first = min(1000 - i for i in range(0, 300, 3))
    assert len(got) == 300
    for r in got:
        hot = (1000 - r["page_id"]) % 3 == 0 and r["page_id"] != first
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if hot else ("response", None))
