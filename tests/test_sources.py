"""Sources run against a local server and local files."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from plumeworks.plans import storage
from plumeworks.sources import archive, ingest
from plumeworks.sources.pages import JsonPages
from pyspark.sql import functions as F

DATA = bytes(range(256)) * 40


class Answers(BaseHTTPRequestHandler):
    """Pages of 3 of 7 facilities a year: some answers fail at first, some are objects; and a file that answers to ranges."""

    seen: dict = {}

    def log_message(self, *args):
        pass

    def answer(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):  # noqa: N802
        url = urlparse(self.path)
        times = self.seen[self.path, self.headers.get("Range")] = self.seen.get((self.path, self.headers.get("Range")), 0) + 1
        if url.path == "/file":
            first, last = self.headers["Range"].removeprefix("bytes=").split("-")
            return self.answer(206, DATA[int(first) : int(last) + 1 if last else None])
        if url.path == "/plain":
            return self.answer(200, DATA)
        query = {k: v[0] for k, v in parse_qs(url.query).items()}
        year, page, size = int(query["year"]), int(query["page"]), int(query["size"])
        if page == 2 and times == 1:
            return self.answer(429, Retry_After="0") if year % 2 else self.answer(200, b"{ no JSON")
        if year == 1990:
            return self.answer(404)
        rows = [{"facilityId": 10 * year + i, "unit": i} for i in range(7)] + [{"unit": "none"}, {"facilityId": "x"}]
        part = rows[(page - 1) * size : page * size]
        return self.answer(200, json.dumps({"items": part} if year % 2 else part).encode())


@pytest.fixture(scope="module")
def server():
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_address[1]}"
    httpd.shutdown()


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "facility_id long")


def test_years_of_pages_with_answers_that_fail_at_first(spark, server):
    url = server + "/pages?year={query}&page={page}&size={size}"
    got = ingest.facility_attributes(spark, url, ids(spark, 20200, 20211, 20216), 2021, 2019, size=3)
    assert sorted((r["year"], r["facility_id"], json.loads(r["record"])["unit"]) for r in got.collect()) == [(2020, 20200, 0), (2021, 20211, 1), (2021, 20216, 6)]
    with pytest.raises(ValueError, match="99"):
        ingest.facility_attributes(spark, url, ids(spark, 20200, 99), 2021, 2020, size=3)
    with pytest.raises(Exception, match="404"):
        ingest.facility_attributes(spark, url, ids(spark, 1), 1990, 1990, size=3)


def test_pages_end_with_a_short_one(spark, server):
    spark.dataSource.register(JsonPages)
    read = lambda size: spark.read.format("json_pages").options(url=server + "/pages?year={query}&page={page}&size={size}", queries="[2010, 2011]", size=str(size)).load()
    for size in (3, 9, 100):
        rows = read(size).collect()
        assert len(rows) == 18 and {r["query"] for r in rows} == {"2010", "2011"}
        assert max(r["page"] for r in rows) == -(-9 // size)


def test_hours_and_addresses(spark):
    hours = archive.hours(spark, "2024-02-28", "2024-02-29")
    rows = hours.select("valid_time", *(c.alias(n) for c, n in zip(archive.addresses("https://a/b/", F.col("valid_time")), ("file", "index")))).orderBy("valid_time").collect()
    assert len(rows) == 48 and rows[0]["valid_time"] == dt.datetime(2024, 2, 28) and rows[-1]["valid_time"] == dt.datetime(2024, 2, 29, 23)
    assert rows[5]["file"] == "https://a/b/hrrr.20240228/conus/hrrr.t05z.wrfsfcf00.grib2" and rows[5]["index"] == rows[5]["file"] + ".idx"
    assert archive.hours(spark, "2024-02-29", "2024-02-28").count() == 0


def test_ranges_of_files(spark, server, tmp_path):
    (tmp_path / "in").mkdir()
    whole, short = tmp_path / "in/whole", tmp_path / "in/short"
    whole.write_bytes(DATA)
    short.write_bytes(DATA[:100])
    ranges = [(str(whole), "d/a.bin", 300, 499), (str(whole), "d/a.bin", 10, 19), (str(whole), "d/a.bin", 10_000, None), (str(short), "d/short.bin", 50, 149), (str(tmp_path / "in/gone"), "gone.bin", 0, 9), (f"{server}/file", "web.bin", 5, 14), (f"{server}/plain", "plain.bin", 5, 14), (str(short), "empty.bin", 100, None)]
    frame = spark.createDataFrame(ranges, "file string, target string, first long, last long")
    run = lambda **o: {r["target"]: (r["bytes"], r["status"], r["error"]) for r in archive.fetch_ranges(frame, f"{tmp_path}/manifest", f"{tmp_path}/out", tries="2", **o).collect()}
    got = run()
    assert got["d/a.bin"] == (10 + 200 + 240, "fetched", None) and got["web.bin"] == (10, "fetched", None)
    assert (tmp_path / "out/d/a.bin").read_bytes() == DATA[10:20] + DATA[300:500] + DATA[10_000:] and (tmp_path / "out/web.bin").read_bytes() == DATA[5:15]
    assert {t: s for t, (_, s, _) in got.items() if s == "failed"} == dict.fromkeys(("d/short.bin", "gone.bin", "plain.bin", "empty.bin"), "failed")
    assert "50 bytes from 50, not 100" in got["d/short.bin"][2] and "ignores byte ranges" in got["plain.bin"][2] and "no bytes" in got["empty.bin"][2]
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a.bin", "web.bin"]
    # A run that is taken up again fetches what isn't there.
    short.write_bytes(DATA)
    again = run()
    assert again["d/a.bin"] == (450, "present", None) and again["d/short.bin"] == (100, "fetched", None) and again["gone.bin"][1] == "failed"
    assert run(overwrite="true")["d/a.bin"] == (450, "fetched", None)


def test_tables_from_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2024, 1, [1.5, 2.0]), (2, 2024, 2, None)], "id int, year int, month int, v array<double>")
    storage.write_csv(rows, f"{tmp_path}/csv")
    assert sorted((r["id"], r["v"]) for r in spark.read.csv(f"{tmp_path}/csv", header=True, schema="id int, year int, month int, v string").collect()) == [(1, "[1.5,2.0]"), (2, "[]")]
    storage.write_partitions(rows, f"{tmp_path}/parts", ["year", "month"], ["id"])
    storage.write_partitions(rows.filter("month = 2").withColumn("id", F.lit(9)), f"{tmp_path}/parts", ["year", "month"])
    assert sorted((r["id"], r["month"]) for r in spark.read.parquet(f"{tmp_path}/parts").collect()) == [(1, 1), (9, 2)]


def test_results_and_statistics_as_files(spark, tmp_path):
    metrics = spark.createDataFrame([("a", "val", 0.5, 2), ("a", "test", 0.25, 4), ("b", "val", 1.0, 2)], "model string, split string, accuracy double, n int")
    rows = spark.createDataFrame([("a", "val", 1, [0.5, 0.5]), ("a", "test", 2, None), ("b", "val", 1, [1.0])], "model string, split string, record int, p array<double>")
    for _ in range(2):  # a second run replaces the first
        storage.write_results(metrics, rows, f"{tmp_path}/run", primary="a", classes=["down", "up"], extra={"comparison": {"val": 0.5}})
    found = json.loads((tmp_path / "run/results.json").read_text())
    assert found["splits"] == {"val": {"accuracy": 0.5, "n": 2}, "test": {"accuracy": 0.25, "n": 4}} and found["models"]["b"] == {"val": {"accuracy": 1.0, "n": 2}}
    assert (found["primary_model"], found["class_names"], found["comparison"]) == ("a", ["down", "up"], {"val": 0.5})
    read = spark.read.csv(f"{tmp_path}/run/predictions", header=True)
    assert sorted((r["model"], r["split"], r["record"], r["p"]) for r in read.collect()) == [("a", "test", "2", "[]"), ("a", "val", "1", "[0.5,0.5]"), ("b", "val", "1", "[1.0]")]
    with pytest.raises(ValueError, match="no metrics of c"):
        storage.write_results(metrics, rows, f"{tmp_path}/other", primary="c", classes=[])
    image = spark.createDataFrame([("no2", 3, 0.5, 2.0)], "channel string, count long, center double, scale double")
    seasonal = spark.createDataFrame([("day", 3, 0.0, 1.0)], "name string, count long, center double, scale double")
    storage.write_stats(image, seasonal, f"{tmp_path}/stats.json")
    assert json.loads((tmp_path / "stats.json").read_text()) == {"image": {"no2": {"count": 3, "center": 0.5, "scale": 2.0}}, "features": {"day": {"count": 3, "center": 0.0, "scale": 1.0}}}
    assert not list(tmp_path.rglob("*.part"))
