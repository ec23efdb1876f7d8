import json
from datetime import datetime
from urllib.parse import parse_qs, urlsplit

import pytest

from servista.functions import clean
from servista.sources import catalog, landing, local_api, rest
from servista.streaming import bronze


class Answers:
    """Answers from a list of keys, after the given statuses."""

    def __init__(self, n, statuses=(), order=sorted):
        self.keys, self.statuses, self.urls, self.waits, self.order = [f"{i:04d}" for i in range(n)], [*statuses], [], [], order

    def get(self, url, headers, timeout):
        self.urls.append(url)
        if self.statuses:
            return self.statuses.pop(0), b""
        args = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        where = args["$where"]
        if "IS NULL" in where:
            return 200, b"[]"
        last = where.split("> '")[1].split("'")[0] if "> '" in where else ""
        found = [k for k in self.order(self.keys) if k > last][: int(args["$limit"])]
        return 200, json.dumps([{"sr_number": k} for k in found]).encode()

    def all(self, **more):
        return [r["sr_number"] for r in rest.records_by_key(rest.ApiConfig("http://x/y", page_size=10, **more), None, self.get, self.waits.append)]


@pytest.mark.parametrize(("n", "pages"), [(0, 1), (1, 1), (10, 2), (11, 2), (25, 3)])
def test_pages(n, pages):
    a = Answers(n)
    assert a.all() == a.keys and len(a.urls) == pages + 1 and a.waits == [0.1] * (pages - 1)


def test_retry_and_errors():
    a = Answers(5, [429, 503])
    assert len(a.all()) == 5 and a.waits[:2] == [0.5, 1.0]
    for statuses in ([500] * 4, [404]):
        with pytest.raises(rest.ApiError, match="status"):
            Answers(3, statuses).all()
    with pytest.raises(rest.ApiError, match="order"):
        Answers(30, order=lambda keys: keys[::-1]).all()


def test_query_url():
    url = rest.Request("a > '1'", "a,b", "k").url(rest.ApiConfig("http://x/y", page_size=10))
    assert "%24limit=10" in url and "%24order=k" in url and "%24where=a+%3E+%271%27" in url and "%24select=a%2Cb" in url


def test_windows_cover_a_span():
    assert rest.windows("2024-01-01T00:00:00", "2024-01-25T12:00:00", 10) == [("2024-01-01T00:00:00", "2024-01-11T00:00:00"), ("2024-01-11T00:00:00", "2024-01-21T00:00:00"), ("2024-01-21T00:00:00", "2024-01-25T12:00:00")]
    assert rest.windows("2024-01-01", "2024-01-01", 10) == []


SCHEMA = "sr_number string, created_date string, last_modified_date string, ward string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def some(n):
    """Many records of the same few times, some without a time, one without a key; in shuffled order."""
    day = lambda k: f"2024-01-{1 + k % 5:02d}T00:00:00"
    rows = [(str(i), day(i) if i % 11 else None, day(i + 3) if i % 2 else None, "it's") for i in range(n)]
    return [*rows[::3], *rows[1::3], *rows[2::3], (None, day(1), None, "no key")]


def config(url, **more):
    return rest.ApiConfig(url, page_size=7, pause=0.0, retry_backoff=0.0, window_days=2, **more)


def test_executors_read_every_record_once(spark):
    rows = some(200)
    with local_api.serve(table(spark, rows), fails_every=5) as url:
        df = rest.records(spark, config(url), schema=SCHEMA)
        assert df.rdd.getNumPartitions() == 4  # without a time, two windows, and the last moment
        assert sorted(map(repr, df.collect())) == sorted(repr(r) for r in table(spark, rows).collect())
        assert {r.sr_number for r in rest.records(spark, config(url), "ward = 'it''s'", SCHEMA).collect()} == {r[0] for r in rows if r[0]}
        last = rest.changes_since(spark, config(url), "2024-01-04T00:00:00", ("created_date", "last_modified_date"), SCHEMA)
        assert {r.sr_number for r in last.collect()} == {r[0] for r in rows if r[0] and max(r[1] or "", r[2] or "") > "2024-01-04T00:00:00"}
        assert rest.with_fallback(spark, config(url), "ward = 'none'", SCHEMA).count() == len(rows)
        assert rest.with_fallback(spark, config(url), "sr_number = '7'", SCHEMA).count() == 1
    with local_api.serve(table(spark, rows).limit(0)) as url:
        assert rest.records(spark, config(url), schema=SCHEMA).count() == 0


def test_an_error_of_the_api_fails_the_job(spark):
    with local_api.serve(table(spark, some(5)), fails_every=1) as url, pytest.raises(Exception, match="status 503"):
        rest.records(spark, config(url), schema=SCHEMA).count()


def test_loads_land_every_change_once(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "land"), str(tmp_path / "checkpoint")
    rows = [(f"{i:03d}", f"2024-01-{1 + i % 9:02d}T00:00:00", None, "a") for i in range(60)]
    later = [(k, c, "2024-02-01T00:00:00", "b") if int(k) % 10 == 0 else (k, c, None, w) for k, c, _, w in rows] + [("100", "2024-02-03T00:00:00", "2024-02-01T00:00:00", "new"), ("101", "2024-01-09T00:00:00", None, "at the mark")]
    landed = lambda: sorted((r.sr_number, r.ward) for r in landing.read_landing(spark, folder).collect())
    want = [(k, w) for k, c, _, w in rows if c >= "2024-01-03T00:00:00"]
    for served, more in ((rows, want), (later, [(k, "b") for k, *_ in rows if int(k) % 10 == 0] + [("100", "new")]), (later, [])):
        with local_api.serve(table(spark, served)) as url:
            landing.incremental_load(spark, config(url), folder, checkpoint, "2024-01-03T00:00:00", ("created_date", "last_modified_date"), SCHEMA).awaitTermination()
        want = want + more if more is not want else want
        assert landed() == sorted(want)
    with local_api.serve(table(spark, rows)) as url:
        for _ in range(2):
            landing.initial_load(spark, config(url), str(tmp_path / "first"), 1, datetime(2024, 6, 1), schema=SCHEMA)
    assert landing.read_landing(spark, str(tmp_path / "first")).count() == 60


ROWS = [
    {"sr_number": "1", "sr_type": "Pothole", "status": "Open", "created_date": "2024-01-01T00:00:00", "ward": 28, "location": {"a": 1}, "duplicate": False},
    {"sr_number": "2", "sr_type": "Tree", "status": "Nonsense", "created_date": "2024-01-01T00:00:00"},
    {"sr_number": None, "sr_type": "Tree", "status": "Open", "created_date": "2024-01-01T00:00:00"},
]


LANDED = "sr_number string, sr_type string, status string, created_date string, ward int, location struct<a: int>, duplicate boolean"


def test_bronze_and_staged_streams(spark, tmp_path):
    land, root = str(tmp_path / "land"), str(tmp_path / "tables")
    landing.write_landing(spark.createDataFrame(ROWS, LANDED), land, "initial")
    b, s = bronze.run_bronze(spark, land, root)
    raw = spark.read.parquet(b)
    assert raw.count() == 3 and raw.filter("sr_number = '1'").first().location == '{"a":1}'
    assert [r.ward for r in spark.read.parquet(s).collect()] == [28]
    bronze.run_bronze(spark, land, root)
    assert spark.read.parquet(b).count() == 3
    landing.write_landing(spark.createDataFrame([{**ROWS[0], "sr_number": "9"}], LANDED), land)
    bronze.run_bronze(spark, land, root)
    assert {r.sr_number for r in spark.read.parquet(s).collect()} == {"1", "9"}
    assert bronze.ingestion_counts(spark.read.parquet(b)).count() >= 1
    bronze.append_batches(bronze.landing_stream(spark, land, 1), str(tmp_path / "b2"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b2")).count() == 4
    assert landing.read_landing(spark, land).count() == 4 and "ward" in landing.preview(spark, land).columns


def test_literal_status_names_keep_nothing(spark):
    from servista.plans.adapter import raw

    assert clean.valid(clean.stage(raw(spark, "/root/testdata/sf0.001")), ("Open", "Completed", "Canceled")).count() == 0


def test_config_from_the_environment(monkeypatch):
    monkeypatch.setenv("OPENDATA_URL", "http://x")
    assert rest.ApiConfig.from_env() == rest.ApiConfig("http://x")
    monkeypatch.setenv("OPENDATA_APP_TOKEN", "t")
    assert rest.ApiConfig.from_env().app_token == "t"


def test_catalog_and_volume(spark, tmp_path):
    names = catalog.create_layers(spark, "t_", reset=True)
    assert len(names) == 5 and catalog.describe_layers(spark, names).count() == 5
    catalog.set_comment(spark, "t_raw", "it's \\ here")
    assert spark.catalog.getDatabase("t_raw").description == "it's \\ here"
    catalog.use(spark, "t_raw")
    spark.range(3).write.saveAsTable("three")
    assert [r.name for r in catalog.tables(spark, "t_raw").collect()] == ["three"] and catalog.table(spark, "three").count() == 3
    assert catalog.table(spark, "t_raw.three", stream=True).isStreaming
    catalog.use(spark, "default")
    catalog.drop_layers(spark, "t_")
    assert not spark.catalog.databaseExists("t_raw")
    v = catalog.Volume(spark, str(tmp_path), "raw").create("a", "b")
    assert v.exists() and v.list() == ["a", "b"] and v.smoke_test()
    v.drop()
    assert not v.exists()
