import json

import pytest
from pyspark.sql import functions as F

from leadflow.plans.run import fetch, two_phase
from leadflow.sources import archive, frames, search
from leadflow.streaming.ingest import ingest
from leadflow.streaming.limiter import limited_stream
from test_operators import limit_by_loop, make_events


def test_json_archive(spark, tmp_path):
    path = str(tmp_path / "leads.json")
    assert archive.read_json_archive(spark, path).count() == 0
    (tmp_path / "leads.json").write_text(json.dumps([{"username": "a", "score": 3, "junk": 1, "iranEvidence": [{"type": "t", "sourceId": "s"}]}, {"businessName": "B", "scoreBreakdown": {"contactability": 4}}]))
    rows = {r.username: r for r in archive.read_json_archive(spark, path).collect()}
    assert (rows["a"].score, rows["a"].tier, rows["a"].score_breakdown.shop_bot_fit, rows["a"].iran_evidence[0].source_id) == (3, "REJECT", 0, "s")
    assert (rows[None].business_name, rows[None].reason, rows[None].provider) == ("B", [], "unknown")
    assert rows[None].discovered_at.endswith("Z")


def test_json_archive_round_trip(spark, tmp_path):
    (tmp_path / "leads.json").write_text(json.dumps([{"username": "a", "discoveredAt": "2", "evidence": [{"type": "t", "sourceUrl": "u", "sourceId": "s"}]}, {"businessName": "B", "discoveredAt": "3"}]))
    leads = archive.read_json_archive(spark, str(tmp_path / "leads.json"))
    archive.write_json_archive(leads, str(tmp_path / "out"))
    again = archive.read_json_archive(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, leads.collect()))
    rows, total = archive.listed(again)
    assert ([r.discovered_at for r in rows.collect()], total) == (["3", "2"], 2)


def test_reply_providers(spark):
    from leadflow.operators.replies import parsed_reply
    from leadflow.sources import replies as rp

    df = spark.createDataFrame([(1, "N", "u", None, "x" * 5000), (2, None, None, None, None)], "lead_id long, business_name string, username string, website string, text string")
    mock = rp.chosen_replies(None, {}).replies(df, "lead_id").select("lead_id", parsed_reply("raw").alias("r")).orderBy("lead_id").collect()
    assert [(r.r.business_name, r.r.business_type, r.r.shop_bot_fit) for r in mock] == [("N", "retail", 0.0), (None, "retail", 0.0)]

    def ask(request):
        if "null, \"text\": \"\"" in request:
            raise RuntimeError("down")
        return str(len(request))

    assert rp.chosen_replies(ask, {"AI_PROVIDER": "off"}).is_mock
    rows = rp.chosen_replies(ask, {}).replies(df, "lead_id").collect()
    assert [r.lead_id for r in rows] == [1] and 4000 < int(rows[0].raw) < 4100
    assert rp.TableReplies(spark.createDataFrame([(1, "a"), (9, "b")], "lead_id long, raw string")).replies(df, "lead_id").count() == 1


def test_progress(spark):
    from leadflow.streaming.progress import Progress

    progress = Progress(spark)
    fetch(search.RoutedProvider(spark, ROUTES), ["toy", "game"], 10, 99, 2, progress.on_query)
    progress.emit("finish")
    assert [(r.seq, r.stage, r.detail, r.current) for r in progress.table().collect()] == [(0, "search", "toy", 1), (1, "search", "game", 2), (2, "finish", None, None)]
    with pytest.raises(ValueError):
        progress.emit("nothing")


def test_broken_archive_is_an_error(spark, tmp_path):
    (tmp_path / "leads.json").write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        archive.read_json_archive(spark, str(tmp_path / "leads.json")).collect()


NEW = "first_idx long, username string, instagram_url string, website string, business_name string, city string"


def test_adding_twice_adds_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([(1, "a", None, "https://x.ir", "N", "c"), (2, "b", None, "http://www.x.ir/y", None, None), (3, None, None, None, "n", "C"), (4, "d", None, None, None, None), (5, None, None, None, None, None)], NEW)
    archive.add_new(path, rows, "first_idx")
    assert sorted(r.first_idx for r in spark.read.parquet(path).collect()) == [1, 4, 5]
    assert archive.add_new(path, rows.where("first_idx < 5"), "first_idx").count() == 0


def test_replies_of_services(spark):
    bodies = {
        "tavily": '{"results":[{"title":"t","url":"u","content":"c"},{"url":"v"}]}', "serper": '{"organic":[{"title":"t","link":"u","snippet":"c"},{"link":"v"}]}',
        "brave": '{"web":{"results":[{"title":"t","url":"u","description":"c"},{"url":"v"}]}}',
    }
    for service, body in bodies.items():
        df = spark.createDataFrame([("q", body), ("q2", "broken"), ("q3", "{}"), ("q4", None)], "query string, body string")
        assert [tuple(r) for r in search.reply_rows(df, service).collect()] == [("q", "t", "u", "c", service), ("q", "", "v", "", service)]


def test_choice_of_a_service():
    assert search.chosen_service({"SEARCH_PROVIDER": " Mock "}) == "mock"
    assert search.chosen_service({"BRAVE_API_KEY": "x", "SERPER_API_KEY": "y"}) == "serper"
    with pytest.raises(ValueError):
        search.chosen_service({})
    with pytest.raises(ValueError):
        search.required("X", {"X": " "})
    assert (search.budgets(10), search.budgets(50, "500"), search.budgets(1)) == ((80, 100), (120, 300), (80, 60))


ROUTES = [("toy|game", [("Toys | X", "https://toys.ir", "toy shop"), ("Game", "https://www.instagram.com/game1", "see https://game.ir")]), ("game", [("G2", "https://g2.ir/?a", "")])]


def test_routed_fixtures(spark):
    provider = search.RoutedProvider(spark, ROUTES)
    queries = spark.createDataFrame([("Game night",), ("toy",), ("none",)], "query string")
    assert {(r.query, r.title) for r in provider.search(queries).collect()} == {("Game night", "Toys | X"), ("Game night", "Game"), ("Game night", "G2"), ("toy", "Toys | X"), ("toy", "Game")}
    assert search.TableProvider(provider.search(queries)).search(queries.where("query = 'toy'")).count() == 2


def test_fetch_stops_between_chunks(spark):
    provider, used = search.RoutedProvider(spark, ROUTES), []
    rows, n = fetch(provider, ["toy", "game", "toy a", "toy b"], 10, 4, 2, lambda q, a, b: used.append((q, a, b)))
    assert (rows.count(), n, used) == (5, 2, [("toy", 1, 4), ("game", 2, 4)])
    assert fetch(provider, ["none"], 10, 4, 2)[0].count() == 0


class _Broken(search.SearchProvider):
    name = "broken"

    def __init__(self, spark):
        self.session = spark

    def search(self, queries):
        raise RuntimeError("down")


def test_fetch_raises_only_if_nothing_came(spark):
    with pytest.raises(RuntimeError):
        fetch(_Broken(spark), ["a"], 5, 5, 3)


def test_two_phases(spark):
    request = spark.createDataFrame([(1, "toy", "Turkey", None, 2)], "request_id long, category string, country string, city string, max_leads int")
    rows = two_phase(search.RoutedProvider(spark, ROUTES), request).collect()
    assert {r.url for r in rows} == {"https://toys.ir", "https://www.instagram.com/game1"}


def test_python_source(spark):
    class Echo(search.CallableSource):
        service = "echo"

        @staticmethod
        def fetch(query):
            return [(query.upper(), f"https://{query}.ir", "s")]

    spark.dataSource.register(Echo)
    rows = spark.read.format("leadflow_echo").option("queries", "a\nb\nc").option("concurrency", "2").load().collect()
    assert sorted((r.title, r.url, r.query, r.provider) for r in rows) == [(q.upper(), f"https://{q}.ir", q, "echo") for q in "abc"]


def test_frames(spark):
    df = spark.createDataFrame([("event: progress\ndata: {\"n\":1}\n\nnoise\n\nevent: complete\ndata: {\"n\":2}\n\nevent: cut",)], "text string")
    rows = frames.split_frames(df, "text", "n int").collect()
    assert [(r.pos, r.event, r.data.n) for r in rows] == [(0, "progress", 1), (2, "complete", 2)]
    text = spark.range(1).select(frames.as_frame(F.lit("x"), "id").alias("t")).first().t
    assert text == 'event: x\ndata: {"id":0}\n\n'


def test_limit_on_a_stream(spark, tmp_path):
    events = make_events(9)
    source = str(tmp_path / "in")
    spark.createDataFrame(events, "row_id long, key long, ts timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("row_id long, key long, ts timestamp").parquet(source)
    query = limited_stream(stream, 4, 60_000_000).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.row_id: r.allowed for r in spark.table("limited").collect()} == limit_by_loop(events, 4, 60)


def test_ingest_of_files(spark, tmp_path):
    kind = "request_id long, result_idx long, title string, url string, snippet string"
    source, target = str(tmp_path / "in"), str(tmp_path / "archive")
    spark.createDataFrame([(1, 1, "A", "https://www.instagram.com/a", "https://a.ir"), (1, 2, "A2", "https://a.ir/x", ""), (1, 3, "B", "https://b.ir/?x", "")], kind).write.parquet(source)
    ingest(spark, source, kind, target, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([(2, 9, "B again", "https://www.b.ir", ""), (2, 10, "C", "https://c.ir", "")], kind).write.mode("append").parquet(source)
    ingest(spark, source, kind, target, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.website for r in spark.read.parquet(target).collect()) == ["https://a.ir", "https://b.ir/?x", "https://c.ir"]
