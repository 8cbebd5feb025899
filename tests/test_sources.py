"""Sources and sinks: histories, incoming files, pages, logs."""

import datetime
import json

import pytest

from drawspark.sources import draws as D
from drawspark.sources import store, web
from drawspark.streaming.pickup import pick_up


def _rows(spark, numbers, game="baloto", extra=7):
    base = datetime.date(2026, 1, 3)
    return spark.createDataFrame([(base + datetime.timedelta(days=3 * n), n, game, 1 + n % 30, 32, 35, 40, 43, extra) for n in numbers], D.SCHEMA)


def test_history(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text("Date,C1,C2,C3,C4,C5,SB,#Sorteo\n7 de Agosto de 2026,40,2,30,11,5,9,1.204\n4 de setiembre de 2024,1,2,3,4,5,16,998", encoding="utf-8")
    rows = D.raw_histories(spark, {"baloto": str(file), "revancha": str(tmp_path / "none.csv")}).orderBy("n_sorteo").collect()
    assert [(str(r["fecha"]), r["n_sorteo"], r["juego"], r["b1"], r["b5"], r["superbalota"]) for r in rows] == [("2024-09-04", 998, "baloto", 1, 5, 16), ("2026-08-07", 1204, "baloto", 2, 40, 9)]
    file.write_text("Date,C1,C2,C3,C4,C5,SB,#Sorteo\n31 de Febrero de 2026,1,2,3,4,5,6,1\n", encoding="utf-8")
    with pytest.raises(Exception, match="no date"):
        D.raw_history(spark, str(file), "baloto").collect()


def test_incoming(spark, tmp_path):
    folder = str(tmp_path / "in")
    assert D.incoming(spark, folder).collect() == [] and D.read_draws(spark, str(tmp_path / "none.csv")).schema == D.SCHEMA
    first = store.write_incoming(_rows(spark, range(1, 13)), folder, "web")
    store.write_incoming(_rows(spark, range(8, 21)), folder, "hand")
    assert first.split("/")[-1].startswith("web_1-12_") and store.write_incoming(_rows(spark, []), folder, "web") is None
    assert D.incoming(spark, folder).count() == 20
    (tmp_path / "bad.csv").write_text("fecha,n_sorteo\n2026-01-01,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        D.read_canonical(spark, str(tmp_path / "bad.csv"))


def test_writers_are_deterministic(spark, tmp_path):
    rows = _rows(spark, range(30))
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    store.write_draws(rows, a)
    store.write_draws(rows.repartition(7).orderBy("b1"), b)
    assert open(a, "rb").read() == open(b, "rb").read() and b"\r" not in open(a, "rb").read()
    assert D.read_draws(spark, a).orderBy("n_sorteo").collect() == rows.orderBy("n_sorteo").collect()
    assert store.content_digest(rows, D.KEY, 4) == store.content_digest(rows.repartition(5), D.KEY, 4) != store.content_digest(rows.where("n_sorteo > 0"), D.KEY, 4)
    store.write_json({"x": [1 / 3, float("nan"), 1e-13, True, None], "d": datetime.date(2026, 1, 2)}, a)
    assert json.load(open(a)) == {"x": [0.333333, None, 0.0, True, None], "d": "2026-01-02"}


PAGE = """<html><style>.container-balls-results {{ }}</style><body>
<div class="old-balls-results"><div class="yellow-ball-old">9</div></div>
<div class="head"><h2>Resultado</h2><p>SORTEO {number}</p><span>{day} 7 de Agosto de 2026</span></div>
<div class="main container-balls-results">{balls}<div class="red-ball"> 12 </div></div>
<p>Acumulado $1.204.000</p><p>Próximo sorteo: sábado 8 de Agosto de 2026</p></body></html>"""


def _page(number="1.204", day="Viernes", balls=(3, 14, 15, 9, 26)):
    return PAGE.format(number=number, day=day, balls="".join(f'<div class="yellow-ball"><b>{b}</b></div>' for b in balls))


def test_pages(spark):
    got = web.parse_page(_page())
    assert got == {"number": 1204, "date": datetime.date(2026, 8, 7), "balls": [3, 14, 15, 9, 26], "extra": 12, "weekday": 4}
    assert web.parse_page(_page("88"))["number"] == 88
    for bad in (_page(balls=(1, 2, 3, 4)), _page(balls=(1, 2, 3, 4, "x")), "<p>SORTEO 5</p>", _page().replace("SORTEO", "x"), _page().replace(" de Agosto", " Agosto")):
        with pytest.raises(web.PageError):
            web.parse_page(bad)
    table = web.parse_pages(spark.createDataFrame([(1, _page()), (2, "nothing"), (3, None)], "id int, html string")).orderBy("id").collect()
    assert [(r["draw"]["number"], r["draw"]["error"] is None) for r in table] == [(1204, True), (None, False), (None, False)]


class Site:
    """Pages 1204 and 1205 of one game; ``robots`` and ``fail`` are answers given before them."""

    def __init__(self, robots=(200, "User-agent: *\nDisallow: /admin/"), fail=()):
        self.robots, self.fail, self.asked, self.slept = robots, list(fail), [], []

    def get(self, url):
        self.asked.append(url)
        if self.fail:
            answer = self.fail.pop(0)
            if isinstance(answer, Exception):
                raise answer
            return answer, ""
        if url.endswith("robots.txt"):
            return self.robots
        n = int(url.rsplit("/", 1)[1])
        return (200, _page(str(n))) if n in (1204, 1205) else (302, "")

    def source(self, **more):
        return web.WebSource(self.get, "https://site/{game}/{n}", "https://site/robots.txt", games=("baloto",), sleep=self.slept.append, **more)


def test_web(spark):
    site = Site()
    rows = site.source().fetch(spark, {"baloto": 1203}).orderBy("n_sorteo").collect()
    assert [(r["n_sorteo"], r["b1"], r["superbalota"]) for r in rows] == [(1204, 3, 12), (1205, 3, 12)]
    assert site.slept == [2.5] * 3 and len(site.asked) == 4  # robots, two pages, the redirect
    assert Site().source().fetch(spark, {"baloto": 1205}).collect() == []
    limited = Site().source(most=1)
    assert limited.fetch(spark, {"baloto": 1203}).count() == 1 and limited.warnings
    with pytest.raises(ValueError):
        Site().source().fetch(spark, {})


def test_web_refusals_and_retries(spark):
    for robots, kind in (((403, ""), web.Refused), ((500, ""), web.WebError), ((200, "User-agent: *\nDisallow: /"), web.WebError)):
        with pytest.raises(kind):
            Site(robots).source().check_robots()
    Site((404, "")).source().check_robots()
    site = Site(fail=[OSError("down"), 503])
    assert site.source().fetch_draw("baloto", 1204)["number"] == 1204 and site.slept == [5.0, 2.5, 10.0, 2.5]
    for status, kind in ((429, web.Refused), (418, web.WebError)):
        site = Site(fail=[status])
        with pytest.raises(kind):
            site.source().fetch_draw("baloto", 1204)
        assert len(site.asked) == 1  # not asked again
    with pytest.raises(web.WebError):
        Site(fail=[503, 503, 503]).source().fetch_draw("baloto", 1204)
    odd = Site()
    source = odd.source()
    odd.get = lambda url: (200, _page("1204", "Lunes"))
    source.get = odd.get
    assert source.fetch_draw("baloto", 1204) and source.warnings
    with pytest.raises(web.PageError):
        source.fetch_draw("baloto", 1205)


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    schema = "id string, combinacion string, p_balls array<double>"
    assert store.read_log(spark, path, schema).collect() == []
    assert store.append_rows(spark.createDataFrame([("a-1", "01-02", [0.5, 0.25])], schema), path) == 1
    before = open(path).read()
    assert before == "id,combinacion,p_b01,p_b02\na-1,01-02,0.5,0.25\n"
    store.append_rows(spark.createDataFrame([("a-2", "03-04", [0.1, 0.9])], schema), path)
    assert store.append_rows(spark.createDataFrame([], schema), path) == 0
    rows = store.read_log(spark, path, schema).orderBy("id").collect()
    assert [(r["combinacion"], r["p_balls"]) for r in rows] == [("01-02", [0.5, 0.25]), ("03-04", [0.1, 0.9])]
    after = open(path).read()
    assert store.only_grew(before, after) and not store.only_grew(after, before)
    store.add_columns(path, ["x"], [[1], [2]])
    assert store.only_grew(after, open(path).read())
    with pytest.raises(ValueError):
        store.add_columns(path, ["y"], [[1]])
    with pytest.raises(ValueError, match="missing"):
        store.read_log(spark, path, schema + ", other int")


@pytest.mark.parametrize("new, ok", [("a,b\n1,2\n3,4\n", True), ("a,b\n1,5\n", False), ("a,b\n", False), ("b,a\n2,1\n", False), ("a,b,c\n1,2,9\n", True), ("a,b,c\n1,2\n", False), ("a,b\n1,2,9\n", False)])
def test_only_grew(new, ok):
    assert store.only_grew("a,b\n1,2\n", new) == ok


def test_stream_takes_every_file_once(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "draws", "state"))
    store.write_incoming(_rows(spark, range(1, 6)), folder, "a")
    pick_up(spark, folder, table, checkpoint)
    pick_up(spark, folder, table, checkpoint)
    assert spark.read.parquet(table).count() == 5
    store.write_incoming(_rows(spark, range(4, 9)), folder, "b")
    pick_up(spark, folder, table, checkpoint)
    assert sorted(r["n_sorteo"] for r in spark.read.parquet(table).collect()) == list(range(1, 9))
    store.write_incoming(_rows(spark, [3], extra=1), folder, "c")
    with pytest.raises(Exception):
        pick_up(spark, folder, table, checkpoint)
    assert spark.read.parquet(table).count() == 8
