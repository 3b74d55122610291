import colorsys
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import catalog as C
from lectern.operators import catalog as K
from lectern.operators import suitability as U
from lectern.sources import media as M

ROW = "row int, id string, link string, cuts string, note string, bg array<string>, fg string"


def rows(spark):
    return spark.createDataFrame(
        [(2, "a", "", "", "", [], "#000000"), (3, "b", "", "", "", ["#cc0000"], ""), (4, "a", "", "", "", [], ""), (5, "c", "", "0:01-0:02", "", [], ""), (6, "d", "", "", "", [], "#ff0000"), (7, "e", "", "", " ", [], "")], ROW
    )


def test_selection(spark):
    found = {r.row: r.reason for r in K.link_reasons(rows(spark), 2, 7).collect()}
    assert found == {2: None, 3: "red", 4: "repeat", 5: "filled", 6: "red", 7: None}
    assert [r.link for r in K.select_links(rows(spark), 7, 7).collect()] == [C.LINK + "e"]


def test_transcript_states(spark):
    done = spark.createDataFrame([(4,)], "row int")
    found = {r.id: r.state for r in K.video_states(rows(spark), None, done).collect()}
    assert found == {"a": "done", "b": "red", "c": None, "d": "red", "e": None}


def test_red_equals_colorsys(spark):
    random.seed(5)
    colors = [f"#{random.randrange(1 << 24):06x}" for _ in range(500)] + ["", None, "red", "#fff", "cc0000", "#000000", "#ffffff"]

    def plain(c):
        import re

        m = re.fullmatch(r"#?([0-9a-fA-F]{6})", c or "")
        if not m:
            return False
        h, s, v = colorsys.rgb_to_hsv(*(int(m[1][i : i + 2], 16) / 255 for i in (0, 2, 4)))
        return (h <= 20 / 360 or h >= 340 / 360) and s >= 0.15 and v >= 0.25

    found = spark.createDataFrame([(i, c) for i, c in enumerate(colors)], "i int, c string").select("i", C.is_red(F.col("c")).alias("r")).orderBy("i").collect()
    assert [r.r for r in found] == [plain(c) for c in colors]


def test_row_numbers(spark):
    one = lambda s: spark.createDataFrame([(s,)], "s string").select(C.row_numbers(F.col("s")).alias("r")).first().r
    assert one("3-5, 9; 12 – 10") == [3, 4, 5, 9, 10, 11, 12]
    assert one("") is None and one(None) is None
    for bad in ("a", "1-2-3", "1-200002"):
        with pytest.raises(Exception, match="bad rows"):
            one(bad)


def test_columns_links_connections(spark):
    both = spark.range(1, 200).select(F.col("id").cast("int").alias("n")).withColumn("s", C.column_letters(F.col("n"))).withColumn("b", C.column_number(F.col("s")))
    assert both.filter("n <> b").isEmpty() and both.filter("n = 52").first().s == "AZ"
    links = ["https://www.youtube.com/watch?v=abcdefghijk&x=1", "https://youtu.be/abcdefghijk", "https://youtube.com/shorts/abcdefghijk", "https://x.com/embed/abcdefghijk", "https://x.com", None]
    found = [r.i for r in spark.createDataFrame([(x,) for x in links], "l string").select(C.link_id(F.col("l")).alias("i")).collect()]
    assert found == ["abcdefghijk"] * 4 + [None, None]


def test_connection_lines(spark):
    fields = {"url": "https://x/?a=b&c=ü", "key": "k>>>???", "link_col": "C", "note_col": "", "other": "o"}
    made = spark.createDataFrame([(fields,)], "f map<string,string>").select(C.connection_line(F.col("f")).alias("l")).first().l
    assert made.startswith("lectern:") and "+" not in made and "/" not in made[8:]
    lines = [made, f" {made[:20]} \n\t{made[20:]}", "", None, "lectern:x", "lectern:!!!", made[8:], made[:-9]]
    lines += [r.l for r in spark.createDataFrame([({"url": "x"},), ({"key": "x"},)], "f map<string,string>").select(C.connection_line(F.col("f")).alias("l")).collect()]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").select("i", C.connection_fields(F.col("l")).alias("f")).orderBy("i").collect()
    kept = {"url": fields["url"], "key": fields["key"], "link_col": "C"}
    assert [r.f for r in found] == [kept, kept, *[None] * 8]


def test_worker_plans():
    """Never more threads or memory than there are, never less than one process of one thread."""
    for threads in range(1, 65):
        for ram in range(1, 65):
            processes, each = C.worker_plan(threads, ram)
            assert 1 <= processes <= 4 and each >= 1 and (processes * each <= threads or processes == each == 1)
            assert processes == 1 or 4 + 1.5 * processes <= ram
    assert C.worker_plan(64, 64) == (4, 16)


def test_numbered_names(spark):
    names = spark.createDataFrame([(1, "a", ".m4a"), (2, "a", ".m4a"), (3, "b", ".m4a")], "pos int, name string, ext string")
    taken = spark.createDataFrame([("b.m4a",), ("b (2).m4a",)], "full_name string")
    assert [r.output for r in K.numbered_names(names, taken).orderBy("pos").collect()] == ["a.m4a", "a (2).m4a", "b (3).m4a"]


def test_numbered_names_take_the_least_free_number(spark):
    """Against a plain walk in order; the plain name is used where only numbered ones are taken."""
    rng = random.Random(4)
    for _ in range(4):
        taken = {f"{rng.choice('xy')}{rng.choice(['', ' (2)', ' (3)', ' (5)'])}.m4a" for _ in range(5)} | {"b (5).m4a"}
        names = [rng.choice(["x", "y", "b", "Z"]) for _ in range(9)]
        used, expected = set(taken), []
        for name in names:
            n = 1
            while (out := f"{name}.m4a" if n == 1 else f"{name} ({n}).m4a") in used:
                n += 1
            used.add(out)
            expected.append(out)
        df = spark.createDataFrame([(i, n, ".m4a") for i, n in enumerate(names)], "pos int, name string, ext string")
        found = [r.output for r in K.numbered_names(df, spark.createDataFrame([(t,) for t in taken], "full_name string")).orderBy("pos").collect()]
        assert found == expected
    asked = spark.createDataFrame([(1, "a", ".x"), (2, "a", ".x"), (3, "a (2)", ".x")], "pos int, name string, ext string")
    assert [r.output for r in K.numbered_names(asked, spark.createDataFrame([], "full_name string")).orderBy("pos").collect()] == ["a.x", "a (3).x", "a (2).x"]


def test_skips_of_files_without_a_row(spark):
    table = spark.createDataFrame([(2, "v", [], ""), (3, "r", ["#cc0000"], "")], "row int, id string, bg array<string>, fg string")
    data = [(i, f"/m/n{i}.m4a", None, False, False) for i in range(50)] + [(60, "/m/a.m4a", 2, False, False), (61, "/m/b.m4a", 2, True, False), (62, "/m/b.m4a", 2, False, False), (63, "/m/c.m4a", 3, False, False)]
    files = spark.createDataFrame(data, "file_id int, path string, row int, has_cut boolean, has_result boolean")
    found = {r.file_id: r.skip for r in K.mark_skips(files, table).collect()}
    assert [found[i] for i in (60, 61, 62, 63)] == ["repeat", None, "same", "red"] and all(found[i] is None for i in range(50))


def test_sheet_sinks(spark):
    sheet = spark.createDataFrame([(1, "x", "L", "t1"), (2, "y", "L", "t2"), (3, "x", "L", "t3")], "row int, id string, link string, text string")
    updates = spark.createDataFrame([("x", "N", "new", 1), ("z", "N", "z1", 2), ("z", "N", "z2", 3), ("w", "N", "w1", 4)], "id string, link string, text string, seq int")
    assert sorted((r.row, r.text) for r in M.append_texts(sheet, updates).collect()) == [(1, "new"), (2, "t2"), (3, "t3"), (4, "z2"), (5, "w1")]
    empty = M.append_texts(sheet.limit(0), updates).collect()
    assert sorted((r.row, r.text) for r in empty) == [(1, "Расшифровка"), (2, "new"), (3, "z2"), (4, "w1")]
    grid = spark.createDataFrame([(1, "a", ""), (2, " ", None), (3, "", "b")], "row int, c string, d string")
    assert sorted((r.row, r.new_row) for r in M.compact(grid, ["c", "d"]).collect()) == [(1, 1), (3, 2)]


def test_files_and_report(spark, tmp_path):
    (tmp_path / "готово").mkdir()
    for name in ("a.m4a", "b.MP4", "c.txt", ".d.m4a", "e_cut.m4a", "готово/f.m4a"):
        (tmp_path / name).write_bytes(b"x")
    found = M.media_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.m4a", "b.MP4"]
    known = spark.createDataFrame([(f"{tmp_path}//./a.m4a",)], "path string")
    assert [r.path.rsplit("/", 1)[1] for r in M.new_files(found, known).collect()] == ["b.MP4"]
    links = spark.createDataFrame([(2, "l2"), (1, "l1")], "row int, link string")
    M.write_links(links.coalesce(1), str(tmp_path / "links"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "links").glob("part*"))) == b"l1\r\nl2\r\n"
    store = M.SessionStore(spark, str(tmp_path / "store"))
    assert store.load() is None
    store.save(links)
    store.save(links.filter("row = 1"))
    assert store.load().count() == 1


def test_suitability_cases(spark):
    schema = "dialogue_done boolean, conversation boolean, encounter double, lecture double, topic_done boolean, medical boolean, accent_top string, music_share double"
    data = [(True, True, 0.0, 0.0, True, True, "британский", 0.1), (True, False, 0.0, 2.0, True, True, "британский", 0.1), (True, False, 3.0, 0.0, True, True, "американский", 0.6), (False, None, 0.0, 0.0, True, True, None, None)]
    found = [r.w for r in spark.createDataFrame(data, schema).select(U.suitability().alias("w")).collect()]
    assert found == [[], ["НЕ РАЗГОВОР"], ["НЕ БРИТАНСКИЙ АКЦЕНТ", "МУЗЫКА ПОД РЕЧЬЮ"], None]
