"""Solver, exposure, sources and the analysis."""

import io
import itertools
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.functions.lag import CENTERS, kernel_weights
from lagloom.functions.text import date_shape, near_names, normal_header, normal_name, normalize_column, paragraphs, parsed_date, parsed_minutes
from lagloom.operators import baskets
from lagloom.operators.exposure import exposure, lag_join
from lagloom.operators.solver import Groups, most_active, nnls, orthonormal, penalties, residualise
from lagloom.plans import simulate
from lagloom.plans.analyze import Params, analyze, persistence, prewhitened, register_views, vocabulary


def test_names(spark):
    assert normal_name("  Crème-Brûlée  x ") == "creme_brulee_x" and normal_name("Fruit salad - fresh") == "fruit_salad_fresh"
    assert normal_name("ﬁ ½") == "fi_1⁄2" and normal_header(" Pain level (0-10) x") == "pain_level" and normal_header("Médicaments") == "medicaments"
    df = spark.createDataFrame([("A b",), ("Crème",), (None,), ("",)], "n string")
    assert {r["x"] for r in normalize_column(df, "n", "x").collect()} == {"a_b", "creme", None, ""}


def test_paragraphs(spark):
    rows = [(["0a0", "1b1", " 2c ", "", " \u00a0 ", "\u3000d\u2009", "5 5"],), ([],), (None,)]
    got = spark.createDataFrame(rows, "p array<string>").select(paragraphs(F.col("p"))).collect()
    assert [r[0] for r in got] == ["0a0 1b1 2c d 5 5", "", None]


def test_kernels():
    d = np.concatenate([np.linspace(0, 84, 500), [0, 0.125, 168]])
    w = kernel_weights(d)
    assert w.shape[1] == len(CENTERS) and (w >= 0).all() and (w <= 1).all()
    assert (w[d < 0.25] == 0).all() and (w[-1] == 0).all() and (w[(d >= 0.25) & (d <= 60)].sum(axis=1) > 0.2).all()


@pytest.mark.parametrize("bucket", [12.0, 84.0, 200.0])
def test_lag_join_is_the_interval_join(spark, bucket):
    r = np.random.default_rng(0)
    o = [(i % 3, i, float(t)) for i, t in enumerate(r.uniform(-200, 400, 120))] + [(0, 500, 84.25), (0, 501, 0.25)]
    e = [(i % 3, float(t), "x") for i, t in enumerate(r.uniform(-200, 400, 100))] + [(0, 0.0, "y")]
    got = lag_join(spark.createDataFrame(o, "diary_id long, obs_id long, t_h double"), spark.createDataFrame(e, "diary_id long, t_h double, item string"), bucket)
    want = sum(a == b and 0.25 <= t - u <= 84 for a, _, t in o for b, u, _ in e)
    assert got.count() == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exposure(spark):
    o = spark.createDataFrame([(0, 0, 10.0), (0, 1, 100.0)], "diary_id long, obs_id long, t_h double")
    e = spark.createDataFrame([(0, 8.0, "a"), (0, 95.0, "b")], "diary_id long, t_h double, item string")
    x = {(r["obs_id"], r["item"]): r["s"] for r in exposure(o, e).groupBy("obs_id", "item").agg(F.sum("x").alias("s")).collect()}
    assert x[0, "a"] > 1 and x[1, "b"] > 0 and (0, "b") not in x


def test_residualise_and_whiten():
    r = np.random.default_rng(0)
    z = np.column_stack([np.ones(40), np.arange(40.0)])
    x = r.normal(size=(40, 5))
    res = residualise(z, x)
    assert np.abs(z.T @ res).max() < 1e-8
    e = r.normal(size=4000)
    for i in range(1, len(e)):
        e[i] += 0.6 * e[i - 1]
    assert abs(persistence(e) - 0.6) < 0.05 and persistence(-np.abs(e) * (-1.0) ** np.arange(4000)) == 0 and persistence(np.ones(9)) == 0.9
    even = prewhitened(x, np.arange(40) * 6.0, 0.5)
    assert len(even) == 39 and np.allclose(even, x[1:] - 0.5 * x[:-1])
    t = np.cumsum(np.tile([1.0, 1.0, 2.0], 14))[:40]
    assert np.allclose(prewhitened(x, t, 0.5)[1], x[2] - 0.25 * x[1])


def planted(seed=0, n=200):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 42))
    return x.T @ x / n, x.T @ (x[:, 7:14] @ np.full(7, 1.5) + r.normal(0, 0.5, n)) / n


def test_group_lasso():
    g, c = planted()
    groups = Groups(g)
    beta = groups.solve(c, 0.15)
    assert groups.active(beta).tolist() == [False, True, False, False, False, False] and (beta >= 0).all()
    assert not groups.active(groups.solve(c, groups.largest(c) * 1.001)).any()
    t = orthonormal(g)
    signed = Groups(t.T @ g @ t, positive=False)
    assert signed.active(signed.solve(t.T @ c, 0.3)).tolist()[1]


def test_group_lasso_is_optimal():
    """Conditions of the least value hold, also where columns are nearly or wholly dependent."""
    for seed in range(20):
        r = np.random.default_rng(seed)
        x = np.maximum(0, r.normal(size=(8 + 3 * seed, 35)).cumsum(axis=1))
        x[:, 8] = x[:, 7]
        g, c = x.T @ x / len(x), x.T @ (x[:, 7:14].sum(axis=1) + r.normal(size=len(x))) / len(x)
        groups = Groups(g)
        for share in (0.7, 0.3, 0.1, 0.03):
            by = groups.largest(c) * share * 7**0.5
            beta = groups.solve(c, by / 7**0.5)
            slope = (c - g @ beta).reshape(5, 7)
            assert (beta >= 0).all()
            for b, v in zip(beta.reshape(5, 7), slope):
                if b.any():
                    left = v - by * b / np.linalg.norm(b)
                    assert np.abs(left[b > 0]).max() < 1e-3 * by and left.max() < 1e-3 * by
                else:
                    assert np.linalg.norm(np.maximum(v, 0)) <= by * 1.001


def test_penalties_keep_to_the_sparse_part():
    g, c = planted(3)
    t = orthonormal(g)
    for groups, target, points in ((Groups(g), c, 50), (Groups(t.T @ g @ t, positive=False), t.T @ c, 40)):
        for q in (1, 2, 4):
            lams = penalties(groups, target, q)
            path = groups.largest(target) * np.logspace(0, -2, points)
            assert 1 <= len(lams) <= 6 and all(np.isclose(path, x).any() for x in lams) and (np.diff(lams) < 0).all()
            assert all(1 <= groups.active(groups.solve(target, x)).sum() <= q for x in lams)
    nothing = Groups(np.eye(14))
    assert len(penalties(nothing, np.full(14, 1.0), 1)) == 1  # both groups enter at once: the fifth point stands in
    assert most_active(2) == 4 and most_active(40) == 6


def test_nnls_against_active_sets():
    for seed in range(30):
        r = np.random.default_rng(seed)
        x, y = r.normal(size=(12, 4)), r.normal(size=12)
        best = min(
            (float(((y - x[:, s] @ b) ** 2).sum()) for k in range(5) for s in map(list, itertools.combinations(range(4), k)) if (b := np.linalg.lstsq(x[:, s], y, rcond=None)[0]).min(initial=0) >= 0),
        )
        b = nnls(x.T @ x, x.T @ y)
        assert (b >= 0).all() and abs(((y - x @ b) ** 2).sum() - best) < 1e-8


def test_fusion(spark):
    rows = [(0, i, float(i), x) for i in range(10) for x in ["garlic", "onion"] + ["rice"] * (i % 2)]
    got = baskets.fuse(spark.createDataFrame(rows, "diary_id long, entry_id long, t_h double, item string"), ["diary_id"])
    assert {r["block"] for r in got.collect()} == {"garlic+onion", "rice"}


def test_reliever_is_never_fused(spark):
    e = spark.createDataFrame([(0, i, float(i), ["bread"]) for i in range(12)], "diary_id long, entry_id long, t_h double, items array<string>")
    events, _ = vocabulary(e, e.withColumn("items", F.array(F.lit("antacid"))), Params())
    assert {(r["block"], r["sign"]) for r in events.collect()} == {("bread", 1), ("antacid", -1)}
    both, _ = vocabulary(e, e, Params())
    assert {(r["block"], r["sign"]) for r in both.collect()} == {("bread", 1)}


def test_end_to_end(spark):
    """Six diaries of 56 days: every culprit at its delay, and at most one other block in the mean."""
    setup = simulate.Setup(n_days=56, reading_hours=simulate.READING_HOURS)
    o, e, r = simulate.split(simulate.generate(spark, 6, setup).persist())
    results, stats, _ = analyze(o, e, r, replicates=80)
    rows = results.where("selected").collect()
    found = {(x["diary_id"], x["block"]): x["lag_h"] for x in rows}
    for item, (lag, _) in simulate.CULPRITS.items():
        delays = [found[d, item] for d in range(6) if (d, item) in found]
        assert len(delays) >= 5 and np.median(np.abs(np.array(delays) - lag)) <= 4 and max(abs(x - lag) for x in delays) <= 8
    assert sum(x["block"] not in simulate.CULPRITS for x in rows) <= 6
    assert stats.where("error is not null").isEmpty()


def test_errors_and_several_diaries(spark):
    o = spark.createDataFrame([(d, i, i * 5.0, (i * 5.0) % 24, float(i % 4)) for d in (0, 1) for i in range(20)], "diary_id long, obs_id long, t_h double, hod double, y double")
    e = spark.createDataFrame([(0, i, i * 7.0, ["a"] if i % 2 else ["b"]) for i in range(12)] + [(1, 0, 1.0, ["rare"])], "diary_id long, entry_id long, t_h double, items array<string>")
    results, stats, discarded = analyze(o, e, replicates=10)
    told = {r["diary_id"]: r["error"] for r in stats.collect()}
    assert told[1] == "no_items" and set(told) == {0, 1} and {r["item"] for r in discarded.collect()} == {"rare"}
    alone, _, _ = analyze(o.where("diary_id = 0").repartition(3), e.where("diary_id = 0"), replicates=10)
    assert sorted(map(tuple, alone.select("block", "frequency").collect())) == sorted(map(tuple, results.select("block", "frequency").collect()))


DIARY = """date,time,meal,foods,medications,pain
1/3/26,08:00,breakfast,Bread;coffee,,2
1/1/26,,lunch,bread; Coffee ,antacid;iron,3
1/1/26,12:30,,tea,,
1/4/26,9:00,,,,"1,5"
1/5/26,9:00,,rice,,abc
junk,9:00,,rice,,1
,,,,,
 , ,,"  ",,
1/6/26,10:00,,,,4
"""


def test_csv_and_ods(spark, tmp_path):
    from lagloom.sources import ods
    from lagloom.sources.diary import load

    (tmp_path / "d.csv").write_text("﻿" + DIARY, encoding="utf-8")
    rows = [x.replace('"1,5"', "1.5").replace('"', "").split(",") for x in DIARY.splitlines()]
    (tmp_path / "d.ods").write_bytes(ods.document(rows))
    for name in ("d.csv", "d.ods"):
        obs, entries, relievers, said = load(spark, str(tmp_path / name))
        y = obs.orderBy("t_h").collect()
        assert [r["y"] for r in y] == [3.0, 2.0, 1.5, 4.0] and y[0]["hod"] == 12.0
        assert y[-1]["obs_id"] == 8  # blank rows, also of blanks, don't count as lines
        e = entries.orderBy("t_h").collect()
        assert [r["items"] for r in e] == [["bread", "coffee"], ["tea"], ["bread", "coffee"], ["rice"]] and e[1]["t_h"] - e[0]["t_h"] == 0.5
        assert [r["items"] for r in relievers.collect()] == [["antacid", "iron"]]
        assert {r["code"] for r in said.collect()} == {"bad_date", "bad_outcome", "default_time"}


def test_missing_columns_and_empty_files(spark, tmp_path):
    from lagloom.sources.diary import load

    (tmp_path / "m.csv").write_text("date,foods\n1/1/26,tea\n", encoding="utf-8")
    obs, entries, relievers, said = load(spark, str(tmp_path / "m.csv"))
    assert obs.count() == 0 and [r["items"] for r in entries.collect()] == [["tea"]] and relievers.count() == 0
    assert {(r["code"], r["arg"]) for r in said.collect()} == {("missing_column", "pain"), ("default_time", "1")}
    (tmp_path / "f.csv").write_text("date,heure,aliments,douleur\n31/01/2026,8:00,Thé;thé vert,\"2,5\"\n", encoding="utf-8")
    obs, entries, _, said = load(spark, str(tmp_path / "f.csv"), lang="fr")
    assert obs.first()["y"] == 2.5 and entries.first()["items"] == ["the", "the_vert"] and said.count() == 0
    (tmp_path / "e.csv").write_text("", encoding="utf-8")
    obs, entries, _, said = load(spark, str(tmp_path / "e.csv"))
    assert obs.count() == 0 and entries.count() == 0 and "no_lines" in {r["code"] for r in said.collect()}


def test_ods_package(tmp_path):
    from lagloom.sources import ods

    data = ods.document([["Date", "t", "v"], ["2026-03-01", "8:00", "2"], ["", "", ""], ["a<b", None, "2.5"], [" 2026-03-02 ", "1e3", ".5"], ["  x  ", "-2", "nan"]])
    (tmp_path / "x.ods").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "x.ods") as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and "styles.xml" in z.namelist()
        content = z.read("content.xml").decode()
    declared, used = set(re.findall(r'<style:style style:name="([^"]+)"', content)), set(re.findall(r'table:style-name="([^"]+)"', content))
    assert used and used <= declared and "<number:date-style" in content and "<number:time-style" in content
    assert content.count('value-type="date"') == 2 and content.count('value-type="float"') == 5
    assert ods.sheet_rows(data) == [["Date", "t", "v"], ["2026-03-01", "08:00", "2"], [], ["a<b", "", "2.5"], ["2026-03-02", "1000", "0.5"], ["x", "-2", "nan"]]
    with pytest.raises(ValueError, match="diary"):
        ods.sheet_rows(data, "other")


SHEET = """<office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"
 xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:spreadsheet>{}</office:spreadsheet></office:body></office:document-content>"""


def packed(*tables: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", SHEET.format("".join(f'<table:table table:name="s{i}">{t}</table:table>' for i, t in enumerate(tables))))
    return out.getvalue()


def test_ods_cells():
    from lagloom.sources import ods

    cell = lambda kind, shown, **a: f'<table:table-cell office:value-type="{kind}" ' + " ".join(f'office:{k}="{v}"' for k, v in a.items()) + f"><text:p>{shown}</text:p></table:table-cell>"
    noted = '<table:table-cell><office:annotation><text:p>a private comment</text:p></office:annotation><text:p>x</text:p><text:p> </text:p><text:p> y<text:span>z</text:span></text:p></table:table-cell>'
    row = noted + cell("date", "shown").replace("office:value-type", "office:date-value=\"2026-01-02T08:00\" office:value-type") + cell("time", "8 h").replace("office:value-type", 'office:time-value="PT08H30M05S" office:value-type')
    row += cell("time", "8 h").replace("office:value-type", 'office:time-value="soon" office:value-type') + cell("float", "2,0", value="2.0") + cell("percentage", "50 %", value="0.5") + cell("currency", "3", value="odd") + cell("boolean", "WAHR").replace("office:value-type", 'office:boolean-value="true" office:value-type')
    assert ods.sheet_rows(packed(f"<table:table-row>{row}</table:table-row>")) == [["x yz", "2026-01-02", "08:30", "8 h", "2", "0.5", "3", "true"]]
    flat = SHEET.format('<table:table table:name="f"><table:table-row>' + cell("float", "2", value="2") + "</table:table-row></table:table>").encode()
    assert ods.sheet_rows(flat) == [["2"]]


def test_ods_repeats():
    from lagloom.sources import ods

    text = lambda t, n="": f"<table:table-cell {n}><text:p>{t}</text:p></table:table-cell>"
    blank = '<table:table-cell table:number-columns-repeated="{}"/>'
    rows = f"<table:table-row>{text('date')}{blank.format(3)}{text('pain')}</table:table-row>"
    rows += f'<table:table-row table:number-rows-repeated="1048576">{blank.format(16384)}</table:table-row>'
    assert ods.sheet_rows(packed(rows)) == [["date", "", "", "", "pain"]]
    rows += f"""<table:table-row table:number-rows-repeated="2">{text("a", 'table:number-columns-repeated="2"')}{blank.format("x")}{text("b")}</table:table-row>"""
    assert ods.sheet_rows(packed("", rows), "s1") == [["date", "", "", "", "pain"], [], ["a", "a", "", "b"], ["a", "a", "", "b"]]
    assert ods.sheet_rows(packed("", rows)) == []
    many = ods.sheet_rows(packed(f"<table:table-row>{blank.format(99999)}{text('z')}</table:table-row>"))
    assert [len(r) for r in many] == [ods.MOST_REPEATS + 1]


def test_ods_source_reads_folders(spark, tmp_path):
    from lagloom.sources import ods

    ods.register(spark)
    for i in range(3):
        (tmp_path / f"d{i}.ods").write_bytes(ods.document([["a"], [f"v{i}"]]))
    for got in (spark.read.format("ods").load(str(tmp_path)), spark.read.format("ods").load(f"file://{tmp_path}"), ods.sheets(spark, str(tmp_path))):
        assert sorted((r["row_no"], r["cells"][0]) for r in got.collect()) == [(0, "a")] * 3 + [(1, f"v{i}") for i in range(3)]


def test_times_and_dates(spark):
    rows = [("8:00", 480), (" 08:05:59 ", 485), ("8:30am", 510), ("12:00 AM", 0), ("12:15pm", 735), ("13:00pm", None), ("24:00", None), ("8:60", None), ("8", None), ("", None), (None, None), ("8:30amx", None), ("x8:30", None), ("008:30", None)]
    got = spark.createDataFrame(rows, "t string, want int").select("want", parsed_minutes(F.col("t")).alias("m")).collect()
    assert all(r["m"] == r["want"] for r in got)
    days = [("2026-1-5", "2026-01-05"), ("1/5/26", "2026-01-05"), (" 01/05/2026", "2026-01-05"), ("1.5.2026", "2026-01-05"), ("13/1/2026", None), ("1/5/026", None), ("junk", None), ("", None), (None, None)]
    got = spark.createDataFrame(days, "t string, want string").select("want", parsed_date(F.col("t"), ("yyyy-M-d", "M/d/yyyy", "M/d/yy", "M.d.yyyy")).cast("string").alias("d")).collect()
    assert all(r["d"] == r["want"] for r in got) and date_shape("M.d.yy") == r"^\d{1,2}\.\d{1,2}\d{2}$".replace(r"\d{1,2}\d{2}", r"\d{1,2}\.\d{2}")


@pytest.mark.parametrize("distance", [1, 2])
def test_near_names(spark, distance):
    r = np.random.default_rng(distance)
    names = sorted({"".join(r.choice(list("abc"), r.integers(1, 6))) for _ in range(80)})

    def far(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b) for a, b in itertools.combinations(names, 2) if a[0] == b[0] and far(a, b) <= distance}
    assert {tuple(x) for x in near_names(spark.createDataFrame([(n,) for n in [*names, "", None]], "item string"), distance=distance).collect()} == want


def test_ods_folder(spark, tmp_path):
    from lagloom.sources import ods

    ods.register(spark)
    orders = spark.range(ods.MOST_ROWS + 1000).selectExpr("id % 3 as k")  # more than a sheet holds
    orders.repartition(2).write.format("ods").mode("append").save(f"file://{tmp_path}/many")
    files = sorted((tmp_path / "many").iterdir())
    assert len(files) == 2 * -(-(ods.MOST_ROWS // 2 + 500) // ods.FILE_ROWS)
    got = ods.read_ods(spark, f"{tmp_path}/many")
    assert {(r["k"], r["count"]) for r in got.groupBy("k").count().collect()} == {(str(r["k"]), r["count"]) for r in orders.groupBy("k").count().collect()}
    two = spark.createDataFrame([("<&>", " x "), ("2026-01-02", None)], "a string, b string").coalesce(1)
    for mode, n in (("append", 2), ("append", 4), ("overwrite", 2)):
        two.write.format("ods").mode(mode).save(f"{tmp_path}/two")
        assert sorted((r["line_no"], r["a"], r["b"]) for r in ods.read_ods(spark, f"{tmp_path}/two").collect())[:2] == [(2, "<&>", "x"), (3, "2026-01-02", "")]
        assert ods.read_ods(spark, f"{tmp_path}/two").count() == n
    two.where("a = ''").write.format("ods").mode("append").save(f"{tmp_path}/none")
    assert ods.read_ods(spark, f"{tmp_path}/none").columns == ["a", "b", "line_no"]
    two.toDF("b", "a").write.format("ods").mode("append").save(f"{tmp_path}/two")
    with pytest.raises(Exception, match="has the columns"):
        ods.read_ods(spark, f"{tmp_path}/two").collect()


def test_near_names_sends_no_forms_to_all(spark, tmp_path):
    spark.range(300).selectExpr("concat('n', id) as item").write.parquet(str(tmp_path / "names"))
    got = near_names(spark.read.parquet(str(tmp_path / "names")))
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_components_of_long_chains(spark):
    """Chains, a star, a ring and lone items; by joins and by union-find."""
    pairs = [(0, f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [(0, "s", f"s{i}") for i in range(20)] + [(1, f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [(1, "c000", "c001")]
    items = {(g, x) for g, a, b in pairs for x in (a, b)} | {(0, "alone"), (1, "alone")}
    p, i = spark.createDataFrame(pairs, "diary_id long, a string, b string"), spark.createDataFrame(sorted(items), "diary_id long, item string")
    root = lambda g, x: x if x == "alone" else "r0" if x[0] == "r" else "s" if x[0] == "s" else "c000"
    for f in (baskets.components, baskets.grouped_components):
        assert {tuple(r) for r in f(i, p, ["diary_id"]).collect()} == {(g, x, root(g, x)) for g, x in items}


def test_report_and_cli(spark, tmp_path, capsys, monkeypatch):
    from lagloom import cli
    from lagloom.plans.report import diagnostic, text
    from lagloom.sources.i18n import MESSAGES, message

    monkeypatch.setenv("LAGLOOM_LANG", "en")
    assert cli.main([]) == 1 and cli.main(["--format-help"]) == 0
    for name in ("e.csv", "e.ods"):
        assert cli.main(["--example", str(tmp_path / name), "3"]) == 0
    capsys.readouterr()
    assert cli.main(["--lang", "fr", "--example", str(tmp_path / "f.csv"), "3"]) == 0
    assert "fromage" in capsys.readouterr().out and (tmp_path / "f.csv").read_text().startswith("date,heure,repas,aliments,medicaments,douleur")
    rows, true = cli.example_rows(3, reading_hours=(9.0,), reliever=())
    assert len(rows) == 1 + 3 * 4 and len(true) == 3 and all(not r[4] for r in rows[1:])
    assert len(cli.example_rows(3)[0]) == 1 + 3 * 9
    r = spark.createDataFrame([(0, "a+b", 1, 0.9, 5.0, 1.2, 0.3, 9, True), (0, "pill", -1, 0.8, 4.0, -1.0, -0.2, 7, True), (0, "c", 1, 0.1, None, 0.0, 0.0, 3, False)], "diary_id long, block string, sign int, frequency double, lag_h double, peak double, effect double, occurrences long, selected boolean")
    schema = "diary_id long, rho double, n_obs long, n_days long, n_blocks long, replicates long, undetectable array<string>, error string"
    s = spark.createDataFrame([(0, 0.3, 50, 1, 3, 20, ["tea"], None), (1, 0.0, 5, 0, 0, 0, [], "no_items")], schema)
    few = spark.createDataFrame([(0, "egg", 1)], "diary_id long, item string, n long")
    out = text(r, s, few)
    assert "a+b" in out and "℞" in out and "tea" in out and "egg" in out and "a + b" in out and "leave out, one at a time, a+b" in out and "pill" not in out.splitlines()[-1]
    assert out.startswith("1 day, 50 readings")
    french = text(r, s, few, lang="fr")
    assert french.startswith("1 jour, 50 relevés") and "Trop rares : egg" in french and "Ensuite" in french and "Next" not in french
    assert text(r, s, few, 1, lang="fr") == "Erreur : aucun élément n'est assez fréquent" and text(r, s, few, 9) == "Error: no such diary"
    row = {"line_no": None, "code": "default_time", "arg": "1"}
    assert diagnostic(row) == "1 row without a time, noon taken" and diagnostic(row | {"arg": "2"}, "fr") == "2 lignes sans heure, midi retenu"
    assert message("default_time", "fr", n=0).startswith("0 ligne ") and message("default_time", "en", n=0).startswith("0 rows") and message("no_diary", "xx") == "no such diary"
    assert all(set(x) == {"en", "fr"} for x in MESSAGES.values())


def test_plot(spark, tmp_path, monkeypatch):
    from lagloom.plans import plot

    o = spark.createDataFrame([(0, 0, 100.0), (0, 1, 10.0)], "diary_id long, obs_id long, t_h double")
    x = exposure(o, spark.createDataFrame([(0, 8.0, "a"), (0, 95.0, "b")], "diary_id long, t_h double, item string"))
    rows = plot.series(o, x, ["a", "b"], [("a", None), ("b", 1), 8])
    labels = plot.write_table(rows, str(tmp_path / "t.tsv"))
    assert labels == ["a, all delays", "b, 5 h", "column 8"]
    lines = [line.split("\t") for line in (tmp_path / "t.tsv").read_text().splitlines()]
    assert lines[0][0] == "# t" and [line[0] for line in lines[1:]] == ["10", "100"] and float(lines[1][1]) > 1 and lines[2][2] == lines[2][3] == "1"
    assert [r["label"] for r in plot.series(o, x, ["a", "b"]).select("series", "label").distinct().orderBy("series").collect()] == ["a, all delays", "b, all delays"]
    for wrong in ([("z", None)], [("a", 7)], [14]):
        with pytest.raises(ValueError):
            plot.chosen(["a", "b"], wrong)
    assert 'set output "p.svg"' in plot.script("t", labels, "p.svg", title="x") and "svg size" in plot.script("t", labels, "p.svg")
    ran = []
    monkeypatch.setattr(plot.shutil, "which", lambda _: "gnuplot")
    monkeypatch.setattr(plot.subprocess, "run", lambda *a, **k: ran.append(k["input"]))
    assert plot.draw(rows, str(tmp_path / "t.tsv"), "p.png") == "p.png" and "pngcairo" in ran[0]
    monkeypatch.setattr(plot.shutil, "which", lambda _: None)
    with pytest.raises(RuntimeError):
        plot.draw(rows, str(tmp_path / "t.tsv"))


def test_views_and_kernel_function(spark):
    setup = simulate.Setup(n_days=21, reading_hours=simulate.READING_HOURS)
    o, e, r = simulate.split(simulate.generate(spark, 1, setup).persist())
    names = register_views(o, e, r, prefix="lag_", replicates=10)
    assert set(names) == {f"lag_{x}" for x in ("observations", "entries", "relievers", "events", "exposure", "results", "run_stats", "discarded")}
    assert spark.sql("select count(*) as n from lag_results join lag_run_stats using (diary_id) where frequency between 0 and 1").first()["n"] > 10
    got = spark.sql("select e.d, w.k, w.weight from (select explode(array(0.1D, 2D, 50D)) as d) e, lateral lag_kernels(e.d) w").collect()
    assert len(got) == 21 and all(abs(x["weight"] - kernel_weights(np.array([x["d"]]))[0, x["k"]]) < 1e-12 for x in got)


def test_forest(spark):
    from lagloom.plans import forest

    r = np.random.default_rng(0)
    rows = [(0, i, 6.0 * i, float(5 * (i % 3 == 0) + r.normal())) for i in range(160)]
    o = spark.createDataFrame(rows, "diary_id long, obs_id long, t_h double, y double")
    cells = [(0, i, "good", 1.0) for i in range(0, 160, 3)] + [(0, i, f"noise{j}", float(r.random())) for i in range(160) for j in range(4) if r.random() < 0.5]
    x = spark.createDataFrame(cells, "diary_id long, obs_id long, feature string, x double")
    got = forest.rank(o, x, trees=20, repeats=5).collect()
    assert [g["feature"] for g in got][0] == "good" and len(got) == 5 and got[0]["importance"] > 0.5 > got[1]["importance"] and got[0]["exposed"] == 54
    folds = forest.cross_validate(o, x, trees=10).collect()
    assert [f["fold"] for f in folds] == list(range(10)) and sum(f["n"] for f in folds) == 160 and np.mean([f["r2"] for f in folds]) > 0.5
    names = forest.features_of(x)
    wide = forest.wide(o, x, names).orderBy("obs_id").toPandas()
    model = forest.forest(8).fit(forest.assembled(forest.wide(o, x, names)))
    trees, m = forest.Trees(model.toDebugString), np.stack(wide["x"].to_numpy())
    want = [p["prediction"] for p in model.transform(forest.assembled(forest.wide(o, x, names))).orderBy("obs_id").collect()]
    assert np.allclose(trees.each(m, np.arange(8)).mean(axis=1), want)
    # the sparse count of the squared error is that of whole shuffled predictions
    y, f = wide["y"].to_numpy(), names.index("good")
    shuffled = np.random.default_rng([7, f])
    total = 0.0
    for _ in range(3):
        new = m.copy()
        new[:, f] = m[shuffled.permutation(len(m)), f]
        total += ((y - trees.each(new, np.arange(8)).mean(axis=1)) ** 2 - (y - want) ** 2).sum()
    assert np.isclose(forest._losses(trees, [f], y, m, 3, 7)[0], total)


def test_generator():
    s = simulate.Setup(n_days=400, reading_hours=simulate.READING_HOURS, reliever=simulate.RELIEVER)
    meals, doses, readings = simulate.one_diary(3, s)
    assert len(meals) == 1200 and len(readings) == 1200 + 2400 and [t for t, _ in meals] == sorted(t for t, _ in meals)
    share = lambda name, slot: np.mean([name in items for _, items in meals[slot::3]])
    assert abs(share("coffee", 0) - 0.9) < 0.06 and abs(share("orange_juice", 0) - 0.25) < 0.08 and abs(share("cheese", 1) - 0.35) < 0.08 and share("jam", 2) == 0
    assert all(("garlic" in x) == ("onion" in x) for _, x in meals) and abs(len(doses) / 1200 - 0.75) < 0.05
    assert all(0 <= y <= 10 and y == round(y) for _, _, y in readings)
    again = simulate.one_diary(3, s)
    assert again[2] == readings and simulate.one_diary(4, s)[2] != readings
    french = simulate.one_diary(3, simulate.Setup(n_days=5, lang="fr"))[0]
    assert {"pain", "cafe"} & {i for _, x in french for i in x} and simulate.truth(lang="fr")[0][0] == "fromage"


def test_relief_is_credited(spark):
    """A reliever of which a quarter of the doses is missed comes out negative, culprits stay positive."""
    setup = simulate.Setup(n_days=56, reading_hours=simulate.READING_HOURS, reliever=simulate.RELIEVER)
    o, e, r = simulate.split(simulate.generate(spark, 1, setup).persist())
    results, _, _ = analyze(o, e, r, replicates=80)
    rows = {x["block"]: x for x in results.collect()}
    pill = rows["antacid"]
    assert pill["sign"] == -1 and pill["selected"] and pill["peak"] < 0 and pill["effect"] < 0
    assert all(x["sign"] == 1 and x["effect"] >= 0 for b, x in rows.items() if x["selected"] and b != "antacid")


def test_analysis_without_whitening_or_limits_of_sign(spark):
    setup = simulate.Setup(n_days=56, reading_hours=simulate.READING_HOURS)
    o, e, r = simulate.split(simulate.generate(spark, 1, setup).persist())
    plain, stats, _ = analyze(o, e, r, replicates=40, whiten=False)
    assert stats.first()["rho"] == 0 and stats.first()["n_days"] == 56
    assert len({x["block"] for x in plain.where("selected").collect()} & set(simulate.CULPRITS)) >= 2
    signed, _, _ = analyze(o, e, r, replicates=40, positive=False)
    found = signed.collect()
    assert len(found) > 20 and all(0 <= x["frequency"] <= 1 for x in found) and any(x["frequency"] >= 0.5 for x in found if x["block"] in simulate.CULPRITS)


def test_evaluate(spark):
    from lagloom.plans.evaluate import evaluate

    m = evaluate(spark, n_seeds=2, n_days=28, reading_hours=simulate.READING_HOURS, replicates=20)
    assert m["n_seeds"] == 2 and m["n_obs"] == 28 * 9 and 0 <= m["recall"] <= 1 and 0 <= m["precision"] <= 1 and isinstance(m["false_positives"], dict)
    one = evaluate(spark, n_seeds=1, n_days=28, reading_hours=simulate.READING_HOURS, replicates=20, culprits={"rice": (5.0, 4.0)})
    assert one["recall"] == 1.0


def test_streaming_exposure(spark, tmp_path):
    from lagloom.functions.lag import kernel_table
    from lagloom.streaming.exposure import streaming_exposure

    spark.sql("select 0L as diary_id, 1L as obs_id, timestamp'2026-01-01 10:00:00' as ts").write.parquet(f"{tmp_path}/o")
    spark.sql("select 0L as diary_id, 'a' as item, timestamp'2026-01-01 08:00:00' as ts").write.parquet(f"{tmp_path}/e")
    read = lambda n: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}")
    q = streaming_exposure(read("o"), read("e"), kernel_table(spark)).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(weight) as w from streamed").first()["w"] > 1


def test_queries_match_their_sql(spark, sf):
    """A few queries against DuckDB; the driver compares all of them."""
    import duckdb

    from lagloom.plans.queries import ORACLE, QUERIES

    c = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part", "customer", "documents"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("exposure", "gram_blocks", "free_share_controls", "exposure_plot", "jaccard_pairs", "block_names", "day_blocks", "ar1_rho", "diary_parse", "near_duplicate_names"):
        got = QUERIES[name](spark, sf)
        cols = sorted(got.columns)
        want = c.sql(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect()), name


def test_registered_analyses_take_all_replicates(spark, sf, monkeypatch):
    from lagloom.plans import analyze as module
    from lagloom.plans.queries import QUERIES

    assert {r["replicates"] for r in QUERIES["selection_counts"](spark, sf).collect()} == {200}
    given = []
    monkeypatch.setattr(module, "analyze", lambda o, e, **params: given.append(params) or (o, o, o))
    QUERIES["analyze_full"](spark, sf)
    assert module.Params(**given[0]).replicates == 200


def grown_forest(r, x, y, trees):
    from lagloom.plans import forest

    edges = [np.unique(np.quantile(c, np.linspace(0.1, 0.9, 9))) for c in x.T]
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)
    made = [forest.grown(bins, y, [7, i]) for i in range(trees)]
    return forest.Trees.of(made, edges), made, bins


def test_grown_trees():
    from lagloom.plans import forest

    r = np.random.default_rng(3)
    x = r.random((700, 6)) * (r.random((700, 6)) < 0.6)
    y = 4 * (x[:, 1] > 0.4) + 2 * x[:, 4] * (x[:, 2] == 0) + r.normal(0, 0.1, 700)
    model, made, bins = grown_forest(r, x, y, 30)
    each = model.each(x, np.arange(30))
    assert all(np.allclose(forest.predicted(t, bins), each[:, i]) for i, t in enumerate(made))
    assert 1 - ((y - each.mean(axis=1)) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
    for i, (feature, _, left, right, value) in enumerate(made):
        weight, at = np.random.default_rng([7, i]).poisson(1.0, 700), np.unique(each[:, i], return_inverse=True)[1]
        assert np.bincount(at, weight).min() >= forest.LEAST and np.isclose(value[0], weight @ y / weight.sum())
        depth = np.zeros(len(value), int)
        for a in np.flatnonzero(feature >= 0):
            depth[[left[a], right[a]]] = depth[a] + 1
        assert depth.max() <= forest.DEPTH
    # all features, repeats and rows as whole shuffled predictions have them
    want, wrong = [], (y - each.mean(axis=1)) ** 2
    for f in range(6):
        shuffled, total = np.random.default_rng([5, f]), 0.0
        for _ in range(4):
            new = x.copy()
            new[:, f] = x[shuffled.permutation(700), f]
            total += ((y - model.each(new, np.arange(30)).mean(axis=1)) ** 2 - wrong).sum()
        want.append(total)
    assert np.allclose(forest._losses(model, list(range(6)), y, x, 4, 5), want)
    alone = forest.grown(bins[:, :0], y, [0])
    assert len(alone[0]) == 1 and alone[0][0] == -1


def test_forest_work_follows_splits(monkeypatch):
    """Shuffles look values up; trees are gone through once, however many shuffles there are."""
    from lagloom.plans import forest

    r = np.random.default_rng(4)
    x = r.random((300, 5))
    model, _, _ = grown_forest(r, x, x[:, 0] + x[:, 1], 10)
    monkeypatch.setattr(forest.Trees, "each", lambda *_: pytest.fail("predicted again"))
    assert forest._losses(model, list(range(5)), x[:, 0] + x[:, 1], x, 50, 0)[0] > 0


def test_forest_by_level(spark, monkeypatch):
    """Few readings don't grow by Spark's levels; many do, with like results."""
    from lagloom.plans import forest

    r = np.random.default_rng(1)
    o = spark.createDataFrame([(0, i, 6.0 * i, float(5 * (i % 3 == 0) + r.normal())) for i in range(160)], "diary_id long, obs_id long, t_h double, y double")
    x = spark.createDataFrame([(0, i, "good", 1.0) for i in range(0, 160, 3)] + [(0, i, "bad", float(r.random())) for i in range(0, 160, 2)], "diary_id long, obs_id long, feature string, x double")
    by_level, spark_forest = [], forest.forest
    monkeypatch.setattr(forest, "forest", lambda *a: by_level.append(a) or spark_forest(*a))
    few = forest.cross_validate(o, x, trees=30).collect(), forest.rank(o, x, trees=30, repeats=3).collect()
    assert not by_level
    monkeypatch.setattr(forest, "WHOLE", 0)
    many = forest.cross_validate(o, x, trees=30).collect(), forest.rank(o, x, trees=30, repeats=3).collect()
    assert len(by_level) == 11
    assert [f[:2] for f in few[0]] == [f[:2] for f in many[0]] and abs(np.mean([f["r2"] for f in few[0]]) - np.mean([f["r2"] for f in many[0]])) < 0.1
    assert [f["feature"] for f in few[1]] == [f["feature"] for f in many[1]] == ["good", "bad"] and abs(few[1][0]["importance"] - many[1][0]["importance"]) < 0.3


def test_forest_nested_splits():
    """Trees of two features split by them again and again; each side of each bound is as whole shuffled predictions have it."""
    from lagloom.plans import forest

    r = np.random.default_rng(8)
    x = np.round(r.random((900, 2)), 2)
    y = np.sin(9 * x[:, 0]) + np.cos(7 * x[:, 1]) + r.normal(0, 0.1, 900)
    model, _, _ = grown_forest(r, x, y, 6)
    assert any(start != v for splits, _ in model.plans for v, *_, start, _ in splits)
    base, classes, table = forest._by_class(model, [0, 1], x)
    assert np.allclose(base, model.each(x, np.arange(6)).sum(axis=1))
    for f in (0, 1):
        for of in (0, 17, 450, 899):
            new = x.copy()
            new[:, f] = x[of, f]
            assert np.allclose(base + table[f, classes[f, of]], model.each(new, np.arange(6)).sum(axis=1))


def test_forest_of_shared_rows():
    """Readings of equal exposures share a row; trees and losses are those of a row for each."""
    from lagloom.plans import forest

    r = np.random.default_rng(6)
    x, row = r.random((120, 5)) * (r.random((120, 5)) < 0.5), np.sort(r.integers(0, 120, 3000))
    y = np.round(20 * (x[row, 2] > 0.3) + 9 * x[row, 4] + r.normal(0, 1, 3000))  # whole numbers: sums are equal in any order
    model, made, bins = grown_forest(r, x[row], y, 8)
    edges = [np.unique(np.quantile(c, np.linspace(0.1, 0.9, 9))) for c in x[row].T]
    few = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)
    assert (few[row] == bins).all()
    for i, tree in enumerate(made):
        assert all(np.allclose(a, b) for a, b in zip(tree, forest.grown(few, y, [7, i], row)))
    assert np.allclose(forest._losses(model, [0, 2, 4], y, x, 5, 3, row), forest._losses(model, [0, 2, 4], y, x[row], 5, 3))


def test_forest_rank_of_many_copies(spark, monkeypatch):
    """Copies of a diary's readings add no rows to go through the trees, and trees are grown once."""
    from lagloom.plans import forest

    r = np.random.default_rng(1)
    o = spark.createDataFrame([(d, i, 6.0 * i, float(5 * (i % 3 == 0) + d)) for i in range(90) for d in range(12)], "diary_id long, obs_id long, t_h double, y double")
    cells = [(i, "good", 1.0) for i in range(0, 90, 3)] + [(i, "bad", float(r.random())) for i in range(0, 90, 2)]
    x = spark.createDataFrame([(d, *c) for c in cells for d in range(12)], "diary_id long, obs_id long, feature string, x double")
    rows = forest.wide(o, x, ["bad", "good"])
    shared = forest.alike(rows, 1080).collect()
    assert len(shared) == rows.select("x").distinct().count() < 90 and sum(len(s["ys"]) for s in shared) == 1080
    assert all(s["ys"] == sorted(s["ys"]) for s in shared)
    grow, seen = forest.tasks, spark.sparkContext.accumulator(0)

    def counted(s, n):
        made = grow(s, n)
        return made.mapInPandas(lambda batches: (seen.add(len(b)) or b for b in batches), made.schema)

    monkeypatch.setattr(forest, "tasks", counted)
    got = forest.rank(o, x, trees=60, repeats=4).collect()
    assert seen.value == 3 and [g["feature"] for g in got] == ["good", "bad"] and got[0]["importance"] > 0.5 and [g["exposed"] for g in got] == [360, 540]
    monkeypatch.setattr(forest, "ALIKE", 100)  # very many equal readings are dealt to several rows
    assert len(forest.alike(rows, 1080).collect()) > len(shared)
    again = forest.rank(o, x, trees=60, repeats=4).collect()
    assert [g["exposed"] for g in again] == [360, 540] and abs(again[0]["importance"] - got[0]["importance"]) < 0.3


def test_equal_draws_are_solved_once(monkeypatch):
    import pandas as pd

    from lagloom.plans import analyze as plan

    r = np.random.default_rng(2)
    t = np.sort(r.uniform(0, 24 * 12, 48))  # 12 days, 4 day blocks: 6 halves
    obs = pd.DataFrame({"obs_id": range(48), "t_h": t, "hod": t % 24, "y": r.normal(size=48)})
    cells = pd.DataFrame([(i, b, k, r.random()) for i in range(48) for b in "abcd" for k in range(7) if r.random() < 0.5], columns=["obs_id", "block", "k", "x"])
    p = Params()
    d = plan.prepare(obs, list("abcd"), [1] * 4, cells, dict.fromkeys("abcd", 9), p)
    assert len(d["sizes"]) == 4 and sum(d["times"]) == p.replicates and len(d["draws"]) <= 6
    solved, solve = [], Groups.solve
    monkeypatch.setattr(Groups, "solve", lambda *a: solved.append(1) or solve(*a))
    counts, valid = plan.replicate_counts(d, 0, len(d["draws"]), p)
    assert len(solved) <= 6 * len(d["lams"]) and valid == p.replicates
    # as every draw solved by itself, in the order of the seed
    s, want = np.random.default_rng(p.seed), np.zeros_like(counts)
    for x in [s.choice(4, size=2, replace=False) for _ in range(p.replicates)]:
        n, beta = d["sizes"][x].sum(), None
        groups = Groups(d["grams"][x].sum(axis=0) / n)
        for i, lam in enumerate(d["lams"]):
            beta = groups.solve(d["crosses"][x].sum(axis=0) / n, lam, beta)
            want[i] += groups.active(beta)
    assert (counts == want).all() and counts.any()
    parts = [plan.replicate_counts(d, i, i + 1, p) for i in range(len(d["draws"]))]
    assert (sum(c for c, _ in parts) == counts).all() and sum(v for _, v in parts) == valid
