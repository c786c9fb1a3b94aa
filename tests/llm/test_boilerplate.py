"""Templates of made-up hosts: the article stays, furniture goes."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from linkloom.llm import boilerplate as B

SCHEMA = "extract_id bigint, site string, title string, content string, token int, pages int, _k string"


def word(rng):
    return "".join(rng.choices("abcdefgh", k=5))


def article(rng):
    w = [word(rng) for _ in range(40)]
    return " ".join(w[:20]).capitalize() + ".", " ".join(w[20:]).capitalize() + "."


def pages(rng, hosts=8, each=9):
    rows, truth, n = [], {}, 0
    for h in range(hosts):
        menu = " | ".join(rng.sample(["Home", "News", "Jobs", "About us", "Contact", "Press"], 4))
        for _ in range(each):
            one, two = article(rng)
            title = f"A title {word(rng)} about {word(rng)}"
            lines = [(menu, 1), (f"{rng.randrange(1, 900)} shares", 1), (title, 0), ("", 0), (one, 0)]
            if rng.random() < 0.05:
                lines.append(("In short", 0))
            lines += [("Cookies were the first thing that " + one.lower(), 0), ("  Back to top ", 1), (two, 0), ("Related stories", 1)]
            lines += [(f"- Story {word(rng)} and {word(rng)}", 1) for _ in range(3)] + [(f"(c) Host{h} Daily 20{rng.randrange(10, 25)}", 1)]
            rows.append((n, f"host{h}-daily.example", title, "\n".join(x for x, _ in lines), 0, 0, ""))
            truth[n] = [i for i, (x, drop) in enumerate(lines) if drop and x.strip()]
            n += 1
    return rows, truth


def test_hosts(spark):
    rows, truth = pages(random.Random(1))
    rows.append((900, rows[0][1], rows[0][2], rows[0][3], 0, 0, ""))  # fetched twice
    truth[900] = truth[0]
    got = {r["extract_id"]: r for r in B.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r["dropped"] for k, r in got.items()} == truth
    assert all("shares" not in r["main_text"] and "Cookies" in r["main_text"] for r in got.values())


def test_host_of_one_page_uses_others(spark):
    rows, truth = pages(random.Random(2))
    alone = [r for r in rows if r[1] != "host0-daily.example"] + [rows[0]]
    got = {r["extract_id"]: r["dropped"] for r in B.drop_boilerplate(spark.createDataFrame(alone, SCHEMA)).collect()}
    assert got[0] == truth[0]


def test_join_without_broadcast(spark, monkeypatch):
    rows, truth = pages(random.Random(3), 3)
    monkeypatch.setattr(B, "MAX_BROADCAST", 0)
    got = {r["extract_id"]: r["dropped"] for r in B.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == truth


def test_nulls_blanks_long_and_empty(spark):
    rows = [(1, None, None, None, 0, 0, ""), (2, "a.example", None, "", 0, 0, ""), (3, "", "t", " \n\r\n", 0, 0, ""), (4, None, "t", "one line", 0, 0, ""), (5, "a.example", "t", "x y z.\n" * 50_000, 0, 0, "")]
    got = {r["extract_id"]: r for r in B.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["main_text"] is None and all(r["dropped"] == [] for r in got.values()) and got[4]["main_text"] == "one line"
    assert B.drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classes_nest(spark):
    rows, _ = pages(random.Random(4), 2)
    t = B.templates(spark.createDataFrame(rows, SCHEMA))
    assert t.where("level = 1").agg(F.max("class_size")).first()[0] >= 4  # what stands on every page is one class
    assert t.where("heads_list").select("token").distinct().count() == 1


def test_pages_of_one_title_or_longest_line_all_count(spark):
    rng, rows, truth = random.Random(6), [], {}
    for n in range(8):
        one, two = article(rng)
        lines = ["Our harbour portal", "Enter the club", one, "Notice: " + "this long notice stands on each of the pages of the host. " * 8, two, "Back to the quay"]
        rows.append((n, "hot.example", "Our harbour portal", "\n".join(lines), 0, 0, ""))
        truth[n] = [1, 3, 5]
    rows.append((90, *rows[0][1:3], rows[0][3].replace("\n", " \r\n"), 0, 0, ""))  # fetched twice
    truth[90] = truth[0]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["extract_id"]: r["dropped"] for r in B.drop_boilerplate(df).collect()} == truth
    assert {r["pages"] for r in B.templates(df).collect()} == {8}


def test_furniture_longer_than_the_article(spark):
    rng, rows, truth = random.Random(7), [], {}
    for h in range(6):
        notice = "We use cookies. " + " ".join(word(rng) for _ in range(90)) + "."
        for _ in range(12):
            one, two = article(rng)
            lines = [("Home | News | Jobs", 1), (notice, 1), (one, 0), ("Share this page", 1), (two, 0), (notice.upper(), 1)]
            n = len(rows)
            rows.append((n, f"host{h}.example", "A title", "\n".join(x for x, _ in lines), 0, 0, ""))
            truth[n] = [i for i, (_, drop) in enumerate(lines) if drop]
    assert {r["extract_id"]: r["dropped"] for r in B.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()} == truth


def test_classes_decide(spark):
    """Lines on both pages of a host confirm each other; one such line alone is no class that is large enough."""
    rng, rows = random.Random(8), []
    for n in range(2):
        one, two = article(rng)
        rows.append((n, "small.example", "", "\n".join(["Quay office", "Harbour dues", one, two, "Tide tables"]), 0, 0, ""))
    for n in range(2, 4):
        one, two = article(rng)
        rows.append((n, "single.example", "", "\n".join([one, "Some steps", two]), 0, 0, ""))
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["extract_id"]: r["dropped"] for r in B.drop_boilerplate(df).collect()} == {0: [0, 1, 4], 1: [0, 1, 4], 2: [], 3: []}
    assert {(r["class_size"], r["level"]) for r in B.templates(df).collect()} == {(3, 1)}


def test_text_elsewhere_template_here(spark):
    """What few pages of other hosts have as a heading is of the template of a host that has it on most."""
    rng, rows, truth = random.Random(9), [], {}
    for h in range(9):
        for k in range(30):
            one, two = article(rng)
            heading = h == 0 or k == 3
            rows.append((len(rows), f"h{h}.example", "", "\n".join([one] + ["What we saw"] * heading + [two]), 0, 0, ""))
            truth[len(truth)] = [1] if h == 0 else []
    assert {r["extract_id"]: r["dropped"] for r in B.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()} == truth
