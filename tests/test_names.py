"""Name lookups for every row, against brute force."""

import random
import re

from grovelens.plans import catalogue


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_nearest_name_of_every_part(spark, tmp_path):
    rng = random.Random(2)
    parts = [(k, f"Brand#{k % 3}", "".join(rng.choices("ab", k=rng.randint(0, 9)))) for k in range(1, 90)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for key, brand, own in parts:
        name = own[1:] if key % 2 == 0 else own + "x"
        near = []
        for _, other, option in parts:
            if other == brand:
                d = float(edits(name, option))
                if name.startswith(option) or option.startswith(name):
                    d = min(d, 1 + abs(len(name) - len(option)) / 100)
                near.append((d, option))
        if min(near)[0] <= 3:
            want[key] = min(near)
    got = {r.p_partkey: (r.distance, r.best) for r in catalogue.QUERIES["nearest_name_all"](spark, str(tmp_path)).collect()}
    assert got == want and any(k % 20 for k in got)


def test_suffixes_of_every_page(spark, tmp_path):
    rng = random.Random(4)
    urls = ["https://h.org/" + "/".join(rng.choices(["a", "b", "c.html", "d"], k=rng.randint(1, 4))) + rng.choice(["", "?q=1", "#x"]) for _ in range(60)] + ["https://h.org/only/here"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls, 1)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    paths = {re.sub("^[a-z]+://[^/?#]*", "", re.sub("[?#].*", "", u)).lstrip("/") for u in urls}
    names = {re.search("([^/?#]+)([?#].*)?$", u)[1] for u in urls}
    want = {n: sum(p == n or p.endswith(f"/{n}") for p in paths) for n in names}
    got = {r.name: r.n for r in catalogue.QUERIES["suffix_match_all"](spark, str(tmp_path)).collect()}
    assert got == {n: c for n, c in want.items() if c} and got["here"] == 1
