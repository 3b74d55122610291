import random

from pyspark.sql import functions as F

from lectern.operators import chains
from lectern.operators import matching as J


def plain(to):
    """What each chain meets, step by step."""
    out = {}
    for path in to:
        seen, at = [path], to[path]
        while at is not None and at not in seen:
            seen.append(at)
            at = to.get(at)
        out[path] = seen[1:]
    return out


def test_chains_rings_and_trees(spark):
    random.seed(10)
    to = {f"c{k}": f"c{k - 1}" for k in range(1, 70)}  # c0 points nowhere
    to |= {f"r{k}": f"r{(k + 1) % 13}" for k in range(13)} | {"q0": "q1", "q1": "q0"}
    to |= {f"t{k}": random.choice([f"t{k - 1}", "r5", "c40", "q1", "gone"]) if k else "r2" for k in range(60)}
    met = plain(to)
    frame = spark.createDataFrame([(a, b, f"<{b}>") for a, b in to.items()], "path string, to string, name string")
    assert {r.path: r.steps for r in chains.lengths(frame).collect() if r.steps} == {p: len(m) for p, m in met.items() if m}
    found = chains.along(frame, ["name"], {"name": F.concat("near_name", "far_name")})
    assert {r.path: r.name for r in found.collect()} == {p: "".join(f"<{x}>" for x in m) for p, m in met.items() if m}


def test_a_chain_of_a_thousand_files(spark):
    rows = spark.createDataFrame([(2, "bbbbbbbbbbb")], "row int, id string")
    titles = spark.createDataFrame([("bbbbbbbbbbb", "A title of its own")], "id string, title string")
    files = [("/m/c0.m4a", {"comment": "https://youtu.be/bbbbbbbbbbb"}, None)] + [(f"/m/c{k}.m4a", {}, f"/m/c{k - 1}.m4a") for k in range(1, 1000)]
    found = {r.path: r for r in J.identify(spark.createDataFrame(files, "path string, tags map<string,string>, source string"), rows, titles).collect()}
    assert {r.id for r in found.values()} == {"bbbbbbbbbbb"}
    assert found["/m/c999.m4a"].how == "ссылка внутри файла" + "".join(f" (исходный файл c{k}.m4a)" for k in range(999))


def test_rounds_send_nothing_whole_through_the_driver(spark, monkeypatch):
    """No round of a chain is broadcast, however small what it has kept."""
    plans = []
    monkeypatch.setattr(chains, "keep_sized", lambda df, f=chains.keep_sized: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    frame = spark.createDataFrame([(k, k - 1) for k in range(1, 40)] + [(100, 101), (101, 100), (102, 100)], "path long, to long")
    found = chains.lengths(frame)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 42 and len(plans) > 5 and not any("Broadcast" in p for p in plans)
