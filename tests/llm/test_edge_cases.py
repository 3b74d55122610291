"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import queries

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (0, "One two three four five six seven eight nine ten eleven twelve.", "en", "s0", 1),
    (1, None, None, None, None),
    (2, "", "en", "s0", 0),
    (3, "   \n\t ", "en", "s0", 5),
    (4, "!!! 123 ???", "de", "s1", 11),
    (5, LONG, "en", "s1", len(LONG)),
    (6, "One two three four five six seven eight nine ten eleven twelve.", "en", "s0", 1),
    (6, "One two three four five six seven eight nine ten eleven twelve.", "en", "s0", 1),
    (7, "ééé ßß 中文 😀 \u0000 x", "fr", "s2", 9),
    (8, "a", None, "s2", 1),
    (None, "a text without an id", "en", "s2", 1),
    (9, "You are an idiot, a pathetic loser and worthless scum.", "en", "s2", 1),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for kind in ("odd", "empty", "clash"):
        base = tmp_path_factory.mktemp(kind)
        docs = spark.createDataFrame(ROWS, DOCS)
        labels = spark.createDataFrame([(0, 1, 0), (9, 0, 1), (9, 0, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
        bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "FIVE six"), (4, "FIVE six"), (None, "nothing here")], "item_id long, text string")
        html = "<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; t</h1><p>One<br>two.<p>Three.</article></body></html>"
        pages = spark.createDataFrame([(0, "https://a.example.net/en/1", html), (1, None, None), (2, "no scheme", ""), (2, "no scheme", ""), (3, "http://x.org/fr/a?b=1#c", "<"), (4, "http://NET/", LONG)], "page_id long, url string, html string")
        tables = {"documents": docs, "labels": labels, "benchmark": bench, "pages": pages}
        for name, df in tables.items():
            if kind == "empty":
                df = df.limit(0)
            if kind == "clash":
                for extra in ("key", "row", "part", "bundle", "shard", "words", "term", "score", "host", "label", "candidates", "size", "slot"):
                    if extra not in df.columns:
                        df = df.withColumn(extra, F.lit("x"))
            df.coalesce(2).write.parquet(f"{base}/{name}.parquet")
        made[kind] = str(base)
    return made


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, folders, name):
    """Each query gives its rows; empty tables give none; extra columns change nothing."""
    found = {kind: queries.QUERIES[name](spark, sf).collect() for kind, sf in folders.items()}
    pages = name.startswith(("op2_", "op9_"))
    assert found["empty"] == []
    if name.startswith("op6_"):
        ids = {r.doc_id for r in found["odd"]}
        assert ids == {r[0] for r in ROWS}
    elif name != "proximity_matches":  # which has a row for each match
        assert len(found["odd"]) == (6 if pages else len(ROWS))
    plain = lambda rows: sorted(map(repr, rows))
    if not name.startswith("op6_"):
        assert plain(found["odd"]) == plain(found["clash"])


def test_defined_results(spark, folders):
    sf = folders["odd"]
    by = lambda name, key="doc_id": {r[key]: r for r in queries.QUERIES[name](spark, sf).collect()}
    classes = by("op1_order_minhash")
    assert classes[6].class_id == 0 and classes[1].class_id == classes[2].class_id == 1 and classes[None].class_id is None
    pages = by("op2_mincut_html", "page_id")
    assert pages[0].text == "T & t\n\nOne two.\n\nThree." and pages[1].text == "" and pages[2].n_chars == 0
    prints = by("op3_imatch_fingerprints")
    assert prints[0].fingerprint == prints[6].fingerprint and prints[1].fingerprint == "" == prints[2].fingerprint
    counts = by("op5_transducer_token_counts")
    assert (counts[1].n_bytes, counts[1].n_tokens, counts[5].over_limit) == (0, 0, True)
    langs = by("op7_hyperdimensional_language")
    assert langs[1].lang_pred == langs[3].lang_pred == langs[4].lang_pred == "und" and langs[1].score == 0
    toxic = by("op8_grammar_toxicity")
    assert toxic[9].predicted == 1 and toxic[0].predicted == 0 and toxic[1].score == 0
    urls = by("op9_boosted_url_filter", "page_id")
    assert (urls[0].rule, urls[0].verdict) == ("example.net/en/", "allow") and urls[1].host == urls[2].host == "" and urls[4].rule == "net/" and urls[3].rule == "org/fr/"
    leaks = by("op10_positional_decontamination")
    assert (leaks[0].n_hit, leaks[0].n_items) == (10, 2) and leaks[1].n_words == 0 and not leaks[8].contaminated


def test_pipeline_stages(spark, folders):
    for kind, sf in folders.items():
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        kept = {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.schema.simpleString() == docs.schema.simpleString()
            rows = out.collect()
            kept[name] = sorted(str(r["doc_id"]) for r in rows)
            docs = spark.createDataFrame(rows, out.schema).coalesce(1)
        if kind == "empty":
            assert all(not k for k in kept.values())
        else:
            assert "9" not in kept["toxicity"] and len(kept["toxicity"]) == len(ROWS) - 1
            assert not {"1", "2", "3", "4"} & set(kept["language"])
            assert kept["near_duplicates"].count("0") == 1 and "6" not in kept["near_duplicates"]
            assert "0" not in kept["decontamination"] and "5" in kept["decontamination"]


def test_whole_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
