"""Source divergence, conversation trie and quality rules against plain versions and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import conversationtrie, divergence, quality, queries
from lectern.llm.common import table

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
key = lambda row: tuple((v is None, v) for v in row)


# 11. source divergence


def plain_divergence(rows, min_docs, top):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))
        seen[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in held:
        kept = sorted((t for t, n in held[lang].items() if n >= min_docs), key=lambda t: t.encode())
        groups = [s for lng, s in seen if lng == lang]
        share = {}
        whole = Counter()
        for s in groups:
            whole.update(seen[lang, s])
        for s, counts in [(None, whole), *((s, seen[lang, s]) for s in groups)]:
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            share[s] = {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}
        for s in groups:
            pairs = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(share[None][t] - share[s][t], t.encode()) for t in kept if seen[lang, s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -f, i) for i, (f, item) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("seats, cells, top", [(8, 1 << 18, 50), (4, 40, 3), (2, 1, 1)])
def test_divergence_equals_plain_version(spark, seats, cells, top):
    random.seed(3)
    words = [f"{a}{b}" for a in "abÉzñ" for b in "wxY"]
    rows = [(random.choice(["en", "", None, "x"]), random.choice(["s1", None, "", "ü", "s2", "s3", "s4"]), " ".join(random.choices(words, range(1, 16), k=random.randrange(12)))) for _ in range(300)]
    rows += [("lone", "one", "aw aw"), ("none", "a", ""), ("none", "b", None), ("en", "s1", "aw " * 5000), ("en", "s1", "aw " * 5000), ("x", "s1", "4-4 [\\] \x00")]
    docs = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "lang string, source string, text string, n int, term string, seat int")
    found = [tuple(r) for r in divergence.divergence(docs, min_docs=5, top=top, seats=seats, cells=cells).collect()]
    assert sorted(found) == sorted(plain_divergence(rows, 5, top))


def test_divergence_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence(none).count() == 0


@pytest.mark.parametrize("seats", [2, 4, 8, 10])
def test_tournament_meets_each_pair_once(seats):
    met = Counter(frozenset((s, divergence.partner(s, turn, seats))) for turn in range(seats - 1) for s in range(seats))
    assert len(met) == seats * (seats - 1) // 2 and set(met.values()) == {2}
    assert all(divergence.partner(divergence.partner(s, t, seats), t, seats) == s for s in range(seats) for t in range(seats - 1))


def test_shares_are_exact():
    import numpy as np

    for counts, total, terms in (([0, 1, 10**15], 10**15 + 1, 3), ([7], 7, 1), ([0, 0], 0, 2), ([3, 4, 8 * 10**15], 8 * 10**15 + 7, 3)):
        assert divergence.shares(np.array(counts), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]


# 12. conversation trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = tuple(turns.get(base, [])[:h] + ts[h:])
    members, children = defaultdict(set), defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].add(c)
            if d:
                children[ts[: d - 1]].add(ts[:d])

    def below(p):
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            leaves += not children[q]
            saved += (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
            todo += children[q]
        return leaves, saved

    out = []
    for p, cs in list(members.items()):
        leaves, saved = below(p)
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [conversationtrie.CHUNK, 2])
def test_trie_equals_plain_version(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversationtrie, "CHUNK", chunk)
    random.seed(4)
    rows = []
    for conv in [*range(-12, 40), 10**12, 10**12 + 1]:
        for turn in range(random.randrange(12)):
            rows.append((conv, turn, random.choice(["user", "assistant"]), random.choice(["a", "bé", ""])))
    rows += [(5, None, None, None), (5, None, "user", "x"), (6, 3, "user", "tie"), (6, 3, "user", "tie"), (6, 3, "assistant", "tie"), (None, 0, "user", "nobody's")]
    rows += [(c, t, "user", f"long {t % 3}") for c in (100, 101, 102, 300) for t in range(37 if c < 300 else 64)]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(10)]
    random.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, name int, part string")
    found = [tuple(r) for r in conversationtrie.trie(df).collect()]
    assert sorted(found, key=key) == sorted(plain_trie(rows), key=key)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversationtrie.trie(none).count() == 0


@pytest.mark.parametrize("name", ["op11_systolic_divergence", "op12_prefix_doubling_trie"])
def test_results_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, SF)
    assert found.columns == want.columns
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want.fetchall(), key=key)


# 13. quality


def plain_statistics(text):
    count = lambda keep: sum(map(keep, text))
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    lines = [x.strip(" ") for x in text.split("\n") if x.strip(" ")]
    blanks = count(lambda c: c in " \t\n\x0b\f\r")
    solid, letters = len(text) - blanks, count(str.isalpha)
    ratio = lambda a, b: a / b if b else 0.0
    symbols = count(lambda c: not (c.isalpha() or c.isdecimal() or c in " \t\n\x0b\f\r.,;:'’()-"))
    return {
        "characters": math.log1p(len(text)), "words": math.log1p(len(words)), "word_length": ratio(solid, len(words)), "letters": ratio(letters, solid), "capitals": ratio(count(str.isupper), letters),
        "digits": ratio(count(str.isdecimal), solid), "symbols": ratio(symbols, solid), "marks": ratio(count(lambda c: c in "!?"), len(words)), "bars": ratio(count(lambda c: c == "|"), len(words)),
        "distinct_words": ratio(len(set(words)), len(words)), "twins": ratio(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        "sentence_words": ratio(len(words), len(re.findall(r"[.!?…]+", text))), "line_words": ratio(len(words), len(lines)), "distinct_lines": ratio(len(set(lines)), len(lines)),
    }


def plain_score(ensemble, text):
    values = plain_statistics(text)
    return 1 / (1 + math.exp(-ensemble.intercept - sum(w for w, rule in ensemble.rules if rule.holds(values))))


def test_statistics_and_scores_equal_plain_version(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {-1: "", -2: "   \n\n ", -3: "!!! ??? || | a a a", -4: "ÀÉ é\t\r\n1 2 ٣ …", -5: "word " * 200_000}
    frame = spark.createDataFrame([(i, t, i, "x") for i, t in texts.items()] + [(-6, None, 0, "x")], "doc_id long, text string, words int, said string")
    for r in quality.with_statistics(frame.select("doc_id", "text")).collect():
        want = plain_statistics(texts.get(r.doc_id) or "")
        assert all(abs(r[name] - want[name]) < 1e-9 for name in quality.FEATURES), (r, want)
    ensemble = quality.fit(docs, table(spark, SF, "labels"))
    assert ensemble.rules
    found = quality.score_documents(frame, ensemble).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert abs(r.score - plain_score(ensemble, texts.get(r.doc_id) or "")) < 1e-9 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    scored = quality.score_documents(docs, quality.fit(docs, labels)).filter("held_out").join(labels, "doc_id")
    counts = {(r.quality, r.predicted): r["count"] for r in scored.groupBy("quality", "predicted").count().collect()}
    assert counts.get((0, 1), 0) <= 0.05 * counts[0, 0] and counts.get((1, 0), 0) <= 0.01 * counts[1, 1]


def test_quality_learns_from_no_held_out_row(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, turned) == quality.fit(docs, labels)


def test_quality_with_few_or_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a b c."), (2, None), (2, "other"), (None, "d"), (3, "")], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows, score in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0)], 0.0), ([(1, None), (None, 1)], 0.5), ([(1, 0), (1, 1)], 0.5)):
        found = quality.score_documents(docs, quality.fit(docs, labels(rows))).collect()
        assert len(found) == 5 and all(abs(r.score - score) < 1e-9 for r in found)
    assert all(r.held_out for r in found if r.doc_id is None)
    assert quality.score_documents(docs.limit(0), quality.Ensemble(0.0)).count() == 0
